"""DataFrame: named columns that share rows, order and labels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import DataFrame as SparkFrame
from pyspark.sql import functions as F

from pelagos import types as t
from pelagos.operators.groups import DataFrameGroupBy
from pelagos.operators.indexes import Index, MultiIndex, evaluated, index_of, level_names, ordered
from pelagos.operators.indexing import ILoc, taken
from pelagos.operators.series import Series, check_aggregations, labelled, labels_for, pandas_index, shown, stacked
from pelagos.operators.vector import Level, Vector, aggregate, arithmetic, bounds, to_array
from pelagos.plans.plan import Plan, fresh
from pelagos.sources.memory import as_array, plan_of, range_plan


class DataFrame:
    """``data``: a dict of arrays, lists or Series by name; ``index``: labels, by default positions. Frames don't change but for ``df[name] = column``."""

    def __init__(self, data: dict | None = None, index=None) -> None:
        if data is not None and not isinstance(data, dict):
            raise TypeError("expected a dict of columns")
        data = data or {}
        for name, column in data.items():
            if not isinstance(name, str):
                raise TypeError("column names are strings")
            if not isinstance(column, (Vector, np.ndarray, list, tuple, pd.Series)):
                raise TypeError(f"can't make a column of {type(column).__name__}")
        made = {n: as_array(c) for n, c in data.items() if not isinstance(c, Vector)}
        series = {n: c for n, c in data.items() if isinstance(c, Vector)}
        self._labels, self._multi = None, False
        if made:
            self._plan, columns = plan_of(list(made.values()))
            found = {n: (F.col(c), d) for n, c, (_, d) in zip(made, columns, made.values())}
        elif series:
            first = next(iter(series.values()))
            self._plan, found = first._plan, {}
            self._labels, self._multi = getattr(first, "_labels", None), getattr(first, "_multi", False)
        else:
            self._plan, found = range_plan(0, 0, 1)[0], {}
        for n, c in series.items():
            self._plan, (expr,) = self._plan.zipped(c._plan, [c._expr])
            found[n] = (expr, c.dtype)
        self._cols: dict[str, tuple[Column, np.dtype]] = {n: found[n] for n in data}
        if index is not None:
            if not data:
                index = index if isinstance(index, (Index, MultiIndex)) else Index(index)
                self._plan = index._plan
            self._plan, self._labels, self._multi = labels_for(self._plan, index)

    @classmethod
    def _of(cls, plan: Plan, cols: dict, labels: tuple[Level, ...] | None = None, multi: bool = False) -> DataFrame:
        out = object.__new__(cls)
        out._plan, out._cols, out._labels, out._multi = plan, dict(cols), labels, multi
        return out

    def _with(self, cols: dict, plan: Plan | None = None) -> DataFrame:
        return DataFrame._of(plan or self._plan, cols, self._labels, self._multi)

    @classmethod
    def from_spark(cls, sdf: SparkFrame, order_by: list[str] | None = None) -> DataFrame:
        """A frame over a Spark frame. ``order_by``: columns that define the order of rows; else it is that in which Spark reads them."""
        names = {c: fresh() for c in sdf.columns}
        kinds = {f.name: t.from_spark(f.dataType) for f in sdf.schema}
        own = sdf.select(*[sdf[f"`{c}`"].alias(n) for c, n in names.items()])
        if order_by:
            plan = Plan(own, tuple((names[c], True) for c in order_by), "key")
        else:
            at = fresh("at")
            plan = Plan(own.withColumn(at, F.monotonically_increasing_id()), ((at, True),), "key")
        return cls._of(plan, {c: (F.col(n), kinds[c]) for c, n in names.items()})

    # what it is

    @property
    def columns(self) -> Index:
        return self.keys()

    def keys(self) -> Index:
        return Index(np.array([n.encode() for n in self._cols]) if self._cols else np.array([], "S1"))

    @property
    def dtypes(self) -> Series:
        names = np.array([n.encode() for n in self._cols]) if self._cols else np.array([], "S1")
        return Series(np.array([(str(d) if d != t.STRING else "|S").encode() for _, d in self._cols.values()]) if self._cols else np.array([], "S1"), Index(names))

    @property
    def index(self):
        return index_of(self._plan, self._labels, self._multi)

    @property
    def empty(self) -> bool:
        return not self._cols and self._labels is None or self._plan.sdf.isEmpty()

    @property
    def values(self) -> list[np.ndarray]:
        """The columns' elements, in order. An action."""
        rows = ordered(self._plan, [e for e, _ in self._cols.values()]).toPandas()
        return [to_array(rows.iloc[:, i], d) for i, (_, d) in enumerate(self._cols.values())]

    @property
    def iloc(self) -> ILoc:
        return ILoc(self)

    def __len__(self) -> int:
        return self._plan.sdf.count()

    def __iter__(self) -> Iterator[str]:
        return iter(self._cols)

    def __contains__(self, name) -> bool:
        return name in self._cols

    def __repr__(self) -> str:
        return f"DataFrame({{{', '.join(f'{n}: {d}' for n, (_, d) in self._cols.items())}}})"

    def __str__(self) -> str:
        return shown(self)

    # selection

    def _column(self, name: str) -> Series:
        expr, dtype = self._cols[name]
        return Series._of(self._plan, expr, dtype, name, self._labels, self._multi)

    def __getitem__(self, item):
        if isinstance(item, str):
            return self._column(item)
        if isinstance(item, list):
            if not all(isinstance(n, str) for n in item):
                raise TypeError("column names are strings")
            return self._with({n: self._cols[n] for n in item})
        if isinstance(item, slice):
            return self._with(self._cols, self._plan.between(*bounds(item, self.__len__)))
        if isinstance(item, Vector):
            if item.dtype != t.BOOL:
                raise TypeError("expected booleans")
            plan, (mask,) = self._plan.zipped(item._plan, [item._expr])
            return self._with(self._cols, plan.where(mask))
        raise TypeError(f"can't select by {type(item).__name__}")

    def __setitem__(self, name: str, value) -> None:
        """An array goes in by position; a Series of the same rows as it is; any other is matched by label: its greatest element
        for a label, and what stands for missing where it has none."""
        if not isinstance(name, str):
            raise TypeError("column names are strings")
        if isinstance(value, (np.ndarray, list)):
            value = Index(value)
        if not isinstance(value, Vector):
            raise TypeError(f"can't make a column of {type(value).__name__}")
        if not self._cols and self._labels is None:
            self._plan, self._labels, self._multi = value._plan, getattr(value, "_labels", None), getattr(value, "_multi", False)
        if not isinstance(value, Series) or value._plan.rows is self._plan.rows:
            self._plan, (expr,) = self._plan.zipped(value._plan, [value._expr])
            self._cols[name] = (expr, value.dtype)
            return
        self._plan, expr = self._aligned(value)
        self._cols[name] = (expr, value.dtype)

    def _aligned(self, value: Series) -> tuple[Plan, Column]:
        theirs, levels = labelled(value._plan, value._labels)
        plan, own = labelled(self._plan, self._labels)
        if len(levels) != len(own):
            raise ValueError("the labels have different numbers of levels")
        keys, out = [fresh("k") for _ in levels], fresh("v")
        side = theirs.sdf.groupBy(*[x.expr.alias(k) for x, k in zip(levels, keys)]).agg(F.max(value._expr).alias(out))
        on = [x.expr.eqNullSafe(F.col(k)) for x, k in zip(own, keys)]
        sdf = plan.sdf.join(side, on, "left").drop(*keys)
        return Plan(sdf, plan.order, plan.parts, self._plan.rows, plan.position, plan.label), t.or_missing(F.col(out), value.dtype)

    def head(self, n: int = 5) -> DataFrame:
        return self._with(self._cols, self._plan.head(n))

    def tail(self, n: int = 5) -> DataFrame:
        return self._with(self._cols, self._plan.tail(n))

    def _iloc(self, positions: Vector) -> DataFrame:
        plan, levels = taken(self._plan, self._labels, positions)
        return DataFrame._of(plan, self._cols, levels, self._multi)

    # operators over all columns but strings

    def _numeric(self) -> dict[str, tuple[Column, np.dtype]]:
        return {n: c for n, c in self._cols.items() if t.takes_arithmetic(c[1])}

    def _compare(self, other, op: str) -> DataFrame:
        if not t.is_scalar(other) or isinstance(other, (str, bytes)):
            raise TypeError("frames are compared with numbers")
        return self._with({n: (getattr(self._column(n), f"__{op}__")(other)._expr, t.BOOL) for n in self._numeric()})

    def __lt__(self, other):
        return self._compare(other, "lt")

    def __le__(self, other):
        return self._compare(other, "le")

    def __eq__(self, other):
        return self._compare(other, "eq")

    def __ne__(self, other):
        return self._compare(other, "ne")

    def __ge__(self, other):
        return self._compare(other, "ge")

    def __gt__(self, other):
        return self._compare(other, "gt")

    __hash__ = None

    def _arithmetic(self, other, op: str) -> DataFrame:
        cols = self._numeric()
        if isinstance(other, list):
            if len(other) != len(cols):
                raise ValueError(f"expected {len(cols)} scalars")
            if not all(isinstance(x, (int, float, np.integer, np.floating)) for x in other):
                raise TypeError("expected numbers")
            each = other
        elif other is not None and t.is_scalar(other) and not isinstance(other, (str, bytes)):
            each = [other] * len(cols)
        else:
            raise TypeError("expected a scalar or a list of them")
        return self._with({n: (arithmetic(op, e, t.literal(x, d), d), d) for (n, (e, d)), x in zip(cols.items(), each)})

    def __add__(self, other):
        return self._arithmetic(other, "add")

    def __sub__(self, other):
        return self._arithmetic(other, "sub")

    def __mul__(self, other):
        return self._arithmetic(other, "mul")

    def __truediv__(self, other):
        return self._arithmetic(other, "div")

    def __pow__(self, other):
        return self._arithmetic(other, "pow")

    def isna(self) -> DataFrame:
        return self == None  # noqa: E711

    def notna(self) -> DataFrame:
        return self != None  # noqa: E711

    def dropna(self, subset: list[str] | None = None) -> DataFrame:
        """Rows in which no column of the subset (all) is missing."""
        met = F.lit(True)
        for n in self._subset(subset):
            met &= ~t.is_missing(*self._cols[n])
        return self._with(self._cols, self._plan.where(met))

    def fillna(self, value) -> DataFrame:
        """With missing elements as a scalar, or as that of a dict by column."""
        if isinstance(value, dict):
            if unknown := [n for n in value if n not in self._cols]:
                raise KeyError(f"no columns {unknown}")
        elif value is None or not t.is_scalar(value):
            raise TypeError("expected a scalar or a dict")
        else:
            text = isinstance(value, (str, bytes))
            value = {n: value for n, (_, d) in self._cols.items() if (d == t.STRING) == text and d != t.OBJECT}
        return self._with({n: (self._column(n)._filled(value[n]) if n in value else e, d) for n, (e, d) in self._cols.items()})

    def _subset(self, subset: list[str] | None) -> list[str]:
        if subset is None:
            return list(self._cols)
        if not isinstance(subset, list) or not all(isinstance(n, str) for n in subset):
            raise TypeError("expected a list of names")
        if not subset or any(n not in self._cols for n in subset):
            raise ValueError("expected names of columns")
        return subset

    # schema

    def astype(self, dtype) -> DataFrame:
        wanted = dict.fromkeys(self._cols, dtype) if not isinstance(dtype, dict) else dtype
        if unknown := [n for n in wanted if n not in self._cols]:
            raise KeyError(f"no columns {unknown}")
        return self._with({n: (lambda s: (s._expr, s.dtype))(self._column(n).astype(wanted[n])) if n in wanted else c for n, c in self._cols.items()})

    def rename(self, columns: dict[str, str]) -> DataFrame:
        """With new names; names that no column has are ignored."""
        if not isinstance(columns, dict):
            raise TypeError("expected a dict of names")
        return self._with({columns.get(n, n): c for n, c in self._cols.items()})

    def drop(self, columns) -> DataFrame:
        names = [columns] if isinstance(columns, str) else columns
        if not isinstance(names, list) or not all(isinstance(n, str) for n in names):
            raise TypeError("expected a name or a list of names")
        if unknown := [n for n in names if n not in self._cols]:
            raise KeyError(f"no columns {unknown}")
        return self._with({n: c for n, c in self._cols.items() if n not in names})

    def reset_index(self) -> DataFrame:
        """With the labels as the first columns and positions as labels."""
        plan, levels = labelled(self._plan, self._labels)
        cols = {n: (x.expr, x.dtype) for n, x in zip(level_names(levels), levels)}
        return DataFrame._of(plan.root(), {**cols, **self._cols})

    def set_index(self, keys) -> DataFrame:
        """With one column as labels, or a list of them as several; the old labels go."""
        names = [keys] if isinstance(keys, str) else keys
        if not isinstance(names, list) or not all(isinstance(n, str) for n in names):
            raise TypeError("expected a name or a list of names")
        levels = tuple(Level(n, *self._cols[n]) for n in names)
        return DataFrame._of(self._plan, {n: c for n, c in self._cols.items() if n not in names}, levels, not isinstance(keys, str))

    # sorting

    def sort_values(self, by, ascending=True) -> DataFrame:
        """By one column or level, or by a list of them, each rising or falling; ties keep their order."""
        names = [by] if isinstance(by, str) else by
        if not isinstance(names, list) or not names or not all(isinstance(n, str) for n in names):
            raise TypeError("expected a name or a list of names")
        up = ascending if isinstance(ascending, list) else [ascending] * len(names)
        if len(up) != len(names):
            raise ValueError("as many directions as names are needed")
        return self._with(self._cols, self._plan.sorted_by([(self._named(n), u) for n, u in zip(names, up)]))

    def _named(self, name: str) -> Column:
        if name in self._cols:
            return self._cols[name][0]
        for n, x in zip(level_names(self._labels) if self._labels else [], self._labels or ()):
            if n == name:
                return x.expr
        raise KeyError(name)

    def sort_index(self, ascending: bool = True) -> DataFrame:
        """By the labels, level by level."""
        plan, levels = labelled(self._plan, self._labels)
        return self._with(self._cols, plan.sorted_by([(x.expr, ascending) for x in levels])) if self._labels else DataFrame._of(plan.sorted_by([(x.expr, ascending) for x in levels]), self._cols, levels)

    # aggregates

    def _aggregate(self, how: str) -> Series:
        cols = self._numeric()
        if not cols:
            return Series(np.array([], np.float64), Index(np.array([], "S1")))
        found = {n: aggregate(how, *c) for n, c in cols.items()}
        kinds = {k for _, k in found.values()}
        kind = kinds.pop() if len(kinds) == 1 else t.FLOAT  # mixed types: float64, after aggregation
        names = {n: fresh("a") for n in found}
        row = self._plan.sdf.agg(*[e.alias(names[n]) for n, (e, _) in found.items()])
        return stacked([row], [(n, [F.col(names[n])]) for n in found], [kind], [None])[0]

    def min(self) -> Series:
        return self._aggregate("min")

    def max(self) -> Series:
        return self._aggregate("max")

    def sum(self) -> Series:
        return self._aggregate("sum")

    def prod(self) -> Series:
        return self._aggregate("prod")

    def count(self) -> Series:
        return self._aggregate("count")

    def mean(self) -> Series:
        return self._aggregate("mean")

    def var(self) -> Series:
        return self._aggregate("var")

    def std(self) -> Series:
        return self._aggregate("std")

    def agg(self, aggregations: list[str]) -> DataFrame:
        """A row for each aggregate and a column for each that isn't of strings, in float64; one job makes them all."""
        check_aggregations(aggregations)
        cols = self._numeric()
        if not cols:
            raise ValueError("no columns to aggregate")
        names = {(a, n): fresh("a") for a in aggregations for n in cols}
        row = self._plan.sdf.agg(*[aggregate(a, *cols[n])[0].cast("double").alias(x) for (a, n), x in names.items()])
        series = stacked([row], [(a, [F.col(names[a, n]) for n in cols]) for a in aggregations], [t.FLOAT] * len(cols), list(cols))
        return DataFrame._of(series[0]._plan, {n: (s._expr, s.dtype) for n, s in zip(cols, series)}, series[0]._labels)

    def groupby(self, by) -> DataFrameGroupBy:
        names = [by] if isinstance(by, str) else by
        if not isinstance(names, list) or not all(isinstance(n, str) for n in names):
            raise TypeError("expected a name or a list of names")
        for n in names:
            self._cols[n]
        if len(set(names)) == len(self._cols):
            raise ValueError("no columns are left to aggregate")
        return DataFrameGroupBy(self, names)

    def drop_duplicates(self, subset: list[str] | None = None, keep: str = "min") -> DataFrame:
        """One row for each combination of the subset's columns (all). ``keep`` merges the other columns and the labels, each on its own:
        min, max, + or *."""
        merge = {"min": F.min, "max": F.max, "+": F.sum, "*": F.product}
        if keep not in merge:
            raise ValueError("keep is min, max, + or *")
        names = self._subset(subset)
        keys = {n: fresh("k") for n in names}
        rest = {n: fresh("v") for n in self._cols if n not in keys}
        labels = [fresh("i") for _ in self._labels or ["default"]]

        def merged(expr: Column, dtype: np.dtype, how: str) -> Column:
            if how in ("+", "*") and not t.is_numeric(dtype):
                raise TypeError(f"{how} of {dtype}")
            return merge[how](expr) if dtype == t.OBJECT else t.cast(merge[how](expr), dtype)

        sums = [merged(*self._cols[n], keep).alias(v) for n, v in rest.items()]
        of_labels = "min" if subset is None else keep  # the least label of rows that are alike in all columns
        for x, v in zip(self._labels or (), labels):
            sums.append(merged(x.expr, x.dtype, of_labels if t.is_numeric(x.dtype) or of_labels == "max" else "min").alias(v))
        order = tuple((c, True) for c in (*(labels if self._labels else ()), *keys.values()))

        def step(plan: Plan) -> Plan:
            default = [merged(F.col(plan.label), t.LONG, of_labels).alias(labels[0])] if plan.label else []
            sdf = plan.sdf.groupBy(*[self._cols[n][0].alias(k) for n, k in keys.items()]).agg(*sums, *default) if sums or default else plan.sdf.select(*[self._cols[n][0].alias(k) for n, k in keys.items()]).distinct()
            return Plan(sdf, order, "few" if plan.parts == "few" else "key", label=labels[0] if plan.label else None)

        cols = {n: (F.col(keys[n] if n in keys else rest[n]), d) for n, (_, d) in self._cols.items()}
        levels = tuple(x._replace(expr=F.col(v)) for x, v in zip(self._labels, labels)) if self._labels else None
        return DataFrame._of(self._plan._made(step), cols, levels, self._multi)

    # joins

    def merge(self, other: DataFrame, how: str = "inner", on=None, suffixes: tuple[str, str] = ("_x", "_y"), algorithm: str = "merge", is_on_sorted: bool = False, is_on_unique: bool = True) -> DataFrame:
        from pelagos.operators.joins import merged

        return merged(self, other, how, on, suffixes, algorithm)

    def join(self, other: DataFrame, on=None, how: str = "left", lsuffix: str | None = None, rsuffix: str | None = None, algorithm: str = "merge", is_on_sorted: bool = True, is_on_unique: bool = True) -> DataFrame:
        from pelagos.operators.joins import merged

        if lsuffix is None and rsuffix is None and set(self._cols) & set(other._cols) - set([on] if isinstance(on, str) else on or []):
            raise ValueError("columns clash and no suffix is given")
        return merged(self, other, how, on, (lsuffix or "", rsuffix or ""), algorithm)

    # conversions

    def evaluate(self, verbose: bool = False, **_) -> DataFrame:
        """The same frame with its rows computed and kept by Spark."""
        return self._with(self._cols, evaluated(self._plan, verbose))

    def to_spark(self, include_index: bool = False, sort: bool = False) -> SparkFrame:
        """A Spark frame of the columns; ``sort``: in the frame's order."""
        plan, exprs = self._plan, {n: e for n, (e, _) in self._cols.items()}
        if include_index:
            plan, levels = labelled(plan, self._labels)
            exprs = {**{n: x.expr for n, x in zip(level_names(levels), levels)}, **exprs}
        named = [e.alias(n) for n, e in exprs.items()]
        return ordered(plan, list(exprs.values())).toDF(*exprs) if sort else plan.sdf.select(*named)

    def explain(self) -> None:
        self.to_spark().explain("formatted")

    @classmethod
    def from_pandas(cls, frame: pd.DataFrame) -> DataFrame:
        return cls({str(n): frame.iloc[:, i].to_numpy() for i, n in enumerate(frame.columns)}, Index.from_pandas(frame.index))

    def to_pandas(self) -> pd.DataFrame:
        plan, levels = labelled(self._plan, self._labels)
        rows = ordered(plan, [*[e for e, _ in self._cols.values()], *[x.expr for x in levels]]).toPandas()
        k = len(self._cols)
        data = {n: to_array(rows.iloc[:, i], d) for i, (n, (_, d)) in enumerate(self._cols.items())}
        return pd.DataFrame(data, index=pandas_index(rows.iloc[:, k:], levels, self._multi))

    def to_csv(self, filepath: str, sep: str = ",", header: bool = True, index: bool = True, single_file: bool = False) -> None:
        from pelagos.sources.files import to_csv

        to_csv(self, filepath, sep, header, index, single_file)

    def to_parquet(self, path: str, index: bool = False, mode: str = "error") -> None:
        self.to_spark(include_index=index).write.mode(mode).parquet(path)

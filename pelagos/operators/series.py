"""Series: one column with labels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import DataFrame as SparkFrame
from pyspark.sql import functions as F

from pelagos import types as t
from pelagos.operators.indexes import Index, MultiIndex, evaluated, index_of, level_names, ordered
from pelagos.operators.indexing import ILoc, taken
from pelagos.operators.strings import StringMethods
from pelagos.operators.vector import AGGREGATES, Level, Vector, aggregate, bounds, to_array
from pelagos.plans.plan import Plan, fresh
from pelagos.sources.memory import as_array, plan_of


class Series(Vector):
    """``data``: an array, a list, or another Series or Index; ``index``: labels, by default positions."""

    def __init__(self, data=None, index=None, dtype=None, name: str | None = None) -> None:
        if data is None:
            data = []
        if isinstance(data, Vector):
            kind = data.dtype if dtype is None else t.dtype_of(dtype)
            self._plan, self._expr, self.dtype = data._plan, data._expr if kind == data.dtype else t.cast(data._expr, kind), kind
            self._labels, self._multi = getattr(data, "_labels", None), getattr(data, "_multi", False)
        else:
            array, self.dtype = as_array(data, dtype)
            self._plan, (column,) = plan_of([(array, self.dtype)])
            self._expr, self._labels, self._multi = F.col(column), None, False
        self.name = name if name is not None else getattr(data, "name", None) if isinstance(data, Vector) else None
        if index is not None:
            self._plan, self._labels, self._multi = labels_for(self._plan, index)

    @classmethod
    def _of(cls, plan: Plan, expr: Column, dtype: np.dtype, name: str | None, labels: tuple[Level, ...] | None, multi: bool = False) -> Series:
        out = object.__new__(cls)
        out._plan, out._expr, out.dtype, out.name, out._labels, out._multi = plan, expr, dtype, name, labels, multi
        return out

    def _like(self, plan: Plan, expr: Column, dtype: np.dtype) -> Series:
        return Series._of(plan, expr, dtype, self.name, self._labels, self._multi)

    @property
    def index(self):
        return index_of(self._plan, self._labels, self._multi)

    @property
    def str(self) -> StringMethods:
        return StringMethods(self)

    @property
    def iloc(self) -> ILoc:
        return ILoc(self)

    def __invert__(self) -> Series:
        if self.dtype != t.BOOL:
            raise TypeError("~ is for booleans")
        return self._like(self._plan, ~self._expr, t.BOOL)

    def __getitem__(self, item) -> Series:
        if isinstance(item, slice):
            return self._like(self._plan.between(*bounds(item, self.__len__)), self._expr, self.dtype)
        if isinstance(item, Vector):
            if item.dtype != t.BOOL:
                raise TypeError("expected booleans")
            plan, (mask,) = self._plan.zipped(item._plan, [item._expr])
            return self._like(plan.where(mask), self._expr, self.dtype)
        raise TypeError(f"can't select by {type(item).__name__}")

    def head(self, n: int = 5) -> Series:
        return self._like(self._plan.head(n), self._expr, self.dtype)

    def tail(self, n: int = 5) -> Series:
        return self._like(self._plan.tail(n), self._expr, self.dtype)

    def astype(self, dtype) -> Series:
        kind = t.dtype_of(dtype)
        if t.STRING in (kind, self.dtype):
            raise TypeError("strings can't be cast")
        return self._like(self._plan, t.cast(self._expr, kind), kind)

    def fillna(self, value) -> Series:
        return self._like(self._plan, self._filled(value), self.dtype)

    def agg(self, aggregations: list[str]) -> Series:
        """Several aggregates in one job, in float64, labelled by their names."""
        check_aggregations(aggregations)
        found = [aggregate(a, self._expr, self.dtype)[0].cast("double").alias(f"a{i}") for i, a in enumerate(aggregations)]
        row = self._plan.sdf.agg(*found)
        return stacked([row], [(a, [F.col(f"a{i}")]) for i, a in enumerate(aggregations)], [t.FLOAT], [self.name])[0]

    def unique(self) -> Series:
        """Distinct elements, in no order, without labels of their own."""
        name = fresh("u")
        return Series._of(Plan(self._plan.sdf.select(self._expr.alias(name)).distinct(), ((name, True),), "few" if self._plan.parts == "few" else "key"), F.col(name), self.dtype, self.name, None)

    def apply(self, func, mapping: dict | None = None, new_dtype=None, **kwargs) -> Series:
        """A function of the library (``pelagos.sqrt``), one from Column to Column, one made by ``raw``, or SQL text.

        In text, ``{self}`` is the series and other names in braces are from ``mapping``: scalars or series.
        """
        from pelagos.functions import udf

        return udf.applied(self, func, mapping or {}, new_dtype, kwargs)

    def evaluate(self, verbose: bool = False, **_) -> Series:
        return self._like(evaluated(self._plan, verbose), self._expr, self.dtype)

    def to_spark(self, name: str | None = None, include_index: bool = False) -> SparkFrame:
        own = self._expr.alias(name or self.name or "value")
        if not include_index:
            return self._plan.sdf.select(own)
        plan, levels = labelled(self._plan, self._labels)
        return plan.sdf.select(*[x.expr.alias(n) for x, n in zip(levels, level_names(levels))], own)

    @classmethod
    def from_pandas(cls, series: pd.Series) -> Series:
        return cls(series.to_numpy(), Index.from_pandas(series.index), name=series.name)

    def to_pandas(self) -> pd.Series:
        plan, levels = labelled(self._plan, self._labels)
        rows = ordered(plan, [self._expr, *[x.expr for x in levels]]).toPandas()
        return pd.Series(to_array(rows["v0"], self.dtype), pandas_index(rows.iloc[:, 1:], levels, self._multi), name=self.name)

    def __repr__(self) -> str:
        return f"Series(name={self.name}, dtype={self.dtype})"

    def __str__(self) -> str:
        return shown(self)

    def _take(self, plan: Plan, labels, missing: bool) -> Series:
        expr = t.or_missing(self._expr, self.dtype) if missing else self._expr
        return Series._of(plan, expr, self.dtype, self.name, labels, self._multi)

    def _iloc(self, positions: Vector, missing: bool = False) -> Series:
        plan, levels = taken(self._plan, self._labels, positions, missing)
        return self._take(plan, levels, missing)


def shown(x) -> str:
    """The first and last rows."""
    n = len(x)
    return str(x.to_pandas()) if n <= 50 else f"{x.head(20).to_pandas()}\n...\n{x.tail(20).to_pandas()}"


def check_aggregations(names: list[str]) -> None:
    if not isinstance(names, (list, tuple)) or not all(isinstance(x, str) for x in names):
        raise TypeError("expected a list of names")
    if bad := [x for x in names if x not in AGGREGATES]:
        raise ValueError(f"unknown aggregations {bad}")


def stacked(frames: list[SparkFrame], rows: list[tuple[str, list[Column]]], dtypes: list[np.dtype], names: list[str | None]) -> list[Series]:
    """Series over the values of one row of a Spark frame, laid out as labelled rows. One job makes them all."""
    (sdf,) = frames
    at, label, columns = fresh("pos"), fresh("i"), [fresh("v") for _ in dtypes]
    structs = [F.struct(F.lit(i).cast("bigint").alias(at), F.lit(name).alias(label), *[t.cast(v, d).alias(c) for v, c, d in zip(values, columns, dtypes)]) for i, (name, values) in enumerate(rows)]
    plan = Plan(sdf.select(F.inline(F.array(*structs))), ((at, True),), "few", None, at)
    return [Series._of(plan, F.col(c), d, n, (Level(None, F.col(label), t.STRING),)) for c, d, n in zip(columns, dtypes, names)]


def labels_for(plan: Plan, index) -> tuple[Plan, tuple[Level, ...], bool]:
    """Labels for the rows of a plan, matched by position."""
    if not isinstance(index, (Index, MultiIndex)):
        index = Index(index)
    levels = index._levels()
    plan, exprs = plan.zipped(index._plan, [x.expr for x in levels])
    return plan, tuple(x._replace(expr=e) for x, e in zip(levels, exprs)), isinstance(index, MultiIndex)


def labelled(plan: Plan, labels: tuple[Level, ...] | None) -> tuple[Plan, tuple[Level, ...]]:
    if labels is not None:
        return plan, labels
    plan = plan.labelled()
    return plan, (Level(None, F.col(plan.label), t.LONG),)


def pandas_index(columns: pd.DataFrame, levels: tuple[Level, ...], multi: bool) -> pd.Index:
    arrays = [to_array(columns.iloc[:, i], x.dtype) for i, x in enumerate(levels)]
    if multi:
        return pd.MultiIndex.from_arrays(arrays, names=[x.name for x in levels])
    return pd.Index(arrays[0], name=levels[0].name)

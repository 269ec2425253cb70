"""Labels: Index, RangeIndex and MultiIndex."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import DataFrame as SparkFrame
from pyspark.sql import functions as F

from pelagos import types as t
from pelagos.operators.vector import Level, Vector, bounds, to_array
from pelagos.plans.plan import Plan
from pelagos.sources.memory import as_array, plan_of, range_plan


class Index(Vector):
    """One column of labels. ``data``: an array, a list, or another Index or Series."""

    def __init__(self, data, dtype=None, name: str | None = None) -> None:
        if isinstance(data, Vector):
            kind = data.dtype if dtype is None else t.dtype_of(dtype)
            self._plan, self._expr, self.dtype = data._plan, data._expr if kind == data.dtype else t.cast(data._expr, kind), kind
            name = data.name if name is None else name
        else:
            array, self.dtype = as_array(data, dtype)
            self._plan, (column,) = plan_of([(array, self.dtype)])
            self._expr = F.col(column)
        self.name = name

    @classmethod
    def _of(cls, plan: Plan, expr: Column, dtype: np.dtype, name: str | None) -> Index:
        out = object.__new__(Index)
        out._plan, out._expr, out.dtype, out.name = plan, expr, dtype, name
        return out

    def _like(self, plan: Plan, expr: Column, dtype: np.dtype) -> Index:
        return Index._of(plan, expr, dtype, self.name)

    def _levels(self) -> tuple[Level, ...]:
        return (Level(self.name, self._expr, self.dtype),)

    def __getitem__(self, item):
        if isinstance(item, slice):
            return self._like(self._plan.between(*bounds(item, self.__len__)), self._expr, self.dtype)
        if isinstance(item, Vector):
            if item.dtype != t.BOOL:
                raise TypeError("expected booleans")
            plan, (mask,) = self._plan.zipped(item._plan, [item._expr])
            return self._like(plan.where(mask), self._expr, self.dtype)
        raise TypeError(f"can't select by {type(item).__name__}")

    def head(self, n: int = 5) -> Index:
        return self._like(self._plan.head(n), self._expr, self.dtype)

    def tail(self, n: int = 5) -> Index:
        return self._like(self._plan.tail(n), self._expr, self.dtype)

    def astype(self, dtype) -> Index:
        kind = t.dtype_of(dtype)
        if t.STRING in (kind, self.dtype):
            raise TypeError("strings can't be cast")
        return self._like(self._plan, t.cast(self._expr, kind), kind)

    def fillna(self, value) -> Index:
        return self._like(self._plan, self._filled(value), self.dtype)

    def evaluate(self, verbose: bool = False, **_) -> Index:
        plan = evaluated(self._plan, verbose)
        return self._like(plan, self._expr, self.dtype)

    def to_spark(self, name: str | None = None) -> SparkFrame:
        return self._plan.sdf.select(self._expr.alias(name or self.name or "index"))

    @classmethod
    def from_pandas(cls, index: pd.Index):
        if isinstance(index, pd.MultiIndex):
            return MultiIndex.from_pandas(index)
        if isinstance(index, pd.RangeIndex):
            return RangeIndex(index.start, index.stop, index.step) if index.step > 0 else Index(index.to_numpy(), name=index.name)
        return Index(index.to_numpy(), name=index.name)

    def to_pandas(self) -> pd.Index:
        return pd.Index(self.values, name=self.name)

    def __repr__(self) -> str:
        return f"{type(self).__name__}(name={self.name}, dtype={self.dtype})"


class RangeIndex(Index):
    """Labels from ``start`` (0) to below ``stop`` by ``step`` (1). One argument is the stop."""

    def __init__(self, start: int | None = None, stop: int | None = None, step: int | None = None, name: str | None = None) -> None:
        if start is None and stop is None:
            raise ValueError("start or stop is needed")
        if stop is None:
            start, stop = 0, start
        self.start, self.stop, self.step = (0 if start is None else start), stop, 1 if step is None else step
        for x in (self.start, self.stop, self.step):
            if not isinstance(x, (int, np.integer)) or isinstance(x, bool):
                raise TypeError("ranges are of integers")
        if self.step < 1:
            raise ValueError("the step must be positive")
        self._plan, column = range_plan(int(self.start), int(self.stop), int(self.step))
        self._expr, self.dtype, self.name = F.col(column), t.LONG, name

    def _compare(self, other, op: str):
        if other is not None and (not isinstance(other, (int, np.integer)) or isinstance(other, bool)):
            raise TypeError("a range is compared with integers")
        if other is None:  # no label of a range is missing
            return self._like(self._plan, F.lit(op == "ne"), t.BOOL)
        return super()._compare(other, op)

    def __len__(self) -> int:
        return len(range(self.start, self.stop, self.step))


class MultiIndex:
    """Several columns of labels, side by side."""

    def __init__(self, data: list, names: list[str | None] | None = None) -> None:
        if not isinstance(data, (list, tuple)) or not data:
            raise TypeError("expected a list of columns")
        names = list(names) if names is not None else [getattr(d, "name", None) for d in data]
        if len(names) != len(data):
            raise ValueError("as many names as columns are needed")
        if all(isinstance(d, Vector) for d in data):
            plan, levels = data[0]._plan, []
            for d, n in zip(data, names):
                plan, (expr,) = plan.zipped(d._plan, [d._expr])
                levels.append(Level(n, expr, d.dtype))
        else:
            arrays = [(d.values, d.dtype) if isinstance(d, Vector) else as_array(d) for d in data]
            plan, columns = plan_of(arrays)
            levels = [Level(n, F.col(c), k) for n, c, (_, k) in zip(names, columns, arrays)]
        self._plan, self._all = plan, tuple(levels)

    @classmethod
    def _of(cls, plan: Plan, levels: tuple[Level, ...]) -> MultiIndex:
        out = object.__new__(cls)
        out._plan, out._all = plan, tuple(levels)
        return out

    def _levels(self) -> tuple[Level, ...]:
        return self._all

    @property
    def names(self) -> list[str | None]:
        return [x.name for x in self._all]

    @names.setter
    def names(self, names: list[str | None]) -> None:
        if len(names) != len(self._all):
            raise ValueError("as many names as columns are needed")
        self._all = tuple(x._replace(name=n) for x, n in zip(self._all, names))

    @property
    def dtypes(self) -> list[np.dtype]:
        return [x.dtype for x in self._all]

    @property
    def values(self) -> list[Index]:
        return [Index._of(self._plan, x.expr, x.dtype, x.name) for x in self._all]

    @property
    def empty(self) -> bool:
        return self._plan.sdf.isEmpty()

    def __len__(self) -> int:
        return self._plan.sdf.count()

    def __getitem__(self, item) -> MultiIndex:
        if isinstance(item, slice):
            return MultiIndex._of(self._plan.between(*bounds(item, self.__len__)), self._all)
        if isinstance(item, Vector) and item.dtype == t.BOOL:
            plan, (mask,) = self._plan.zipped(item._plan, [item._expr])
            return MultiIndex._of(plan.where(mask), self._all)
        raise TypeError(f"can't select by {type(item).__name__}")

    def head(self, n: int = 5) -> MultiIndex:
        return MultiIndex._of(self._plan.head(n), self._all)

    def tail(self, n: int = 5) -> MultiIndex:
        return MultiIndex._of(self._plan.tail(n), self._all)

    def dropna(self) -> MultiIndex:
        met = F.lit(True)
        for x in self._all:
            met &= ~t.is_missing(x.expr, x.dtype)
        return MultiIndex._of(self._plan.where(met), self._all)

    def evaluate(self, verbose: bool = False, **_) -> MultiIndex:
        return MultiIndex._of(evaluated(self._plan, verbose), self._all)

    def to_spark(self) -> SparkFrame:
        return self._plan.sdf.select(*[x.expr.alias(n) for x, n in zip(self._all, level_names(self._all))])

    @classmethod
    def from_pandas(cls, index: pd.MultiIndex) -> MultiIndex:
        return cls([index.get_level_values(i).to_numpy() for i in range(index.nlevels)], list(index.names))

    def to_pandas(self) -> pd.MultiIndex:
        rows = ordered(self._plan, [x.expr for x in self._all]).toPandas()
        return pd.MultiIndex.from_arrays([to_array(rows.iloc[:, i], x.dtype) for i, x in enumerate(self._all)], names=self.names)

    def __repr__(self) -> str:
        return f"MultiIndex(names={self.names}, dtypes={[str(d) for d in self.dtypes]})"


def level_names(levels: tuple[Level, ...]) -> list[str]:
    """The levels' names, with ``index`` or ``level_i`` for those that have none."""
    if len(levels) == 1:
        return [levels[0].name or "index"]
    return [x.name or f"level_{i}" for i, x in enumerate(levels)]


def index_of(plan: Plan, levels: tuple[Level, ...] | None, multi: bool):
    if levels is None:
        plan = plan.labelled()
        return Index._of(plan, F.col(plan.label), t.LONG, None)
    if multi:
        return MultiIndex._of(plan, levels)
    return Index._of(plan, levels[0].expr, levels[0].dtype, levels[0].name)


def ordered(plan: Plan, exprs: list[Column]) -> SparkFrame:
    """The expressions as columns v0, v1 and so on, sorted by the plan's order."""
    names = [f"v{i}" for i in range(len(exprs))]
    rows = plan.sdf.select(*[e.alias(n) for e, n in zip(exprs, names)], *[F.col(c) for c, _ in plan.order])
    return rows.orderBy(*plan.sort_keys()).select(*names) if plan.order else rows.select(*names)


def evaluated(plan: Plan, verbose: bool) -> Plan:
    """The plan with its rows computed and kept by Spark."""
    if verbose:
        plan.sdf.explain("formatted")
    kept = plan.labelled()
    sdf = kept.sdf.persist()
    sdf.count()
    return Plan(sdf, kept.order, kept.parts, plan.rows, kept.position, kept.label)

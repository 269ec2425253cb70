"""Aggregates by key."""

from __future__ import annotations

from pyspark.sql import functions as F

from pelagos import types as t
from pelagos.operators.vector import Level, aggregate
from pelagos.plans.plan import Plan, fresh


class DataFrameGroupBy:
    """What ``DataFrame.groupby`` gives: each aggregate is one partial and one final hash aggregation over all columns.

    Results are labelled by the keys. A group's variance is that of a sample; of one row it is 0.
    """

    def __init__(self, frame, by: list[str]) -> None:
        self._frame, self._by = frame, by

    def _aggregate(self, how: str):
        from pelagos.operators.frame import DataFrame

        frame, keys, values = self._frame, [], {}
        for name in self._by:
            expr, dtype = frame._cols[name]
            keys.append((fresh("k"), name, expr, dtype))
        made = []
        for name, (expr, dtype) in frame._cols.items():
            if name in self._by:
                continue
            if how == "size":
                found, kind = F.count(F.lit(1)), t.LONG
            else:
                found, kind = aggregate(how, expr, dtype)
            if how in ("var", "std"):
                found = F.when(F.count(expr) < 2, F.lit(0.0)).otherwise(found)
            column = fresh("v")
            made.append(found.alias(column))
            values[name] = (F.col(column), kind)
        sdf = frame._plan.sdf.groupBy(*[e.alias(k) for k, _, e, _ in keys]).agg(*made)
        levels = tuple(Level(name, F.col(k), dtype) for k, name, _, dtype in keys)
        return DataFrame._of(Plan(sdf, tuple((k, True) for k, *_ in keys), "few" if frame._plan.parts == "few" else "key"), values, levels, len(keys) > 1)

    def min(self):
        return self._aggregate("min")

    def max(self):
        return self._aggregate("max")

    def sum(self):
        return self._aggregate("sum")

    def prod(self):
        return self._aggregate("prod")

    def mean(self):
        return self._aggregate("mean")

    def var(self):
        return self._aggregate("var")

    def std(self):
        return self._aggregate("std")

    def size(self):
        """The number of rows of each group, in every column."""
        return self._aggregate("size")

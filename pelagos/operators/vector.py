"""What series and indexes share: one expression over a plan."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column
from pyspark.sql import DataFrame as SparkFrame
from pyspark.sql import functions as F

from pelagos import types as t
from pelagos.plans.plan import Plan

AGGREGATES = ("min", "max", "sum", "prod", "count", "mean", "var", "std")


class Level(NamedTuple):
    """One column of labels."""

    name: str | None
    expr: Column
    dtype: np.dtype


def aggregate(how: str, expr: Column, dtype: np.dtype) -> tuple[Column, np.dtype]:
    """An aggregate over all rows and its dtype. Values that stand for missing count like any others."""
    if how == "count":
        return F.count(F.lit(1)), t.LONG
    if how in ("min", "max"):
        return getattr(F, how)(expr), dtype
    if dtype == t.STRING or dtype == t.OBJECT:
        raise TypeError(f"{how} of {dtype}")
    number = expr.cast("int") if dtype == t.BOOL else expr
    if how == "sum":
        return t.cast(F.coalesce(F.sum(number), F.lit(0)), dtype), dtype
    if how == "prod":
        return t.cast(F.coalesce(F.product(number), F.lit(1)), dtype), dtype
    if how not in AGGREGATES:
        raise ValueError(f"unknown aggregation {how}")
    wide, nan = number.cast("double"), F.lit(float("nan"))
    found = {"mean": F.avg, "var": F.var_samp, "std": F.stddev_samp}[how](wide)
    return F.coalesce(found, nan), t.FLOAT


class Scalar:
    """A value that isn't computed yet."""

    def __init__(self, sdf: SparkFrame, dtype: np.dtype, name: str = "value") -> None:
        self._sdf, self.dtype, self.name = sdf, dtype, name

    def to_spark(self) -> SparkFrame:
        return self._sdf

    def evaluate(self, verbose: bool = False, **_):
        if verbose:
            self._sdf.explain()
        row = self._sdf.first()
        if row is None:
            raise IndexError("no such position")
        value = row[0]
        return value if value is None or self.dtype in (t.STRING, t.OBJECT) else self.dtype.type(value)

    def __repr__(self) -> str:
        return f"Scalar(dtype={self.dtype})"


class Vector:
    """One-dimensional data. Subclasses say what a result of the same rows is: ``_like``."""

    _plan: Plan
    _expr: Column
    dtype: np.dtype
    name: str | None

    def _like(self, plan: Plan, expr: Column, dtype: np.dtype):
        raise NotImplementedError

    # comparisons

    def _compare(self, other, op: str):
        if not t.is_scalar(other):
            raise TypeError("comparisons are with scalars only")
        if other is None:
            if op not in ("eq", "ne"):
                raise TypeError("None is compared by == and != only")
            found = t.is_missing(self._expr, self.dtype)
            return self._like(self._plan, found if op == "eq" else ~found, t.BOOL)
        return self._like(self._plan, getattr(self._expr, f"__{op}__")(t.literal(other, self.dtype)), t.BOOL)

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

    # logic

    def _logic(self, other, op: str):
        if not isinstance(other, Vector):
            raise TypeError("expected a Series or an Index")
        if self.dtype != t.BOOL or other.dtype != t.BOOL:
            raise TypeError("logical operators are for booleans")
        plan, (expr,) = self._plan.zipped(other._plan, [other._expr])
        return self._like(plan, self._expr & expr if op == "and" else self._expr | expr, t.BOOL)

    def __and__(self, other):
        return self._logic(other, "and")

    def __or__(self, other):
        return self._logic(other, "or")

    # arithmetic: results keep this side's dtype

    def _arithmetic(self, other, op: str, reflected: bool = False):
        if not t.is_numeric(self.dtype):
            raise TypeError(f"arithmetic on {self.dtype}")
        plan = self._plan
        if isinstance(other, Vector):
            if other.dtype != self.dtype:
                raise TypeError(f"expected {self.dtype}, got {other.dtype}")
            plan, (right,) = plan.zipped(other._plan, [other._expr])
        elif isinstance(other, np.ndarray):
            from pelagos.operators.series import Series

            return self._arithmetic(Series(other), op, reflected)
        elif other is not None and t.is_scalar(other):
            right = t.literal(other, self.dtype)
        else:
            raise TypeError(f"can't use {type(other).__name__} here")
        left = self._expr
        if reflected:
            left, right = right, left
        return self._like(plan, arithmetic(op, left, right, self.dtype), self.dtype)

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

    def __radd__(self, other):
        return self._arithmetic(other, "add", True)

    def __rsub__(self, other):
        return self._arithmetic(other, "sub", True)

    def __rmul__(self, other):
        return self._arithmetic(other, "mul", True)

    def __rtruediv__(self, other):
        return self._arithmetic(other, "div", True)

    # missing data

    def isna(self):
        return self._compare(None, "eq")

    def notna(self):
        return self._compare(None, "ne")

    def dropna(self):
        return self[self.notna()]

    def _filled(self, value) -> Column:
        if not t.is_scalar(value) or value is None:
            raise TypeError("expected a scalar")
        return F.when(t.is_missing(self._expr, self.dtype), t.literal(value, self.dtype)).otherwise(self._expr)

    # aggregates

    def _aggregate(self, how: str) -> Scalar:
        expr, dtype = aggregate(how, self._expr, self.dtype)
        return Scalar(self._plan.sdf.agg(expr.alias(how)), dtype, how)

    def min(self) -> Scalar:
        return self._aggregate("min")

    def max(self) -> Scalar:
        return self._aggregate("max")

    def sum(self) -> Scalar:
        return self._aggregate("sum")

    def prod(self) -> Scalar:
        return self._aggregate("prod")

    def count(self) -> Scalar:
        return self._aggregate("count")

    def mean(self) -> Scalar:
        return self._aggregate("mean")

    def var(self) -> Scalar:
        return self._aggregate("var")

    def std(self) -> Scalar:
        return self._aggregate("std")

    # access

    def __len__(self) -> int:
        return self._plan.sdf.count()

    @property
    def empty(self) -> bool:
        return self._plan.sdf.isEmpty()

    def to_spark(self) -> SparkFrame:
        raise NotImplementedError

    def explain(self) -> None:
        self.to_spark().explain("formatted")

    @property
    def values(self) -> np.ndarray:
        """The elements, in order. An action."""
        rows = self._plan.sdf.select(self._expr.alias("v"), *[F.col(c) for c, _ in self._plan.order]).orderBy(*self._plan.sort_keys()).select("v").toPandas()["v"]
        return to_array(rows, self.dtype)


def to_array(column, dtype: np.dtype) -> np.ndarray:
    if dtype == t.STRING:
        return np.array([None if v is None else v.encode("utf-8") for v in column], dtype=object if any(v is None for v in column) else None) if len(column) else np.array([], "S1")
    return column.to_numpy() if dtype == t.OBJECT or column.isna().any() and not t.is_float(dtype) else column.to_numpy().astype(dtype)


def arithmetic(op: str, left: Column, right: Column, dtype: np.dtype) -> Column:
    if op == "div":
        if not t.is_float(dtype):
            return t.cast(F.call_function("div", left, right), dtype)
        # as IEEE 754 has it; Spark's division raises an error on zero
        over = F.when((left == 0) | F.isnan(left), F.lit(float("nan"))).otherwise(F.signum(left) * F.lit(float("inf")))
        return t.cast(F.when(right == 0, over).otherwise(left / F.when(right != 0, right)), dtype)
    if op == "pow":
        return t.cast(F.pow(left, right), dtype)
    return t.cast({"add": left + right, "sub": left - right, "mul": left * right}[op], dtype)


def bounds(where: slice, length) -> tuple[int, int | None, int]:
    """(start, stop, step) of a slice, none negative; ``length()`` is asked only for negative bounds. Bounds must be integers."""
    for x in (where.start, where.stop, where.step):
        if x is not None and (not isinstance(x, (int, np.integer)) or isinstance(x, bool)):
            raise ValueError("slices take integers")
    step = 1 if where.step is None else int(where.step)
    if step < 1:
        raise ValueError("the step must be positive")
    start, stop = where.start or 0, where.stop
    if start < 0 or stop is not None and stop < 0:
        start, stop, _ = slice(start, stop).indices(length())
    return int(start), None if stop is None else max(int(stop), int(start)), step

"""Functions of the user: over Columns, as SQL text, over NumPy arrays, and of shared C libraries."""

from __future__ import annotations

import ctypes
import functools
import inspect
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from pelagos import types as t
from pelagos.functions.unary import UNARY
from pelagos.plans.plan import Plan, fresh, session


class Raw:
    """A function over arrays. ``whole``: it needs all elements at once, in order, and not just a batch of them."""

    def __init__(self, func: Callable, whole: bool, kwargs: dict) -> None:
        self.func, self.whole, self.kwargs = func, whole, kwargs
        functools.update_wrapper(self, func, updated=())

    def __call__(self, array, **kwargs):
        if not isinstance(array, np.ndarray):
            raise TypeError("expected an array")
        return self.func(array, **{**self.kwargs, **kwargs})


def raw(func: Callable, whole: bool = False, **kwargs) -> Raw:
    """Marks a function of NumPy arrays for ``Series.apply``; ``kwargs`` are given to it on each call.

    Element by element it runs in Arrow batches on the executors. ``whole`` functions need the series on the driver: for series
    that fit there.
    """
    return Raw(func, whole, kwargs)


def sort(array, kind: str = "q"):
    """Elements in rising order; labels stay where they are. Spark sorts: the series needn't fit anywhere."""
    return np.sort(array, kind={"q": "quicksort", "m": "mergesort", "h": "heapsort"}.get(kind, kind))


def applied(series, func, mapping: dict, new_dtype, kwargs: dict):
    dtype = series.dtype if new_dtype is None else t.dtype_of(new_dtype)
    if isinstance(func, str):
        return _text(series, func, mapping, dtype)
    if func is sort:
        return _sorted(series)
    if isinstance(func, Raw):
        return _array(series, func, kwargs, dtype)
    if not callable(func):
        raise TypeError("expected a function or SQL text")
    if func in UNARY and not t.is_float(series.dtype):
        raise TypeError(f"{func.__name__} is for floats")
    return series._like(series._plan, t.cast(func(series._expr, **kwargs), dtype), dtype)


def _text(series, text: str, mapping: dict, dtype: np.dtype):
    from pelagos.operators.vector import Vector

    plan, own = series._plan.with_column(series._expr)
    names = {"self": f"`{own}`"}
    for name, value in mapping.items():
        if isinstance(value, Vector):
            plan, (expr,) = plan.zipped(value._plan, [value._expr])
            plan, column = plan.with_column(expr)
            names[name] = f"`{column}`"
        else:
            names[name] = _literal(value)
    return series._like(plan, t.cast(F.expr(text.format(**names)), dtype), dtype)


def _literal(value) -> str:
    if isinstance(value, np.generic):
        value = value.item()
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (int, float)):
        return repr(value) + "D" * isinstance(value, float)
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    raise TypeError(f"can't put a {type(value).__name__} into SQL text")


def _array(series, func: Raw, kwargs: dict, dtype: np.dtype):
    call = functools.partial(func.func, **{**func.kwargs, **kwargs})
    if func.whole:
        from pelagos.operators.series import Series

        result = Series(np.asarray(call(series.values)))
        plan, (expr,) = series._plan.zipped(result._plan, [result._expr])
        return series._like(plan, t.cast(expr, dtype) if dtype != t.STRING else expr, dtype)
    kind = t.spark_type(dtype)

    @F.pandas_udf(kind)
    def run(values: pd.Series) -> pd.Series:
        return pd.Series(call(values.to_numpy()))

    return series._like(series._plan, run(series._expr), dtype)


def _sorted(series):
    name = fresh("s")
    plan = Plan(series._plan.sdf.select(series._expr.alias(name)), ((name, True),), "few" if series._plan.parts == "few" else "key")
    plan, (expr,) = series._plan.zipped(plan, [F.col(name)])
    return series._like(plan, expr, series.dtype)


_C_TYPES = {"h": ctypes.c_int16, "i": ctypes.c_int32, "l": ctypes.c_int64, "f": ctypes.c_float, "d": ctypes.c_double}


@functools.lru_cache
def _c_function(path: str, name: str, arguments: tuple[str, ...], result: str):
    """Opened once for each worker."""
    found = getattr(ctypes.CDLL(path), name)
    found.argtypes, found.restype = [_C_TYPES[c] for c in arguments], _C_TYPES[result]
    return found


def load_cudf(path: str, name: str, arguments: list, result) -> str:
    """Registers a scalar function of a C library, to be called by its name in SQL text. Executors load the library from ``path``.

    ``arguments`` and ``result`` are dtypes. Rows come in Arrow batches; the function, being one of scalars, is called for each row.
    """
    kinds = [t.dtype_of(a) for a in arguments]
    back = t.dtype_of(result)
    if any(k.char not in _C_TYPES for k in (*kinds, back)):
        raise TypeError("C functions are of numbers")
    codes, out = [k.char for k in kinds], back.char

    def call(*columns: pd.Series) -> pd.Series:
        found = _c_function(path, name, tuple(codes), out)
        return pd.Series([found(*row) for row in zip(*(c.tolist() for c in columns))], dtype=out)

    call.__signature__ = inspect.Signature([inspect.Parameter(f"c{i}", inspect.Parameter.POSITIONAL_ONLY, annotation=pd.Series) for i in range(len(codes))], return_annotation=pd.Series)
    call.__annotations__ = {**{f"c{i}": pd.Series for i in range(len(codes))}, "return": pd.Series}
    session().udf.register(name, F.pandas_udf(call, t.spark_type(back)))
    return name

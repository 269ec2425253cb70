"""Element types: NumPy dtypes at the edges, Spark types in plans, and the values that stand for missing data."""

from __future__ import annotations

from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

STRING = np.dtype("S")
FLOAT = np.dtype("float64")
LONG = np.dtype("int64")
BOOL = np.dtype("bool")
OBJECT = np.dtype("O")

_TO_SPARK = {"h": "smallint", "i": "int", "l": "bigint", "q": "bigint", "f": "float", "d": "double", "?": "boolean", "S": "string"}
_FROM_SPARK = {
    "smallint": np.dtype("int16"),
    "int": np.dtype("int32"),
    "bigint": LONG,
    "float": np.dtype("float32"),
    "double": FLOAT,
    "boolean": BOOL,
    "string": STRING,
}

# What stands for a missing element of each type. A boolean has no spare value: only NULL is missing there.
MISSING = {"h": -999, "i": -999, "l": -999, "q": -999, "f": -999.0, "d": -999.0, "S": "None"}


_mode = ContextVar("missing", default="sentinel")


@contextmanager
def missing_as(mode: str):
    """While it lasts, what new expressions take for missing: "sentinel" (MISSING and NULL; outer joins and the like give MISSING)
    or "null" (NULL alone)."""
    if mode not in ("sentinel", "null"):
        raise ValueError("the mode is sentinel or null")
    token = _mode.set(mode)
    try:
        yield
    finally:
        _mode.reset(token)


def _sentinel(dtype: np.dtype):
    return MISSING.get(dtype.char) if _mode.get() == "sentinel" else None


def dtype_of(kind) -> np.dtype:
    """A dtype for anything that names one; TypeError for those that have no counterpart."""
    dtype = np.dtype(kind)
    if dtype.kind in "SU":
        return STRING
    if dtype.char not in _TO_SPARK:
        raise TypeError(f"unsupported dtype {dtype}")
    return dtype


def spark_type(dtype: np.dtype) -> str:
    return _TO_SPARK[dtype.char]


def from_spark(kind: T.DataType) -> np.dtype:
    """The dtype of a Spark type; object for types that only pass through (timestamps, arrays, and so on)."""
    return _FROM_SPARK.get(kind.simpleString(), OBJECT)


def is_numeric(dtype: np.dtype) -> bool:
    return dtype.char in "hilqfd"


def is_float(dtype: np.dtype) -> bool:
    return dtype.char in "fd"


def takes_arithmetic(dtype: np.dtype) -> bool:
    """Columns that frame-wide operators apply to: all but strings and types that only pass through."""
    return dtype.char not in ("S", "O")


def cast(expr: Column, dtype: np.dtype) -> Column:
    return expr.cast(spark_type(dtype))


def literal(value, dtype: np.dtype) -> Column:
    """A scalar in a column's type. None is the value that stands for missing."""
    if value is None:
        return missing(dtype)
    if isinstance(value, (bytes, np.bytes_)):
        value = bytes(value).decode("ascii")
    if isinstance(value, np.generic):
        value = value.item()
    if not isinstance(value, (bool, int, float, str)):
        raise TypeError(f"expected a scalar, got {type(value).__name__}")
    if isinstance(value, str) != (dtype.char == "S"):
        raise TypeError(f"a {type(value).__name__} can't be used with {dtype}")
    return F.lit(value).cast(spark_type(dtype))


def missing(dtype: np.dtype) -> Column:
    return F.lit(_sentinel(dtype)).cast(spark_type(dtype) if dtype != OBJECT else "string")


def is_missing(expr: Column, dtype: np.dtype) -> Column:
    """NULL, or the value that stands for missing."""
    if _sentinel(dtype) is None:
        return expr.isNull()
    return expr.isNull() | (expr == missing(dtype))


def or_missing(expr: Column, dtype: np.dtype) -> Column:
    """NULL as the value that stands for missing."""
    return expr if _sentinel(dtype) is None else F.coalesce(expr, missing(dtype))


def is_scalar(value) -> bool:
    return value is None or isinstance(value, (bool, int, float, str, bytes, np.generic))

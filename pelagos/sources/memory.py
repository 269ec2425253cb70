"""Plans over data that the driver holds."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from pelagos import types as t
from pelagos.plans.plan import Plan, fresh, session

_ARROW = {"h": pa.int16(), "i": pa.int32(), "l": pa.int64(), "q": pa.int64(), "f": pa.float32(), "d": pa.float64(), "?": pa.bool_(), "S": pa.string()}


def as_array(data, dtype=None) -> tuple[np.ndarray, np.dtype]:
    """Data as an array of a supported dtype. An empty list is of float64."""
    if not isinstance(data, (np.ndarray, list, tuple, pd.Series, pd.Index)):
        raise TypeError(f"can't make a column of {type(data).__name__}")
    found = np.asarray(data) if not isinstance(data, (pd.Series, pd.Index)) else data.to_numpy()
    if found.ndim != 1:
        raise TypeError("only one-dimensional data have a counterpart")
    if found.dtype == object:
        if not all(v is None or isinstance(v, (str, bytes)) for v in found):
            raise TypeError("objects other than strings have no counterpart")
        kind = t.STRING
    else:
        kind = t.dtype_of(found.dtype)
    if dtype is not None and t.dtype_of(dtype) != kind:
        wanted = t.dtype_of(dtype)
        if t.STRING in (wanted, kind):
            raise TypeError(f"can't cast {kind} to {wanted}")
        found, kind = found.astype(wanted), wanted
    return found, kind


def _arrow(array: np.ndarray, dtype: np.dtype) -> pa.Array:
    if dtype == t.STRING:
        return pa.array([None if v is None else v.decode("utf-8") if isinstance(v, bytes) else str(v) for v in array.tolist()], pa.string())
    return pa.array(array, _ARROW[dtype.char], from_pandas=False)


def plan_of(columns: list[tuple[np.ndarray, np.dtype]]) -> tuple[Plan, list[str]]:
    """A plan of columns of one length, in their order, and the columns' names in it."""
    names, at = [fresh("m") for _ in columns], fresh("pos")
    length = len(columns[0][0]) if columns else 0
    if any(len(a) != length for a, _ in columns):
        raise ValueError("columns differ in length")
    if not length:
        schema = ", ".join(f"{n} {k}" for n, k in [(at, "bigint"), *zip(names, (t.spark_type(d) for _, d in columns))])
        sdf = session().createDataFrame([], schema)
    else:
        sdf = session().createDataFrame(pa.table([pa.array(np.arange(length)), *(_arrow(a, d) for a, d in columns)], names=[at, *names]))
    return Plan(sdf, ((at, True),), "few", None, at), names


def range_plan(start: int, stop: int, step: int) -> tuple[Plan, str]:
    at = fresh("pos")
    name = fresh("r")
    sdf = session().range(0, len(range(start, stop, step))).withColumnRenamed("id", at).withColumn(name, F.col(at) * step + start)
    return Plan(sdf, ((at, True),), "few", None, at), name

"""A labelled, lazy dataframe engine on Spark SQL."""

from pelagos.functions import acos, asin, atan, cos, cosh, erf, exp, load_cudf, log, raw, sin, sinh, sort, sqrt, tan, tanh
from pelagos.operators.frame import DataFrame
from pelagos.operators.indexes import Index, MultiIndex, RangeIndex
from pelagos.operators.series import Series
from pelagos.sources.files import read_csv, read_parquet, to_csv
from pelagos.types import missing_as

__all__ = [
    "DataFrame", "Index", "MultiIndex", "RangeIndex", "Series", "acos", "asin", "atan", "cos", "cosh", "erf", "exp", "load_cudf", "log", "missing_as", "raw",
    "read_csv", "read_parquet", "sin", "sinh", "sort", "sqrt", "tan", "tanh", "to_csv",
]

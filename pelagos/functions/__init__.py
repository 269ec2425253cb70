from pelagos.functions.udf import load_cudf, raw, sort
from pelagos.functions.unary import acos, asin, atan, cos, cosh, erf, exp, log, sin, sinh, sqrt, tan, tanh

__all__ = ["acos", "asin", "atan", "cos", "cosh", "erf", "exp", "load_cudf", "log", "raw", "sin", "sinh", "sort", "sqrt", "tan", "tanh"]

"""Mathematical functions of float columns, as C's math.h has them; results keep the column's dtype.

Each takes a Column, for ``Series.apply``. All but ``erf`` are Spark's own, and all stay in generated code; Spark's logarithm is NULL
where C's is NaN or minus infinity.
"""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F


def exp(c: Column) -> Column:
    return F.exp(c)


def log(c: Column) -> Column:
    return F.when(c > 0, F.log(c)).when(c == 0, F.lit(float("-inf"))).when(c.isNotNull(), F.lit(float("nan")))


def sqrt(c: Column) -> Column:
    return F.sqrt(c)


def sin(c: Column) -> Column:
    return F.sin(c)


def cos(c: Column) -> Column:
    return F.cos(c)


def tan(c: Column) -> Column:
    return F.tan(c)


def asin(c: Column) -> Column:
    return F.asin(c)


def acos(c: Column) -> Column:
    return F.acos(c)


def atan(c: Column) -> Column:
    return F.atan(c)


def sinh(c: Column) -> Column:
    return F.sinh(c)


def cosh(c: Column) -> Column:
    return F.cosh(c)


def tanh(c: Column) -> Column:
    return F.tanh(c)


def erf(c: Column) -> Column:
    """The error function as arithmetic: its series of rising terms up to 3.5, beyond it one less the continued fraction of its complement."""
    x, sign = F.abs(c.cast("double")), F.signum(c.cast("double"))
    near = F.least(x, F.lit(3.5))
    total = F.lit(1.0)
    for n in range(60, 0, -1):  # sum of (2 x^2)^n / (3 * 5 * ... * (2 n + 1)), from the inside
        total = F.lit(1.0) + near * near * F.lit(2.0 / (2 * n + 1)) * total
    series = F.lit(2.0 / pi**0.5) * near * F.exp(-near * near) * total
    far = F.greatest(x, F.lit(3.5))
    fraction = far
    for n in range(40, 0, -1):
        fraction = far + F.lit(n / 2.0) / fraction
    rest = F.exp(-far * far) / (F.lit(pi**0.5) * fraction)
    return F.when(F.isnan(x), F.lit(float("nan"))).otherwise(sign * F.when(x < 3.5, series).otherwise(1.0 - rest))


UNARY = (exp, log, sqrt, sin, cos, tan, asin, acos, atan, sinh, cosh, tanh, erf)

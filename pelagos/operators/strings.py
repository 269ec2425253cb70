"""String functions: what ``Series.str`` offers. Case is that of ASCII letters, patterns are plain text."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from pelagos import types as t

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def upper(c: Column) -> Column:
    return F.translate(c, LOWER, UPPER)


class StringMethods:
    def __init__(self, series) -> None:
        if series.dtype != t.STRING:
            raise AttributeError("only strings have .str")
        self._series = series

    def _made(self, expr: Column, dtype: np.dtype = t.STRING):
        return self._series._like(self._series._plan, expr, dtype)

    @property
    def _c(self) -> Column:
        return self._series._expr

    def lower(self):
        return self._made(lower(self._c))

    def upper(self):
        return self._made(upper(self._c))

    def capitalize(self):
        """The first letter in upper case, the others in lower case."""
        return self._made(F.concat(upper(F.substring(self._c, 1, 1)), lower(F.substring(self._c, 2, 1 << 30))))

    def get(self, i: int):
        """The character at a place, from the end if negative; what stands for missing where there is none."""
        _int(i)
        at = F.substring(self._c, i + 1 if i >= 0 else i, 1)
        inside = F.length(self._c) > i if i >= 0 else F.length(self._c) >= -i
        return self._made(F.when(inside, at).otherwise(t.missing(t.STRING)))

    def strip(self):
        """Without spaces at the ends; other white space stays."""
        return self._made(F.trim(self._c))

    def slice(self, start: int | None = None, stop: int | None = None, step: int | None = None):
        start, step = start or 0, 1 if step is None else step
        for x in (start, step, 0 if stop is None else stop):
            _int(x)
        if step < 1:
            raise ValueError("the step must be positive")
        c, n = self._c, F.length(self._c)
        begin = F.lit(start) if start >= 0 else F.greatest(n + start, F.lit(0))
        end = n if stop is None else F.least(F.lit(stop), n) if stop >= 0 else n + stop
        cut = F.when(end > begin, F.substring(c, begin + 1, end - begin)).otherwise("")
        if step == 1:
            return self._made(cut)
        each = F.transform(F.sequence(begin, end - 1, F.lit(step)), lambda i: F.substring(c, i + 1, F.lit(1)))
        return self._made(F.when(end > begin, F.array_join(each, "")).otherwise(""))

    def contains(self, pat: str):
        return self._made(F.contains(self._c, _text(pat)), t.BOOL)

    def startswith(self, pat: str):
        return self._made(F.startswith(self._c, _text(pat)), t.BOOL)

    def endswith(self, pat: str):
        return self._made(F.endswith(self._c, _text(pat)), t.BOOL)

    def find(self, sub: str, start: int = 0, end: int | None = None):
        """The place of the first hit within start and end, or -1."""
        _int(start)
        if end is not None and start >= _int(end):
            raise ValueError("start must be below end")
        window = F.substring(self._c, F.lit(start + 1), F.length(self._c) if end is None else F.lit(end - start))
        at = F.call_function("instr", window, _text(sub))
        found = F.when(at > 0, at - 1 + start).otherwise(-1)
        if sub == "":
            found = F.when(F.length(self._c) >= start, F.lit(start)).otherwise(-1)
        return self._made(found.cast("bigint"), t.LONG)

    def replace(self, pat: str, rep: str):
        """With the first hit replaced."""
        c, at = self._c, F.call_function("instr", self._c, _text(pat))
        return self._made(F.when(at > 0, F.overlay(c, _text(rep), at, F.lit(len(pat)))).otherwise(c))

    def split(self, pat: str, side: str = "left"):
        """What is left or right of the first hit; all of it where there is none."""
        if side not in ("left", "right"):
            raise ValueError("side is left or right")
        c, at = self._c, F.call_function("instr", self._c, _text(pat))
        part = F.substring(c, F.lit(1), at - 1) if side == "left" else F.substring(c, at + len(pat), F.length(c))
        return self._made(F.when(at > 0, part).otherwise(c))


def _int(x) -> int:
    if not isinstance(x, (int, np.integer)) or isinstance(x, bool):
        raise TypeError("expected an integer")
    return int(x)


def _text(x) -> Column:
    if isinstance(x, bytes):
        x = x.decode("ascii")
    if not isinstance(x, str):
        raise TypeError("expected a string")
    return F.lit(x)

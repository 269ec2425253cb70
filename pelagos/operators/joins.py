"""Joins on keys, labelled by them."""

from __future__ import annotations

from pyspark.sql import functions as F

from pelagos import types as t
from pelagos.operators.indexes import level_names
from pelagos.operators.series import labelled
from pelagos.operators.vector import Level
from pelagos.plans.plan import Plan, fresh

_HOW = {"inner": "inner", "left": "left", "right": "right", "outer": "full"}
#: Joins are the optimizer's choice, but for what the caller asks: "hash" hashes the other side, which Spark checks against memory.
_HINT = {"merge": None, "hash": "shuffle_hash", "broadcast": "broadcast", "sort_merge": "merge"}


def merged(left, right, how: str, on, suffixes: tuple[str, str], algorithm: str):
    """Rows of equal keys, with the keys as labels and in their order. What a side lacks is what stands for missing.

    ``on``: names of columns; None: the labels, if both sides name them alike. Old labels become columns. Keys may repeat: each
    pair of equal keys is a row.
    """
    from pelagos.operators.frame import DataFrame

    if not isinstance(right, DataFrame):
        raise TypeError("expected a DataFrame")
    if how not in _HOW:
        raise ValueError(f"how is one of {', '.join(_HOW)}")
    if algorithm not in _HINT:
        raise NotImplementedError(f"no algorithm {algorithm}")
    if not isinstance(suffixes, tuple) or len(suffixes) != 2:
        raise TypeError("expected two suffixes")
    sides = []
    keys = _keys(left, right, on)
    for side in (left, right):
        plan, levels = labelled(side._plan, side._labels)
        cols = {n: (x.expr, x.dtype) for n, x in zip(level_names(levels), levels)}
        sides.append((plan, {**cols, **side._cols}))
    for n in keys:
        for _, cols in sides:
            if n not in cols:
                raise KeyError(n)
        if sides[0][1][n][1] != sides[1][1][n][1]:
            raise TypeError(f"{n} has different types")
    tables, found = [], []
    for plan, cols in sides:
        own = {n: fresh("j") for n in cols}
        tables.append(plan.sdf.select(*[cols[n][0].alias(c) for n, c in own.items()]))
        found.append({n: (c, cols[n][1]) for n, c in own.items()})
    mine, theirs = found
    if _HINT[algorithm]:
        tables[1] = tables[1].hint(_HINT[algorithm])
    equal = [F.col(mine[n][0]) == F.col(theirs[n][0]) for n in keys]
    sdf = tables[0].join(tables[1], equal, _HOW[how])
    levels, order = [], []
    for n in keys:
        a, b = F.col(mine[n][0]), F.col(theirs[n][0])
        key = fresh("k")
        sdf = sdf.withColumn(key, {"right": b, "outer": F.coalesce(a, b)}.get(how, a))
        levels.append(Level(n, F.col(key), mine[n][1]))
        order.append((key, True))
    clash = {n for n in mine if n in theirs} - set(keys)
    out: dict = {}
    for cols, suffix, may_lack in ((mine, suffixes[0], how in ("right", "outer")), (theirs, suffixes[1], how in ("left", "outer"))):
        for n, (c, dtype) in cols.items():
            if n not in keys:
                out[n + suffix if n in clash else n] = (t.or_missing(F.col(c), dtype) if may_lack else F.col(c), dtype)
    return DataFrame._of(Plan(sdf, tuple(order), "key"), out, tuple(levels), len(levels) > 1)


def _keys(left, right, on) -> list[str]:
    if on is None:
        names = [level_names(s._labels) if s._labels else ["index"] for s in (left, right)]
        if names[0] != names[1]:
            raise ValueError("the labels have different names; say what to join on")
        return names[0]
    keys = [on] if isinstance(on, str) else on
    if not isinstance(keys, list) or not keys or not all(isinstance(n, str) for n in keys):
        raise TypeError("expected a name or a list of names")
    return keys

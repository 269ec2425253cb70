"""Access by position."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from pelagos import types as t
from pelagos.operators.vector import Level, Scalar, Vector
from pelagos.plans.plan import Plan, fresh


class ILoc:
    def __init__(self, of) -> None:
        self._of = of

    def __getitem__(self, item):
        if isinstance(item, slice):
            return self._of[item]
        if isinstance(item, (int, np.integer)) and not isinstance(item, bool):
            if not isinstance(self._of, Vector):
                raise NotImplementedError("a frame's row is not a value; use a slice")
            at = int(item) + (len(self._of) if item < 0 else 0)
            cut = self._of[at : at + 1]
            return Scalar(cut._plan.sdf.select(cut._expr.alias("value")), self._of.dtype)
        if isinstance(item, (list, np.ndarray)):
            from pelagos.operators.series import Series

            item = Series(np.asarray(item, np.int64))
        if isinstance(item, Vector):
            if item.dtype != t.LONG:
                raise TypeError("positions are of int64")
            return self._of._iloc(item)
        raise TypeError(f"can't select by {type(item).__name__}")


def taken(plan: Plan, labels: tuple[Level, ...] | None, positions: Vector, missing: bool = False) -> tuple[Plan, tuple[Level, ...]]:
    """The plan's rows at positions, in their order, with repeats; without ``missing`` those out of range are left out."""
    from pelagos.operators.series import labelled

    plan, levels = labelled(plan, labels)
    plan = plan.numbered()
    wanted = positions._plan.numbered()
    order, at = fresh("pos"), fresh("at")
    side = wanted.sdf.select(F.col(wanted.position).alias(order), positions._expr.alias(at))
    sdf = side.join(plan.sdf, F.col(at) == F.col(plan.position), "left" if missing else "inner").drop(at)
    if missing:
        levels = tuple(x._replace(expr=t.or_missing(x.expr, x.dtype)) for x in levels)
    return Plan(sdf, ((order, True),), "few" if wanted.parts == "few" else "key", None, order if missing else None), levels

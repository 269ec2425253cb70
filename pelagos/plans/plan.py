"""Rows with an order: what frames, series and indexes are expressions over.

Spark's rows have no order and no positions. A plan holds a Spark DataFrame under unique column names and the hidden
columns that define its order; positions are made only when an operator needs them, and then by parts: by file for scans, by
ranges of the key for sorted numbers.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count
from os.path import commonprefix

from pyspark.sql import Column, SparkSession, Window
from pyspark.sql import DataFrame as SparkFrame
from pyspark.sql import functions as F

_names = count()

#: Up to here a leading slice is a top-k; beyond, it is a filter on positions.
TOP_ROWS = 10_000
#: Up to so many parts have their first positions looked up in a map, and beyond in a broadcast table.
MAP_PARTS = 1_000
#: Ranges that a sorted numeric key is cut into for positions.
RANGES = 200


def session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def fresh(of: str = "c") -> str:
    return f"_{of}{next(_names)}"


class Plan:
    """``order``: (column, ascending) pairs. ``parts``: "few" for rows that the driver made, else what the order's first column is: "file" or "key".

    ``rows`` stands for the rows and their order: plans that share it differ in columns only, so expressions over them combine
    without a join.
    """

    def __init__(self, sdf: SparkFrame, order: tuple = (), parts: str = "few", rows: object = None, position: str | None = None, label: str | None = None) -> None:
        self.sdf, self.order, self.parts, self.position, self.label = sdf, tuple(order), parts, position, label
        self.rows = rows if rows is not None else object()
        self.made: tuple[Plan, Callable[[Plan], Plan]] | None = None

    def _made(self, step: Callable[[Plan], Plan]) -> Plan:
        """What a step makes of this plan, with the step: default labels, if they are ever asked for, are carried through it."""
        plan = step(self)
        if plan is not self:
            plan.made = (self, step)
        return plan

    def labelled(self) -> Plan:
        """The same rows with a column of the labels they had by default where the plan began: positions from 0."""
        if self.label:
            return self
        if self.made is None:
            plan = self.numbered()
            return Plan(plan.sdf, plan.order, plan.parts, plan.rows, plan.position, plan.position)
        before, step = self.made
        plan = step(before.labelled())
        plan.rows = self.rows
        return plan

    def sort_keys(self, reverse: bool = False) -> list[Column]:
        return [F.col(c).asc() if up != reverse else F.col(c).desc() for c, up in self.order]

    def where(self, condition: Column) -> Plan:
        return self._made(lambda p: Plan(p.sdf.where(condition), p.order, p.parts, label=p.label))

    def with_column(self, expr: Column, of: str = "c") -> tuple[Plan, str]:
        name = fresh(of)
        return self._made(lambda p: Plan(p.sdf.withColumn(name, expr), p.order, p.parts, self.rows, p.position, p.label)), name

    def sorted_by(self, keys: list[tuple[Column, bool]]) -> Plan:
        plan, order = self, []
        for expr, up in keys:
            plan, name = plan.with_column(expr, "s")
            order.append((name, up))
        # rows from the driver are few however they are sorted
        parts = "key" if self.parts != "few" else "few"
        return plan._made(lambda p: Plan(p.sdf, (*order, *p.order), parts, label=p.label))

    def head(self, n: int) -> Plan:
        if n > TOP_ROWS:
            return self.between(0, n)
        return self._made(lambda p: Plan(p.sdf.orderBy(*p.sort_keys()).limit(max(0, n)), p.order, label=p.label))

    def tail(self, n: int) -> Plan:
        if n > TOP_ROWS:
            length = self.sdf.count()
            return self.between(max(0, length - n), length)
        return self._made(lambda p: Plan(p.sdf.orderBy(*p.sort_keys(reverse=True)).limit(max(0, n)), p.order, label=p.label))

    def between(self, start: int, stop: int | None, step: int = 1) -> Plan:
        """Rows at positions ``start``, ``start + step`` and so on, below ``stop``; neither is negative."""
        if stop is not None and stop <= TOP_ROWS:
            top = self.head(stop)
            return top if start == 0 and step == 1 else top._cut(start, None, step)
        return self._cut(start, stop, step)

    def _cut(self, start: int, stop: int | None, step: int) -> Plan:
        def cut(plan: Plan) -> Plan:
            plan = plan.numbered()
            at = F.col(plan.position)
            met = at >= start
            if stop is not None:
                met &= at < stop
            if step != 1:
                met &= (at - start) % step == 0
            return Plan(plan.sdf.where(met), plan.order, plan.parts, label=plan.label)

        return self._made(cut)

    def numbered(self) -> Plan:
        """The same rows with a column of dense positions from 0."""
        return self if self.position else self._made(Plan._number)

    def _number(self) -> Plan:
        if self.position:
            return self
        name = fresh("pos")
        keyed, part = self._part()
        if part is None:
            at = F.row_number().over(Window.orderBy(*self.sort_keys())) - 1 if self.order else F.monotonically_increasing_id()
            return Plan(self.sdf.withColumn(name, at.cast("long")), self.order, self.parts, self.rows, name, self.label)
        parted = keyed.withColumn(part_name := fresh("part"), part)
        # one row for each part, whose number is that of files or ranges
        before = F.sum("n").over(Window.orderBy("of").rowsBetween(Window.unboundedPreceding, -1))
        bases = parted.groupBy(F.col(part_name).alias("of")).agg(F.count(F.lit(1)).alias("n")).select("of", F.coalesce(before, F.lit(0)).alias("base"))
        within = (F.row_number().over(Window.partitionBy(part_name).orderBy(*self.sort_keys())) - 1).cast("bigint")
        if self.parts != "file" or len(self.sdf.inputFiles()) <= MAP_PARTS:
            # as an expression alone, it is pruned with its window wherever nobody asks for the position
            base = bases.agg(F.map_from_entries(F.collect_list(F.struct("of", "base")))).scalar()
            sdf = parted.withColumn(name, within + F.coalesce(base[F.col(part_name)], F.lit(0))).select(*self.sdf.columns, name)
        else:
            joined = parted.withColumn(name, within).join(bases, F.col(part_name).eqNullSafe(F.col("of")))
            sdf = joined.withColumn(name, F.col(name) + F.col("base")).select(*self.sdf.columns, name)
        return Plan(sdf, self.order, self.parts, self.rows, name, self.label)

    def _part(self) -> tuple[SparkFrame, Column | None]:
        """What rises with the order and has few rows for each of its values, over the frame that comes with it; None for rows that the driver made."""
        if not self.order or self.parts == "few":
            return self.sdf, None
        first, up = self.order[0]
        if self.parts == "file":
            # a file's rows come in parts of a million
            return self.sdf, F.struct(F.col(first).alias("file"), F.shiftright(self.order[1][0], 20).alias("block")) if len(self.order) > 1 else F.col(first)
        kind = dict(self.sdf.dtypes)[first]
        # a column of its own, so that it isn't worked out again for each bound
        key = F.col(name := fresh("key"))
        keyed = self.sdf.withColumn(name, self._sort_number(first, kind))
        # the only action in building a plan: RANGES numbers come back (a subquery can't be in a higher-order function)
        shares = [i / RANGES for i in range(1, RANGES)]
        found = keyed.agg(F.percentile_approx(key, shares, 10 * RANGES)).first()[0]
        ends = sorted(set(found or [0.0]))
        bounds, step = F.array(*map(F.lit, ends)), max(1, int(len(ends) ** 0.5))
        # ranges between the bounds are even, those of a bound itself odd: a frequent key has a range of its own
        # first among every step-th bound, then among those up to the next of them
        block = F.size(F.filter(F.array(*map(F.lit, ends[step - 1 :: step])), lambda b: key > b)) * step
        near = F.slice(bounds, block + 1, F.lit(step))
        at = (block + F.size(F.filter(near, lambda b: key > b))) * 2 + F.array_contains(near, key).cast("int")
        at = F.coalesce(at, F.lit(-1))  # NULL comes first in a rising order and last in a falling one
        place = at if up else -at
        if kind != "string" and len(self.order) > 1 and self.order[1][1] and self.order[1][0].startswith("_file"):
            # rows of a frequent key are in the order of their files
            return keyed, F.struct(place.alias("range"), F.when(at % 2 != 0, F.col(self.order[1][0])).alias("file"))
        return keyed, place

    def _sort_number(self, column: str, kind: str) -> Column:
        """A double that never falls as the column rises; different values may have the same one."""
        c = F.col(column)
        if kind == "string":  # by the first seven bytes after those that all have in common
            lo, hi = self.sdf.agg(F.min(c), F.max(c)).first()
            common = len(commonprefix([(lo or "").encode(), (hi or "").encode()]))
            start = F.hex(F.substring(c.cast("binary"), common + 1, 7))
            return F.conv(F.rpad(start, 14, "0"), 16, 10).cast("double")
        if kind == "date":
            return F.unix_date(c).cast("double")
        if kind == "timestamp_ntz":  # without the zones that a cast to seconds would bring in
            return F.unix_date(c.cast("date")) * 86400.0 + F.hour(c) * 3600 + F.minute(c) * 60 + F.extract(F.lit("SECOND"), c).cast("double")
        return c.cast("double")

    def zipped(self, other: Plan, exprs: list[Column]) -> tuple[Plan, list[Column]]:
        """This plan with expressions over another: (plan, expressions over it), matched by position unless they share rows."""
        if other.rows is self.rows:
            if other.sdf is self.sdf or set(other.sdf.columns) <= set(self.sdf.columns):
                return self, exprs
            if set(self.sdf.columns) <= set(other.sdf.columns):
                return other, exprs
        theirs = other.numbered()
        names = [fresh() for _ in exprs]
        at = fresh("at")
        side = theirs.sdf.select(F.col(theirs.position).alias(at), *[e.alias(n) for e, n in zip(exprs, names)])

        def add(plan: Plan) -> Plan:
            mine = plan.numbered()
            sdf = mine.sdf.join(side, F.col(mine.position) == F.col(at), "left").drop(at)
            return Plan(sdf, mine.order, mine.parts, self.rows, mine.position, mine.label)

        return self._made(add), [F.col(n) for n in names]

    def root(self) -> Plan:
        """The same rows with new default labels."""
        return Plan(self.sdf, self.order, self.parts, self.rows, self.position)

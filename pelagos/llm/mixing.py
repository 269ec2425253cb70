"""Mixing sources to target weights by systematic sampling.

A source's rate is its target over its size. Its documents are put in order of size, each is expected ``rate`` times, and
it is emitted once for each integer that its prefix sum of expected copies, plus the source's one random offset, passes.
In this order what a source yields is off its target by at most its largest document. All rates and offsets are
numbers of ``1 / UNIT``, so sums are exact and reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelagos.llm.common import WORD, joined_by_copies, one_of, ranked, saved, unused

UNIT = 1 << 24


def word_count(text_col: str = "text"):
    """Words in a text; null has none."""
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) of a table (source, source_size): a saved table.

    Sources in order of code points, null last, have the ``weights`` in turn and divide ``share`` of all sizes by them.
    A target stops at ``most`` times its source's size; what is over goes to those below by weight, until none is above.
    The rounds run over the table of sources, with two sums each on the driver.
    """
    if not 0 <= share <= most:
        raise ValueError("share must be from 0 to most")
    spread = sizes.select("source", "source_size", F.col("source").isNull().cast("int").alias("last"))
    place = ranked(saved(spread, "sources"), "last", "source", name="sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    table = saved(place.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(float(most))).alias("cap")), "weights")
    total = (table.agg(F.sum("source_size")).first()[0] or 0) * share
    # a source is full if what a weight of 1 gets (level) fills it; the level only rises, so full sources stay full
    level = 0.0
    while True:
        full = F.col("cap") <= F.col("weight") * F.lit(level)
        used, open_ = table.agg(F.sum(F.when(full, F.col("cap")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if not open_:
            break
        was, level = level, (total - used) / open_
        if level <= was * (1 + 1e-12):
            level = max(level, was)
            break
    return table.select("source", "source_size", F.least("cap", F.col("weight") * F.lit(level)).alias("target"))


def offset(source: str = "source", seed: str = ""):
    """The source's random offset, from 0 to below UNIT: six hex digits of an MD5."""
    text = F.concat(F.lit(seed), F.coalesce(F.col(source), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 6), 16, 10).cast("long")


def mixed(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = "", carry: tuple = ()
) -> DataFrame:
    """(id, size, source_size, target, copies, *carry) for every row of ``docs``: how often the mix takes it.

    Null sources are one source, the last; null texts have size 0; sources without words have target 0 and none of their
    documents is taken. ``copies`` is at most ``most`` rounded up. Rows that agree in source, size and id are as many documents.
    An empty table gives an empty one.
    """
    sized = saved(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(text_col).alias("size"), *carry), "sizes")
    named = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    order = sized.select("*", F.col("source").isNull().cast("int").alias("last"), (-F.col("size")).alias("falling"))
    carried = [c for c in sized.columns if c not in ("id", "source", "size")]
    placed = ranked(order, "last", "source", "falling", "id", *carried, name="mix")
    # where each source starts: a minimum for each source, combined in each task first
    starts = placed.groupBy("source").agg(F.min("rank").alias("start"), F.count(F.lit(1)).alias("rows"))
    plan = saved(named.join(starts, named.source.eqNullSafe(starts.source)).select(named.source.alias("of"), "source_size", "target", "start", "rows"), "plan")
    rate = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * UNIT + 0.5)).otherwise(0).cast("long")
    at = F.col("rank") - F.col("start")
    passed = lambda k: F.shiftright(offset("of", seed) + k * rate, 24)
    joined = joined_by_copies(placed, plan.withColumn("key", F.col("of")), "source", "key", "rows", sized.count())
    copies = (passed(at + 1) - passed(at)).alias("copies")
    return joined.select(F.col("id").alias(id_col), "size", "source_size", "target", copies, *carried)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = "") -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken, with all their columns.

    Of rows with the same id, source and text, that whose columns, written as JSON, come first is emitted as often as all are
    taken. Null texts have no words and are never taken; an empty table gives an empty one; columns of any names are kept.
    """
    own = F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_own")
    taken = mixed(docs, id_col, text_col, source_col, weights, share, most, seed, (own, F.col(source_col).alias("_source")))
    grouped = taken.groupBy(F.col(id_col).alias("_id"), "_source", "_own").agg(F.sum("copies").alias("_copies"), F.count(F.lit(1)).alias("_rows"))
    grouped = saved(grouped, "taken")
    return _emitted(docs, grouped, own, id_col, source_col)


def _emitted(docs: DataFrame, grouped: DataFrame, own, id_col: str, source_col: str) -> DataFrame:
    mark, copies = unused("_own_text", docs), unused("_copies", docs)
    tagged = docs.withColumn(mark, own)
    grouped = grouped.withColumnRenamed("_copies", copies)
    on = tagged[id_col].eqNullSafe(grouped["_id"]) & tagged[source_col].eqNullSafe(grouped["_source"]) & (tagged[mark] == grouped["_own"])
    took = grouped[copies] > 0
    # as often as copies: at most twice but for repeated rows
    times = lambda df: df.withColumn(copies, F.explode(F.array_repeat(F.lit(0), F.col(copies).cast("int")))).drop(copies, mark)
    single = times(tagged.join(grouped.where(took & (F.col("_rows") == 1)), on).drop(grouped["_id"], grouped["_source"], grouped["_own"], grouped["_rows"]))
    again = grouped.where(took & (F.col("_rows") > 1))
    if again.isEmpty():
        return single
    # repeated rows are as many as their copies together: one of them is emitted for all
    first = tagged.join(again, on).drop(grouped["_id"], grouped["_source"], grouped["_own"], grouped["_rows"])
    first = one_of(first, [id_col, source_col, mark])
    return single.unionByName(times(first))

"""Packing documents into sequences by bulk-synchronous best fit.

Documents go in bands of falling length. Each round range-sorts the band's documents left and the gaps that can hold one by
size, falling, and sweeps over them: a gap is put on a stack as often as documents surely fit, a document takes the top, which
is the smallest gap that is large enough (its successor). The ranges are swept by themselves; what a range leaves over meets
that of the ranges before it by its rank, its level on the stack of all of them, so that no gap's place is given twice. Then
the gaps are updated, and the next round takes the documents left. A round begins with as many new sequences as its documents
need at least, whatever goes into the gaps there are.

A round's tables are in the shared folder. The driver reads the counts of each length and gap, which ``capacity`` bounds.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pelagos.llm.common import saved, text_bytes
from pelagos.llm.tokens import word_tokenizer

#: Bands of lengths: the capacity over these. Of documents over a (k + 1)th of the capacity, at most k fit a sequence.
BANDS = (1, 2, 3, 4, 5, 6, 8, 12, 16, 32, 64)
#: Rounds of no more documents and places than this are one range. The result is the same: what they match doesn't depend on the ranges.
ONE_RANGE = 50_000

_SWEPT = "part int, kind int, at long, row long, length int, sequence long, gap int, slot int"


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """(id, piece, start, length, ids): each text's token ids and then ``end_id``, cut into pieces of ``capacity`` if longer.

    ``ids``: little-endian unsigned 32-bit numbers. A null text is empty: its one piece is ``end_id``.
    """
    end = np.array([end_id], "<u4").tobytes()
    size = 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_tokenizer(tokenizer_path).encode
        for batch in batches:
            rows: list[tuple[int, int, bytes]] = []
            for i, text in enumerate(batch.column(0)):
                ids = encode(text.as_py()) + end
                rows += [(i, at, ids[at : at + size]) for at in range(0, len(ids), size)]
            at = np.array([r[1] for r in rows], np.int64)
            lengths = np.array([len(r[2]) // 4 for r in rows], np.int64)
            who = batch.column(1).take(pa.array([r[0] for r in rows], pa.int64()))
            yield pa.RecordBatch.from_arrays([who, pa.array((at // size).astype(np.int32)), pa.array(at // 4), pa.array(lengths), pa.array([r[2] for r in rows], pa.binary())], names=["id", "piece", "start", "length", "ids"])

    kept = docs.select(text_bytes(text_col).alias("_text"), F.col(id_col).alias("id"))
    return kept.mapInArrow(run, f"id {kept.schema['id'].dataType.simpleString()}, piece int, start long, length long, ids binary")


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range of documents and places in gaps (size, is_doc, who, slot), by falling size: what meets in it and what is left over.

    ``kind``: 0 a document with its place, 1 a document without, 2 a place without. ``at``: its rank among those left over.
    """
    part, stack, alone = TaskContext.get().partitionId(), [], 0
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]
    names = [c.split()[0] for c in _SWEPT.split(", ")]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows) if rows else [()] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    for batch in batches:
        rows = []
        for size, is_doc, who, slot in zip(*(c.to_pylist() for c in batch.columns)):
            if not is_doc:
                stack.append((who, size, slot))
            elif stack:
                rows.append((part, 0, 0, who, size, *stack.pop()))
            else:
                rows.append((part, 1, alone, who, size, None, None, None))
                alone += 1
        yield table(rows)
    for first in range(0, len(stack), 10_000):
        yield table([(part, 2, first + i, None, 0, *place) for i, place in enumerate(stack[first : first + 10_000])])


def _matched(docs: DataFrame, gaps: DataFrame, most: int, capacity: int, one_range: bool) -> DataFrame:
    """One round over documents (row, length) of at most ``most`` and gaps (sequence, gap): a saved table.

    (row, length, sequence, offset, gap, first): a document with its place, or with a null sequence; places that stay free
    have a null row. ``gap`` is what is left of it after the round, and ``first`` marks one row of each sequence.
    """
    # a gap that is smaller than the largest document is one place for a document that is no larger than it
    slots = F.explode(F.sequence(F.greatest(F.lit(1), F.expr(f"gap div {most}").cast("int")) - 1, F.lit(0)))
    places = gaps.select(F.col("gap").alias("size"), F.lit(0).alias("is_doc"), F.col("sequence").alias("who"), slots.alias("slot"))
    both = places.unionByName(docs.select(F.col("length").alias("size"), F.lit(1).alias("is_doc"), F.col("row").alias("who"), F.lit(0).alias("slot")))
    # at one size gaps come first, as they fit; of a gap's places the first comes last and so is the first to be taken
    order = [F.col("size").desc(), F.col("is_doc"), F.col("who"), F.col("slot").desc()]
    both = both.repartition(1) if one_range else both.repartitionByRange(*order)
    swept = both.sortWithinPartitions(*order).mapInArrow(_sweep, _SWEPT)
    found = (swept if one_range else _across(saved(swept, "swept"))).select("row", "length", "sequence", "gap", "slot")
    # a sequence has at most ``capacity`` documents; each document without a place is a group of its own
    group = Window.partitionBy(F.coalesce("sequence", -1 - F.col("row")))
    before = F.coalesce(F.sum("length").over(group.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offset = (F.lit(capacity) - F.col("gap") + before).cast("long")
    left = (F.col("gap") - F.sum("length").over(group)).cast("int")
    first = F.row_number().over(group.orderBy("slot")) == 1
    return saved(found.select("row", "length", "sequence", offset.alias("offset"), left.alias("gap"), first.alias("first")), "fitted")


def _across(swept: DataFrame) -> DataFrame:
    """A saved table of swept ranges, with what they leave over matched between them."""
    # levels on the stack of all ranges; a range has each level twice at most, so no level is large
    per = swept.groupBy("part").agg(F.count_if(F.col("kind") == 1).alias("alone"), F.count_if(F.col("kind") == 2).alias("free"))
    before = F.coalesce(F.sum(F.col("free") - F.col("alone")).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    over = swept.where("kind > 0").join(F.broadcast(per.select("part", "alone", before.alias("base"))), "part")
    at = F.when(F.col("kind") == 1, F.col("base") - F.col("at")).otherwise(F.col("base") - F.col("alone") + F.col("at") + 1)
    place = F.struct("sequence", "gap", "slot")
    level = Window.partitionBy("level").orderBy("part", "kind")
    over = over.withColumn("level", at).select("kind", "row", "length", place.alias("own"), F.lag(place).over(level).alias("below"), F.lag("kind").over(level).alias("was"), F.lead("kind").over(level).alias("then"))
    over = over.where((F.col("kind") == 1) | ~F.col("then").eqNullSafe(1))
    over = over.select("row", "length", F.when((F.col("kind") == 1) & (F.col("was") == 2), F.col("below")).otherwise(F.col("own")).alias("place"))
    return swept.where("kind = 0").select("row", "length", "sequence", "gap", "slot").unionByName(over.select("row", "length", "place.*"))


def placed(lengths: DataFrame, capacity: int = 4096, one_range: int = ONE_RANGE) -> DataFrame:
    """(row, sequence_id, offset) for each row of a saved table (row, length), with lengths of 1 to ``capacity``.

    An empty table gives an empty one. Rows differ by their number ``row``, a long from 0.
    """
    spark = lengths.sparkSession
    counts = {r["length"]: r["n"] for r in lengths.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity rows
    if bad := [n for n in counts if not 1 <= n <= capacity]:
        raise ValueError(f"lengths must be from 1 to {capacity}: {bad[:3]}")
    # sorted by length, so that a band reads its own row groups
    docs = saved(lengths.select("row", F.col("length").cast("int").alias("length")).repartitionByRange("length", "row").sortWithinPartitions("length"), "lengths")
    gaps = spark.createDataFrame([], "sequence long, gap int")
    sizes: Counter[int] = Counter()  # sequences by gap
    out, made = [], 0
    for over, under in zip(BANDS, (*BANDS[1:], capacity + 1)):
        low, high = capacity // under, capacity // over
        band = {n: c for n, c in counts.items() if low < n <= high}
        left = docs.where((F.col("length") > low) & (F.col("length") <= high))
        while band:
            n, least, most = sum(band.values()), min(band), max(band)
            # what the gaps can't hold, by tokens and by documents
            held, fit = (sum(c * f(g) for g, c in sizes.items() if g >= least) for f in (lambda g: g, lambda g: g // least))
            new = max(0, -((held - sum(k * c for k, c in band.items())) // capacity), -((fit - n) // (capacity // least)))
            sizes[capacity] += new
            # gaps of the largest document and above take all of them: no larger ones than these need
            top, places = capacity, 0
            for gap in sorted(g for g in sizes if g >= most):
                top, places = gap, places + sizes[gap] * (gap // most)
                if places >= n:
                    break
            if new:
                fresh = spark.range(made, made + new).select(F.col("id").alias("sequence"), F.lit(capacity).alias("gap"))
                gaps, made = gaps.unionByName(fresh), made + new
            used = (F.col("gap") >= least) & (F.col("gap") <= top)
            places += sum(c for g, c in sizes.items() if least <= g < most)
            fitted = _matched(left, gaps.where(used), most, capacity, n + places <= one_range)
            out.append(fitted.where("row is not null and sequence is not null").select("row", F.col("sequence").alias("sequence_id"), "offset"))
            gaps = gaps.where(~used).unionByName(fitted.where("first and sequence is not null").select("sequence", "gap"))
            left = fitted.where("sequence is null").select("row", "length")
            is_doc = F.col("sequence").isNull()
            told = fitted.where(is_doc | F.col("first")).groupBy(is_doc.alias("is_doc"), F.when(is_doc, F.col("length")).otherwise(F.col("gap")).alias("size"))
            told = told.agg(F.count(F.lit(1)).alias("n")).collect()  # at most twice capacity rows
            sizes = Counter({g: c for g, c in sizes.items() if not least <= g <= top})
            sizes.update({r["size"]: r["n"] for r in told if not r["is_doc"]})
            band = {r["size"]: r["n"] for r in told if r["is_doc"]}
        gaps = saved(gaps.where("gap > 0"), "gaps")
        sizes.pop(0, None)
    found = spark.createDataFrame([], "row long, sequence_id long, offset long")
    for part in out:
        found = found.unionByName(part)
    return found


def packed(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int = 1, with_ids: bool = True) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset[, ids]) for every piece of every row of ``docs``.

    Pieces in a sequence follow each other without gaps. Null texts are empty; rows with the same id are packed on their own;
    an empty table gives an empty one; other columns are not read. ``with_ids``: the pieces' token ids too, as bytes, which
    are moved once, at the end.
    """
    cut = pieces(docs, tokenizer_path, id_col, text_col, capacity, end_id)
    cut = saved(cut.select("id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), F.monotonically_increasing_id().alias("row"), *["ids"] * with_ids), "pieces")
    columns = ["piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids]
    return cut.join(placed(cut, capacity), "row").select(F.col("id").alias(id_col), *columns)

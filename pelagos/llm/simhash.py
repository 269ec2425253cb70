"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A text's fingerprint has a bit for each bit of the XXH64 of its word shingles: 1 if set in over half of them. Two
fingerprints that differ in at most ``radius`` bits have a value between them that differs from either in at most half
of that. So every distinct fingerprint emits all values within half the radius (65 of them for radius 2), rows meet on
the value, and those that meet are verified and linked. A value has as many distinct fingerprints around it as there are
bits at most, so no bucket is large, however many copies a text has.

:func:`near_duplicates` links 64 bits at a radius. :func:`drop_near_duplicates` links texts by the Jaccard similarity of their
shingles: two at 0.8 differ in 15 % of their bits, which no ball around the whole fingerprint reaches. So its fingerprints are
wider and cut into bands, each of which is ball hashed on its own, and texts that meet in a band are verified by their entire
sets of shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import acos, ceil, comb, log, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pelagos.llm.common import joined_by_copies, saved, text_bytes, unused
from pelagos.llm.components import components

SEED, BITS, CHUNK = 42, 64, 1 << 16


def fingerprint(text: bytes, width: int = 3) -> int:
    """The fingerprint of UTF-8 bytes, as an unsigned number. Fewer words than ``width``: of all of them; no words: 0."""
    words = text.lower().split()  # bytes.lower() changes A-Z only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: len(words) - width] + 1).tolist()]
    digest, n, ones = xxhash.xxh64_intdigest, len(starts), np.zeros(BITS, np.int64)
    stops = ends[width - 1 :].tolist()
    for at in range(0, n, CHUNK):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + CHUNK], stops[at : at + CHUNK])], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, carry: tuple = ()) -> DataFrame:
    """(id, fp, *carry) for every row; ``fp`` is the fingerprint as a signed long. ``carry``: more columns, as expressions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), width) for t in batch.column(0)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(fps)], names=[*batch.schema.names[1:], "fp"])

    kept = docs.select(text_bytes(text_col).alias("_text"), F.col(id_col).alias(id_col), *carry)
    schema = kept.drop("_text").withColumn("fp", F.lit(0).cast("long")).schema
    return kept.mapInArrow(run, schema)


def masks(radius: int, width: int = BITS) -> list[int]:
    """All numbers of ``width`` bits with at most half of ``radius`` set, as signed longs."""
    if radius < 0 or radius % 2:
        raise ValueError("radius must be even: fingerprints that meet are then within it of each other")
    found = [sum(1 << b for b in bits) for k in range(radius // 2 + 1) for bits in combinations(range(width), k)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in found]


def links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """(a, b): for each value between them, the least fingerprint around it linked with every other one.

    All around a value are within ``radius`` of each other, so these links connect whatever all pairs would.
    """
    ball = F.explode(F.array(*[F.lit(m).cast("long") for m in masks(radius)]))
    emitted = distinct.select("fp", ball.alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("value"))
    around = Window.partitionBy("value").orderBy("fp").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = emitted.select("fp", F.first("fp").over(around).alias("least"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("least"))) <= radius
    return met.where((F.col("fp") != F.col("least")) & near).select(F.col("least").alias("a"), F.col("fp").alias("b")).distinct()


def near_classes(prints: DataFrame, id_col: str = "doc_id", radius: int = 2) -> DataFrame:
    """(of, component_id, copies) for every distinct fingerprint ``of`` of a saved table of :func:`fingerprints`: a saved table.

    ``component_id``: the least id that is reachable over links of at most ``radius`` differing bits. Null ids don't count;
    a component of null ids only has a null one.
    """
    distinct = saved(prints.groupBy("fp").agg(F.min(id_col).alias("least_id"), F.count(F.lit(1)).alias("copies")), "fps")
    roots = components(links(distinct, radius), "a", "b")
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least_id", "copies", F.coalesce("root", "fp").alias("root"))
    rooted = saved(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return saved(rooted.join(least, "root").select(F.col("fp").alias("of"), "component_id", "copies"), "classes")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2) -> DataFrame:
    """(id, fingerprint, component_id) for every row of ``docs``, repeated rows included.

    A null text is an empty one; texts without words have fingerprint 0 and are linked like any others. An empty
    table gives an empty one. Other columns of ``docs`` are not read.
    """
    prints = saved(fingerprints(docs, id_col, text_col, width), "prints")
    classes = near_classes(prints, id_col, radius)
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return joined_by_copies(prints, classes, "fp", "of", "copies", prints.count()).select(id_col, digits, "component_id")


def shingles(text: bytes, width: int = 5) -> set[bytes]:
    """All runs of ``width`` words of UTF-8 bytes, in lower case (A-Z). Fewer words: one run of all of them."""
    words = text.lower().split()
    return {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def similarity(a: bytes, b: bytes, width: int = 5) -> float:
    x, y = shingles(a, width), shingles(b, width)
    both = len(x & y)
    return both / (len(x) + len(y) - both)


def bit_share(least: float) -> float:
    """The share of bits in which two texts at a Jaccard similarity of ``least`` differ, about: the angle of their shingle vectors over pi."""
    return acos(2 * least / (1 + least)) / pi


def band_plan(texts: int, least: float, recall: float = 0.95, radius: int = 2) -> tuple[int, int]:
    """(bits of a band, bands). A band has ten bits more than the number of texts, so that texts that have nothing in common
    rarely meet, whatever their number; there are as many bands as let two texts at ``least`` meet with a probability of ``recall``."""
    bits, p = max(16, min(56, texts.bit_length() + 10)), bit_share(least)
    hit = sum(comb(bits, k) * p**k * (1 - p) ** (bits - k) for k in range(radius + 1))
    return bits, max(1, ceil(log(1 - recall) / log(1 - hit)))


def bands(text: bytes, width: int, bits: int, number: int) -> np.ndarray:
    """The bands of a text's wide fingerprint as signed longs, each with its number above its bits."""
    found = shingles(text, width)
    h = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in found), np.uint64, len(found))
    ones = np.zeros(-(-bits * number // BITS) * BITS, np.int64)
    for at in range(0, len(h), CHUNK):
        for k in range(0, len(ones), BITS):
            x = h[at : at + CHUNK] + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64))  # the next 64 bits of each shingle
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            ones[k : k + BITS] += np.unpackbits((x ^ (x >> np.uint64(31))).view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    set_ = (2 * ones > len(h))[: bits * number].reshape(number, bits)
    return set_ @ (1 << np.arange(bits, dtype=np.int64)) + (np.arange(number, dtype=np.int64) << bits)


def own_text(text_col: str):
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def sketched(docs: DataFrame, id_col: str, text_col: str, width: int, bits: int, number: int) -> DataFrame:
    """(id, _own, bands) for every row: ``_own`` stands for the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([bands(t.as_py(), width, bits, number) for t in batch.column(0)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], found], names=[*batch.schema.names[1:], "bands"])

    kept = docs.select(text_bytes(text_col).alias("_text"), F.col(id_col).alias(id_col), own_text(text_col).alias("_own"))
    return kept.mapInArrow(run, kept.drop("_text").withColumn("bands", F.array(F.lit(0).cast("long"))).schema)


def met(distinct: DataFrame, bits: int, radius: int = 2) -> DataFrame:
    """(value, n, first, rows, exact): what each text emits where others do, too. ``first``: the least text there; ``exact``:
    whether the value is the text's own band."""
    ball = F.explode(F.array(*[F.lit(m).cast("long") for m in masks(radius, bits)]))
    emitted = distinct.select("n", F.explode("bands").alias("band")).select("n", "band", ball.alias("mask"))
    # two numbers a row: nothing else is shuffled as often
    who = (F.shiftleft("n", 1) + (F.col("mask") == 0).cast("long")).alias("who")
    emitted = emitted.select(F.col("band").bitwiseXOR(F.col("mask")).alias("value"), who)
    around = Window.partitionBy("value")
    shared = emitted.select("value", "who", F.min("who").over(around).alias("first"), F.count(F.lit(1)).over(around).alias("rows")).where("rows > 1")
    return shared.select("value", F.shiftright("who", 1).alias("n"), F.shiftright("first", 1).alias("first"), "rows", (F.col("who") % 2 == 1).alias("exact"))


def _ordered(pairs: DataFrame, one: str, other: str) -> DataFrame:
    return pairs.where(F.col(one) != F.col(other)).select(F.least(one, other).alias("a"), F.greatest(one, other).alias("b")).distinct()


def _within(pairs: DataFrame, distinct: DataFrame, differing: int) -> DataFrame:
    """Those of (a, b) whose wide fingerprints differ in at most so many bits: no shingles are compared for the others."""
    one, other = distinct.select(F.col("n").alias("a"), F.col("bands").alias("x")), distinct.select(F.col("n").alias("b"), F.col("bands").alias("y"))
    bits = F.aggregate(F.zip_with("x", "y", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, n: s + n)
    return pairs.join(one, "a").join(other, "b").where(bits <= differing).select("a", "b")


def shingle_hashes(texts: DataFrame, width: int) -> DataFrame:
    """(n, hashes) of a table (_text, n): the XXH64 of each different shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = [np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles(t.as_py(), width)], np.uint64).view(np.int64) for t in part.column(0)]
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(found, pa.list_(pa.int64()))], names=["n", "hashes"])

    return texts.mapInArrow(run, "n long, hashes array<long>")


def hashes_of(named: DataFrame, distinct: DataFrame, docs: DataFrame, text_col: str, width: int) -> DataFrame:
    """(n, hashes) of the texts of a table (n): a saved table."""
    named = saved(named.join(distinct.select("n", "_own"), "n"), "named")
    # only texts that meet others go on; a merge join at every size, as the list grows with the rows
    texts = docs.select(own_text(text_col).alias("_own"), text_bytes(text_col).alias("_text")).join(named.hint("merge"), "_own")
    return saved(shingle_hashes(texts.groupBy("n").agg(F.min("_text").alias("_text")).select("_text", "n"), width), "hashes")


def verified(pairs: DataFrame, hashes: DataFrame, least: float) -> DataFrame:
    """Those of (a, b) whose texts have a similarity of ``least`` or more, by all their shingles' 64-bit hashes: a saved table."""
    one, other = hashes.toDF("a", "x"), hashes.toDF("b", "y")
    both = pairs.select("a", "b").join(one.hint("merge"), "a").join(other.hint("merge"), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return saved(both.where(shared >= F.lit(least) * (F.size("x") + F.size("y") - shared) - 1e-9).select("a", "b"), "similar")


def across(rooted: DataFrame, hashes: DataFrame, least: float) -> DataFrame:
    """(a, b): all pairs of texts with different roots that can have a similarity of ``least``. ``rooted``: (n, root); ``hashes``: a saved table.

    Texts that share a frequent passage meet in many buckets and yet aren't similar, so they aren't compared pair by pair:
    with the shingles of each in one order, rare ones first, two similar texts share one among the first few of both, and the
    smaller text's few are fewer (Xiao et al., "Efficient Similarity Joins for Near Duplicate Detection", WWW 2008).
    """
    shingle = hashes.select("n", F.explode("hashes").alias("h"))
    often = saved(shingle.groupBy(F.col("h").alias("of")).agg(F.count(F.lit(1)).alias("copies")), "often")
    total = often.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    ordered = joined_by_copies(shingle, often, "h", "of", "copies", total).groupBy("n").agg(F.sort_array(F.collect_list(F.struct("copies", "h"))).alias("all"))  # those of one text
    size = F.size("all")
    most = (size - F.ceil(size * least - 1e-9) + 1).cast("int")
    few = (size - F.ceil(size * (2 * least / (1 + least)) - 1e-9) + 1).cast("int")
    entries = ordered.join(rooted, "n").select("n", "root", size.alias("size"), few.alias("few"), "all", F.posexplode(F.slice("all", F.lit(1), most)).alias("at", "of"))
    # the shingle before: where two texts share that, too, they have met there
    before = F.try_element_at("all", F.nullif("at", F.lit(0)))["h"].alias("before")
    entries = saved(entries.where("of.copies > 1").select("n", "root", "size", "few", "at", F.col("of.h").alias("h"), before), "entries")
    names = ("h", "n", "root", "size", "at", "before")
    one, other = (side.select(*[F.col(c).alias(f"{name}_{c}") for c in names]) for name, side in (("one", entries.where("at < few")), ("other", entries)))
    rest = F.least(F.col("one_size") - F.col("one_at"), F.col("other_size") - F.col("other_at"))  # the most that they can share from here on
    smaller = "one_root != other_root and (one_size < other_size or one_size = other_size and one_n < other_n)"
    near = (F.col("one_size") >= F.col("other_size") * least - 1e-9) & (rest >= (F.col("one_size") + F.col("other_size")) * (least / (1 + least)) - 1e-9)
    new = F.expr("one_before is null or other_before is null or one_before != other_before")
    return _ordered(one.join(other, (F.col("one_h") == F.col("other_h")) & F.expr(smaller) & near & new), "one_n", "other_n")


def similar_roots(distinct: DataFrame, docs: DataFrame, text_col: str, width: int, least: float, bits: int, number: int) -> DataFrame:
    """(node, root) for texts that are linked with a lesser one. ``distinct``: a saved table (_own, n, bands), a row for each text.

    First each text is compared with the least one in each of its bands' own buckets, and in buckets of two with the other.
    That links large groups with as many comparisons as they have texts. All that are in larger buckets go to :func:`across`,
    which loses no similar pair of different components among them.
    """
    share, total = bit_share(least), bits * number
    differing = int(share * total + 4 * sqrt(total * share * (1 - share)))
    shared = saved(met(distinct, bits), "met")
    pairs = saved(_within(_ordered(shared.where("exact or rows = 2"), "first", "n"), distinct, differing), "pairs")
    links = verified(pairs, hashes_of(pairs.select(F.explode(F.array("a", "b")).alias("n")).distinct(), distinct, docs, text_col, width), least)
    roots = components(links, "a", "b")
    crowded = shared.where("rows > 2").select("n").distinct()
    rooted = saved(crowded.join(roots, F.col("n") == F.col("node"), "left").select("n", F.coalesce("root", "n").alias("root")), "crowded")
    if rooted.isEmpty():
        return roots
    hashes = hashes_of(rooted.select("n"), distinct, docs, text_col, width)
    later = verified(saved(across(rooted, hashes, least), "later"), hashes, least)
    return components(links.unionByName(later), "a", "b")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, least: float = 0.8, recall: float = 0.95) -> DataFrame:
    """The rows of ``docs`` whose id is the least of their component of texts with a similarity of ``least`` or more.

    All columns are kept, whatever their names. Rows of the same id and text are one document: they stay or go together. Rows
    with a null id stay only if their whole component has null ids. A null text is an empty one; an empty table gives an empty
    one. ``recall``: how likely a pair at ``least`` is met; nearer ones are met more often.
    """
    bits, number = band_plan(docs.count(), least, recall)
    sketches = saved(sketched(docs, id_col, text_col, width, bits, number), "sketches")
    distinct = saved(sketches.groupBy("_own").agg(F.min("bands").alias("bands")).withColumn("n", F.monotonically_increasing_id()), "distinct")
    roots = similar_roots(distinct, docs, text_col, width, least, bits, number)
    named = distinct.select("_own", "n").join(roots, F.col("n") == F.col("node"), "left").select("_own", F.coalesce("root", "n").alias("root"))
    rooted = sketches.select(id_col, "_own").join(named, "_own")
    rooted = saved(rooted, "rooted")
    classes = rooted.groupBy("root").agg(F.min(id_col).alias("component_id"))
    gone = rooted.join(classes, "root").where(~F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias("_id"), "_own").distinct()
    gone = saved(gone, "gone").hint("merge")  # it grows with the corpus
    mark = unused("_own_text", docs)
    tagged = docs.withColumn(mark, own_text(text_col))
    return tagged.join(gone, tagged[id_col].eqNullSafe(gone["_id"]) & (tagged[mark] == gone["_own"]), "left_anti").drop(mark)

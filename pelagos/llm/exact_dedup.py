"""Exact duplicates through a cuckoo-filter index of live digests.

An index has a cuckoo filter (Fan et al., "Cuckoo Filter: Practically Better Than Bloom", CoNEXT 2014) in front of buckets
that hold what the live texts are known by: SHA-256 and length, with the id of the row that stays and the number of live
copies. A probe that misses the filter is new; one that hits is verified against the content of its bucket, so a false
positive can never drop a text. Deleting a text's last copy takes its tag out of the filter. When an insertion finds no
place, the filter is doubled and refilled from the stored keys.

Every row goes through two of them. The first is that of its task: copies that a task has are met there, and as it keeps
``TASK_KEYS`` entries at most, the oldest are deleted from it and handed on. The second is that of the digest's shard, which
meets what the tasks hand on; a text with a third of all rows is a few entries of each task by then.
"""

from __future__ import annotations

import random
from array import array
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelagos.llm.common import joined_by_copies, one_of, saved, unused

#: Keys a shard of the index should hold; the number of shards follows the number of rows.
SHARD_KEYS = 500_000
#: Entries that a task's own index holds at most.
TASK_KEYS = 50_000


class CuckooIndex:
    """Live keys with their entries. A key is a digest, then anything else that it must agree in. Digests are at least 16 bytes and
    evenly spread, as those of a cryptographic hash are.

    A digest's first eight bytes pick its home bucket and bytes 8 and 9 are its tag; the other bucket of a tag is the home
    XOR a spread of the tag, which leads from either to the other.
    """

    SLOTS, KICKS = 4, 200

    def __init__(self, buckets: int = 1 << 10, seed: int = 0) -> None:
        self.mask = (1 << max(1, (buckets - 1).bit_length())) - 1
        self.random = random.Random(seed)
        self.resized = self.false_hits = self.hits = 0
        self._clear()

    def _clear(self) -> None:
        self.tags = array("H", bytes(2 * self.SLOTS * (self.mask + 1)))  # 0: free
        self.keys: list[dict[bytes, list] | None] = [None] * (self.mask + 1)  # by home bucket
        self.size = 0

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        tag = int.from_bytes(digest[8:10], "little") or 1
        home = int.from_bytes(digest[:8], "little") & self.mask
        return tag, home, home ^ (tag * 0x5BD1E995 & self.mask)

    def _has(self, tag: int, bucket: int) -> int:
        """A slot of the bucket that holds the tag, or -1."""
        at = bucket * self.SLOTS
        for i in range(at, at + self.SLOTS):
            if self.tags[i] == tag:
                return i
        return -1

    def _place(self, tag: int, home: int, other: int) -> bool:
        for bucket in (home, other):
            if (i := self._has(0, bucket)) >= 0:
                self.tags[i] = tag
                return True
        bucket = other
        for _ in range(self.KICKS):
            i = bucket * self.SLOTS + self.random.randrange(self.SLOTS)
            self.tags[i], tag = tag, self.tags[i]
            bucket ^= tag * 0x5BD1E995 & self.mask
            if (i := self._has(0, bucket)) >= 0:
                self.tags[i] = tag
                return True
        return False  # a tag is in hand: the caller refills from the keys

    def _grow(self) -> None:
        held = list(self.items())
        while True:
            self.mask = 2 * self.mask + 1
            self.resized += 1
            self._clear()
            if all(self._store(digest, entry) for digest, entry in held):
                return

    def _store(self, digest: bytes, entry: list) -> bool:
        tag, home, other = self._places(digest)
        if self.keys[home] is None:
            self.keys[home] = {}
        self.keys[home][digest] = entry
        self.size += 1
        return self._place(tag, home, other)

    def find(self, digest: bytes) -> list | None:
        """The entry of a live digest: the filter first, then, if it hits, the stored keys of its bucket."""
        tag, home, other = self._places(digest)
        if self._has(tag, home) < 0 and self._has(tag, other) < 0:
            return None
        entry = (self.keys[home] or {}).get(digest)
        self.false_hits += entry is None
        self.hits += entry is not None
        return entry

    def insert(self, digest: bytes, entry: list) -> None:
        """A digest that isn't live. Many equal tags fill their two buckets; then, or when it is nearly full, it doubles."""
        if self.size >= 0.94 * self.SLOTS * (self.mask + 1) or not self._store(digest, entry):
            if digest not in (self.keys[self._places(digest)[1]] or {}):
                self._grow()
                if self._store(digest, entry):
                    return
            self._grow()

    def delete(self, digest: bytes) -> bool:
        """Takes out a live digest; False if it isn't live, in which case nothing changes."""
        tag, home, other = self._places(digest)
        if self.find(digest) is None:
            return False
        del self.keys[home][digest]
        self.size -= 1
        at = self._has(tag, home)
        self.tags[at if at >= 0 else self._has(tag, other)] = 0
        return True

    def items(self) -> Iterator[tuple[bytes, list]]:
        for bucket in self.keys:
            yield from (bucket or {}).items()


def text_digest(text_col: str = "text"):
    """SHA-256 (lower-case hex) of a text with each run of ASCII white space as one space; null is empty."""
    return F.sha2(normalised(text_col).cast("binary"), 256)


def normalised(text_col: str = "text"):
    # most runs are one space already: only others are matched
    return F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, size, row): a saved table with a number for each row; equal texts have equal digests and sizes in bytes."""
    text = normalised(text_col).cast("binary")
    return saved(docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(text, 256)).alias("digest"), F.octet_length(text).cast("long").alias("size"), F.monotonically_increasing_id().alias("row")), "digests")


def _first(entry: list) -> tuple:
    """Orders ids, null last, and then rows."""
    return (1, entry[1]) if entry[0] is None else (0, entry[0], entry[1])


def _meet(index: CuckooIndex, key: bytes, who, row: int | None, n: int) -> bool:
    """Counts ``n`` copies in, or out if below 0; whether the key is a new one."""
    entry = index.find(key)
    if entry is None:
        if n > 0:
            index.insert(key, [who, row, n])
        return n > 0
    entry[2] += n
    if n > 0:
        entry[:2] = min([who, row], entry[:2], key=_first)
    elif entry[2] <= 0:
        index.delete(key)
    return False


def _entries(found: list[tuple[bytes, list]], schema: pa.Schema) -> pa.RecordBatch:
    columns = [[k[:32] for k, _ in found], [int.from_bytes(k[32:], "little") for k, _ in found], *([e[i] for _, e in found] for i in range(3))]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _task(batches: Iterator[pa.RecordBatch], schema: pa.Schema, most: int) -> Iterator[pa.RecordBatch]:
    """Runs rows (digest, size, id, row) through an index of at most ``most`` keys: what it holds, oldest first, as it must go."""
    index, order = CuckooIndex(), deque()
    out: list[tuple[bytes, list]] = []
    for batch in batches:
        for digest, size, who, row in zip(*(c.to_pylist() for c in batch.columns)):
            key = digest + size.to_bytes(8, "little")
            if _meet(index, key, who, row, 1):
                order.append(key)
                if index.size > most:
                    old = order.popleft()
                    out.append((old, index.find(old)))
                    index.delete(old)
        if len(out) >= 10_000:
            yield _entries(out, schema)
            out = []
    held = iter([*out, *index.items()])
    while part := [x for _, x in zip(range(50_000), held)]:
        yield _entries(part, schema)


def _shard(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Runs the rows (digest, size, id, row, n; n < 0 deletes) of a shard through its index; gives the live entries."""
    index = CuckooIndex()
    for batch in batches:
        for digest, size, who, row, n in zip(*(c.to_pylist() for c in batch.columns)):
            _meet(index, digest + size.to_bytes(8, "little"), who, row, n)
    held = index.items()
    while part := [x for _, x in zip(range(50_000), held)]:
        yield _entries(part, schema)


def live_index(keys: DataFrame, deleted: DataFrame | None = None, shard_keys: int = SHARD_KEYS, task_keys: int = TASK_KEYS) -> DataFrame:
    """(digest, size, keep_id, keep_row, copies) of all live texts of a saved table (id, digest, size, row).

    ``keep_id`` is the least id of the text (null only if all are) and ``keep_row`` its row. ``deleted``: (digest, size) of
    copies to take out, once for each row; a text without live copies leaves the index. Deletions count copies and don't move
    ``keep_id``: to retire the row that stays, give the rows that remain.
    """
    spark = keys.sparkSession
    who = keys.schema["id"].dataType.simpleString()
    ids = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}.get(who)
    if ids is None:
        raise TypeError(f"ids of type {who}; cast them to long or string")
    schema = pa.schema([("digest", pa.binary()), ("size", pa.int64()), ("keep_id", ids), ("keep_row", pa.int64()), ("copies", pa.int64())])
    table = f"digest binary, size long, keep_id {who}, keep_row long, copies long"
    rows = keys.select("digest", "size", "id", "row").mapInArrow(lambda batches: _task(batches, schema, task_keys), table)
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-keys.count() // shard_keys))
    if deleted is not None:
        gone = deleted.groupBy("digest", "size").agg((-F.count(F.lit(1))).alias("copies"))
        gone = gone.select("digest", "size", F.lit(None).cast(who).alias("keep_id"), F.lit(None).cast("long").alias("keep_row"), "copies")
        rows = rows.withColumn("step", F.lit(0)).unionByName(gone.withColumn("step", F.lit(1)))
    dealt = rows.repartition(shards, "digest")
    if deleted is not None:
        dealt = dealt.sortWithinPartitions("step").drop("step")
    return dealt.mapInArrow(lambda batches: _shard(batches, schema), table)


def _named(keys: DataFrame, live: DataFrame) -> DataFrame:
    """The rows of ``keys`` with what the index says of their text. ``live``: a saved table."""
    told = live.select(F.col("digest").alias("of"), "keep_id", "keep_row", "copies")
    return joined_by_copies(keys, told, "digest", "of", "copies", keys.count()).withColumn("kept", F.col("row") == F.col("keep_row"))


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: (id, keep_id, group_size, kept, text_sha256).

    Of equal texts the row with the least id stays, a null id last; of repeated rows with that id, one. A null text is
    empty. An empty table gives an empty one; other columns of ``docs`` are not read.
    """
    keys = digests(docs, id_col, text_col)
    found = _named(keys, saved(live_index(keys), "live"))
    return found.select(F.col("id").alias(id_col), "keep_id", F.col("copies").alias("group_size"), "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of equal texts that with the least id, a null id last.

    A null text is empty. Of rows that repeat the id that stays with its text, the one whose columns, written as JSON, come
    first stays. An empty table gives an empty one; columns of any names are kept.
    """
    keys = digests(docs, id_col, text_col)
    found = _named(keys, saved(live_index(keys), "live"))
    # rows that go, by id and digest; a row repeated with the id that stays is dealt with below. Their number grows with
    # the corpus, so they are met by a merge join at every size and never broadcast
    gone = saved(found.where(~F.col("id").eqNullSafe(F.col("keep_id"))).select("id", "digest").distinct(), "gone")
    again = saved(found.where("not kept").where(F.col("id").eqNullSafe(F.col("keep_id"))).select("id", "digest").distinct(), "again")
    own = unused("_digest", docs)
    tagged = docs.withColumn(own, F.unhex(text_digest(text_col)))
    same = lambda other: tagged[id_col].eqNullSafe(other["id"]) & (tagged[own] == other["digest"])
    if again.isEmpty():
        return tagged.join(gone.hint("merge"), same(gone), "left_anti").drop(own)
    out = gone.unionByName(again).hint("merge")
    single = tagged.join(out, same(out), "left_anti")
    repeated = one_of(tagged.join(again.hint("merge"), same(again), "left_semi"), [id_col, own])
    return single.unionByName(repeated).drop(own)

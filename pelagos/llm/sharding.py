"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

Every key has a place on a ring of 2**31 points, cut into arcs by the shards' virtual nodes; an arc's keys belong to the
shard of the node at its end (after Karger et al., STOC 1997). No shard takes more than its bound: keys that overflow a
full shard continue clockwise to the next one with room (Mirrokni, Thorup and Zadimoghaddam, "Consistent Hashing with
Bounded Loads", SODA 2018). The keys of an arc differ by their rank on the ring alone, so the walk is over arcs and
ranges of ranks. There are shards times virtual nodes of them, however many keys there are; only their counts reach
the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelagos.llm.common import ranked, saved
from pelagos.llm.ranges import looked_up

RING = 1 << 31


def ring(shards: int, nodes: int) -> list[tuple[int, int]]:
    """(point, shard) of all virtual nodes, in the ring's order."""
    return sorted((xxhash.xxh64_intdigest(f"shard {s} node {v}", 7) % RING, s) for s in range(shards) for v in range(nodes))


def walk(counts: list[int], owners: list[int], bounds: list[int]) -> list[tuple[int, int, int]]:
    """(arc, keys, shard) runs, arc by arc in the order of ranks: who takes how many of an arc's keys.

    First every shard takes keys of its own arcs, in the ring's order, up to its bound. Then the rest of each arc goes
    clockwise, from shard to shard with room. The bounds' sum is at least that of the counts.
    """
    room, taken, over = list(bounds), [], []
    for arc, (n, shard) in enumerate(zip(counts, owners)):
        own = min(n, room[shard])
        room[shard] -= own
        taken.append([(own, shard)] if own else [])
        over.append(n - own)
    for arc, left in enumerate(over):
        at = arc
        while left:
            at = (at + 1) % len(owners)
            if n := min(left, room[owners[at]]):
                room[owners[at]] -= n
                left -= n
                taken[arc].append((n, owners[at]))
    return [(arc, n, shard) for arc, runs in enumerate(taken) for n, shard in runs]


def even_bounds(total: int, shards: int, slack: float = 0.0) -> list[int]:
    """The shards' bounds. Without slack they add up to ``total``, so all get full and counts are at most one apart."""
    if slack:
        return [-int(-total * (1 + slack) // shards)] * shards
    return [total // shards + (s < total % shards) for s in range(shards)]


def shard_rows(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", nodes: int = 64, slack: float = 0.0, overhead: int = 16) -> DataFrame:
    """(id, size, text_crc32, shard, slot) for each row of ``docs``; ``slot`` is gapless from 0 in each shard.

    A key is an id, hashed to the ring; a null id has a place too. Rows with the same id are as many keys, next to each
    other. A null text has no bytes: size is ``overhead`` and the checksum 0. An empty table gives an empty one.
    """
    if shards < 1 or nodes < 1:
        raise ValueError("shards and nodes must be at least 1")
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    point = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(RING)).alias("point")
    keys = docs.select(F.col(id_col).alias("id"), (F.octet_length(data) + overhead).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), point)
    keys = saved(keys, "keys")
    placed = ranked(keys, "point", "id", "size", "text_crc32", name="ring")
    at = ring(shards, nodes)
    # past the last node, the arc goes on to the first
    held = arc_counts(keys, [p for p, _ in at])
    runs = walk(held, [s for _, s in at] + [at[0][1]], even_bounds(sum(held), shards, slack))
    plan: dict[str, list[int]] = {"first": [], "shard": [], "slot": []}
    rank, filled = 0, [0] * shards
    for _, n, shard in runs:
        for column, value in zip(plan.values(), (rank, shard, filled[shard])):
            column.append(value)
        filled[shard] += n
        rank += n
    rows = placed.select(F.col("id").alias(id_col), "size", "text_crc32", "rank")
    found = looked_up(rows, plan, lambda r, rank: (r["shard"], rank - r["first"] + r["slot"]), "shard long, slot long")
    return found.withColumn("shard", F.col("shard").cast("int"))


def arc_counts(keys: DataFrame, points: list[int]) -> list[int]:
    """Keys of each arc: those up to its node's point and past the node before; the last holds those past all nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends, total = np.array(points), np.zeros(len(points) + 1, np.int64)
        for batch in batches:
            total += np.bincount(np.searchsorted(ends, batch.column(0).to_numpy(zero_copy_only=False), side="left"), minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["arc", "n"])

    # at most one row for each arc reaches the driver
    rows = keys.select("point").mapInArrow(run, "arc long, n long").where("n > 0").groupBy("arc").agg(F.sum("n").alias("n")).collect()
    found = dict(map(tuple, rows))
    return [found.get(i, 0) for i in range(len(points) + 1)]

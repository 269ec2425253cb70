"""Looking rows up, by their rank, in a plan of rank ranges whose number doesn't grow with the data."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def looked_up(ranks: DataFrame, plan: dict[str, Sequence[int]], place, schema: str) -> DataFrame:
    """``ranks`` (with a long ``rank``) with the columns of ``schema``, which ``place(ranges, ranks)`` gives as arrays.

    ``plan["first"]``: the first rank of each range, ascending, from 0; its other columns hold what ``place`` needs.
    ``ranges`` has the plan's columns, one value for each row. The caller proves the bound on the plan's size.
    """
    plan_at = ranks.sparkSession.sparkContext.broadcast({k: np.asarray(v, np.int64) for k, v in plan.items()})
    names = [c for c in ranks.columns if c != "rank"]
    out = ranks.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = plan_at.value
        for batch in batches:
            rank = batch.column(batch.schema.names.index("rank")).to_numpy(zero_copy_only=False)
            at = np.searchsorted(held["first"], rank, side="right") - 1
            new = place({k: v[at] for k, v in held.items()}, rank)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.names.index(n)) for n in names), *(pa.array(np.asarray(c, np.int64)) for c in new)], names=[*names, *out.names])

    fields = ranks.drop("rank").schema
    for f in out:
        fields = fields.add(f)
    return ranks.mapInArrow(run, fields)

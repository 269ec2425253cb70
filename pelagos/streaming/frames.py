"""Frames over streams. What needs no order of all rows (selection, filters, arithmetic, strings) works on them as on tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from pelagos import types as t
from pelagos.operators.frame import DataFrame
from pelagos.plans.plan import Plan, fresh, session


def read_stream(path: str, schema: StructType | str, form: str = "parquet", **options) -> DataFrame:
    """A frame over files as they arrive in a folder."""
    raw = session().readStream.schema(schema).options(**options).format(form).load(path)
    names = {c: fresh() for c in raw.columns}
    sdf = raw.select(*[raw[f"`{c}`"].alias(n) for c, n in names.items()])
    return DataFrame._of(Plan(sdf), {f.name: (F.col(names[f.name]), t.from_spark(f.dataType)) for f in raw.schema})


def write_stream(frame: DataFrame, path: str, checkpoint: str, form: str = "parquet", available_now: bool = True) -> StreamingQuery:
    """Appends what arrives to a folder; ``available_now``: what is there, and then ends."""
    writer = frame.to_spark().writeStream.format(form).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start(path)

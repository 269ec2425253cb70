"""What the corpus operators share: the shared folder, saved tables, distributed ranks."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space; bytes.split() cuts at exactly these bytes.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

#: Keys that more rows have than one in so many are met by a broadcast: there are fewer than so many of them.
HOT_KEYS = 4096

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary folder; a cluster gets an error, as a folder
    of one machine is of no use there.
    """
    if found := spark.conf.get("spark.checkpoint.dir", ""):
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="pelagos-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return f"file://{_own[app]}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/pelagos/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` as a Parquet table in the shared folder: cuts the lineage, and a lost executor loses nothing."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(name: str, *frames: DataFrame) -> str:
    """``name``, with more underscores if a frame has a column of that name in any case."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def own_columns(df: DataFrame) -> list:
    """All columns of ``df``, whatever characters their names have."""
    return [df["`" + c.replace("`", "``") + "`"] for c in df.columns]


def ranked(df: DataFrame, *keys: str, name: str = "ranked", into: str = "rank") -> DataFrame:
    """``df`` with ``into``: each row's place from 0 in the order of ``keys`` over all rows.

    The rows are range-partitioned, so no task sees more than its range; the places before a partition
    come from one count for each partition. Ties get different places in any order. The table is saved,
    so that the places stay the same when a lost task is run again.
    """
    # a range sort runs its input twice (once to sample it): callers pass saved tables
    table = saved(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), name)
    part = F.shiftright("_at", 33)
    # one row for each partition of the sort, so the window and the broadcast are bounded by their number
    counts = table.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = counts.select("_part", before.alias("_base"))
    place = (F.col("_base") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).alias(into)
    return table.withColumn("_part", part).join(F.broadcast(bases), "_part").select(*df.columns, place)


def joined_by_copies(rows: DataFrame, index: DataFrame, key: str, of: str, copies: str, total: int) -> DataFrame:
    """``rows`` joined with a saved table that has each ``key`` once, as ``of``, and the number of its rows, ``copies``.

    Keys with more than one in ``HOT_KEYS`` of the ``total`` rows are met by a broadcast, which so has fewer than
    ``HOT_KEYS`` rows; no other key has enough rows to burden a task. Null keys meet null keys; ``of`` is dropped.
    """
    most = max(1, -(-total // HOT_KEYS))
    hot, cold = F.broadcast(index.where(F.col(copies) > most)), index.where(F.col(copies) <= most)
    same = F.col(key).eqNullSafe(F.col(of))
    left = rows.join(hot.select(of), same, "left_anti")
    return rows.join(hot, same).drop(of).unionByName(left.join(cold, same).drop(of))


def one_of(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row of ``df`` for each value of ``keys``: that whose columns, written as JSON, come first. Nulls are a value."""
    every = F.struct(*own_columns(df))
    first = df.groupBy(*["`" + k.replace("`", "``") + "`" for k in keys]).agg(F.min_by(every, F.to_json(every)).alias("_first"))
    return first.select("_first.*")


def text_bytes(column: str):
    """A text column as its UTF-8 bytes; null is empty. The cast copies nothing."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")

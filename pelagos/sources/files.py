"""Files: CSV and Parquet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from pelagos import types as t
from pelagos.operators.frame import DataFrame
from pelagos.plans.plan import Plan, fresh, session


def read_parquet(path: str, columns: list[str] | None = None) -> DataFrame:
    """A frame over a Parquet table. Rows are ordered by file and row; only the columns that a query uses are read."""
    raw = session().read.parquet(path)
    names = {c: fresh() for c in (columns or raw.columns)}
    kinds = {f.name: t.from_spark(f.dataType) for f in raw.schema}
    file, row = fresh("file"), fresh("row")
    sdf = raw.select(*[raw[f"`{c}`"].alias(n) for c, n in names.items()], F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(row))
    return DataFrame._of(Plan(sdf, ((file, True), (row, True)), "file"), {c: (F.col(n), kinds[c]) for c, n in names.items()})


def read_csv(
    filepath: str,
    sep: str = ",",
    header: int | str | None = "infer",
    names: list[str] | None = None,
    usecols: list | None = None,
    dtype: dict | str | None = None,
    converters: dict[str, Callable] | None = None,
    skiprows: int | None = None,
    nrows: int | None = None,
) -> DataFrame:
    """A frame over CSV files.

    ``header``: "infer" (the first line, unless there are ``names``), 0 or None. Column types are inferred unless ``dtype`` has them
    all. ``converters``: functions from Column to Column by name. ``skiprows``: leading lines to skip, in a single file; ``nrows``: rows to
    read.
    """
    spark = session()
    has_header = header == 0 or header == "infer" and names is None
    options = {"sep": sep, "header": has_header, "inferSchema": dtype is None or isinstance(dtype, dict)}
    if skiprows:
        # Spark's CSV reader can't skip lines: they are numbered as text first
        lines = spark.read.text(filepath).rdd.zipWithIndex().filter(lambda x: x[1] >= skiprows).map(lambda x: x[0][0])
        raw = spark.read.options(**options).csv(lines)
    else:
        raw = spark.read.options(**options).csv(filepath)
    given = [f"Unnamed: {i}" if c == f"_c{i}" and has_header else str(i) if not has_header else c for i, c in enumerate(raw.columns)]
    if names is not None:
        given = [*names, *given[len(names) :]]
    at = fresh("at")
    columns = {c: fresh() for c in given}
    sdf = raw.toDF(*columns.values()).withColumn(at, F.monotonically_increasing_id())
    kinds = {f.name: f.dataType for f in sdf.schema}
    wanted = usecols if usecols is not None else given
    chosen = [given[c] if isinstance(c, int) else c for c in wanted]
    if unknown := [c for c in chosen if c not in columns]:
        raise ValueError(f"no columns {unknown}")
    out = {}
    for c in [c for c in given if c in chosen]:
        expr, kind = F.col(columns[c]), t.from_spark(kinds[columns[c]])
        if kind.char == "i":  # inferred integers are of 64 bits
            expr, kind = expr.cast("bigint"), t.LONG
        if converters and c in converters:
            expr = converters[c](expr)
            kind = t.from_spark(sdf.select(expr).schema[0].dataType)
        said = dtype.get(c) if isinstance(dtype, dict) else dtype
        if said is not None:
            kind = t.dtype_of(said)
            expr = t.cast(expr, kind)
        out[c] = (expr, kind)
    plan = Plan(sdf, ((at, True),), "key")
    return DataFrame._of(plan if nrows is None else plan.head(nrows), out)


def to_csv(frame: DataFrame, filepath: str, sep: str = ",", header: bool = True, index: bool = True, single_file: bool = False) -> None:
    """Writes a folder of CSV files, or with ``single_file`` a folder of one, in the frame's order."""
    out = frame.to_spark(include_index=index, sort=single_file)
    (out.coalesce(1) if single_file else out).write.options(sep=sep, header=header).csv(filepath)

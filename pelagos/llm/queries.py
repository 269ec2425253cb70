"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pelagos.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pelagos.llm.licenses import scanned

    return scanned(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pelagos.llm.mixing import mixed

    return mixed(table(spark, sf_dir, "documents")).withColumn("taken", F.col("size") * F.col("copies"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pelagos.llm.warc import archived

    found = archived(table(spark, sf_dir, "pages"), with_payload=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pelagos.llm.packing import packed

    return packed(table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pelagos.llm.html_text import extracted

    return extracted(table(spark, sf_dir, "pages"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pelagos.llm.quality_rules import judged, learned_rules

    docs = table(spark, sf_dir, "documents")
    return judged(docs, learned_rules(docs, table(spark, sf_dir, "labels")))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pelagos.llm.toxicity import scored

    found = scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pelagos.llm.sharding import shard_rows

    found = shard_rows(table(spark, sf_dir, "documents"), 40)
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pelagos.llm.exact_dedup import duplicates

    return duplicates(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_simhash, op2_licenses, op3_mixing, op4_warc, op5_packing, op6_html, op7_quality, op8_toxicity, op9_sharding, op10_exact_dedup)}



_SIZED = r"SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents"

_MIXING = f"""
WITH sized AS MATERIALIZED ({_SIZED}),
sources AS (SELECT source, sum(size)::BIGINT AS source_size, 2.0::DOUBLE * sum(size)::DOUBLE AS cap FROM sized GROUP BY source),
weighed AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight FROM sources),
filled AS (SELECT *, cap / weight AS ratio, sum(cap) OVER w AS used, sum(weight) OVER w AS gone FROM weighed WINDOW w AS (ORDER BY cap / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
steps AS (
  SELECT ratio, used - cap AS used, (SELECT sum(weight) FROM weighed) - (gone - weight) AS open FROM filled
), level AS (
  SELECT ((SELECT 1.5::DOUBLE * sum(source_size)::DOUBLE FROM sources) - used) / open AS level FROM steps
  WHERE ratio > ((SELECT 1.5::DOUBLE * sum(source_size)::DOUBLE FROM sources) - used) / open ORDER BY ratio LIMIT 1
),
plan AS (SELECT source, source_size, least(cap, weight * (SELECT level FROM level)) AS target FROM weighed),
rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size * 16777216 + 0.5) AS BIGINT) ELSE 0 END AS rate,
    CAST('0x' || substr(md5(coalesce(source, '')), 1, 6) AS BIGINT) AS u FROM plan
),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size DESC, doc_id) - 1 AS at_ FROM sized)
SELECT doc_id, size, source_size, target, ((u + (at_ + 1) * rate) >> 24) - ((u + at_ * rate) >> 24) AS copies, size * (((u + (at_ + 1) * rate) >> 24) - ((u + at_ * rate) >> 24)) AS taken
FROM placed JOIN rates ON placed.source IS NOT DISTINCT FROM rates.source
"""

_WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, 5 * (i // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INTEGER) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN g USING (h)
"""

_EXACT = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS n FROM documents),
g AS (SELECT n, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n) AS text_sha256 FROM t JOIN g USING (n)
"""


def _oracles() -> dict[str, str]:
    from pelagos.llm import licenses

    return {"op2_licenses": licenses.oracle_sql(), "op3_mixing": _MIXING, "op4_warc": _WARC, "op10_exact_dedup": _EXACT}


#: The others hash or tokenize as SQL can't, walk a graph, or learn: tests hold them against brute force.
ORACLE_SQL: dict[str, str] = _oracles()

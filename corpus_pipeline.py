"""The corpus pipeline: documents in, placed sequences out.

Each stage takes and returns a DataFrame. The driver writes what a stage returns as Parquet and gives it to the next;
:func:`run` does the same in the shared folder, so that each stage starts from a table and not from a long lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pelagos.llm import exact_dedup, mixing, packing, quality_rules, simhash
from pelagos.llm.common import saved
from pelagos.llm.queries import table, tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and those learned from the labels."""
    rules = quality_rules.learned_rules(docs, table(spark, sf_dir, "labels"))
    return quality_rules.drop_rejected(docs, rules)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, that with the least id."""
    return exact_dedup.drop_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts with a similarity of 0.8 or more, by shingles of five words, the document with the least id."""
    return simhash.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes, in sequences of 4096 tokens."""
    return packing.packed(docs, tokenizer_path(), with_ids=False)


STAGES = [("quality rules", quality), ("exact dedup", exact), ("near-duplicates", near), ("mixing", mix), ("packing", pack)]

#: No stage of the last three can be said in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if stage is not pack:
            docs = saved(docs, name.replace(" ", "-"))
    return docs

"""Every registered query of the engine against its SQL, and the plans that matter."""

import os
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from pelagos.plans import catalogue

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        c.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", catalogue.QUERIES)
def test_query(spark, duck, name):
    found = catalogue.QUERIES[name](spark, DATA).toPandas()
    if name not in catalogue.ORACLE_SQL:
        assert len(found)
        return
    wanted = duck.sql(catalogue.ORACLE_SQL[name]).df()
    columns = sorted(wanted.columns)
    assert sorted(found.columns) == columns
    order = lambda df: df[columns].sort_values(columns).reset_index(drop=True)
    pd.testing.assert_frame_equal(order(found), order(wanted), check_dtype=False, check_exact=True)


def plan(spark, name):
    return catalogue.QUERIES[name](spark, DATA)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(spark, "filter_conj")
    assert "LessThan(l_quantity,24.0)" in text and "GreaterThanOrEqual(l_discount,0.05)" in text
    assert "l_shipdate" not in text.split("ReadSchema")[1].split("\n")[0]
    assert "Exchange" not in text and "Window" not in text


def test_groups_combine_before_they_shuffle(spark):
    text = plan(spark, "group_sum")
    assert text.count("HashAggregate") >= 2 and "partial_sum" in text and "Window" not in text


def test_top_rows_are_a_top_k(spark):
    assert "TakeOrderedAndProject" in plan(spark, "sort_topk")
    assert "Window" not in plan(spark, "sort_topk")


def test_sorts_by_date_are_numbered_in_parts(spark):
    text = plan(spark, "sort_by_date")
    assert "hashpartitioning" in text and not any("SinglePartition" in x and "o_orderkey" in x for x in text.split("\n\n"))


def test_short_slices_are_a_top_k(spark):
    for name in ("slice", "slice_step", "iloc_int"):
        assert "TakeOrderedAndProject" in plan(spark, name), name


def test_hash_joins_hash(spark):
    text = plan(spark, "join_hash")
    assert "ShuffledHashJoin" in text or "BroadcastHashJoin" in text


def test_expressions_stay_in_the_jvm(spark):
    for name in ("arith_scalar", "unary_exp", "unary_erf", "str_slice_step", "udf_column_fn", "udf_template"):
        assert "Python" not in plan(spark, name) and "Arrow" not in plan(spark, name)


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_streams(spark, tmp_path):
    from pelagos.streaming.frames import read_stream, write_stream

    schema = spark.read.parquet(f"{DATA}/events.parquet").schema
    spark.read.parquet(f"{DATA}/events.parquet").write.parquet(f"{tmp_path}/in")
    frame = read_stream(f"{tmp_path}/in", schema)
    few = frame[frame["value"] > 50.0][["event_id", "value"]]
    write_stream(few, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == spark.read.parquet(f"{tmp_path}/in").where("value > 50").count()

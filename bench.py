"""Times the headline queries and prints one JSON line.

written to Spark's noop sink.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

ROOT = str(Path(__file__).resolve().parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "5"))

QUERIES = {
    "filter": "filter_conj",
    "agg_4x": "agg_multi",
    "op_3x": "arith_scalar",
    "udf_exp": "unary_exp",
    "groupby_var": "group_var",
    "join": "join_orders_customer",
    "join_grouped": "join_inner",
    "join_multi_key": "join_multi_key",
    "pipeline": "bench_pipeline",
    "sort_topk": "sort_topk",
    "drop_duplicates": "drop_duplicates_subset_min",
    "strings": "str_split_right",
    "align": "align_setitem",
    "positions": "slice_step",
    "number_by_date": "sort_by_date",
}


def main() -> None:
    from pyspark.sql import SparkSession

    from pelagos.plans import catalogue

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name, query in QUERIES.items():
        took = []
        for _ in range(RUNS + 1):
            began = time.perf_counter()
            catalogue.QUERIES[query](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        seconds[name] = round(statistics.median(took[1:]), 4)
    spark.stop()
    sf = Path(SF_DIR).name.removeprefix("sf")
    print(json.dumps({"metric": "total of median query times", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))


if __name__ == "__main__":
    main()

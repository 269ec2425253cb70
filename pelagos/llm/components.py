"""Connected components by alternating large-star and small-star steps.

After Kiveris et al., "Connected Components in MapReduce and Beyond" (SoCC 2014). Each step is a
minimum by key and a join with it, both of which Spark can combine early and split when a key is hot;
no neighbourhood is ever gathered in a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelagos.llm.common import saved


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, left: str, right: str, rounds: int = 60) -> DataFrame:
    """(node, root) for every node that an edge names and that isn't its component's least node.

    Edges in any direction, repeated or from a node to itself are allowed; those with a null end are left out. An empty
    table gives an empty one. Rounds grow with the logarithm of the longest path; ``rounds`` only guards against endless
    loops, and running out of it is an error.
    """
    a, b = F.col(left), F.col(right)
    now = saved(edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    state = _state(now)
    for _ in range(rounds):
        if not state[0]:
            break
        now = saved(_small_star(_large_star(now)), "edges")
        was, state = state, _state(now)
        if was == state:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))

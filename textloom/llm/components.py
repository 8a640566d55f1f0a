"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step finds the lowest neighbour of every node by an aggregation (with partial minima, so that a hub is no heavy group) and joins it back; the number of rounds
grows with the logarithm of the longest path. Every round is checkpointed, so a lost executor costs no more than its round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.session import cut


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u")).toDF("u", "v")
    low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return both.filter("v > u").join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every id in the two columns of edges but the roots themselves; root is the component's lowest id."""
    a, b = edges.columns
    now = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct())
    state = None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if seen == state or not seen[0]:
            return now.select(F.col("u").alias("id"), F.col("v").alias("root"))
        state, now = seen, cut(_small(_large(now)))

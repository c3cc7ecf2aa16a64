"""Connected components of an edge table, as alternating star contractions.

Every round is two grouped minima and two joins over edges; only two counters reach the driver. Minima are combined
before they are shuffled, and what is found for hubs is broadcast: there are few of them, with many edges each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import cut, looked_up


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _low(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.union(edges.select("v", "u")).toDF("u", "v")
    low = _low(both).withColumn("m", F.least("u", "m"))
    met = looked_up(both.where("v > u"), low, "u", 2 * total)
    return met.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    low = _low(edges)
    met = looked_up(edges, low, "u", total).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return met.where("u != v").union(low.select("u", "m")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b): long, in any order, repeats allowed. Returns (node, component): the least node reachable.

    Nodes without an edge to another node have no row. Rounds grow with the logarithm of the longest chain.
    """
    ab = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    now = cut(ab)
    before, state = None, _state(now)
    while state != before and state[0]:
        now = cut(_small_star(cut(_large_star(now, state[0])), state[0]))
        before, state = state, _state(now)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v"), F.col("v")).distinct()
    )

"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import shared

MOST_ROUNDS = 60


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the least node of node's component. edges: (a long, b long), in any direction, repeats allowed.

    Nodes without an edge (or only with themselves) have no row. Each round joins neighbours to their least one; hot
    nodes are reduced by partial minima before rows move, and their rows aren't dealt by them.
    """
    now = shared.written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(MOST_ROUNDS):
        state = _state(now)
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = state
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = shared.written(both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")))
        large = shared.join_hot(both.where("b > a"), least, "a", state[0]).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = shared.written(large)
        shared.drop(now, least)
        least = shared.written(large.groupBy("a").agg(F.min("b").alias("m")))
        small = shared.join_hot(large, least, "a", state[0]).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        now = shared.written(small)
        shared.drop(large, least)
    raise ValueError("components don't settle")

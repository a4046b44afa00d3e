"""Connected components by alternating large-star and small-star steps, as DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _least(edges: DataFrame) -> DataFrame:
    """The smallest of each node and its neighbours; map-side partial minima keep a hub's edges apart."""
    return edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.join(_least(both), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    joined = down.join(_least(down), "a")
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(joined.select("a", F.col("m").alias("b"))).distinct()


def connected(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges (a long, b long) -> node, component: the smallest node that it reaches.

    Nodes without an edge do not appear.  Self loops and repeated edges change nothing; rows with a null are dropped.
    Each round's edges are written to the shared folder, which keeps plans short and survives lost executors.
    """
    now = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = common.materialize(now, "edges")
    before = None
    for _ in range(max_rounds):
        last, now = now, common.materialize(_small_star(_large_star(now)), "edges")
        common.discard(last)
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = state
    raise RuntimeError(f"no fixed point of the star steps in {max_rounds} rounds")

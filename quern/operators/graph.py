"""Connected components of an undirected graph by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.sources.scratch import Scratch


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Large: every node hands the smallest of itself and its neighbours to its larger neighbours.
    Small: it hands the smallest to its smaller neighbours and itself."""
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if not large:
        both = both.where("b < a")
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = both.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component): the smallest node that edges (a, b) of longs lead to.

    Nodes without edges are not in the result. Each round is written to the shared folder, so
    neither lineage nor the driver grows with the graph; rounds grow as a power of the logarithm.
    """
    now = scratch.table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        new = scratch.table(_stars(_stars(now, True), False))
        told = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(now)
        now = new
        if tuple(told) == state:
            break
        state = tuple(told)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())

"""Connected components of a graph of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpuslens.llm import common


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Point the larger (or the smaller) neighbours of each node to its least neighbour or itself."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if not large:
        # Each edge once, at its larger end.
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    out = both.join(least, "a")
    if large:
        moved = out.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = out.select("b", "m").union(least).toDF("a", "b")
    return moved.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b): each node that is not the least of its component, with the least.  ``edges`` has a and b.

    Every round is written to the shared folder.  The rounds grow with the logarithm of the longest
    chain of links; a node with many links is one counted row before it meets its neighbours.
    """
    now = common.written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(
        F.col("a") != F.col("b")).distinct(), "edges")
    state = None
    while True:
        after = common.written(_star(_star(now, True), False), "edges")
        seen = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state:
            return after
        now, state = after, seen

"""Connected components by alternating stars, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (a, b) with a > b."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        moved = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        joined = edges.join(least, "a")
        moved = joined.select(
            F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")
        ).select("e.a", "e.b")
    return moved.where("a > b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component_id) of every node that has an edge.

    ``edges`` holds two long columns, a and b, in any order; loops, nulls and
    repeated rows are ignored. ``component_id`` is the smallest node that can
    be reached. Each round is two small shuffles; the rounds needed grow with
    the logarithm of the longest path. A hub's edges are joined to one row, so
    adaptive execution can split it.
    """
    at = edges.select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).where("a > b").distinct()
    at = cut(at)
    mark = None
    while True:
        at = cut(_stars(_stars(at, large=True), large=False))
        now = at.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    leaves = at.select(F.col("a").alias("node"), F.col("b").alias("component_id"))
    roots = at.select(F.col("b").alias("node"), F.col("b").alias("component_id")).distinct()
    return leaves.unionByName(roots)

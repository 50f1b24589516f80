"""Connected components by alternating stars, as rounds of joins.

In a large star every node hands its larger neighbours to its least neighbour;
in a small star its smaller ones. Both keep components; the edges become stars
around each component's least node in a logarithmic number of rounds. Each round
is written, so a lost executor repeats one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import matched, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over (a, b) with a < b."""
    down = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    near = down.unionByName(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))) if large else down
    least = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))  # partial minima first
    joined = near.join(matched(least), "u")
    if large:
        moved = joined.filter(F.col("v") > F.col("u")).select(F.col("m").alias("a"), F.col("v").alias("b"))
    else:
        moved = joined.select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(
            least.select(F.col("m").alias("a"), F.col("u").alias("b"))
        )
    return moved.filter(F.col("a") < F.col("b")).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes but the roots; ``edges`` has columns a and b."""
    now = written(
        edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .filter(F.col("a") < F.col("b"))
        .distinct(),
        "edges",
    )
    mark = _mark(now)
    while True:
        now = written(_star(_star(now, True), False), "edges")
        new = _mark(now)
        if new == mark:
            return now.select(F.col("b").alias("node"), F.col("a").alias("root"))
        mark = new

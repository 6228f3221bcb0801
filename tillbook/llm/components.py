"""Connected components by alternating star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tillbook.operators.staging import staged

# Edges or nodes of one file between rounds.
ROWS = 1 << 17


def components(edges: DataFrame) -> DataFrame:
    """``node, head`` of every node that has an edge ``a, b``: ``head`` is the least
    node that it is connected with.

    Each round hangs larger neighbours, then smaller ones, on a node's least
    neighbour, until all edges form stars around the least node of each; the number of
    rounds grows with the logarithm of the number of nodes. Hubs are never gathered: minima
    are combined before the shuffle and stored, so that both sides of the joins with them
    come straight from a shuffle, whose skewed partitions adaptive execution splits.
    What a round stores is a final aggregate, spread by hash, in files of ROWS edges rather
    than one for each partition of the shuffle: no round has more edges than there were.
    """
    size = Observation()
    stars = _downward(edges.filter("a != b").select("a", "b")).observe(size, F.count("*").alias("edges"))
    stars = staged(stars, "stars")
    files = size.get["edges"] // ROWS + 1
    while True:
        both = stars.union(stars.select("b", "a"))
        # A node of a star has one neighbour, or none that is smaller. What the write
        # counts spares a round that moves nothing, and a job that compares its edges.
        unlike = Observation()
        near = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        near = near.observe(unlike, F.count_if(F.expr("n > 1 and m < a")).alias("nodes"))
        least = staged(near.select("a", F.least("a", "m").alias("m")).coalesce(files), "stars-least")
        if not unlike.get["nodes"]:
            break
        outer = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        outer = staged(outer.coalesce(files), "stars")
        least = staged(outer.groupBy("a").agg(F.min("b").alias("m")).coalesce(files), "stars-least")
        inner = outer.join(least, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        stars = staged(inner.union(least.select("a", F.col("m").alias("b"))).distinct().coalesce(files), "stars")
    heads = stars.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("head"))
    return stars.select(F.col("a").alias("node"), F.col("b").alias("head")).union(heads)


def _downward(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

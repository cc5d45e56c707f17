"""Connected components of an edge table, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every node of ``edges`` (a, b); the component is its smallest id.

    Each round, every node takes its smallest neighbour, if smaller, and that one's choice
    in turn; nodes that chose alike become one, and the edges between what is left go on to
    the next round. Rounds grow with the logarithm of the longest chain, and edges shrink
    from round to round. Spark combines minima before the shuffle; each round's results are
    stored tables.
    """
    left = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    labels = stored(left.select(F.col("a").alias("id")).union(left.select("b")).distinct().withColumn("component", F.col("id")))
    while not left.isEmpty():
        chosen = left.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("up"))  # a < b, so nodes that are never b stay
        above = chosen.select(F.col("id").alias("up"), F.col("up").alias("top"))
        chosen = stored(chosen.join(above, "up", "left").select("id", F.coalesce("top", "up").alias("to")))
        labels = stored(labels.join(chosen.select(F.col("id").alias("component"), "to"), "component", "left").select("id", F.coalesce("to", "component").alias("component")))
        moved = left.join(chosen.select(F.col("id").alias("a"), F.col("to").alias("to_a")), "a", "left").join(chosen.select(F.col("id").alias("b"), F.col("to").alias("to_b")), "b", "left")
        moved = moved.select(F.coalesce("to_a", "a").alias("x"), F.coalesce("to_b", "b").alias("y")).where("x <> y")
        left = stored(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    return labels

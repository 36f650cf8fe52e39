"""Connected components by alternating large-star and small-star (DataFrame operations only).

Both operators point nodes at smaller ones and keep the components as they are; their alternation ends in stars around each component's
smallest node.  A hub is a key of a join whose other side has one row for it, so its rows can be split among tasks.  Every round is
written to the shared folder, which cuts the lineage and lets executors be lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.cut import discard, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every node that has an edge: component is the smallest node reachable.

    Edges have no direction; repeated edges, loops and edges with a null end add nothing.  No edges, no rows.  Extra columns are ignored."""
    ends = edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    current = materialize(ends.filter("a <> b").distinct(), "edges")
    before = _state(current)
    while before[0]:
        following = materialize(_small_star(_large_star(current)), "stars")
        after = _state(following)
        discard(current)
        current = following
        if after == before:
            break
        before = after
    return current.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(current.select(F.col("b").alias("id"), F.col("b").alias("component"))).distinct()

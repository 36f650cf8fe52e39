"""Strongly connected components of any graph, as loops of joins.

Vertices that depend on each other directly are in one component, so what such pairs connect is contracted first, in few rounds however deep it is.  What is
left goes through trimming, forward colouring and backward confirmation.  The loops work on hashes of the names, which are checked to be distinct.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.cut import discard, materialize
from . import local
from .connected import components as connected


def trim(edges: DataFrame) -> DataFrame:
    """The edges left when vertices without predecessor or without successor are taken away again and again."""
    current = materialize(edges.select("src", "dst").filter("src <> dst").distinct(), "edges")
    size = current.count()
    while size:
        both = current.join(current.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(current.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        smaller = materialize(both.select("src", "dst"), "edges")
        left = smaller.count()
        discard(current)
        current = smaller
        if left == size:
            break
        size = left
    return current


def _colours(edges: DataFrame) -> DataFrame:
    """(name, colour): the smallest vertex that reaches each vertex."""
    state = materialize(edges.select(F.explode(F.array("src", "dst")).alias("name")).distinct().withColumn("colour", F.col("name")), "colours")
    while True:
        offers = edges.join(state.withColumnRenamed("name", "src"), "src").select(F.col("dst").alias("name"), "colour")
        after = materialize(state.unionByName(offers).groupBy("name").agg(F.min("colour").alias("colour")), "colours")
        changed = not after.join(state, ["name", "colour"], "left_anti").isEmpty()
        discard(state)
        state = after
        if not changed:
            return state


def _numbered(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, name) of the vertices, ids being hashes that tell them apart, and the edges (src, dst) by id."""
    seed = 0
    while True:
        number = lambda c, n=seed: F.xxhash64(F.lit(n), F.col(c))
        vertices = materialize(edges.select(F.explode(F.array("src", "dst")).alias("name")).select(number("name").alias("id"), "name").distinct(), "vertices")
        if vertices.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
            return vertices, edges.select(number("src").alias("src"), number("dst").alias("dst"))
        discard(vertices)
        seed += 1


def _by_rounds(edges: DataFrame) -> DataFrame | None:
    """(name, root) of the vertices in components of two or more, None if there are none.

    In a round, each vertex takes the smallest vertex that reaches it as colour; what reaches the colour's own vertex inside the colour is its
    component, and goes.  The rest is trimmed and goes around again."""
    found = None
    left = trim(edges)
    while not left.isEmpty():
        colours = _colours(left)
        inside = left.join(colours.select(F.col("name").alias("src"), "colour"), "src").join(colours.select(F.col("name").alias("dst"), F.col("colour").alias("other")), "dst").filter("colour = other")
        inside = materialize(inside.select("src", "dst", F.col("colour").alias("root")), "inside")
        confirmed = frontier = materialize(colours.filter("name = colour").select("name", F.col("colour").alias("root")), "roots")
        while True:
            new = inside.join(frontier.select(F.col("name").alias("dst"), "root"), ["dst", "root"], "left_semi").select(F.col("src").alias("name"), "root").distinct()
            new = materialize(new.join(confirmed, ["name", "root"], "left_anti"), "back")
            if new.isEmpty():
                break
            confirmed, frontier = confirmed.unionByName(new), new
        confirmed = materialize(confirmed, "confirmed")
        found = confirmed if found is None else found.unionByName(confirmed)
        gone = confirmed.select("name")
        rest = left.join(gone.withColumnRenamed("name", "src"), "src", "left_anti").join(gone.withColumnRenamed("name", "dst"), "dst", "left_anti")
        left = trim(rest.select("src", "dst"))
    if found is None:
        return None
    several = found.groupBy("root").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("root")
    return found.join(several, "root", "left_semi").select("name", "root")


def components(edges: DataFrame) -> DataFrame:
    """(name, root) of the vertices in components of two or more; root is the component's smallest vertex."""
    few = local.small_edges(edges)
    if few is not None:
        return edges.sparkSession.createDataFrame(local.strong_components(few), "name string, root string")
    vertices, numbered = _numbered(edges)
    ends = numbered.filter("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), (F.col("src") < F.col("dst")).alias("up"))
    pairs = materialize(ends.groupBy("a", "b").agg(F.min("up").alias("low"), F.max("up").alias("high")), "pairs")
    tied = materialize(connected(pairs.filter("low <> high")), "tied")
    as_one = lambda n: tied.select(F.col("id").alias(n), F.col("component").alias(f"{n}_c"))
    one_way = pairs.filter("low = high").select(F.when(F.col("high"), F.col("a")).otherwise(F.col("b")).alias("src"), F.when(F.col("high"), F.col("b")).otherwise(F.col("a")).alias("dst"))
    found = _by_rounds(one_way.join(as_one("src"), "src", "left").join(as_one("dst"), "dst", "left").select(F.coalesce("src_c", "src").alias("src"), F.coalesce("dst_c", "dst").alias("dst")))
    together = tied.select("id", F.col("component").alias("c"))
    if found is not None:
        further = tied.join(found, tied["component"] == found["name"], "left").select("id", F.coalesce("root", "component").alias("c"))
        together = further.unionByName(found.join(tied, found["name"] == tied["id"], "left_anti").select(F.col("name").alias("id"), F.col("root").alias("c")))
    named = materialize(together.join(vertices, "id").select("name", "c"), "named")
    for x in (pairs, vertices):
        discard(x)
    return named.join(named.groupBy("c").agg(F.min("name").alias("root")), "c").select("name", "root")

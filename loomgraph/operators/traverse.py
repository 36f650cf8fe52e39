"""Reachability, one shortest path, and the subgraph of all paths, as loops of joins.

A loop's step joins the frontier with the edges, on whichever side AQE finds small, and writes what it found: one small table a step.  Nothing
but counts comes to the driver.  Graphs of few edges, which are counted first, are worked on by the kernels of ``local``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.cut import discard, materialize
from . import local

#: Rounds after which the tables of what has been seen are written as one.
TOGETHER = 8


def _few(edges: DataFrame, *sets: DataFrame) -> tuple | None:
    """The edges and sets as Python collections, if all of them are small."""
    found = [local.small_edges(edges)]
    for x in sets:
        if found[-1] is None:
            return None
        found.append(local.small_names(x))
    return None if found[-1] is None else tuple(found)


def _next(frontier: DataFrame, edges: DataFrame) -> DataFrame:
    return edges.join(frontier.select(F.col("name").alias("src")), "src", "left_semi").select(F.col("dst").alias("name")).distinct()


def _gathered(seen: DataFrame, step: int) -> DataFrame:
    """What has been seen; written as one table after 8, 16, 32, ... rounds, so that rounds don't read more and more tables and rows are written a few times only."""
    return materialize(seen, "seen") if step >= TOGETHER and step & (step - 1) == 0 else seen


def reach(edges: DataFrame, begin: DataFrame, include_begin: bool, include_reached: bool, max_steps: int = -1) -> DataFrame:
    """(step, name) of every vertex first reached by crossing ``step`` edges; a negative limit is none.

    No begin, no step.  Step 0 is the begin set if it is included; otherwise a begin vertex counts at the first step that reaches it, if
    ``include_reached``.  The search ends with a step that adds nothing."""
    few = _few(edges, begin)
    if few is not None:
        return edges.sparkSession.createDataFrame(local.reach(*few, include_begin, include_reached, max_steps), "step int, name string")
    begin = materialize(begin.select("name").distinct(), "begin")
    rows = [begin.select(F.lit(0).alias("step"), "name")] if include_begin else [begin.limit(0).select(F.lit(0).alias("step"), "name")]
    seen, frontier, step = begin, begin, 0
    reported = begin if include_begin or not include_reached else begin.limit(0)
    while step != max_steps:
        step += 1
        met = materialize(_next(frontier, edges), "step")
        new = met.join(seen, "name", "left_anti")
        back = met.join(begin, "name", "left_semi").join(reported, "name", "left_anti") if not include_begin and include_reached else met.limit(0)
        found = materialize(new.select("name", F.lit(True).alias("new")).unionByName(back.select("name", F.lit(False).alias("new"))), "reached")
        discard(met)
        if found.isEmpty():
            break
        rows.append(found.select(F.lit(step).alias("step"), "name"))
        frontier = found.filter("new").select("name")
        seen = _gathered(seen.unionByName(frontier), step)
        reported = _gathered(reported.unionByName(found.filter("not new").select("name")), step)
    return reduce(DataFrame.unionByName, rows)


def shortest_path(edges: DataFrame, begin: DataFrame, end: DataFrame) -> DataFrame:
    """(pos, name) along one shortest path: a vertex's parent is its smallest predecessor one level up, the end the one with the smallest (parent, name)."""
    spark = edges.sparkSession
    few = _few(edges, begin, end)
    if few is not None:
        return spark.createDataFrame([*enumerate(local.shortest_path(*few))], "pos int, name string")
    begin, end = materialize(begin.select("name").distinct(), "begin"), materialize(end.select("name").distinct(), "end")
    level = begin.select("name", F.lit(None).cast("string").alias("parent"))
    levels, seen = [level], begin
    while True:
        hit = levels[-1].join(end, "name", "left_semi").agg(F.min(F.struct("parent", "name")).alias("m")).first()["m"]
        if hit is not None:
            break
        nxt = edges.join(levels[-1].select(F.col("name").alias("src")), "src", "left_semi").groupBy("dst").agg(F.min("src").alias("parent")).select(F.col("dst").alias("name"), "parent")
        nxt = materialize(nxt.join(seen, "name", "left_anti"), "level")
        if nxt.isEmpty():
            return spark.createDataFrame([], "pos int, name string")
        levels.append(nxt)
        seen = _gathered(seen.unionByName(nxt.select("name")), len(levels))
    # the end's ancestors, by steps that double: as many rounds as the path's length has binary digits
    steps = materialize(reduce(DataFrame.unionByName, levels[1:]), "parents") if len(levels) > 1 else None
    path = spark.createDataFrame([(0, hit["name"])], "back int, name string")
    for k in range((len(levels) - 1).bit_length()):
        further = path.join(steps, "name").select((F.col("back") + (1 << k)).alias("back"), F.col("parent").alias("name"))
        path = materialize(path.unionByName(further), "path")
        steps = materialize(steps.select("name", F.col("parent").alias("over")).join(steps.select(F.col("name").alias("over"), "parent"), "over").select("name", "parent"), "parents")
    return path.select((F.lit(len(levels) - 1) - F.col("back")).alias("pos"), "name")


def paths_vertices(edges: DataFrame, begin: DataFrame, end: DataFrame, max_steps: int = -1) -> DataFrame:
    """(name) of the vertices on paths from begin to end: forward up to the limit without leaving end vertices, then back from the ends reached,
    inside what the first search found, without going on from begin vertices newly reached."""
    few = _few(edges, begin, end)
    if few is not None:
        return edges.sparkSession.createDataFrame([(v,) for v in local.paths_vertices(*few, max_steps)], "name string")
    begin, end = materialize(begin.select("name").distinct(), "begin"), materialize(end.select("name").distinct(), "end")

    def search(edges: DataFrame, start: DataFrame, stop: DataFrame, stop_start: bool) -> DataFrame:
        seen, frontier, step = start, start.join(stop, "name", "left_anti") if stop_start else start, 0
        while step != max_steps:
            step += 1
            new = materialize(_next(frontier, edges).join(seen, "name", "left_anti"), "step")
            if new.isEmpty():
                break
            seen, frontier = _gathered(seen.unionByName(new), step), new.join(stop, "name", "left_anti")
        return materialize(seen, "found")

    forward = search(edges, begin, end, True)
    ends = materialize(forward.join(end, "name", "left_semi"), "ends")
    if ends.isEmpty():
        return ends
    inside = edges.join(forward.select(F.col("name").alias("src")), "src", "left_semi").join(forward.select(F.col("name").alias("dst")), "dst", "left_semi")
    back = materialize(inside.select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct(), "back")
    return search(back, ends, begin, False)

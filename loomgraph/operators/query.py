"""The queries on a view of a dependency graph.

Results are flat tables; names are shown names (the default package has a label), which only differ from real ones for packages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names
from ..functions.filters import ANY, NameFilter
from ..plans.cut import materialize
from ..plans.view import ElemType, Graph
from . import cycles as cyc
from . import scc, traverse


def _shown(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: names.display_name(F.col(c)) for c in columns})


def _chosen(graph: Graph, accepted: NameFilter) -> DataFrame:
    return graph.vertices.filter(accepted(F.col("name"))).select("name")


def matches(graph: Graph, accepted: NameFilter = ANY) -> DataFrame:
    """(name, byte_size) of the elements a filter accepts."""
    return _shown(graph.vertices.filter(accepted(F.col("name"))).select("name", "byte_size"), "name")


def _steps(graph: Graph, begin: NameFilter, include_begin: bool, include_reached: bool, max_steps: int) -> DataFrame:
    return traverse.reach(graph.edges, _chosen(graph, begin), include_begin, include_reached, max_steps)


def deps(graph: Graph, begin: NameFilter, include_begin: bool = False, include_reached: bool = False, max_steps: int = -1) -> DataFrame:
    """(step, name, byte_size): what the begin set depends on, by the number of edges on the way."""
    return _shown(_steps(graph, begin, include_begin, include_reached, max_steps).join(graph.vertices, "name").select("step", "name", "byte_size"), "name")


def deps_graph(graph: Graph, begin: NameFilter, include_begin: bool = False, include_reached: bool = False, end: NameFilter = ANY, max_steps: int = -1) -> DataFrame:
    """(step, name, dep, causes): the vertices of ``deps`` with their successors that ``end`` accepts; dep is null for a vertex without any."""
    shown = graph.edges.filter(end(F.col("dst"))).select(F.col("src").alias("name"), F.col("dst").alias("dep"), "causes")
    return _shown(_steps(graph, begin, include_begin, include_reached, max_steps).join(shown, "name", "left").select("step", "name", "dep", "causes"), "name", "dep")


def one_shortest_path(graph: Graph, begin: NameFilter, end: NameFilter) -> DataFrame:
    """(pos, name, causes) along one shortest path; the last vertex has no causes."""
    path = traverse.shortest_path(graph.edges, _chosen(graph, begin), _chosen(graph, end))
    following = path.select((F.col("pos") - 1).alias("pos"), F.col("name").alias("dst"))
    told = path.join(following, "pos", "left").join(graph.edges.withColumnRenamed("src", "name"), ["name", "dst"], "left")
    return _shown(told.select("pos", "name", F.coalesce("causes", F.array().cast("array<string>")).alias("causes")), "name")


def paths_graph(graph: Graph, begin: NameFilter, end: NameFilter, max_steps: int = -1) -> DataFrame:
    """(name, dep, causes): the vertices on paths from begin to end, and the edges between them."""
    kept = traverse.paths_vertices(graph.edges, _chosen(graph, begin), _chosen(graph, end), max_steps)
    edges = graph.edges.join(kept.select(F.col("name").alias("dst")), "dst", "left_semi").select(F.col("src").alias("name"), F.col("dst").alias("dep"), "causes")
    return _shown(kept.join(edges, "name", "left").select("name", "dep", "causes"), "name", "dep")


def _across_classes(graph: Graph, parts: DataFrame) -> DataFrame:
    """Components of classes without those inside one top level class."""
    if graph.elem_type is ElemType.PACKAGE:
        return parts
    tops = parts.groupBy("root").agg(F.min(names.top_level_class(F.col("name"))).alias("a"), F.max(names.top_level_class(F.col("name"))).alias("b")).filter("a <> b").select("root")
    return parts.join(tops, "root", "left_semi")


def sccs(graph: Graph, min_size: int = 2, max_size: int = -1, max_count: int = -1) -> DataFrame:
    """(scc_id, scc_size, name, byte_size) of the strongly connected components of two or more, ids by size, then names.

    The limits keep components by size, and the first ``max_count`` of them."""
    parts = materialize(_across_classes(graph, scc.components(graph.edges)), "components")
    sized = parts.groupBy("root").agg(F.count(F.lit(1)).cast("int").alias("scc_size"), F.array_sort(F.collect_list("name")).alias("names"))
    sized = sized.filter((F.col("scc_size") >= min_size) & (F.lit(max_size < 0) | (F.col("scc_size") <= max_size)))
    numbered = sized.withColumn("scc_id", F.row_number().over(Window.orderBy("scc_size", "names")) - 1)
    if max_count >= 0:
        numbered = numbered.filter(F.col("scc_id") < max_count)
    return _shown(numbered.select("scc_id", "scc_size", F.explode("names").alias("name")).join(graph.vertices, "name").select("scc_id", "scc_size", "name", "byte_size"), "name")


def _with_causes(graph: Graph, found: DataFrame) -> DataFrame:
    """(size, names, causes) of cycles: causes has for each name those of the edge to the next one, null for classes."""
    if graph.elem_type is ElemType.CLASS:
        return found.select(F.size("names").alias("size"), "names", F.lit(None).cast("array<array<string>>").alias("causes"))
    pairs = found.select("names", F.posexplode("names").alias("pos", "src")).withColumn("dst", F.get("names", F.pmod(F.col("pos") + 1, F.size("names"))))
    told = pairs.join(graph.edges, ["src", "dst"]).groupBy("names").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "causes"))), lambda x: x["causes"]).alias("causes"))
    return _shown_names(told.select(F.size("names").alias("size"), "names", "causes"))


def _shown_names(df: DataFrame) -> DataFrame:
    return df.withColumn("names", F.transform("names", names.display_name))


def _in_one_class(path) -> F.Column:
    return F.size(F.array_distinct(F.transform(path, names.top_level_class))) == 1


def _cycles(graph: Graph, kind: str, max_size: int, min_size: int, max_count: int) -> DataFrame:
    if max_size == 0:
        empty = graph.edges.limit(0).select(F.array("src").alias("names"))
        found = empty
    else:
        inner = cyc.inner_edges(graph.edges.select("src", "dst"), scc.components(graph.edges))
        joined = kind == "all" and max_size > 0 and max_count < 0
        found = cyc.bounded_cycles(inner, max_size) if joined else cyc.component_cycles(inner, kind, max_size, min_size, max_count, graph.elem_type is ElemType.CLASS).select("names")
    if graph.elem_type is ElemType.CLASS:
        found = found.filter(~_in_one_class(F.col("names")))
    found = found.filter(F.size("names") >= min_size)
    if max_count >= 0:
        found = found.orderBy(F.size("names"), "names").limit(max_count)
    return _with_causes(graph, found)


def all_cycles(graph: Graph, max_size: int = -1, min_size: int = 2, max_count: int = -1) -> DataFrame:
    """(size, names, causes) of all elementary cycles; 0 as limit finds none, a negative one is none.

    The search of a component ends after ``max_count`` cycles; of those of all components the first by size and names are kept."""
    return _cycles(graph, "all", max_size, min_size, max_count)


def shortest_cycles(graph: Graph, max_size: int = -1, min_size: int = 2, max_count: int = -1) -> DataFrame:
    """(size, names, causes) of short cycles that cover every edge which lies on a cycle."""
    return _cycles(graph, "shortest", max_size, min_size, max_count)


def some_cycles(graph: Graph, max_size: int = -1, min_size: int = 2, max_count: int = -1) -> DataFrame:
    """(size, names, causes) of some cycles: at least one if there is any and no limit."""
    return _cycles(graph, "some", max_size, min_size, max_count)


def minus(rows: DataFrame, graph: Graph, subtracted: NameFilter, column: str = "name") -> DataFrame:
    """The rows whose element is neither accepted by a filter nor reached from what it accepts."""
    closure = deps(graph, subtracted, include_begin=True).select(F.col("name").alias(column)).distinct()
    return rows.join(closure, column, "left_anti")

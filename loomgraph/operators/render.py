"""Results as text and as DOT graphs, for people: renderers read a result's rows in order through an iterator, partition by partition."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import DEFAULT_PACKAGE
from ..plans.view import CodeGraph, ElemType

_INDENT = "   "


def deps_lines(steps: DataFrame) -> Iterator[str]:
    """Elements with sizes, under their steps if there are any."""
    stepped = "step" in steps.columns
    last = None
    for r in steps.orderBy(*(["step"] if stepped else []), "name").toLocalIterator():
        if stepped and r["step"] != last:
            last = r["step"]
            yield f"step {last}:"
        yield f"{_INDENT if stepped else ''}{r['name']}: {r['byte_size']}"


def graph_lines(rows: DataFrame, causes: bool = True) -> Iterator[str]:
    """Each element, and below it what it depends on; causes stand before the arrow they explain."""
    stepped = "step" in rows.columns
    key = lambda r: (r["step"] if stepped else 0, r["name"])
    last = None
    for (step, name), found in groupby(rows.orderBy(*(["step"] if stepped else []), "name", "dep").toLocalIterator(), key):
        if stepped and step != last:
            last = step
            yield f"step {step}:"
        pad = _INDENT if stepped else ""
        yield f"{pad}{name}"
        for r in found:
            if r["dep"] is not None:
                if causes and "causes" in rows.columns:
                    yield from (f"{pad}{_INDENT}{_INDENT}{c}" for c in r["causes"] or ())
                yield f"{pad}{_INDENT}-> {r['dep']}"


def tree_lines(code: CodeGraph, verbose: bool = False) -> Iterator[str]:
    """The package tree: each package, its classes with what they depend on, then the packages in it; ``verbose`` adds sizes, class files and causes."""
    classes = code.ordered(ElemType.CLASS).join(code.class_edges.groupBy(F.col("src").alias("name")).agg(F.sort_array(F.collect_set("dst")).alias("deps")), "name", "left")
    files = code.files.groupBy("name").agg(F.sort_array(F.collect_set(F.struct("file_no_ext", "byte_size"))).alias("files"))
    rows = classes.join(files, "name", "left").select("path", "file", "name", "byte_size", "deps", "files", F.lit(None).cast("array<struct<dst:string,causes:array<string>>>").alias("causes"))
    causes = code.package_edges.groupBy(F.col("src").alias("name")).agg(F.sort_array(F.collect_list(F.struct("dst", "causes"))).alias("causes"))
    packages = code.ordered(ElemType.PACKAGE).join(causes, "name", "left").select("path", F.lit(None).cast("string").alias("file"), "name", "byte_size", F.lit(None).cast("array<string>").alias("deps"), F.lit(None).cast("array<struct<file_no_ext:string,byte_size:bigint>>").alias("files"), "causes")
    for r in rows.unionByName(packages).orderBy("path", F.asc_nulls_first("file")).toLocalIterator():
        if r["file"] is None:
            yield (r["name"] or DEFAULT_PACKAGE) + (f" ({r['byte_size']} bytes)" if verbose else "")
            if verbose:
                yield from (f"{_INDENT}on {c['dst']} by {', '.join(c['causes'])}" for c in r["causes"] or ())
        else:
            found = ", ".join(f"{x['file_no_ext']}={x['byte_size']}" for x in r["files"] or ())
            yield f" {r['name']}" + (f" ({r['byte_size']} bytes: {found})" if verbose else "")
            yield from (f"{_INDENT}-> {x}" for x in r["deps"] or ())


def dot_lines(rows: DataFrame, name: str = "graph") -> Iterator[str]:
    """A directed graph in DOT; an element without shown successor stands alone."""
    yield f'digraph "{name}" {{'
    for r in rows.select("name", "dep").distinct().orderBy("name", "dep").toLocalIterator():
        yield f'{_INDENT}"{r["name"]}"{"" if r["dep"] is None else f" -> {chr(34)}{r["dep"]}{chr(34)}"};'
    yield "}"


def path_lines(path: DataFrame, causes: bool = True) -> Iterator[str]:
    """A path, an element a line, with the causes of each step."""
    for r in path.orderBy("pos").toLocalIterator():
        yield r["name"]
        if causes and "causes" in path.columns:
            yield from (f"{_INDENT}{c}" for c in r["causes"] or ())


def scc_lines(rows: DataFrame) -> Iterator[str]:
    """Components with their sizes and members."""
    for (number, size), found in groupby(rows.orderBy("scc_id", "name").toLocalIterator(), lambda r: (r["scc_id"], r["scc_size"])):
        members = [*found]
        yield f"SCC {number + 1} ({size} elements, {sum(r['byte_size'] for r in members)} bytes):"
        yield from (f"{_INDENT}{r['name']}: {r['byte_size']}" for r in members)


def cycle_lines(rows: DataFrame, causes: bool = True) -> Iterator[str]:
    """Cycles by size and names; the first name is repeated at the end."""
    for i, r in enumerate(rows.orderBy("size", "names").toLocalIterator()):
        yield f"CYCLE {i + 1}:"
        for k, name in enumerate(r["names"]):
            yield f"{_INDENT}{name}"
            if causes and r["causes"]:
                yield from (f"{_INDENT}{_INDENT}{c}" for c in r["causes"][k])
        yield f"{_INDENT}{r['names'][0]}"

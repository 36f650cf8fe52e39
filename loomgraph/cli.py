"""Command line: ``python -m loomgraph.cli PATH [-regex R] COMPUTATION [options]``."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable, Sequence
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import filters as nf
from .operators import query, reduce, render
from .plans.view import CodeGraph, ElemType

#: Computations by the number of patterns they take.
COMPUTATIONS = {"depsof": 1, "depsto": 1, "gdepsof": 1, "gdepsto": 1, "spath": 2, "pathsg": 2, "sccs": 0, "cycles": 0, "scycles": 0, "somecycles": 0}
_CYCLES: dict[str, Callable[..., DataFrame]] = {"cycles": query.all_cycles, "scycles": query.shortest_cycles, "somecycles": query.some_cycles}
#: Options that only some computations take.
_ONLY = {
    "into": {"depsof", "gdepsof"}, "from_": {"depsto", "gdepsto"}, "minusof": {"depsof", "gdepsof"}, "minusto": {"depsto", "gdepsto"}, "incl": {"depsof", "depsto", "gdepsof", "gdepsto"},
    "steps": {"depsof", "depsto", "gdepsof", "gdepsto"}, "maxsteps": {"depsof", "depsto", "gdepsof", "gdepsto", "pathsg"},
    "minsize": {"sccs", *_CYCLES}, "maxsize": {"sccs", *_CYCLES}, "maxcount": {"sccs", *_CYCLES},
    "dotformat": {"gdepsof", "gdepsto", "pathsg", "spath"},
}


def parser() -> argparse.ArgumentParser:
    """The parser of the command line."""
    p = argparse.ArgumentParser(prog="loomgraph", description=__doc__, allow_abbrev=False)
    p.add_argument("paths", nargs="+", help="class files, jars or directories")
    p.add_argument("-regex", default=None, help="only classes whose name matches are parsed")
    for name, n in COMPUTATIONS.items():
        p.add_argument(f"-{name}", nargs=n, metavar="REGEX") if n else p.add_argument(f"-{name}", action="store_true")
    for name in ("into", "minusof", "minusto", "tofile"):
        p.add_argument(f"-{name}", default=None)
    p.add_argument("-from", dest="from_", default=None)
    for name in ("maxsteps", "maxsize", "maxcount"):
        p.add_argument(f"-{name}", type=int, default=-1)
    p.add_argument("-minsize", type=int, default=-1)
    for name in ("packages", "apionly", "nomerge", "incl", "steps", "nocauses", "nostats", "onlystats", "dotformat"):
        p.add_argument(f"-{name}", action="store_true")
    return p


def command(args: Sequence[str]) -> argparse.Namespace:
    """The parsed command line; options that the computation doesn't take end the program with an error."""
    p = parser()
    got = p.parse_args(args)
    chosen = [name for name in COMPUTATIONS if getattr(got, name)]
    if len(chosen) != 1:
        p.error("exactly one computation is needed: " + ", ".join(f"-{x}" for x in COMPUTATIONS))
    got.computation = chosen[0]
    for option, fit in _ONLY.items():
        if getattr(got, option) not in (None, False, -1) and got.computation not in fit:
            p.error(f"-{option.rstrip('_')} doesn't go with -{got.computation}")
    if got.nostats and got.onlystats:
        p.error("-nostats doesn't go with -onlystats")
    if got.dotformat and got.onlystats:
        p.error("-dotformat doesn't go with -onlystats")
    return got


def _pattern(regex: str | None) -> nf.NameFilter:
    return nf.ANY if regex is None else nf.matches(regex)


def _deps(code: CodeGraph, cmd: argparse.Namespace, kind: ElemType) -> tuple[list[str], list[str]]:
    to, graphic = cmd.computation.endswith("to"), cmd.computation.startswith("g")
    graph = code.inverted(to).graph(kind).kept
    begin, keep = nf.matches(getattr(cmd, cmd.computation)[0]), _pattern(cmd.from_ if to else cmd.into)
    minus = cmd.minusto if to else cmd.minusof
    if graphic:
        rows = query.deps_graph(graph, begin, include_begin=cmd.incl, end=keep, max_steps=cmd.maxsteps)
    else:
        rows = query.deps(graph, begin, include_begin=cmd.incl, max_steps=cmd.maxsteps)
        # matches of the begin set are kept whatever -into says
        rows = rows.filter(keep(F.col("name")) | (begin(F.col("name")) & F.lit(cmd.incl)))
    if minus is not None:
        rows = query.minus(rows, graph, nf.matches(minus))
    shown = rows if cmd.steps else rows.drop("step")
    if graphic:
        lines = render.dot_lines(rows, cmd.computation) if cmd.dotformat else render.graph_lines(shown, not cmd.nocauses)
        stats = [f"number of {kind.plural}: {rows.select('name').distinct().count()}", f"number of dependencies: {rows.filter('dep is not null').count()}"]
    else:
        lines = render.deps_lines(shown)
        stats = [f"number of {kind.plural}: {rows.count()}", f"total byte size: {reduce.total_size(rows).first()[0] or 0}"]
    return [*lines] if not cmd.onlystats else [], stats


def _path(code: CodeGraph, cmd: argparse.Namespace, kind: ElemType) -> tuple[list[str], list[str]]:
    begin, end = map(nf.matches, getattr(cmd, cmd.computation))
    graph = code.graph(kind).kept
    if cmd.computation == "spath":
        path = query.one_shortest_path(graph, begin, end)
        n = path.count()
        lines = render.dot_lines(reduce.graph_of_path(path), "spath") if cmd.dotformat else render.path_lines(path, not cmd.nocauses)
        return [*lines] if not cmd.onlystats else [], [f"path length: {n - 1}" if n else "no path"]
    rows = query.paths_graph(graph, begin, end, cmd.maxsteps)
    lines = render.dot_lines(rows, "pathsg") if cmd.dotformat else render.graph_lines(rows, not cmd.nocauses)
    return [*lines] if not cmd.onlystats else [], [f"number of {kind.plural}: {rows.select('name').distinct().count()}"]


def _groups(code: CodeGraph, cmd: argparse.Namespace, kind: ElemType) -> tuple[list[str], list[str]]:
    graph = code.graph(kind).kept
    smallest = max(cmd.minsize, 2)
    if 0 <= cmd.maxsize < smallest:
        return [], ["number of results: 0"]
    if cmd.computation == "sccs":
        rows = query.sccs(graph, smallest, cmd.maxsize, cmd.maxcount)
        sizes = reduce.count_by_size(rows.select("scc_id", F.col("scc_size").alias("size")).distinct())
        lines, extra = render.scc_lines(rows), []
    else:
        rows = _CYCLES[cmd.computation](graph, cmd.maxsize, smallest, cmd.maxcount)
        sizes, lines = reduce.count_by_size(rows), render.cycle_lines(rows, not cmd.nocauses)
        extra = [f"cycles with {r['name']}: {r['n']}" for r in reduce.count_by_element(rows).orderBy("n", "name").toLocalIterator()]
        if kind is ElemType.PACKAGE:
            extra = [f"cycles with cause {r['cause']}: {r['n']}" for r in reduce.count_by_cause(rows).orderBy("n", "cause").toLocalIterator()] + extra
    counted = sizes.orderBy("size").collect()
    return [*lines] if not cmd.onlystats else [], [*extra, *(f"number of size {r['size']}: {r['n']}" for r in counted), f"number of results: {sum(r['n'] for r in counted)}"]


def run(args: Sequence[str], out: TextIO = sys.stdout, source: Callable[[argparse.Namespace], CodeGraph] | None = None) -> None:
    """Runs a command line.  source: makes the graph instead of a scan of the paths."""
    from .sources import scan

    cmd = command(args)
    if source is None:
        spark = SparkSession.builder.getOrCreate()
        code = scan.code_graph(spark, cmd.paths, not cmd.nomerge, cmd.apionly, scan.ParsingFilters(class_name=_pattern(cmd.regex)))
    else:
        code = source(cmd)
    kind = ElemType.PACKAGE if cmd.packages else ElemType.CLASS
    work = _deps if "deps" in cmd.computation else _path if cmd.computation in ("spath", "pathsg") else _groups
    lines, stats = work(code, cmd, kind)
    shown = [f"{'// ' if cmd.dotformat else ''}args: [{', '.join(args)}]", *lines, *([] if cmd.nostats or cmd.dotformat else stats)]
    if cmd.tofile:
        with open(cmd.tofile, "w", encoding="utf-8") as f:
            f.write("\n".join(shown) + "\n")
    else:
        out.write("\n".join(shown) + "\n")


if __name__ == "__main__":
    run(sys.argv[1:])

"""Cycles inside strongly connected components.

Cycles up to a size come from a loop of joins that extends paths whose smallest vertex is their start.  What is sequential by nature (all cycles of
any size, shortest covering cycles, some cycles) runs on one component at a time, on dictionaries of the component: cycles are handed on in batches as they
are found, and a search ends with the last cycle that is asked for.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.cut import materialize


def normalized(path: Column) -> Column:
    """A cycle turned so that its smallest name comes first."""
    at = F.array_position(path, F.array_min(path)).cast("int")
    return F.concat(F.slice(path, at, F.size(path)), F.slice(path, F.lit(1), at - 1))


def inner_edges(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """(root, src, dst) of the edges inside components."""
    return edges.join(parts.select(F.col("name").alias("src"), "root"), "src").join(parts.select(F.col("name").alias("dst"), F.col("root").alias("other")), "dst").filter("root = other").select("root", "src", "dst")


def bounded_cycles(inner: DataFrame, max_size: int) -> DataFrame:
    """(names) of all elementary cycles of ``max_size`` vertices at most, smallest name first."""
    edges = materialize(inner.select("src", "dst"), "inner")
    path = edges.filter("dst > src").select(F.col("src").alias("start"), F.col("dst").alias("last"), F.array("src", "dst").alias("path"))
    out = edges.limit(0).select(F.array("src").alias("names"))
    for size in range(2, max_size + 1):
        path = materialize(path, "paths")
        if path.isEmpty():
            break
        closed = path.join(edges.select(F.col("src").alias("last"), F.col("dst").alias("start")), ["last", "start"], "left_semi")
        out = out.unionByName(closed.select(F.col("path").alias("names")))
        if size < max_size:
            longer = path.join(edges.withColumnRenamed("src", "last"), "last").filter((F.col("dst") > F.col("start")) & ~F.array_contains("path", F.col("dst")))
            path = longer.select("start", F.col("dst").alias("last"), F.concat("path", F.array("dst")).alias("path"))
    return out


def elementary(successors: dict[str, list[str]], max_size: int) -> Iterator[list[str]]:
    """All elementary cycles of a component from their smallest vertex, by search with blocking; sizes above the limit (unless negative) are cut off."""
    order = sorted(successors)
    for start in order:
        # vertices above the start that can come back to it, with their distance to it
        back: dict[str, list[str]] = {}
        for v in order:
            for w in successors[v]:
                if v >= start and w >= start:
                    back.setdefault(w, []).append(v)
        home, queue = {start: 0}, deque([start])
        while queue:
            v = queue.popleft()
            for w in back.get(v, ()):
                if w not in home:
                    home[w] = home[v] + 1
                    queue.append(w)
        path, on_path = [start], {start}
        open_ = [iter(w for w in successors[start] if w in home)]
        blocked: set[str] = set()
        waiting: dict[str, set[str]] = {}
        found = [False]
        while open_:
            for w in open_[-1]:
                if w == start:
                    yield [*path]
                    found[-1] = True
                elif w not in on_path and (max_size >= 0 or w not in blocked) and (max_size < 0 or len(path) + home[w] < max_size + 0 or len(path) + home[w] == max_size):
                    path.append(w)
                    on_path.add(w)
                    blocked.add(w)
                    open_.append(iter(x for x in successors[w] if x in home))
                    found.append(False)
                    break
            else:
                v, hit = path.pop(), found.pop()
                open_.pop()
                on_path.discard(v)
                if hit:
                    if found:
                        found[-1] = True
                    free = [v]
                    while free:
                        x = free.pop()
                        if x in blocked or x == v:
                            blocked.discard(x)
                            free.extend(waiting.pop(x, ()))
                else:
                    for w in successors[v]:
                        if w in home:
                            waiting.setdefault(w, set()).add(v)


def covering(successors: dict[str, list[str]], max_size: int) -> Iterator[list[str]]:
    """Short cycles that cover every edge of a component that lies on a cycle within the limit.

    Vertices come by their number of successors, then name.  From each, a breadth-first search goes on until every incoming edge not yet
    covered has closed a cycle; a cycle covers all its edges, one above the limit only the edge that closed it."""
    covered: set[tuple[str, str]] = set()
    predecessors: dict[str, list[str]] = {v: [] for v in successors}
    for v in sorted(successors):
        for w in successors[v]:
            predecessors[w].append(v)
    for start in sorted(successors, key=lambda v: (len(successors[v]), v)):
        wanted = {v for v in predecessors[start] if (v, start) not in covered}
        parent: dict[str, str] = {}
        queue = deque([start])
        while queue and wanted:
            v = queue.popleft()
            for w in successors[v]:
                if w == start:
                    if v in wanted:
                        wanted.discard(v)
                        if (v, start) not in covered:
                            path = [v]
                            while path[-1] != start:
                                path.append(parent[path[-1]])
                            path.reverse()
                            covered.add((v, start))
                            if max_size < 0 or len(path) <= max_size:
                                covered.update(zip(path, [*path[1:], start], strict=True))
                                yield path
                elif w not in parent:
                    parent[w] = v
                    queue.append(w)


def some(successors: dict[str, list[str]], max_size: int) -> Iterator[list[str]]:
    """One cycle for each edge that closes one in a depth-first search which visits vertices once, by name."""
    visited: set[str] = set()
    for root in sorted(successors):
        if root in visited:
            continue
        visited.add(root)
        path, place, open_ = [root], {root: 0}, [iter(successors[root])]
        while open_:
            for w in open_[-1]:
                if w in place:
                    cycle = path[place[w] :]
                    if max_size < 0 or len(cycle) <= max_size:
                        yield cycle
                elif w not in visited:
                    visited.add(w)
                    place[w] = len(path)
                    path.append(w)
                    open_.append(iter(successors[w]))
                    break
            else:
                open_.pop()
                del place[path.pop()]


KERNELS: dict[str, Callable[[dict[str, list[str]], int], Iterator[list[str]]]] = {"all": elementary, "shortest": covering, "some": some}


def _in_one_class(cycle: list[str]) -> bool:
    """Whether all names are of one top level class (see ``functions.names``)."""

    def top(name: str) -> str:
        pack, dot, file = name.rpartition(".")
        odd = file.startswith("$") or file.endswith("$") or "$$" in file
        return pack + dot + (file if odd else file.partition("$")[0])

    return len({top(x) for x in cycle}) == 1


#: Cycles of a batch that a search hands on.
BATCH = 10_000


def component_cycles(inner: DataFrame, kind: str, max_size: int, min_size: int = 2, max_count: int = -1, across_classes: bool = False) -> DataFrame:
    """(root, nth, names) of a component's cycles, in the order in which they are found.

    min_size, across_classes (not inside one top level class): what counts; a component's search ends after ``max_count`` (unless negative) that do."""
    kernel = KERNELS[kind]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for root, edges in zip(batch["root"], batch["edges"], strict=True):
                pairs = sorted((e["src"], e["dst"]) for e in edges)
                successors: dict[str, list[str]] = {v: [] for v in sorted({x for pair in pairs for x in pair})}
                for v, w in pairs:
                    successors[v].append(w)
                counts = (c for c in kernel(successors, max_size) if len(c) >= min_size and not (across_classes and _in_one_class(c)))
                found = enumerate(counts if max_count < 0 else islice(counts, max_count))
                while some := [*islice(found, BATCH)]:
                    yield pd.DataFrame({"root": [root] * len(some), "nth": [i for i, _ in some], "names": [c for _, c in some]})

    whole = inner.groupBy("root").agg(F.collect_list(F.struct("src", "dst")).alias("edges"))
    return whole.mapInPandas(run, "root string, nth long, names array<string>").select("root", "nth", normalized(F.col("names")).alias("names"))

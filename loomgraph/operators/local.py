"""The same kernels on dictionaries, for graphs that are counted to be small: a loop of Spark jobs would spend its time on starting jobs."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame

#: Edges up to which a graph is worked on in the driver.
SMALL_EDGES = 50_000


def small_edges(edges: DataFrame) -> list[tuple[str, str]] | None:
    """The edges (src, dst), if they are few; None if they are more than ``SMALL_EDGES``."""
    rows = edges.select("src", "dst").limit(SMALL_EDGES + 1).collect() if SMALL_EDGES >= 0 else [None]
    return None if len(rows) > SMALL_EDGES else [(r["src"], r["dst"]) for r in rows]


def small_names(rows: DataFrame) -> set[str] | None:
    """The names, if they are few."""
    found = rows.select("name").limit(SMALL_EDGES + 1).collect()
    return None if len(found) > SMALL_EDGES else {r["name"] for r in found}


def adjacency(edges: list[tuple[str, str]]) -> dict[str, set[str]]:
    """Successors by vertex."""
    out: dict[str, set[str]] = defaultdict(set)
    for a, b in edges:
        out[a].add(b)
    return out


def reach(edges: list[tuple[str, str]], begin: set[str], include_begin: bool, include_reached: bool, max_steps: int) -> list[tuple[int, str]]:
    """(step, name) as ``traverse.reach`` has it."""
    following = adjacency(edges)
    rows = [(0, v) for v in begin] if include_begin else []
    seen, frontier, step = set(begin), set(begin), 0
    back = set(begin) if include_reached and not include_begin else set()
    while step != max_steps:
        step += 1
        met = set().union(*(following.get(v, ()) for v in frontier))
        frontier = met - seen
        reported = met & back
        if not frontier and not reported:
            break
        rows += [(step, v) for v in frontier | reported]
        seen |= frontier
        back -= reported
    return rows


def shortest_path(edges: list[tuple[str, str]], begin: set[str], end: set[str]) -> list[str]:
    """The path of ``traverse.shortest_path``; empty if there is none."""
    following = adjacency(edges)
    parents: dict[str, str | None] = dict.fromkeys(begin)
    level = {v: "" for v in begin}
    while level:
        hit = [(p, v) for v, p in level.items() if v in end]
        if hit:
            path = [min(hit)[1]]
            while parents[path[-1]] is not None:
                path.append(parents[path[-1]])
            return path[::-1]
        after: dict[str, str] = {}
        for v in level:
            for w in following.get(v, ()):
                if w not in parents and (w not in after or v < after[w]):
                    after[w] = v
        parents.update(after)
        level = after
    return []


def paths_vertices(edges: list[tuple[str, str]], begin: set[str], end: set[str], max_steps: int) -> set[str]:
    """The vertices of ``traverse.paths_vertices``."""

    def search(following: dict[str, set[str]], start: set[str], stop: set[str], stop_start: bool) -> set[str]:
        seen, frontier, step = set(start), start - stop if stop_start else set(start), 0
        while frontier and step != max_steps:
            step += 1
            new = set().union(*(following.get(v, ()) for v in frontier)) - seen
            seen |= new
            frontier = new - stop
        return seen

    forward = search(adjacency(edges), begin, end, True)
    ends = forward & end
    return search(adjacency([(b, a) for a, b in edges if a in forward and b in forward]), ends, begin, False) if ends else set()


def strong_components(edges: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """(name, root) of the vertices in components of two or more: one depth-first search with low links, without recursion."""
    following = {v: sorted(ws) for v, ws in adjacency(edges).items()}
    number: dict[str, int] = {}
    low: dict[str, int] = {}
    stack: list[str] = []
    on_stack: set[str] = set()
    out = []
    for root in sorted(following):
        if root in number:
            continue
        number[root] = low[root] = len(number)
        stack.append(root)
        on_stack.add(root)
        work = [(root, iter(following[root]))]
        while work:
            v, rest = work[-1]
            for w in rest:
                if w not in number:
                    number[w] = low[w] = len(number)
                    stack.append(w)
                    on_stack.add(w)
                    work.append((w, iter(following.get(w, ()))))
                    break
                if w in on_stack:
                    low[v] = min(low[v], number[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == number[v]:
                    members = [stack.pop()]
                    while members[-1] != v:
                        members.append(stack.pop())
                    on_stack.difference_update(members)
                    if len(members) > 1:
                        out += [(x, min(members)) for x in members]
    return out

"""Architecture rules: allowed direct dependencies and cycles."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..functions.filters import NameFilter, all_of, any_of, negated
from ..plans.view import CodeGraph, ElemType, Graph
from . import query


@dataclass(frozen=True)
class Allowed:
    """What one filter accepts may directly depend only on what some filter of ``to`` accepts."""

    begin: NameFilter
    to: tuple[NameFilter, ...]

    @staticmethod
    def not_on(begin: NameFilter, to: Sequence[NameFilter]) -> Allowed:
        """The rule that forbids what some filter of ``to`` accepts; without any, everything is allowed."""
        return Allowed(begin, (negated(any_of(*to)),))


def illegal_deps(graph: Graph, allowed: Sequence[Allowed]) -> DataFrame:
    """(rule, dep) of the direct dependencies that break a rule; each rule stands for itself, sources of no rule are free."""
    broken = []
    for i, rule in enumerate(allowed):
        edges = graph.edges.filter(rule.begin(F.col("src")) & ~any_of(*rule.to)(names.display_name(F.col("dst"))))
        broken.append(edges.select(F.lit(i).alias("rule"), names.display_name(F.col("dst")).alias("dep")))
    if not broken:
        return graph.edges.limit(0).select(F.lit(0).alias("rule"), F.col("dst").alias("dep"))
    return reduce(DataFrame.unionByName, broken).distinct()


def _turned(path: Sequence[str]) -> list[str]:
    at = path.index(min(path))
    return [*path[at:], *path[:at]]


def illegal_cycles(graph: Graph, allowed: Sequence[Sequence[str]], shortest: bool = False, max_size: int = -1) -> DataFrame:
    """(size, names, causes) of the cycles that aren't allowed; an allowed cycle may start anywhere, with two names or more."""
    if any(len(x) < 2 for x in allowed):
        raise ValueError("an allowed cycle has two names or more")
    found = (query.shortest_cycles if shortest else query.all_cycles)(graph, max_size)
    known = [F.array(*map(F.lit, _turned(list(x)))) for x in allowed]
    return found.filter(~reduce(lambda a, b: a | b, [F.col("names") == x for x in known])) if known else found


@dataclass
class DepUnit:
    """Rules on a view, checked with a report of at most ``max_errors`` violations; a violation raises AssertionError."""

    code: CodeGraph
    max_errors: int = 100
    write: Callable[[str], object] = print
    allowed: dict[ElemType, list[Allowed]] = field(default_factory=lambda: {t: [] for t in ElemType})
    cycles: dict[ElemType, list[list[str]]] = field(default_factory=lambda: {t: [] for t in ElemType})

    def clear(self) -> None:
        """Forget all rules."""
        for t in ElemType:
            self.allowed[t].clear()
            self.cycles[t].clear()

    def add_allowed_direct_deps(self, kind: ElemType, begin: NameFilter, to: Sequence[NameFilter]) -> None:
        """A rule that allows some direct dependencies only."""
        self.allowed[kind].append(Allowed(begin, tuple(to)))

    def add_illegal_direct_deps(self, kind: ElemType, begin: NameFilter, to: Sequence[NameFilter]) -> None:
        """A rule that forbids some direct dependencies."""
        self.allowed[kind].append(Allowed.not_on(begin, to))

    def add_allowed_cycle(self, kind: ElemType, cycle: Sequence[str]) -> None:
        """A cycle that may be."""
        if len(cycle) < 2:
            raise ValueError("an allowed cycle has two names or more")
        self.cycles[kind].append(_turned(list(cycle)))

    def check_deps(self, kind: ElemType) -> None:
        """Checks the rules on direct dependencies; each violation is reported with one shortest path."""
        graph = self.code.graph(kind).kept
        rows = illegal_deps(graph, self.allowed[kind]).orderBy("rule", "dep")
        shown = rows.limit(self.max_errors).collect()
        for row in shown:
            rule = self.allowed[kind][row["rule"]]
            real = "" if row["dep"] == names.DEFAULT_PACKAGE and kind is ElemType.PACKAGE else row["dep"]
            begin = all_of(rule.begin, negated(NameFilter(f"equalsName({real})", lambda c, real=real: c == real)))
            path = query.one_shortest_path(graph, begin, NameFilter(f"equalsName({real})", lambda c, real=real: c == real)).orderBy("pos").collect()
            self.write(f"illegal dependency of {rule.begin} on {row['dep']}: " + " -> ".join(x["name"] for x in path))
        if shown or self.max_errors <= 0 and not rows.isEmpty():
            raise AssertionError("there are illegal dependencies")

    def _check_cycles(self, kind: ElemType, shortest: bool) -> None:
        rows = illegal_cycles(self.code.graph(kind).kept, self.cycles[kind], shortest)
        shown = rows.orderBy("size", "names").limit(self.max_errors).collect()
        for row in shown:
            self.write("illegal cycle: " + " -> ".join([*row["names"], row["names"][0]]))
        if shown or self.max_errors <= 0 and not rows.isEmpty():
            raise AssertionError("there are illegal cycles")

    def check_cycles(self, kind: ElemType) -> None:
        """Checks all cycles."""
        self._check_cycles(kind, False)

    def check_shortest_cycles(self, kind: ElemType) -> None:
        """Checks short cycles that cover all others."""
        self._check_cycles(kind, True)


def split_packages(classes: DataFrame) -> DataFrame:
    """(package, origins) of packages with classes (name, origin) from several places."""
    found = classes.select(names.package_name(F.col("name")).alias("package"), "origin").groupBy("package").agg(F.countDistinct("origin").alias("origins"))
    return found.filter("origins > 1")

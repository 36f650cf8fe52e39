"""The golden graph of nine classes, small graphs, and random graphs against plain Python."""

import random
from itertools import islice

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import filters as nf
from loomgraph.functions import names
from loomgraph.operators import cycles, local, query, reduce, render, rules, scc, traverse
from loomgraph.plans.view import CodeGraph, ElemType

P1, P2, P3 = (f"net.example.p{i}" for i in (1, 2, 3))
PACK = {**dict.fromkeys((1, 2, 3, 4), P1), **dict.fromkeys((5, 6, 7), P2), **dict.fromkeys((8, 9), P3)}
SIZE = {1: 123, 2: 234, 3: 345, 4: 456, 5: 567, 6: 678, 7: 789, 8: 890, 9: 901}
EDGES = [(1, 2), (1, 3), (2, 5), (3, 4), (4, 2), (4, 6), (5, 4), (5, 7), (6, 4), (6, 7), (7, 6), (8, 9), (9, 8)]
OBJ = "java.lang.Object"


@pytest.fixture(params=["jobs", "local"], autouse=True)
def kernels(request, monkeypatch):
    """Every test runs on the loops of jobs and on the kernels for small graphs."""
    if request.param == "jobs":
        monkeypatch.setattr(local, "SMALL_EDGES", -1)


def n(i):
    return f"{PACK[i]}.C{i}"


def short(name):
    return "Obj" if name == OBJ else name.rpartition(".C")[2]


def graph_of(spark, edges, sizes=None):
    files = spark.createDataFrame(sizes or [(x, 1) for x in sorted({y for e in edges for y in e})], "name string, byte_size long")
    return CodeGraph.of(files, spark.createDataFrame(edges, "src string, dst string"))


@pytest.fixture(scope="module")
def golden(spark):
    edges = [(n(a), n(b)) for a, b in EDGES] + [(n(i), OBJ) for i in SIZE]
    return graph_of(spark, edges, [(n(i), s) for i, s in SIZE.items()])


@pytest.fixture(scope="module")
def classes(golden):
    return golden.graph(ElemType.CLASS).kept


@pytest.fixture(scope="module")
def packages(golden):
    return golden.graph(ElemType.PACKAGE).kept


def steps(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["step"], set()).add(short(r["name"]))
    return out


def test_matches_and_sizes(golden, classes, packages):
    assert {short(r["name"]): r["byte_size"] for r in query.matches(classes).collect()} == {**{str(i): s for i, s in SIZE.items()}, "Obj": 0}
    sizes = {r["name"]: r["byte_size"] for r in query.matches(packages).collect()}
    assert (sizes[P1], sizes[P2], sizes[P3], sizes["java.lang"], sizes["java"], sizes["[default package]"]) == (1158, 2034, 1791, 0, 0, 0)


def test_deps(golden, classes):
    assert steps(query.deps(classes, nf.equals_name(n(2)))) == {1: {"Obj", "5"}, 2: {"4", "7"}, 3: {"6"}}
    assert reduce.total_size(reduce.merged(query.deps(classes, nf.equals_name(n(2))))).first()[0] == 2490
    p1 = nf.starts_with_name(P1)
    assert steps(query.deps(classes, p1)) == {1: {"Obj", "5", "6"}, 2: {"7"}}
    assert steps(query.deps(classes, p1, include_reached=True))[1] == {"Obj", "5", "6", "2", "3", "4"}
    assert steps(query.deps(classes, nf.ANY)) == {}
    assert steps(query.deps(golden.inverted().graph(ElemType.CLASS).kept, nf.equals_name(n(4)))) == {1: {"3", "5", "6"}, 2: {"1", "2", "7"}}


def test_deps_graph(classes, packages):
    rows = query.minus(query.deps_graph(classes, nf.equals_name(n(1))), classes, nf.equals_name(n(4))).collect()
    assert {(short(r["name"]), short(r["dep"])) for r in rows} == {("3", "Obj"), ("3", "4")}
    rows = {(r["name"], r["dep"], tuple(short(c) for c in r["causes"] or ())) for r in query.deps_graph(packages, nf.equals_name(P1)).collect()}
    assert rows == {("java.lang", None, ()), (P2, "java.lang", ("5", "6", "7")), (P2, P1, ("5", "6"))}


def test_shortest_path(classes, packages):
    path = lambda g, a, b: [(short(r["name"]), tuple(map(short, r["causes"]))) for r in query.one_shortest_path(g, a, b).orderBy("pos").collect()]
    assert [x for x, _ in path(classes, nf.equals_name(n(2)), nf.equals_name(n(4)))] == ["2", "5", "4"]
    assert path(classes, nf.equals_name(n(2)), nf.equals_name(n(2))) == [("2", ())]
    assert path(classes, nf.equals_name(n(2)), nf.NONE) == []
    assert path(packages, nf.equals_name(P1), nf.equals_name(P2)) == [(P1, ("2", "4")), (P2, ())]
    assert path(classes, nf.ANY, nf.ANY) == [("Obj", ())]
    assert path(packages, nf.ANY, nf.ANY) == [("[default package]", ())]


def test_paths_graph(classes):
    rows = {(short(r["name"]), r["dep"] and short(r["dep"])) for r in query.paths_graph(classes, nf.equals_name(n(1)), nf.equals_name(n(2))).collect()}
    assert rows == {("1", "2"), ("1", "3"), ("2", None), ("3", "4"), ("4", "2"), ("4", "6"), ("6", "4"), ("6", "7"), ("7", "6")}
    two, five = nf.any_of(nf.equals_name(n(2)), nf.equals_name(n(3))), nf.any_of(nf.equals_name(n(5)), nf.equals_name(n(6)))
    sizes = {k: query.paths_graph(classes, two, five, k).select("name").distinct().count() for k in (-1, 2, 0, 1)}
    assert sizes == {-1: 5, 2: 5, 0: 0, 1: 2}


def test_components_and_cycles(classes, packages):
    found = {}
    for r in query.sccs(classes).collect():
        found.setdefault(r["scc_id"], set()).add(short(r["name"]))
    assert found == {0: {"8", "9"}, 1: {"2", "4", "5", "6", "7"}}
    assert {r["name"] for r in query.sccs(packages).collect()} == {P1, P2}
    as_set = lambda df: {tuple(map(short, r["names"])) for r in df.collect()}
    every = {("2", "5", "4"), ("2", "5", "7", "6", "4"), ("4", "6"), ("6", "7"), ("8", "9")}
    assert as_set(query.all_cycles(classes)) == as_set(query.all_cycles(classes, 7)) == every
    assert as_set(query.all_cycles(classes, 2)) == {("4", "6"), ("6", "7"), ("8", "9")}
    assert as_set(query.all_cycles(classes, 0)) == set()
    assert as_set(query.shortest_cycles(classes)) == every
    assert as_set(query.some_cycles(classes)) == {("2", "5", "4"), ("4", "6"), ("6", "7"), ("8", "9")}
    row = query.all_cycles(packages).first()
    assert (row["names"], [[short(c) for c in x] for x in row["causes"]]) == ([P1, P2], [["2", "4"], ["5", "6"]])
    assert {short(r["name"]): r["n"] for r in reduce.count_by_element(query.all_cycles(classes, min_size=2)).collect()} == {"2": 2, "5": 2, "7": 2, "4": 3, "6": 3, "8": 1, "9": 1}


def test_cycles_inside_one_class_are_left_out(spark):
    g = graph_of(spark, [("a.b.A$B", "a.b.A"), ("a.b.A", "a.b.A$B")]).graph(ElemType.CLASS).kept
    assert query.sccs(g).isEmpty() and query.all_cycles(g).isEmpty() and query.shortest_cycles(g).isEmpty()


def test_ball_and_shortest_example(spark):
    ball = graph_of(spark, [(f"c{i}", f"d.c{j}".replace("d.", "")) for i in range(3) for j in range(3) if i != j]).graph(ElemType.CLASS).kept
    assert (query.all_cycles(ball).count(), query.shortest_cycles(ball).count()) == (5, 3)
    eight = {f"v{i}": [f"v{j}" for j in range(8) if j != i] for i in range(8)}
    assert sum(1 for _ in cycles.elementary(eight, -1)) == 16064
    example = {"0": ["3"], "1": ["0", "3"], "2": ["1"], "3": ["1", "2"]}
    norm = lambda c: tuple(c[c.index(min(c)) :] + c[: c.index(min(c))])
    found = {norm(c) for c in cycles.covering(example, -1)}
    assert {(0, 3, 1), (1, 3, 2)} <= {tuple(map(int, c)) for c in found}


def _random(rng, size):
    vertices = [f"v{i}" for i in range(rng.randint(2, size))]
    return {v: sorted({w for w in rng.choices(vertices, k=rng.randint(0, 3)) if w != v}) for v in vertices}


def _naive(successors, most):
    out = set()

    def go(path):
        for w in successors[path[-1]]:
            if w == path[0]:
                out.add(tuple(path))
            elif w > path[0] and w not in path:
                go([*path, w])

    for v in successors:
        go([v])
    return {c for c in out if most < 0 or len(c) <= most}


def test_cycle_kernels_against_naive():
    rng = random.Random(123456789)
    norm = lambda c: tuple(c[c.index(min(c)) :] + c[: c.index(min(c))])
    for _ in range(3000):
        g, most = _random(rng, 8), rng.choice((-1, -1, 2, 3, 5))
        every = _naive(g, most)
        got = [norm(c) for c in cycles.elementary(g, most)]
        assert len(got) == len(set(got)) and set(got) == every
        cover = {norm(c) for c in cycles.covering(g, most)}
        assert cover <= every
        edges = lambda cs: {(a, b) for c in cs for a, b in zip(c, [*c[1:], c[0]], strict=True)}
        if most < 0:
            assert edges(cover) == edges(every)
        some = {norm(c) for c in cycles.some(g, most)}
        assert some <= every and (most >= 0 or bool(some) == bool(every))


def test_loops_against_plain_python(spark):
    rng = random.Random(7)
    for _ in range(3):
        g = _random(rng, 14)
        edges = spark.createDataFrame([(v, w) for v, ws in g.items() for w in ws], "src string, dst string")
        begin = rng.sample(sorted(g), 2)
        level, seen, expected = begin, set(begin), {0: set(begin)}
        while level:
            level = sorted({w for v in level for w in g[v]} - seen)
            seen.update(level)
            if level:
                expected[len(expected)] = set(level)
        got = {}
        for r in traverse.reach(edges, spark.createDataFrame([(b,) for b in begin], "name string"), True, False).collect():
            got.setdefault(r["step"], set()).add(r["name"])
        assert got == expected

        def reached(v):
            out, todo = set(), [v]
            while todo:
                for w in g[todo.pop()]:
                    if w not in out:
                        out.add(w)
                        todo.append(w)
            return out

        closure = {v: reached(v) for v in g}
        roots = {(v, min(w for w in closure[v] if v in closure[w])) for v in g if v in closure[v]}
        assert {(r["name"], r["root"]) for r in scc.components(edges).collect()} == roots


def test_direct_mutual_dependencies_need_no_rounds(spark, monkeypatch):
    """A chain of pairs that depend on each other is one component without colouring, however long it is; one-way edges can't add to it, a long way round does."""
    monkeypatch.setattr(local, "SMALL_EDGES", -1)
    chain = [(f"c{i:02}", f"c{i + 1:02}") for i in range(40)]
    edges = lambda pairs: spark.createDataFrame(pairs, "src string, dst string")
    both = chain + [(b, a) for a, b in chain]
    round_ = [("c20", "x1"), ("x1", "x2"), ("x2", "c03"), ("y1", "y2"), ("y2", "y3"), ("y3", "y1")]
    whole = {(f"c{i:02}", "c00") for i in range(41)}
    assert set(map(tuple, scc.components(edges(both + round_)).collect())) == whole | {("x1", "c00"), ("x2", "c00"), ("y1", "y1"), ("y2", "y1"), ("y3", "y1")}
    monkeypatch.setattr(scc, "_colours", None)
    assert set(map(tuple, scc.components(edges([*both, ("c05", "z1"), ("z2", "c07")])).collect())) == whole


def test_a_search_ends_with_the_last_cycle_asked_for(spark, kernels):
    """A complete graph of 100 has more cycles than can be counted."""
    ball = graph_of(spark, [(f"c{i:03}", f"c{j:03}") for i in range(100) for j in range(100) if i != j]).graph(ElemType.CLASS)
    inner = ball.edges.select(F.lit("c000").alias("root"), "src", "dst")
    for most in (-1, 60):
        found = cycles.component_cycles(inner, "all", most, 3, 2, True).collect()
        assert len(found) == 2 and all(len(r["names"]) >= 3 for r in found)
    hundred = {f"v{i:03}": [f"v{j:03}" for j in range(100) if j != i] for i in range(100)}
    assert len([*islice(cycles.some(hundred, -1), 2)]) == 2
    nested = graph_of(spark, [("a.A", "a.A$B"), ("a.A$B", "a.A"), ("a.A", "a.C"), ("a.C", "a.A")]).graph(ElemType.CLASS).kept
    assert [r["names"] for r in query.all_cycles(nested, max_count=1).collect()] == [["a.A", "a.C"]]


def test_a_long_way(spark):
    """A chain is walked back by doubled steps, and what has been seen is gathered on the way."""
    edges = spark.createDataFrame([(f"v{i:03}", f"v{i + 1:03}") for i in range(20)] + [("v003", "w"), ("w", "v005")], "src string, dst string")
    one = lambda x: spark.createDataFrame([(x,)], "name string")
    path = sorted((r["pos"], r["name"]) for r in traverse.shortest_path(edges, one("v000"), one("v020")).collect())
    assert [x for _, x in path] == [f"v{i:03}" for i in range(21)]
    assert traverse.reach(edges, one("v000"), True, False).count() == 22


def test_tree_and_accessors(spark, golden):
    lines = [*render.tree_lines(golden)]
    assert lines[:4] == ["[default package]", "java", "java.lang", f" {OBJ}"] and lines[4:7] == ["net", "net.example", P1]
    assert lines[7:11] == [f" {n(1)}", f"   -> {OBJ}", f"   -> {n(2)}", f"   -> {n(3)}"]
    assert f" {n(8)} (890 bytes: C8=890)" in [*render.tree_lines(golden, verbose=True)] and f"   on {P1} by {n(5)}, {n(6)}" in [*render.tree_lines(golden, verbose=True)]
    assert {(r["kind"], r["name"]) for r in golden.children("net.example").collect()} == {("package", P1), ("package", P2), ("package", P3)}
    assert [r["file_no_ext"] for r in golden.file_sizes(n(8)).collect()] == ["C8"] and golden.nested(n(8)).isEmpty()
    ordered = [r["name"] for r in golden.ordered(ElemType.PACKAGE).orderBy("path").collect()]
    assert ordered == ["", "java", "java.lang", "net", "net.example", P1, P2, P3]


def test_empty_graph(spark):
    g = graph_of(spark, [], [("a.A", 5)]).graph(ElemType.CLASS).kept
    assert query.deps(g, nf.ANY).isEmpty() and query.sccs(g).isEmpty() and query.all_cycles(g).isEmpty()
    assert query.one_shortest_path(g, nf.equals_name("a.A"), nf.equals_name("x")).isEmpty()


def test_views(spark, golden):
    edges = {(short(r["src"]), short(r["dst"])) for r in golden.retaining(nf.starts_with_name(P2)).class_edges.collect()}
    assert edges == {("5", "4"), ("5", "7"), ("6", "4"), ("6", "7"), ("7", "6"), ("5", "Obj"), ("6", "Obj"), ("7", "Obj")}
    inverse = {(r["src"], r["dst"]): [short(c) for c in r["causes"]] for r in golden.inverted().package_edges.collect()}
    assert inverse[P2, P1] == ["2", "4"] and inverse[P1, P2] == ["5", "6"]
    merged = CodeGraph.of(spark.createDataFrame([("p.A", 5), ("p.A$B", 3), ("p.A$B", 9)], "name string, byte_size long"), spark.createDataFrame([("p.A$B", "p.C"), ("p.A", "p.A$B")], "src string, dst string"), merge_nested=True)
    assert {(r["name"], r["byte_size"]) for r in merged.class_vertices.collect()} == {("p.A", 8), ("p.C", 0)}
    assert [tuple(r) for r in merged.deps.collect()] == [("p.A", "p.C")]
    cut = golden.without(nf.equals_name(n(4))).deps.collect()
    assert not any(n(4) in tuple(r) for r in cut)
    assert {r["name"]: r["classes"] for r in golden.subtree_class_counts().collect()}[""] == 10


def test_rules(golden):
    said = []
    unit = rules.DepUnit(golden, write=said.append)
    unit.add_allowed_direct_deps(ElemType.CLASS, nf.equals_name(n(1)), [nf.equals_name(n(2)), nf.equals_name(n(7))])
    with pytest.raises(AssertionError):
        unit.check_deps(ElemType.CLASS)
    assert len(said) == 2 and "Object" in said[0] + said[1] and "C3" in said[0] + said[1]
    unit.clear()
    unit.check_deps(ElemType.CLASS)
    unit.add_allowed_cycle(ElemType.PACKAGE, [P2, P1])
    unit.check_cycles(ElemType.PACKAGE)
    with pytest.raises(AssertionError):
        unit.check_shortest_cycles(ElemType.CLASS)


def test_names_and_filters(spark):
    df = spark.createDataFrame([("",), ("A",), ("a.b.C$D$E",), ("a.b.$C",), ("a.b.C$$D",), ("a$b.C$D",), ("a.b$",)], "c string")
    c = F.col("c")
    rows = [tuple(r) for r in df.select(names.package_name(c), names.file_name(c), names.outer_class(c), names.top_level_class(c)).collect()]
    assert rows == [("", "", None, ""), ("", "A", None, "A"), ("a.b", "C$D$E", "a.b.C$D", "a.b.C"), ("a.b", "$C", None, "a.b.$C"), ("a.b", "C$$D", None, "a.b.C$$D"), ("a$b", "C$D", "a$b.C", "a$b.C"), ("a", "b$", None, "a.b$")]
    values = spark.createDataFrame([("xa.a.a",), ("a.a",), ("b.a.a$c",), ("a.ab",), ("a.a\n",)], "c string")
    told = lambda f: [r[0] for r in values.filter(f(F.col("c"))).collect()]
    assert told(nf.contains_name("a.a")) == ["xa.a.a", "a.a", "b.a.a$c"]
    assert told(nf.matches("a.a")) == ["a.a"]
    assert told(nf.starts_with_name("a.a")) == ["a.a"] and told(nf.ends_with_name("a.a")) == ["xa.a.a", "a.a"]
    assert told(nf.all_of()) == told(nf.any_of()) == [] and str(nf.any_of(nf.NONE, nf.starts_with("a"))) == "or(none,startsWith(a))"
    assert nf.all_of(nf.starts_with("a."), nf.starts_with("b.")).prefix is None

"""Registered queries of the graph operators on graphs derived from the tables, and SQL for them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import filters as nf
from .functions import names
from .operators import query as q
from .operators import reduce as r
from .operators import render, rules, scc
from .plans.view import CodeGraph, ElemType
from .sources import scan, tables

C, P = ElemType.CLASS, ElemType.PACKAGE
#: Begin and end sets of the queries.
_START, _ASIA = nf.ends_with_name("NATION_8"), nf.starts_with_name("ASIA")

_EDGES = """with recursive c as (select r_name || '.' || n_name as nm, n_nationkey as k from nation join region on n_regionkey = r_regionkey),
w as (select a.nm as s, b.nm as d, count(*) as n from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
      join supplier on l_suppkey = s_suppkey join c a on a.k = c_nationkey join c b on b.k = s_nationkey where a.nm <> b.nm group by a.nm, b.nm),
e as (select s as src, d as dst from (select s, d, row_number() over (partition by s order by n desc, d) as rk from w) where rk <= 3),
sz as (select nm as name, count(*) as byte_size from customer join c on k = c_nationkey group by nm),
v as (select name, coalesce(max(byte_size), 0) as byte_size from (select name, byte_size from sz union all select src, null from e union all select dst, null from e) group by name),
pe as (select split_part(src, '.', 1) as src, split_part(dst, '.', 1) as dst, string_agg(distinct src, ',' order by src) as causes from e where split_part(src, '.', 1) <> split_part(dst, '.', 1) group by 1, 2),
pv as (select split_part(name, '.', 1) as name, cast(sum(byte_size) as bigint) as byte_size from v group by 1 union all select '', 0)"""
_SUPPLIERS = """with recursive n as (select l_suppkey as s, lead(l_suppkey) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice) as d from lineitem),
w as (select s, d, count(*) as n from n where s <> d group by s, d),
e as (select 's' || lpad(s::varchar, 9, '0') as src, 's' || lpad(d::varchar, 9, '0') as dst from (select s, d, row_number() over (partition by s order by n desc, d) as rk from w) where rk <= 1)"""
_EVENTS = """with recursive n as (select event_type as src, lead(event_type) over (partition by user_id order by ts, event_id) as dst from events), e as (select distinct src, dst from n where src <> dst)"""
_BEGIN = "like '%.NATION_8'"


def _reach(begin: str, edges: str = "e", limit: int = 25, vertices: str = "v") -> str:
    """A recursive step table r(v, d) for a begin condition."""
    return f"r(v, d) as (select name, 0 from {vertices} where {begin} union select dst, d + 1 from r join {edges} on src = v where d < {limit})"


def _closure(edges: str = "e", p: str = "p", m: str = "m") -> str:
    return f"{p}(a, b) as (select src, dst from {edges} union select a, dst from {p} join {edges} on src = b), {m} as (select x.a as v, least(x.a, min(x.b)) as root from {p} x join {p} y on x.a = y.b and x.b = y.a group by x.a), k as (select v as name, root from {m} where root in (select root from {m} group by root having count(*) > 1))"


def _paths(edges: str, size: int, p: str = "cy") -> str:
    return f"{p}(s, v, path, k) as (select src, dst, src, 1 from {edges} where dst >= src union all select s, dst, path || '>' || src, k + 1 from {p} join {edges} on src = v where v <> s and dst >= s and k < {size} and not contains('>' || path || '>', '>' || src || '>')), y as (select path as cycle, k as size from {p} where v = s)"


_FOUND: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def _register(name: str, make: Callable, sql: str | None, graph: Callable = lambda s, d: tables.nation_top(s, d, 3)) -> None:
    _FOUND[name] = (lambda spark, sf_dir: make(graph(spark, sf_dir)), sql)


def _kept(code: CodeGraph, kind: ElemType = C):
    return code.graph(kind).kept


def _cycle_text(df: DataFrame) -> DataFrame:
    return df.select(F.concat_ws(">", "names").alias("cycle"), F.col("size").cast("long").alias("size"))


def _texts(df: DataFrame) -> DataFrame:
    return df.withColumn("causes", F.concat_ws(",", "causes"))


# matches and filters
for _name, _filter, _where in (
    ("matches_any", nf.ANY, "true"), ("matches_starts_with_name", _ASIA, "name like 'ASIA.%'"), ("matches_ends_with_name", _START, f"name {_BEGIN}"),
    ("matches_contains_name", nf.contains_name("EUROPE"), "name like 'EUROPE.%'"), ("matches_regex", nf.matches("A.*[17]"), "regexp_full_match(name, 'A.*[17]')"),
    ("matches_and_or_not", nf.all_of(nf.any_of(nf.starts_with("A"), nf.contains("E.")), nf.negated(nf.ends_with("A"))), "(name like 'A%' or name like '%E.%') and not name like '%A'"),
):
    _register(_name, lambda g, f=_filter: q.matches(g.graph(C), f), f"{_EDGES} select name, byte_size from v where {_where}")
_register("matches_packages", lambda g: q.matches(g.graph(P)), f"{_EDGES} select case when name = '' then '[default package]' else name end as name, byte_size from pv")

# names
_register("name_parts", lambda g: g.class_vertices.select("name", names.package_name(F.col("name")).alias("package"), names.file_name(F.col("name")).alias("simple"), names.top_level_class(F.concat("name", F.lit("$In$Er"))).alias("top_level"), names.outer_class(F.concat("name", F.lit("$In$Er"))).alias("outer_class"), names.display_name(names.package_name(F.col("name"))).alias("display")),
          f"{_EDGES} select name, split_part(name, '.', 1) as package, split_part(name, '.', 2) as simple, name as top_level, name || '$In' as outer_class, split_part(name, '.', 1) as display from v")

# views
_register("package_rollup_causes", lambda g: _texts(g.package_edges), f"{_EDGES} select src, dst, causes from pe")
_register("inverse_edges", lambda g: g.inverted().class_edges, f"{_EDGES} select dst as src, src as dst, src as cause from e")
_register("inverse_package_causes", lambda g: _texts(g.inverted().package_edges), f"{_EDGES} select dst as src, src as dst, causes from pe")
_register("retained_edges", lambda g: g.retaining(_ASIA).class_edges.select("src", "dst"), f"{_EDGES} select src, dst from e where src like 'ASIA.%'")
_register("retained_vertices", lambda g: g.retaining(_ASIA).class_vertices, f"{_EDGES} select name, byte_size from v where name like 'ASIA.%' or name in (select dst from e where src like 'ASIA.%')")
_register("vertex_sizes", lambda g: g.class_vertices, f"{_EDGES} select name, byte_size from v")
_register("subtree_class_counts", lambda g: g.subtree_class_counts(), f"{_EDGES} select split_part(name, '.', 1) as name, count(*) as classes from v group by 1 union all select '', count(*) from v")

# traversal
_first = "select v as name, cast(min(d) as integer) as step from r group by v"
_sized = f"select name, step, byte_size from ({_first}) join v using (name)"
_register("deps_of_steps", lambda g: q.deps(_kept(g), _START, include_begin=True), f"{_EDGES}, {_reach(f'name {_BEGIN}')} {_sized}")
_register("deps_of_excl_begin", lambda g: q.deps(_kept(g), _START), f"{_EDGES}, {_reach(f'name {_BEGIN}')} select * from ({_sized}) where step > 0")
_register("deps_of_with_begin_reached", lambda g: q.deps(_kept(g), _ASIA, include_reached=True), f"{_EDGES}, {_reach("name like 'ASIA.%'")}, f as (select v as name, cast(min(d) as integer) as step from r where d > 0 group by v), b as (select v as name, cast(min(d) as integer) as step from r group by v) select f.name, case when b.step = 0 then f.step else b.step end as step, byte_size from f join b using (name) join v using (name)")
_register("deps_to_steps", lambda g: q.deps(_kept(g.inverted()), nf.ends_with_name("NATION_7"), include_begin=True), f"{_EDGES}, i as (select dst as src, src as dst from e), {_reach("name like '%.NATION_7'", 'i')} {_sized}")
_register("deps_maxsteps_1", lambda g: q.deps(_kept(g), _ASIA, include_begin=True, max_steps=1), f"{_EDGES}, {_reach("name like 'ASIA.%'", limit=1)} {_sized}")
_register("deps_packages", lambda g: q.deps(_kept(g, P), nf.equals_name("AFRICA"), include_begin=True), f"{_EDGES}, {_reach("name = 'AFRICA'", 'pe', vertices='pv')} select name, step, byte_size from ({_first}) join pv using (name)")
_register("deps_into", lambda g: q.deps(_kept(g), _START).filter(_ASIA(F.col("name"))), f"{_EDGES}, {_reach(f'name {_BEGIN}')} select * from ({_sized}) where step > 0 and name like 'ASIA.%'")
_register("deps_minus", lambda g: q.minus(q.deps(k := _kept(g.inverted()), nf.ends_with_name("NATION_7")), k, nf.ends_with_name("NATION_19")),
          f"{_EDGES}, i as (select dst as src, src as dst from e), {_reach("name like '%.NATION_7'", 'i')}, t(v) as (select name from v where name like '%.NATION_19' union select dst from t join i on src = v) select * from ({_sized}) where step > 0 and name not in (select v from t)")
_register("deps_graph", lambda g: q.deps_graph(_kept(g), _START, include_begin=True, end=_ASIA).drop("causes"), f"{_EDGES}, {_reach(f'name {_BEGIN}')} select f.name, step, dst as dep from ({_first}) f left join (select * from e where dst like 'ASIA.%') on src = f.name")
_register("deps_graph_packages", lambda g: _texts(q.deps_graph(_kept(g, P), nf.equals_name("ASIA"), include_begin=True)), f"{_EDGES}, {_reach("name = 'ASIA'", 'pe', vertices='pv')} select f.name, step, dst as dep, coalesce(causes, '') as causes from ({_first}) f left join pe on src = f.name")
_register("deps_total_size", lambda g: r.total_size(r.merged(q.deps(_kept(g), _START))), f"{_EDGES}, {_reach(f'name {_BEGIN}')} select cast(sum(byte_size) as bigint) as byte_size from ({_sized}) where step > 0")

# paths
_walk = """lv as (select v as name, min(d) as d from r group by v), par as (select b.name, b.d, min(a.name) as parent from lv b join e on e.dst = b.name join lv a on a.name = e.src and a.d = b.d - 1 group by b.name, b.d),
al as (select name, d, parent from par where name like '%.NATION_7' union all select name, d, null from lv where d = 0 and name like '%.NATION_7'),
en as (select name, d, parent from (select *, row_number() over (order by d, parent, name) as nr from al) where nr = 1),
wk(name, d, parent) as (select name, d, parent from en union all select lv.name, lv.d, par.parent from wk join lv on lv.name = wk.parent left join par on par.name = lv.name)"""
_register("shortest_path", lambda g: q.one_shortest_path(_kept(g), _START, nf.ends_with_name("NATION_7")).select("pos", "name"), f"{_EDGES}, {_reach(f'name {_BEGIN}')}, {_walk} select cast(d as integer) as pos, name from wk")
_register("shortest_path_causes", lambda g: _texts(q.one_shortest_path(_kept(g, P), nf.equals_name("AFRICA"), nf.equals_name("ASIA"))), f"{_EDGES}, {_reach("name = 'AFRICA'", 'pe', vertices='pv')}, {_walk.replace('join e on e.dst', 'join pe e on e.dst').replace("like '%.NATION_7'", "= 'ASIA'")} select cast(wk.d as integer) as pos, wk.name, coalesce(pe.causes, '') as causes from wk left join wk n on n.d = wk.d + 1 left join pe on pe.src = wk.name and pe.dst = n.name")
for _suffix, _limit in (("", 25), ("_maxsteps_2", 2)):
    _register(f"paths_graph{_suffix}", lambda g, n=_limit: q.paths_graph(_kept(g), _START, nf.ends_with_name("NATION_7"), -1 if n == 25 else n).select("name", "dep"),
              f"""{_EDGES}, f(v, d) as (select name, 0 from v where name {_BEGIN} union select dst, d + 1 from f join e on src = v where d < {_limit} and v not like '%.NATION_7'), fs as (select distinct v from f),
              b(v, d) as (select v, 0 from fs where v like '%.NATION_7' union select src, d + 1 from b join e on dst = v where d < {_limit} and src in (select v from fs) and v not {_BEGIN}), bs as (select distinct v from b)
              select bs.v as name, x.dst as dep from bs left join (select * from e where dst in (select v from bs)) x on x.src = bs.v""")

# components
_sccs = "select name, root from k"
_ids = f"x as (select root, count(*) as n, string_agg(name, ',' order by name) as t from ({_sccs}) group by root), o as (select root, cast(n as integer) as scc_size, cast(row_number() over (order by n, t) - 1 as integer) as scc_id from x)"
_register("sccs", lambda g: q.sccs(_kept(g)), f"{_EDGES}, {_closure()}, {_ids} select scc_id, scc_size, name, byte_size from k join o using (root) join v using (name)")
_register("sccs_package", lambda g: q.sccs(_kept(g, P)), f"{_EDGES}, {_closure('pe')}, {_ids} select scc_id, scc_size, name, byte_size from k join o using (root) join pv using (name)")
_register("sccs_suppliers", lambda g: q.sccs(_kept(g)).select("scc_id", "scc_size", "name"), f"{_SUPPLIERS}, {_closure()}, {_ids} select scc_id, scc_size, name from k join o using (root)", lambda s, d: tables.supplier_top(s, d, 1))
_register("scc_count_by_size", lambda g: r.count_by_size(q.sccs(_kept(g)).select("scc_id", F.col("scc_size").cast("long").alias("size")).distinct()), f"{_SUPPLIERS}, {_closure()}, {_ids} select cast(scc_size as bigint) as size, count(*) as n from o group by 1", lambda s, d: tables.supplier_top(s, d, 1))
_register("scc_total_size", lambda g: r.total_size(q.sccs(_kept(g))), f"{_EDGES}, {_closure()} select cast(sum(byte_size) as bigint) as byte_size from k join v using (name)")
_register("sccs_minsize", lambda g: q.sccs(_kept(g), min_size=3, max_count=1).select("scc_id", "scc_size", "name"), f"{_SUPPLIERS}, {_closure()}, {_ids}, z as (select root, scc_size, cast(row_number() over (order by scc_id) - 1 as integer) as scc_id from o where scc_size >= 3) select scc_id, scc_size, name from k join z using (root) where scc_id < 1", lambda s, d: tables.supplier_top(s, d, 1))

# cycles
_register("cycles_max4", lambda g: _cycle_text(q.all_cycles(_kept(g), 4)), f"{_EDGES}, {_paths('e', 4)} select cycle, cast(size as bigint) as size from y")
_register("cycles_unlimited", lambda g: _cycle_text(q.all_cycles(_kept(g))), f"{_EVENTS}, {_paths('e', 12)} select cycle, cast(size as bigint) as size from y", tables.event_transitions)
_register("cycles_package_causes", lambda g: q.all_cycles(_kept(g, P)).select(F.concat_ws(">", "names").alias("cycle"), F.concat_ws(";", F.transform("causes", lambda x: F.concat_ws(",", x))).alias("causes")),
          f"{_EDGES}, {_paths('pe', 6)}, st as (select cycle, string_split(cycle, '>') as l, unnest(range(1, len(string_split(cycle, '>')) + 1)) as i from y) select cycle, string_agg(causes, ';' order by i) as causes from st join pe on src = l[i] and dst = l[i % len(l) + 1] group by cycle")
_register("cycles_count_by_size", lambda g: r.count_by_size(_cycle_text(q.all_cycles(_kept(g), 4))), f"{_EDGES}, {_paths('e', 4)} select cast(size as bigint) as size, count(*) as n from y group by 1")
_register("cycles_count_by_name", lambda g: r.count_by_element(q.all_cycles(_kept(g), 4)), f"{_EDGES}, {_paths('e', 4)} select name, count(*) as n from (select unnest(string_split(cycle, '>')) as name from y) group by 1")
_register("cycles_count_by_cause", lambda g: r.count_by_cause(q.all_cycles(_kept(g, P))), f"{_EDGES}, {_paths('pe', 6)}, st as (select string_split(cycle, '>') as l, unnest(range(1, len(string_split(cycle, '>')) + 1)) as i from y) select cause, count(*) as n from (select unnest(string_split(causes, ',')) as cause from st join pe on src = l[i] and dst = l[i % len(l) + 1]) group by 1")
_register("scycles_edge_coverage", lambda g: r.graph_of_cycle(q.shortest_cycles(_kept(g))).select(F.col("name").alias("src"), F.col("dep").alias("dst")).distinct(), f"{_EDGES}, {_closure()} select src, dst from e join k a on a.name = src join k b on b.name = dst where a.root = b.root")
_register("scycles_subset_check", lambda g: (lambda k: _cycle_text(q.shortest_cycles(k)).join(_cycle_text(q.all_cycles(k)), ["cycle", "size"], "left_anti"))(_kept(g)), f"{_EVENTS} select '' as cycle, cast(0 as bigint) as size from e where false", tables.event_transitions)
_register("somecycles_exists", lambda g: q.some_cycles(_kept(g)).agg((F.count(F.lit(1)) > 0).alias("found")), f"{_EDGES}, {_closure()} select count(*) > 0 as found from k")

# rules
_register("illegal_direct_deps", lambda g: rules.illegal_deps(_kept(g), [rules.Allowed(_ASIA, (nf.starts_with_name("ASIA"), nf.starts_with_name("EUROPE")))]).select("dep"), f"{_EDGES} select distinct dst as dep from e where src like 'ASIA.%' and not (dst like 'ASIA.%' or dst like 'EUROPE.%')")
_register("allowed_cycle_violations", lambda g: _cycle_text(rules.illegal_cycles(_kept(g, P), [["ASIA", "EUROPE"]])), f"{_EDGES}, {_paths('pe', 6)} select cycle, cast(size as bigint) as size from y where cycle <> 'ASIA>EUROPE'")

# exact cycles: in a graph in which all depend on all, the shortest covering cycles are the pairs, and the search by name closes one cycle for each edge back
_register("scycles_exact", lambda g: _cycle_text(q.shortest_cycles(_kept(g))), f"{_EVENTS} select e.src || '>' || e.dst as cycle, cast(2 as bigint) as size from e join e b on b.src = e.dst and b.dst = e.src where e.src < e.dst", tables.event_transitions)
_register("somecycles_exact", lambda g: _cycle_text(q.some_cycles(_kept(g))), f"{_EVENTS}, vs as (select distinct src as v from e), pr as (select a.v as a, b.v as b from vs a join vs b on a.v < b.v) select string_agg(v, '>' order by v) as cycle, count(*) as size from pr join vs on v between a and b group by a, b", tables.event_transitions)
_register("cycles_first_found", lambda g: r.count_by_size(q.all_cycles(_kept(g), max_count=4, min_size=3)).agg(F.sum("n").alias("n")), f"{_EVENTS}, {_paths('e', 12)} select cast(least(4, count(*)) as bigint) as n from y where size >= 3", tables.event_transitions)

# graphs with more edges than the driver works on: customers, orders and lines
_TREE = """with recursive o as (select 'c.' || lpad(o_custkey::varchar, 12, '0') as c, 'o.' || lpad(o_orderkey::varchar, 12, '0') as o from orders),
l as (select 'o.' || lpad(l_orderkey::varchar, 12, '0') as o, 'l.' || lpad(l_orderkey::varchar, 12, '0') || '_' || l_linenumber as l, 'p.' || lpad(l_partkey::varchar, 12, '0') as p from lineitem),
e as (select c as src, o as dst from o union select o, c from o union select o, l from l union select l, o from l union select o, p from l)"""
_C1, _OF_C1 = nf.equals_name("c.000000000001"), "= 'c.000000000001'"
_P1, _OF_P1 = nf.starts_with("p."), "like 'p.%'"
_ends = "vt as (select src as name from e union select dst from e)"
_register("deps_of_orders", lambda g: q.deps(_kept(g), _C1, include_begin=True).select("step", "name"), f"{_TREE}, {_ends}, {_reach(f'name {_OF_C1}', vertices='vt')} {_first}", tables.order_tree)
_register("shortest_path_orders", lambda g: q.one_shortest_path(_kept(g), _C1, _P1).select("pos", "name"), f"{_TREE}, {_ends}, {_reach(f'name {_OF_C1}', vertices='vt')}, {_walk.replace("like '%.NATION_7'", _OF_P1)} select cast(d as integer) as pos, name from wk", tables.order_tree)
_register("paths_graph_orders", lambda g: q.paths_graph(_kept(g), _C1, _P1).select("name", "dep"),
          f"""{_TREE}, f(v) as (select src from e where src {_OF_C1} union select dst from f join e on src = v where v not {_OF_P1}),
          b(v) as (select v from f where v {_OF_P1} union select src from b join e on dst = v where src in (select v from f) and v not in ('c.000000000001'))
          select b.v as name, x.dst as dep from b left join (select * from e where dst in (select v from b)) x on x.src = b.v""", tables.order_tree)
_register("sccs_orders", lambda g: scc.components(_kept(g).edges).groupBy("root").agg(F.count(F.lit(1)).alias("n")), f"{_TREE}, t as (select c, o as v from o union select c, l.l from o join l using (o) union select c, c from o), m as (select c, count(*) as n, min(v) as root from t group by c) select root, n from m", tables.order_tree)

# class files: the nations' classes as files and as a jar, decoded
_FILES = """with c as (select replace(r_name, ' ', '_') as r, n_name as n, n_nationkey as k from nation join region on n_regionkey = r_regionkey),
shown as (select r || '.' || n as src, unnest(['regions.' || r, 'shown.F' || k % 3, 'param.P', 'errors.E'] || case when k % 2 = 0 then ['java.lang.Object', 'generic.S' || k % 5] else [] end) as dst from c),
own as (select * from shown union select r || '.' || n, unnest(['constants.C' || k % 4, 'called.N' || k % 3, 'hidden.G' || k % 2, r || '.' || n || '$In'] || case when k % 2 = 0 then ['mark.A'] else [] end) from c
        union select r || '.' || n || '$In', unnest(['java.lang.Object', 'nested.Q']) from c),
merged as (select distinct split_part(src, '$', 1) as src, split_part(dst, '$', 1) as dst from own where split_part(src, '$', 1) <> split_part(dst, '$', 1))"""


def _scanned(name: str, make: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    _FOUND[name] = (make, f"{_FILES} {sql}")


_edges = lambda code: code.class_edges.select("src", "dst")
_scanned("scan_files_full", lambda s, d: _edges(scan.code_graph(s, [tables.class_files(s, d)], merge_nested=False)), "select src, dst from own")
_scanned("scan_files_api", lambda s, d: _edges(scan.code_graph(s, [tables.class_files(s, d)], merge_nested=False, api_only=True)), "select src, dst from shown")
_scanned("scan_files_merged", lambda s, d: _edges(scan.code_graph(s, [tables.class_files(s, d)])), "select src, dst from merged")
_scanned("scan_one_file", lambda s, d: scan.decoded(s, [f"{tables.class_files(s, d)}/EUROPE/NATION_8.class"]).select("name", F.array_join("deps", ",").alias("deps")), "select src as name, string_agg(dst, ',' order by dst) as deps from own where src = 'EUROPE.NATION_8' group by 1")
_scanned("scan_jar", lambda s, d: _edges(scan.code_graph(s, [tables.class_files(s, d, as_jar=True)], merge_nested=False)), "select src, dst from own")
_scanned("scan_jar_entries", lambda s, d: scan.decoded(s, [tables.class_files(s, d, as_jar=True)], filters=scan.ParsingFilters(entry=nf.starts_with("ASIA/"))).select("entry", "name"), "select replace(src, '.', '/') || '.class' as entry, src as name from own where src like 'ASIA.%' group by src")
_scanned("scan_class_names", lambda s, d: _edges(scan.code_graph(s, [tables.class_files(s, d)], filters=scan.ParsingFilters(class_name=nf.negated(nf.ends_with("$In"))))), "select distinct split_part(src, '$', 1) as src, split_part(dst, '$', 1) as dst from own where src not like '%$In' and split_part(src, '$', 1) <> split_part(dst, '$', 1)")
_scanned("scan_directories", lambda s, d: scan.decoded(s, [tables.class_files(s, d)], filters=scan.ParsingFilters(directory=nf.negated(nf.ends_with("/EUROPE")))).select("name"), "select distinct src as name from own where src not like 'EUROPE.%'")
_scanned("scan_no_directory", lambda s, d: scan.decoded(s, [tables.class_files(s, d)], filters=scan.ParsingFilters(directory=nf.ends_with("/ASIA"))).select("name"), "select src as name from own where false")
_scanned("scan_vertices", lambda s, d: scan.code_graph(s, [tables.class_files(s, d)]).class_vertices.select("name", (F.col("byte_size") > 0).alias("parsed")), "select name, name in (select src from merged) as parsed from (select src as name from merged union select dst from merged)")
_scanned("scan_two_sources", lambda s, d: _edges(scan.code_graph(s, [f"{tables.class_files(s, d)}/ASIA"]).union(scan.code_graph(s, [tables.class_files(s, d, as_jar=True)], api_only=True))), "select src, dst from merged where src like 'ASIA.%' union select src, dst from shown")
_scanned("scan_package_edges", lambda s, d: _texts(scan.code_graph(s, [tables.class_files(s, d)]).package_edges), "select regexp_extract(src, '^(.*)[.]', 1) as src, regexp_extract(dst, '^(.*)[.]', 1) as dst, string_agg(distinct src, ',' order by src) as causes from merged group by 1, 2")


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .streaming import incremental

    top = tables.class_files(spark, sf_dir)
    incremental.start(incremental.decoded_stream(spark, top), f"{top}-table", f"{top}-state").awaitTermination()
    return _edges(incremental.graph_so_far(spark, f"{top}-table"))


_scanned("stream_of_class_files", _streamed, "select src, dst from merged")

# editing a graph, its elements, and the tree of packages
_rows = lambda g, rows, schema: g.deps.sparkSession.createDataFrame(rows, schema)
_register("edit_with_dependency", lambda g: g.with_dependency(_rows(g, [("EUROPE.NATION_8", "OTHER.X"), ("EUROPE.NATION_8", "OTHER.X")], "src string, dst string")).package_edges.select("src", "dst"), f"{_EDGES} select src, dst from pe union select 'EUROPE', 'OTHER'")
_register("edit_without_dependency", lambda g: _texts(g.without_dependency(g.class_edges.filter("src like 'ASIA.%7' or dst like 'EUROPE.%'")).package_edges), f"{_EDGES} select split_part(src, '.', 1) as src, split_part(dst, '.', 1) as dst, string_agg(distinct src, ',' order by src) as causes from e where not (src like 'ASIA.%7' or dst like 'EUROPE.%') and split_part(src, '.', 1) <> split_part(dst, '.', 1) group by 1, 2")
_register("edit_without_classes", lambda g: _edges(g.without(nf.ends_with("8"))), f"{_EDGES} select src, dst from e where src not like '%8' and dst not like '%8'")
_register("edit_without_package", lambda g: g.without_package("ASIA").class_vertices, f"{_EDGES} select name, byte_size from v where name not like 'ASIA.%' and (name in (select name from sz) or name in (select src from e where dst not like 'ASIA.%') or name in (select dst from e where src not like 'ASIA.%'))")
_register("edit_union", lambda g: g.union(CodeGraph.of(_rows(g, [("EUROPE.NATION_8", 5), ("OTHER.X$Y", 7)], "name string, byte_size long"), _rows(g, [("OTHER.X$Y", "EUROPE.NATION_8")], "src string, dst string"))).class_vertices, f"{_EDGES} select name, byte_size from v union all select 'OTHER.X', 0 union all select 'OTHER.X$Y', 7")
_register("children_of_root", lambda g: g.children(""), f"{_EDGES} select 'package' as kind, name, byte_size from pv where name <> ''")
_register("children_of_package", lambda g: g.children("ASIA"), f"{_EDGES} select 'class' as kind, name, byte_size from v where name like 'ASIA.%'")
_register("nested_and_files", lambda g: (lambda x: x.nested("EUROPE.NATION_8").join(x.file_sizes("EUROPE.NATION_8$In").withColumnRenamed("byte_size", "file_size")))(CodeGraph.of(g.files.withColumn("name", F.concat("name", F.lit("$In"))).drop("file_no_ext"), g.deps)), f"{_EDGES} select name || '$In' as name, byte_size, split_part(name, '.', 2) || '$In' as file_no_ext, byte_size as file_size from sz where name = 'EUROPE.NATION_8'")
_register("tree_order", lambda g: g.ordered(C).select(F.row_number().over(Window.orderBy("path", "file")).alias("pos"), "name"), f"{_EDGES} select cast(row_number() over (order by split_part(name, '.', 1), split_part(name, '.', 2)) as integer) as pos, name from v")
_register("view_that_changes_nothing", lambda g: g.inverted(False).retaining(nf.ANY).class_edges, f"{_EDGES} select src, dst, src as cause from e")
_register("view_settings", lambda g: (lambda x: x.class_vertices.agg(F.count(F.lit(1)).alias("n")).select("n", F.lit(x.inverse).alias("inverse"), F.lit(str(x.retained)).alias("retained")))(g.inverted().retaining(nf.any_of(nf.NONE, nf.starts_with("A")))), f"{_EDGES}, i as (select dst as src, src as dst from e where dst like 'A%') select count(*) as n, true as inverse, 'or(none,startsWith(A))' as retained from (select src from i union select dst from i union select name from sz where name like 'A%')")
_register("in_one_class", lambda g: g.class_vertices.select("name", q._in_one_class(F.array("name", F.concat("name", F.lit("$A$B")))).alias("nested"), q._in_one_class(F.array("name", F.lit("x.Y"))).alias("other")), f"{_EDGES} select name, true as nested, false as other from v")

# more names and filters
_register("names_text", lambda g: g.class_vertices.select(names.slashed(F.col("name")).alias("slashed"), names.doted(names.slashed(F.col("name"))).alias("doted"), names.quoted(F.col("name")).alias("quoted"), names.is_pathological(F.concat(names.file_name(F.col("name")), F.lit("$"))).alias("odd"), F.array_join(names.split_name(F.col("name")), "|").alias("parts"), F.col("name").rlike(f"^{names.to_regex('EUROPE.NATION_8')}$").alias("same")),
          f"""{_EDGES} select replace(name, '.', '/') as slashed, name as doted, '"' || name || '"' as quoted, true as odd, replace(name, '.', '|') as parts, name = 'EUROPE.NATION_8' as same from v""")
_register("matches_none", lambda g: q.matches(g.graph(C), nf.NONE), f"{_EDGES} select name, byte_size from v where false")
_register("matches_own_filter", lambda g: q.matches(g.graph(C), nf.NameFilter("long names", lambda c: F.length(c) > 15)), f"{_EDGES} select name, byte_size from v where length(name) > 15")
_register("filter_texts", lambda g: g.class_vertices.limit(1).select(F.lit(str(nf.all_of(nf.starts_with("A"), nf.negated(nf.ends_with("B")), nf.any_of(nf.NONE, nf.contains("C"))))).alias("text")), "select 'and(startsWith(A),not(endsWith(B)),or(none,contains(C)))' as text")

# reductions
_asia = f"{_EDGES}, {_reach("name = 'ASIA'", 'pe', vertices='pv')}, dg as (select f.name, step, dst as dep, coalesce(causes, '') as causes from ({_first}) f left join pe on src = f.name)"
_graph_of_asia = lambda g: q.deps_graph(_kept(g, P), nf.equals_name("ASIA"), include_begin=True)
_register("graph_merged", lambda g: _texts(r.merged(_graph_of_asia(g))), f"{_asia} select name, dep, causes from dg")
_register("graph_causeless", lambda g: r.causeless(_graph_of_asia(g)), f"{_asia} select step, name, dep from dg")
_register("graph_merged_and_causeless", lambda g: r.merged_and_causeless(_graph_of_asia(g)), f"{_asia} select name, dep from dg")
_path_of = lambda g: q.one_shortest_path(_kept(g), _START, nf.ends_with_name("NATION_7"))
_walked = f"{_EDGES}, {_reach(f'name {_BEGIN}')}, {_walk}"
_register("path_causeless", lambda g: r.causeless(_path_of(g)), f"{_walked} select cast(d as integer) as pos, name from wk")
_register("path_as_graph", lambda g: r.causeless(r.graph_of_path(_path_of(g))), f"{_walked} select wk.name, n.name as dep from wk left join wk n on n.d = wk.d + 1")

# rules that forbid, and reports
_register("forbidden_direct_deps", lambda g: rules.illegal_deps(_kept(g), [rules.Allowed.not_on(_ASIA, (nf.matches(".*N_[0-9]"),)), rules.Allowed.not_on(_ASIA, ())]), f"{_EDGES} select distinct 0 as rule, dst as dep from e where src like 'ASIA.%' and regexp_full_match(dst, '.*N_[0-9]')")


def _numbered(g: CodeGraph, lines) -> DataFrame:
    return _rows(g, [*enumerate(lines)], "pos int, line string")


def _rule_report(g: CodeGraph) -> DataFrame:
    said: list[str] = []
    unit = rules.DepUnit(g, write=said.append)
    unit.add_illegal_direct_deps(C, _ASIA, [nf.matches(".*N_[0-9]")])
    try:
        unit.check_deps(C)
    except AssertionError as e:
        said.append(str(e))
    return _numbered(g, said)


_register("rule_report", _rule_report, f"{_EDGES}, x as (select dst, min(src) as src from e where src like 'ASIA.%' and regexp_full_match(dst, '.*N_[0-9]') group by dst), t as (select dst, 'illegal dependency of startsWithName(ASIA) on ' || dst || ': ' || src || ' -> ' || dst as line from x union all select '~', 'there are illegal dependencies' from x having count(*) > 0) select cast(row_number() over (order by dst) - 1 as integer) as pos, line from t")


def _cycle_report(g: CodeGraph) -> DataFrame:
    said: list[str] = []
    unit = rules.DepUnit(g, write=said.append)
    unit.add_allowed_cycle(P, ["EUROPE", "ASIA"])
    try:
        unit.check_cycles(P)
    except AssertionError as e:
        said.append(str(e))
    return _numbered(g, said)


_register("cycle_report", _cycle_report, f"{_EDGES}, {_paths('pe', 6)}, z as (select * from y where cycle <> 'ASIA>EUROPE'), t as (select size, string_split(cycle, '>') as l, 'illegal cycle: ' || replace(cycle, '>', ' -> ') || ' -> ' || split_part(cycle, '>', 1) as line from z union all select 99, [], 'there are illegal cycles' from z having count(*) > 0) select cast(row_number() over (order by size, l) - 1 as integer) as pos, line from t")

# texts
_pos = "select cast(row_number() over (order by {}) - 1 as integer) as pos, line from t"
_register("text_of_deps", lambda g: _numbered(g, render.deps_lines(q.deps(_kept(g), _START, include_begin=True))), f"{_EDGES}, {_reach(f'name {_BEGIN}')}, x as ({_sized}), t as (select distinct step, '' as name, 'step ' || step || ':' as line from x union all select step, name, '   ' || name || ': ' || byte_size from x) {_pos.format('step, name')}")
_register("text_of_graph", lambda g: _numbered(g, render.graph_lines(r.merged(_graph_of_asia(g)))), f"{_asia}, t as (select distinct name, '' as dep, -1 as k, name as line from dg union all select name, dep, i, case when i < len(l) then '      ' || l[i + 1] else '   -> ' || dep end from (select name, dep, string_split(causes, ',') as l, unnest(range(0, len(string_split(causes, ',')) + 1)) as i from dg where dep is not null)) {_pos.format('name, dep, k')}")
_register("text_of_dot", lambda g: _numbered(g, render.dot_lines(_graph_of_asia(g), "asia")), f"""{_asia}, t as (select distinct 1 as k, name, coalesce(dep, '') as dep, '   "' || name || '"' || coalesce(' -> "' || dep || '"', '') || ';' as line from dg union all select 0, '', '', 'digraph "asia" {{' union all select 2, '', '', '}}') {_pos.format('k, name, dep')}""")
_register("text_of_path", lambda g: _numbered(g, render.path_lines(_path_of(g))), f"{_walked}, t as (select d, name as line from wk) {_pos.format('d')}")
_register("text_of_sccs", lambda g: _numbered(g, render.scc_lines(q.sccs(_kept(g)))), f"{_EDGES}, {_closure()}, {_ids}, rw as (select scc_id, scc_size, name, byte_size from k join o using (root) join v using (name)), t as (select scc_id, '' as name, 'SCC ' || (scc_id + 1) || ' (' || count(*) || ' elements, ' || cast(sum(byte_size) as bigint) || ' bytes):' as line from rw group by scc_id union all select scc_id, name, '   ' || name || ': ' || byte_size from rw) {_pos.format('scc_id, name')}")
_register("text_of_cycles", lambda g: _numbered(g, render.cycle_lines(q.all_cycles(_kept(g), 3))), f"{_EVENTS}, {_paths('e', 3)}, nl as (select row_number() over (order by size, string_split(cycle, '>')) as nr, string_split(cycle, '>') as l from y), t as (select nr, unnest(range(0, len(l) + 2)) as k, l from nl), u as (select nr, k, case when k = 0 then 'CYCLE ' || nr || ':' else '   ' || l[(k - 1) % len(l) + 1] end as line from t) {_pos.format('nr, k').replace('from t', 'from u')}", tables.event_transitions)
_register("text_of_tree", lambda g: _numbered(g, render.tree_lines(g)), f"{_EDGES}, t as (select name as p, '' as n, '' as d, case when name = '' then '[default package]' else name end as line from pv union all select split_part(name, '.', 1), name, '', ' ' || name from v union all select split_part(src, '.', 1), src, dst, '   -> ' || dst from e) {_pos.format('p, n, d')}")

# packages defined in several places: names of parts by brand, the place is the size
def _split_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators.rules import split_packages

    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return split_packages(part.select(F.concat_ws(".", "p_brand", F.col("p_partkey").cast("string")).alias("name"), F.col("p_size").cast("string").alias("origin")))


_FOUND["split_packages"] = (_split_packages, "select p_brand as package, count(distinct p_size) as origins from part group by 1 having count(distinct p_size) > 1")

QUERIES = {k: make for k, (make, _) in _FOUND.items()}
ORACLES = {k: sql for k, (_, sql) in _FOUND.items() if sql}

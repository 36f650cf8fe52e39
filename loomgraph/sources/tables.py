"""Dependency graphs derived from relational tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.cut import materialize, shared_dir
from ..plans.view import CodeGraph
from . import assemble


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nation_top(spark: SparkSession, sf_dir: str, k: int) -> CodeGraph:
    """Nations as classes in regions as packages: a nation depends on the ``k`` nations that supply most of its lines; sizes are customers.

    Counts are taken by key before names are joined, so only key columns are shuffled."""
    line = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    order = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = _read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    supplier = _read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    lines = line.join(order, line["l_orderkey"] == order["o_orderkey"]).join(customer, F.col("o_custkey") == customer["c_custkey"]).join(supplier, F.col("l_suppkey") == supplier["s_suppkey"])
    counted = lines.groupBy("c_nationkey", "s_nationkey").agg(F.count(F.lit(1)).alias("n")).filter("c_nationkey <> s_nationkey")
    nation = _read(spark, sf_dir, "nation").join(_read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.concat("r_name", F.lit("."), "n_name").alias("nm"))
    named = counted.join(nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("nm").alias("src")), "c_nationkey").join(nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("nm").alias("dst")), "s_nationkey")
    best = named.withColumn("rk", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("n"), "dst"))).filter(F.col("rk") <= k)
    sizes = customer.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("byte_size")).join(nation.withColumnRenamed("n_nationkey", "c_nationkey"), "c_nationkey").select(F.col("nm").alias("name"), "byte_size")
    return CodeGraph.of(materialize(sizes, "sizes"), materialize(best.select("src", "dst"), "deps"))


def supplier_top(spark: SparkSession, sf_dir: str, k: int) -> CodeGraph:
    """Suppliers that follow each other in orders: each depends on the ``k`` that follow it most often."""
    line = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice")
    inside = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice")
    pairs = line.select(F.col("l_suppkey").alias("s"), F.lead("l_suppkey").over(inside).alias("d")).filter("s <> d").groupBy("s", "d").agg(F.count(F.lit(1)).alias("n"))
    best = pairs.withColumn("rk", F.row_number().over(Window.partitionBy("s").orderBy(F.desc("n"), "d"))).filter(F.col("rk") <= k)
    name = lambda c: F.concat(F.lit("s"), F.lpad(F.col(c).cast("string"), 9, "0"))
    sizes = line.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("byte_size")).select(name("l_suppkey").alias("name"), "byte_size")
    return CodeGraph.of(materialize(sizes, "sizes"), materialize(best.select(name("s").alias("src"), name("d").alias("dst")), "deps"))


def event_transitions(spark: SparkSession, sf_dir: str) -> CodeGraph:
    """Event types that follow each other for a user: a small graph in which nearly all depend on all."""
    event = _read(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    steps = event.select(F.col("event_type").alias("src"), F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("dst")).filter("src <> dst")
    sizes = event.groupBy(F.col("event_type").alias("name")).agg(F.count(F.lit(1)).alias("byte_size"))
    return CodeGraph.of(materialize(sizes, "sizes"), materialize(steps.distinct(), "deps"))


def order_tree(spark: SparkSession, sf_dir: str) -> CodeGraph:
    """Customers, orders and lines: a customer depends on its orders, an order on its customer, its lines and their parts, a line on its order and the line after it.

    The largest table's rows are edges; a customer with its orders and lines is a component."""
    key = lambda c, letter: F.concat(F.lit(letter), F.lpad(F.col(c).cast("string"), 12, "0"))
    order = _read(spark, sf_dir, "orders").select(key("o_custkey", "c.").alias("c"), key("o_orderkey", "o.").alias("o")).distinct()
    line = _read(spark, sf_dir, "lineitem").select(key("l_orderkey", "o.").alias("o"), F.concat(key("l_orderkey", "l."), F.lit("_"), F.col("l_linenumber").cast("string")).alias("l"), key("l_partkey", "p.").alias("p"))
    pairs = lambda df, a, b: df.select(F.col(a).alias("src"), F.col(b).alias("dst"))
    deps = [pairs(order, "c", "o"), pairs(order, "o", "c"), pairs(line, "o", "l"), pairs(line, "l", "o"), pairs(line, "o", "p")]
    every = deps[0]
    for x in deps[1:]:
        every = every.unionByName(x)
    sizes = order.groupBy(F.col("c").alias("name")).agg(F.count(F.lit(1)).alias("byte_size"))
    return CodeGraph.of(materialize(sizes, "sizes"), materialize(every.distinct(), "deps"))


def _nation_class(region: str, nation: str, key: int) -> dict[str, bytes]:
    """A nation as a class file with every kind of dependency, and a private class in it.  Nations of odd keys are of a version that knows no signatures and annotations."""
    name, inner = f"{region}/{nation}", f"{region}/{nation}$In"
    w = assemble.ClassWriter(name, f"regions/{region}", version=(48, 0) if key % 2 else (52, 0))
    w.class_(f"constants/C{key % 4}")
    w.name_and_type("call", f"(I[Lcalled/N{key % 3};)V")
    w.field(assemble.PUBLIC, "f", f"Lshown/F{key % 3};")
    w.field(assemble.PRIVATE, "g", f"[[Lhidden/G{key % 2};")
    w.method(assemble.PROTECTED, "m", "(JLparam/P;D)V", w.exceptions("errors/E"))
    w.attributes += [w.signature(f"<T:Ljava/lang/Object;>Lregions/{region};Lgeneric/S{key % 5}<TT;>;"), w.annotations("Lmark/A;"), w.inner_classes((inner, assemble.PRIVATE))]
    n = assemble.ClassWriter(inner, access=0)
    n.method(assemble.PUBLIC, "q", "()Lnested/Q;")
    n.attributes.append(n.inner_classes((inner, assemble.PRIVATE)))
    return {f"{name}.class": w.bytes(), f"{inner}.class": n.bytes()}


def class_files(spark: SparkSession, sf_dir: str, as_jar: bool = False) -> str:
    """A folder with the nations' class files, or with a jar of them, beside files that are none."""
    nations = _read(spark, sf_dir, "nation").join(_read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_name", "n_nationkey").collect()
    files = {"notes/readme.txt": b"no class", "notes/Wrong.class": b"not a class file", "notes/Empty.class": b""}
    for r in nations:
        files |= _nation_class(r["r_name"].replace(" ", "_"), r["n_name"], r["n_nationkey"])
    if as_jar:
        files = {"lib/all.jar": assemble.jar(files | {"inside.jar": assemble.jar({"x/Y.class": assemble.ClassWriter("x/Y").bytes()})}), "lib/readme.txt": b"no jar"}
    directory = f"{shared_dir(spark)}/loomgraph-classes-{uuid.uuid4().hex}"
    assemble.write_files(spark, directory, files)
    return directory

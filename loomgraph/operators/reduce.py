"""Reductions of query results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merged(steps: DataFrame) -> DataFrame:
    """Stepped rows without their steps; an element in two steps is an error."""
    named = [c for c in steps.columns if c != "step"]
    twice = F.count(F.lit(1)).over(Window.partitionBy(*[c for c in named if c in ("name", "dep")]))
    checked = steps.withColumn("_n", twice)
    return checked.select(*[F.when(F.col("_n") > 1, F.raise_error(F.lit("an element is in two steps")).cast("string")).otherwise(F.col(c)).alias(c) if c == "name" else F.col(c) for c in named])


def causeless(rows: DataFrame) -> DataFrame:
    """Rows without their causes."""
    return rows.drop("causes")


def merged_and_causeless(steps: DataFrame) -> DataFrame:
    """Stepped rows without steps and causes."""
    return causeless(merged(steps))


def graph_of_path(path: DataFrame) -> DataFrame:
    """(name, dep, causes) of a path's rows; the last vertex has no dep."""
    columns = [F.lead("name").over(Window.orderBy("pos")).alias("dep")]
    return path.select("name", *columns, *(["causes"] if "causes" in path.columns else []))


def graph_of_cycle(cycles: DataFrame) -> DataFrame:
    """(name, dep, causes) of cycles' rows (names, causes)."""
    rows = cycles.select("names", "causes", F.posexplode("names").alias("pos", "name"))
    return rows.select("name", F.get("names", F.pmod(F.col("pos") + 1, F.size("names"))).alias("dep"), F.get("causes", F.col("pos")).alias("causes")).distinct()


def total_size(rows: DataFrame) -> DataFrame:
    """(byte_size): the sum of sizes; an element in two rows is an error."""
    once = rows.groupBy("name").agg(F.max("byte_size").alias("byte_size"), F.count(F.lit(1)).alias("n"))
    return once.agg(F.sum(F.when(F.col("n") > 1, F.raise_error(F.lit("an element is in two rows")).cast("long")).otherwise(F.col("byte_size"))).alias("byte_size"))


def count_by_size(sized: DataFrame, size: str = "size") -> DataFrame:
    """(size, n): how many components or cycles have each size."""
    return sized.groupBy(F.col(size).alias("size")).agg(F.count(F.lit(1)).alias("n"))


def count_by_element(cycles: DataFrame) -> DataFrame:
    """(name, n): in how many cycles each element is."""
    return cycles.select(F.explode("names").alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


def count_by_cause(cycles: DataFrame) -> DataFrame:
    """(cause, n): how many edges of cycles each cause stands behind."""
    return cycles.select(F.explode("causes").alias("causes")).select(F.explode("causes").alias("cause")).groupBy("cause").agg(F.count(F.lit(1)).alias("n"))

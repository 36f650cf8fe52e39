"""Scanning files, jars and directories for class files with Spark's binary reader."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..functions.filters import ANY, NameFilter, ends_with
from ..plans.cut import materialize
from ..plans.view import CodeGraph


@dataclass(frozen=True)
class ParsingFilters:
    """Which paths and classes a scan takes: directories, jars and class files by path, entries of jars by name, classes by dotted name."""

    directory: NameFilter = ANY
    jar: NameFilter = ends_with(".jar")
    entry: NameFilter = ends_with(".class")
    file: NameFilter = ends_with(".class")
    class_name: NameFilter = ANY


_DECODED = "origin string, entry string, byte_size long, name string, deps array<string>"


def _entries(api_only: bool):
    """Class files out of files and jars: an entry for each; jars inside jars are not opened."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from .classfile import decode

        for batch in batches:
            rows = []
            for path, content, is_jar in zip(batch["path"], batch["content"], batch["is_jar"], strict=True):
                if is_jar:
                    with zipfile.ZipFile(io.BytesIO(content)) as jar:
                        found = [(e.filename, e.file_size, jar.read(e)) for e in jar.infolist() if e.filename.endswith(".class") and e.file_size > 0]
                else:
                    found = [(path.rpartition("/")[2], len(content), content)]
                for entry, size, data in found:
                    name, deps = decode(data, api_only)
                    if name is not None and size > 0:
                        rows.append((path, entry, size, name, deps))
            yield pd.DataFrame(rows, columns=["origin", "entry", "byte_size", "name", "deps"])

    return run


def _inside(spark: SparkSession, paths: list[str], accepted: NameFilter) -> Column:
    """Whether the filter accepts every directory on the way from one of the paths, itself included, down to a file."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    roots = [path(p).getFileSystem(conf).makeQualified(path(p)).toString().rstrip("/") for p in paths]
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    under = lambda d: reduce(lambda x, y: x | y, [(d == r) | d.startswith(f"{r}/") for r in roots])
    return F.forall(F.filter(above, under), accepted)


def decoded(spark: SparkSession, paths: list[str], api_only: bool = False, filters: ParsingFilters = ParsingFilters()) -> DataFrame:
    """(origin, entry, byte_size, name, deps) of the class files under some paths.  A path that isn't there is an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select("path", "content")
    is_jar = filters.jar(F.col("path")) & ~filters.file(F.col("path"))
    inside = _inside(spark, paths, filters.directory)
    wanted = files.filter(inside & (filters.file(F.col("path")) | is_jar)).withColumn("is_jar", is_jar)
    found = wanted.mapInPandas(_entries(api_only), _DECODED)
    return found.filter(filters.entry(F.col("entry")) & filters.class_name(F.col("name")))


def code_graph(spark: SparkSession, paths: list[str], merge_nested: bool = True, api_only: bool = False, filters: ParsingFilters = ParsingFilters()) -> CodeGraph:
    """The dependency graph of the class files under some paths; of files with one name the first by path counts."""
    found = materialize(decoded(spark, paths, api_only, filters), "decoded")
    rank = F.struct("origin", "entry")
    first = found.groupBy("name").agg(F.min_by("deps", rank).alias("deps"), F.min_by("byte_size", rank).alias("byte_size"))
    files = first.select("name", names.file_name(F.col("name")).alias("file_no_ext"), "byte_size")
    return CodeGraph.of(files, first.select(F.col("name").alias("src"), F.explode("deps").alias("dst")), merge_nested)


def origins(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(name, origin) of the classes under some paths, for ``split_packages``."""
    return decoded(spark, paths).select("name", "origin").distinct()

"""Dependency graphs of classes, and the views of them that queries run on.

A ``CodeGraph`` has two tables: class files (name, byte_size) and dependencies (src, dst).  Everything else is derived: the vertices, the
package roll-up with the classes that cause each dependency, the inverse and the retained view.  All operations return new graphs.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from enum import Enum
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..functions.filters import ANY, NameFilter
from .cut import materialize


class ElemType(Enum):
    """What the vertices of a query are."""

    CLASS = ("class", "classes")
    PACKAGE = ("package", "packages")

    @property
    def singular(self) -> str:
        return self.value[0]

    @property
    def plural(self) -> str:
        return self.value[1]


@dataclass(frozen=True)
class Graph:
    """vertices: (name, byte_size); edges: (src, dst, causes), causes null for classes; tree_key: the order of a walk through the package tree."""

    vertices: DataFrame
    edges: DataFrame
    elem_type: ElemType

    @cached_property
    def kept(self) -> Graph:
        """The same graph, its tables written once: loops read them again and again."""
        return Graph(materialize(self.vertices, "vertices"), materialize(self.edges, "edges"), self.elem_type)


@dataclass(frozen=True)
class CodeGraph:
    """files: (name, file_no_ext, byte_size), a file name once; deps: (src, dst), distinct and without loops."""

    files: DataFrame
    deps: DataFrame
    inverse: bool = False
    retained: NameFilter = ANY

    @staticmethod
    def of(files: DataFrame, deps: DataFrame, merge_nested: bool = False) -> CodeGraph:
        """A graph from raw tables: files (name, byte_size[, file_no_ext, rank]) and deps (src, dst).

        Sizes of 0 or less are ignored; of files with one name the first counts (by rank, then size); with ``merge_nested`` every name stands for
        its top level class.  Rows with nulls are ignored."""
        if "file_no_ext" not in files.columns:
            files = files.withColumn("file_no_ext", names.file_name(F.col("name")))
        rank = F.col("rank") if "rank" in files.columns else F.lit(0)
        files = files.filter("name is not null and byte_size > 0").select("name", "file_no_ext", F.col("byte_size").cast("long").alias("byte_size"), rank.alias("rank"))
        deps = deps.filter("src is not null and dst is not null").select("src", "dst")
        if merge_nested:
            files = files.withColumn("name", names.top_level_class(F.col("name")))
            deps = deps.select(names.top_level_class(F.col("src")).alias("src"), names.top_level_class(F.col("dst")).alias("dst"))
        first = files.groupBy("name", "file_no_ext").agg(F.min(F.struct("rank", "byte_size")).alias("f"))
        return CodeGraph(first.select("name", "file_no_ext", F.col("f.byte_size").alias("byte_size")), deps.filter("src <> dst").distinct())

    def inverted(self, inverse: bool = True) -> CodeGraph:
        """The view in which dependencies point the other way."""
        return replace(self, inverse=inverse)

    def retaining(self, retained: NameFilter) -> CodeGraph:
        """The view that has only the dependencies whose source (after inversion) is accepted."""
        return replace(self, retained=retained)

    def union(self, other: CodeGraph) -> CodeGraph:
        """Both sources together; files of this one count first."""
        files = self.files.withColumn("rank", F.lit(0)).unionByName(other.files.withColumn("rank", F.lit(1)))
        return replace(CodeGraph.of(files, self.deps.unionByName(other.deps)), inverse=self.inverse, retained=self.retained)

    def with_dependency(self, deps: DataFrame) -> CodeGraph:
        """The graph with more dependencies; loops are an error."""
        checked = deps.select(F.when(F.col("src") == F.col("dst"), F.raise_error(F.lit("a class can't depend on itself")).cast("string")).otherwise(F.col("src")).alias("src"), "dst")
        return replace(self, deps=self.deps.unionByName(checked).distinct())

    def without_dependency(self, deps: DataFrame) -> CodeGraph:
        """The graph without some dependencies; causes follow by themselves."""
        return replace(self, deps=self.deps.join(deps.select("src", "dst"), ["src", "dst"], "left_anti"))

    def without(self, accepted: NameFilter) -> CodeGraph:
        """The graph without some classes, their nested classes, files and dependencies."""
        gone = lambda c: accepted(F.col(c)) | F.exists(names.outer_classes(F.col(c)), accepted)
        return replace(self, files=self.files.filter(~gone("name")), deps=self.deps.filter(~gone("src") & ~gone("dst")))

    def without_package(self, package: str) -> CodeGraph:
        """The graph without a package and what is below it."""
        below = lambda c: F.lit(True) if package == "" else (c == package) | c.startswith(f"{package}.")
        gone = lambda c: below(names.package_name(F.col(c)))
        return replace(self, files=self.files.filter(~gone("name")), deps=self.deps.filter(~gone("src") & ~gone("dst")))

    @cached_property
    def class_edges(self) -> DataFrame:
        """(src, dst, cause) of the view; the cause is the class that really depends."""
        edges = self.deps.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("src").alias("cause")) if self.inverse else self.deps.select("src", "dst", F.col("src").alias("cause"))
        return edges if self.retained is ANY else edges.filter(self.retained(F.col("src")))

    @cached_property
    def class_vertices(self) -> DataFrame:
        """(name, byte_size) of the view: parsed classes, targets, and all their outer classes."""
        sizes = self.files.groupBy("name").agg(F.sum("byte_size").alias("byte_size"))
        parsed = sizes.select("name") if self.retained is ANY else sizes.select("name").filter(self.retained(F.col("name")))
        ends = self.class_edges.select(F.explode(F.array("src", "dst")).alias("name"))
        own = parsed.unionByName(ends)
        outers = own.select(F.explode(names.outer_classes(F.col("name"))).alias("name"))
        every = own.withColumn("own", F.lit(True)).unionByName(outers.withColumn("own", F.lit(False))).groupBy("name").agg(F.max("own").alias("own"))
        size = F.coalesce("byte_size", F.lit(0).cast("long"))
        shown = size if self.retained is ANY else F.when(F.col("own"), size).otherwise(F.lit(0).cast("long"))
        return every.join(sizes, "name", "left").select("name", shown.alias("byte_size"))

    @cached_property
    def package_vertices(self) -> DataFrame:
        """(name, byte_size): all packages down from the default one; a package's size is that of the classes directly in it."""
        classes = self.class_vertices.select(names.package_name(F.col("name")).alias("package"), "byte_size")
        direct = classes.groupBy("package").agg(F.sum("byte_size").alias("byte_size"))
        every = direct.select(F.explode(names.ancestor_packages(F.col("package"))).alias("name")).distinct()
        return every.join(direct.withColumnRenamed("package", "name"), "name", "left").select("name", F.coalesce("byte_size", F.lit(0).cast("long")).alias("byte_size"))

    @cached_property
    def package_edges(self) -> DataFrame:
        """(src, dst, causes): a package depends on another if a class of it does."""
        packs = self.class_edges.select(names.package_name(F.col("src")).alias("src"), names.package_name(F.col("dst")).alias("dst"), "cause").filter("src <> dst")
        return packs.groupBy("src", "dst").agg(F.array_sort(F.collect_set("cause")).alias("causes"))

    def graph(self, elem_type: ElemType) -> Graph:
        """The graph of classes or of packages."""
        if elem_type is ElemType.PACKAGE:
            return Graph(self.package_vertices, self.package_edges, elem_type)
        return Graph(self.class_vertices, self.class_edges.select("src", "dst", F.lit(None).cast("array<string>").alias("causes")), elem_type)

    def children(self, package: str) -> DataFrame:
        """(kind, name, byte_size): the classes and packages directly in a package, in tree order."""
        classes = self.class_vertices.filter(names.package_name(F.col("name")) == package).select(F.lit("class").alias("kind"), "name", "byte_size")
        below = (F.col("name") != "") & (names.package_name(F.col("name")) == package)
        return classes.unionByName(self.package_vertices.filter(below).select(F.lit("package").alias("kind"), "name", "byte_size"))

    def nested(self, name: str) -> DataFrame:
        """(name, byte_size) of the classes inside a class, at any depth."""
        return self.class_vertices.filter(F.array_contains(names.outer_classes(F.col("name")), name))

    def file_sizes(self, name: str) -> DataFrame:
        """(file_no_ext, byte_size) of the class files of a class."""
        return self.files.filter(F.col("name") == name).select("file_no_ext", "byte_size")

    def ordered(self, elem_type: ElemType) -> DataFrame:
        """(path, file, name, byte_size): elements with what a walk through the package tree orders them by: a package's classes by file name, then its packages."""
        if elem_type is ElemType.PACKAGE:
            return self.package_vertices.select(names.tree_path(F.col("name")).alias("path"), F.lit("").alias("file"), "name", "byte_size")
        return self.class_vertices.select(names.tree_path(names.package_name(F.col("name"))).alias("path"), names.file_name(F.col("name")).alias("file"), "name", "byte_size")

    def subtree_class_counts(self) -> DataFrame:
        """(name, classes): the number of classes at or below each package."""
        return self.class_vertices.select(F.explode(names.ancestor_packages(names.package_name(F.col("name")))).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("classes"))

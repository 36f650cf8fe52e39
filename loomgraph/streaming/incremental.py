"""A growing set of class files as a stream: files are decoded as they come, and the graph is read from what has come so far."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import names
from ..plans.view import CodeGraph
from ..sources.scan import _DECODED, ParsingFilters, _entries


def decoded_stream(spark: SparkSession, path: str, api_only: bool = False, filters: ParsingFilters = ParsingFilters()) -> DataFrame:
    """(origin, entry, byte_size, name, deps) of the class files and jars that come into a directory."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(path).select("path", "content")
    is_jar = filters.jar(F.col("path")) & ~filters.file(F.col("path"))
    wanted = files.filter(filters.file(F.col("path")) | is_jar).withColumn("is_jar", is_jar)
    return wanted.mapInPandas(_entries(api_only), _DECODED).filter(filters.entry(F.col("entry")) & filters.class_name(F.col("name")))


def start(decoded: DataFrame, table_path: str, checkpoint_path: str) -> StreamingQuery:
    """Appends what comes to a Parquet table, exactly once, and ends when all that is there has been read."""
    return decoded.writeStream.format("parquet").option("path", table_path).option("checkpointLocation", checkpoint_path).trigger(availableNow=True).start()


def graph_so_far(spark: SparkSession, table_path: str, merge_nested: bool = True) -> CodeGraph:
    """The graph of what has been appended; of files with one name the first by path counts."""
    found = spark.read.schema(_DECODED).parquet(table_path)
    rank = F.struct("origin", "entry")
    first = found.groupBy("name").agg(F.min_by("deps", rank).alias("deps"), F.min_by("byte_size", rank).alias("byte_size"))
    files = first.select("name", names.file_name(F.col("name")).alias("file_no_ext"), "byte_size")
    return CodeGraph.of(files, first.select(F.col("name").alias("src"), F.explode("deps").alias("dst")), merge_nested)

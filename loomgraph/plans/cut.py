"""Cutting lineage: tables written in the shared folder, which survive the loss of executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; only where it is unset, on one machine (tests), one of our own.  On a cluster it must be set."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named is None and not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if named is None:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="loomgraph-checkpoint-"))
        named = sc.getCheckpointDir()
    return named.rstrip("/")


def materialize(df: DataFrame, label: str = "cut", compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.  The write's own shuffle files are deleted when it has ended.
    ``compression``: tables of text take less disk with zstd."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomgraph-{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path, compression=compression)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._loomgraph_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what ``materialize`` wrote for ``df``; the caller no longer reads it."""
    path = getattr(df, "_loomgraph_path", None)
    if path is not None:
        jvm, sc = df.sparkSession._jvm, df.sparkSession.sparkContext
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)

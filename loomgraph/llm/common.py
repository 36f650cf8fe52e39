"""Shared plumbing: reading tables, cutting lineage in the shared folder, batches of texts for Arrow functions."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.cut import discard, materialize, shared_dir  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def if_few(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """A written table of a few columns of numbers, to be broadcast if it is counted to have ``most`` rows at most, and to be shuffled otherwise."""
    return F.broadcast(df) if df.count() <= most else df


def map_arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``df.mapInArrow``, after this package has been sent to the executors, which need not have it installed."""
    sc = df.sparkSession.sparkContext
    if not hasattr(sc, "_loomgraph_sent"):
        package = Path(__file__).resolve().parent.parent
        path = Path(tempfile.mkdtemp(prefix="loomgraph-package-")) / "loomgraph.zip"
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f.relative_to(package.parent))
        sc.addPyFile(str(path))
        sc._loomgraph_sent = True
    return df.mapInArrow(run, schema)


def chunks(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 4 << 20, most_rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches of about ``most_bytes`` of text at most (at least one row), so memory is bounded by one slice."""
    for batch in batches:
        lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, total = 0, 0
        for i, n in enumerate(lengths.tolist()):
            if i > start and (total + n > most_bytes or i - start >= most_rows):
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < batch.num_rows:
            yield batch.slice(start)

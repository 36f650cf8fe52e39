"""The corpus pipeline: documents go through five stages, each written as Parquet and read again by the next one.

A stage is a function of (spark, docs, sf_dir).  All but the last return the columns of ``documents``; the last one encodes what is left.

Every stage takes whole tables with nulls in any column.  A null text has no words, so the quality rules reject it; a null id is an id like others, and
documents are told apart by id and text, so neither null nor shared ids lose or tie documents.  Rows that are equal are one document: the near-duplicate
stage keeps one row of it.  Ties between near copies go to the smallest id, then the smallest hash of the text.  Very long texts are taken whole.  An
empty table gives an empty table.  Columns beyond those of ``documents`` pass through all stages but the last, which returns the columns it names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import bpe, lines, minhash, mixing, quality
from loomgraph.llm.common import materialize, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without their boilerplate lines."""
    return quality.apply_rules(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that are near copies of earlier lines; what loses all its lines goes."""
    return lines.drop_lines(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (5-word shingles, similarity 0.8): the one of the smallest id, by id and text; one row of it."""
    kept = minhash.marked(docs).filter("kept").select(F.col("id").alias("_id"), F.col("th").alias("_th")).distinct()
    own = [c.alias(n) for c, n in zip(minhash.identity("doc_id", "text"), ("_id", "_th"), strict=True)]
    return docs.select("*", *own).join(kept, ["_id", "_th"], "left_semi").dropDuplicates(["_id", "_th"]).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rates in the mixture say."""
    return mixing.mix(docs, mixing._labels(spark, sf_dir))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, decoded_sha256): the byte-level BPE ids of each text."""
    import public_tokenizers

    encoded = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, outputs=("n_tokens", "ids", "decoded_sha256"))
    return encoded.select("doc_id", "lang", "source", "n_tokens", "ids", "decoded_sha256")


STAGES = [("quality", quality_stage), ("lines", line_stage), ("near duplicates", near_stage), ("mixing", mixing_stage), ("encoding", encoding_stage)]

#: SQL can't express the stages from line dedup on; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

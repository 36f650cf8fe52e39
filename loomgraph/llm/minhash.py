"""MinHash near-dedup of documents.

A document's set has its distinct word shingles as 64-bit hashes.  128 universal hash functions (odd multiplier and addend modulo 2^64) give
its minima; 32 bands of 4 minima are its buckets, which a pair of similarity 0.8 misses with a probability of 5e-8.  Documents with
equal sets become one item first.  Links are confirmed on full sets (module ``similar``), and components found by alternating
large-star and small-star.

Null texts and texts without words have an empty set and link with nothing.  With fewer words than a shingle has, the whole sequence is
the one element.  Very long texts are shingled whole.  Rows are told apart by id and text, so rows of one id, or without one, are
linked by their texts only.  A null id is treated as the largest id, so it is never the smallest of others, and is null in the result.  The operator selects the columns it
names, so extra columns do not clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, map_arrow, materialize, table
from .similar import linked_components, most_unequal, shared_buckets, unequal_bits
from .substrings import Prefixes, _mixed

BANDS, ROWS = 32, 4
_NO_ID = (1 << 63) - 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = ~np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_RNG = np.random.default_rng(20_240_229)
_TIMES = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RNG.integers(0, 1 << 64, BANDS * ROWS, np.uint64)
_PLACES = _RNG.integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


def word_hashes(text: str | None) -> np.ndarray:
    """A hash of each word, after A-Z are lower-cased; words are what stands between spaces and \\t to \\r."""
    data = _LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], _IS_WORD[data], [False])).astype(np.int8)))
    start, end = edges[::2], edges[1::2]
    return _mixed(Prefixes(data).of(start, end - start) + (end - start).astype(np.uint64))


def shingles(text: str | None, words: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a whole text."""
    each = word_hashes(text)
    if not len(each):
        return each
    if len(each) < words:
        return _mixed(np.array([sum(int(h) * int(p) for h, p in zip(each, _PLACES, strict=False)) + len(each) & (1 << 64) - 1], np.uint64))
    total = np.zeros(len(each) - words + 1, np.uint64)
    for i in range(words):
        total += each[i : len(total) + i] * _PLACES[i]
    return np.unique(_mixed(total))


def minima(elements: np.ndarray) -> np.ndarray:
    """The minimum of every hash function over a set."""
    least = np.full(len(_TIMES), np.iinfo(np.uint64).max)
    for k in range(0, len(elements), 1024):
        least = np.minimum(least, (elements[k : k + 1024, None] * _TIMES + _PLUS).min(0))
    return least >> np.uint64(16)


def _sketch(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _RNG_POWERS
        for part in chunks(batches, "text"):
            sets = [shingles(x, words) for x in part.column("text").to_pylist()]
            low = np.array([minima(x) for x in sets])
            bands = _mixed((low.reshape(len(sets), BANDS, ROWS) * powers).sum(2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * _PLACES[40])
            bits = np.packbits((_mixed(low) & np.uint64(1)).astype(np.uint8), axis=1).view(">i8").astype(np.int64)
            lists = lambda x: pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.array(x.ravel()))
            digest = pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).hexdigest() for x in sets])
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("th"), pa.array([len(x) for x in sets], pa.int64()), digest, lists(bands.view(np.int64)), lists(bits)], names=["id", "th", "n", "digest", "bands", "bits"])

    return run


_RNG_POWERS = _PLACES[50 : 50 + ROWS]


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([shingles(x, words).view(np.int64) for x in part.column("text").to_pylist()], pa.list_(pa.int64()))], names=["id", "elements"])

    return run


#: 1-bit min-hashes of the candidates that the pivots leave open.
FINE = 2048


def _fine():
    """2048 1-bit min-hashes of a set, as longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(7)
        times = rng.integers(0, 1 << 63, FINE, np.uint64) * np.uint64(2) + np.uint64(1)
        for batch in batches:
            out = []
            for elements in batch.column("elements"):
                values = elements.values.to_numpy().view(np.uint64)
                least = np.full(FINE, np.iinfo(np.uint64).max)
                for k in range(0, len(values), 256):
                    least = np.minimum(least, (values[k : k + 256, None] * times).min(0))
                out.append(np.packbits((_mixed(least) & np.uint64(1)).astype(np.uint8)).view(">i8").astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.list_(pa.int64()))], names=["id", "fine"])

    return run


def identity(key: str, text: str) -> list[Column]:
    """(id, th): what tells rows apart."""
    return [F.coalesce(F.col(key).cast("long"), F.lit(_NO_ID)).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th")]


def marked(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """(id, th, n, component_id, kept) for every row by ``identity``: kept tells whether it is the smallest (id, th) reachable, component_id is that one's id."""
    texts = docs.select(*identity(key, text), F.coalesce(F.col(text), F.lit("")).alias("text"))
    sketches = materialize(map_arrow(texts, _sketch(words), "id long, th long, n long, digest string, bands array<long>, bits array<long>").withColumn("class", F.xxhash64("digest")), "sketches")
    classes = materialize(sketches.filter("n > 0").groupBy("class").agg(F.min(F.struct("id", "th", "n", "bits", "bands")).alias("one")).select("class", "one.*"), "classes")
    members = materialize(shared_buckets(classes.select(F.col("class").alias("id"), F.explode("bands").alias("bucket")).distinct()), "members")
    wanted = classes.join(members.select(F.col("id").alias("class")).distinct(), "class", "left_semi").select("id", "th", "class")
    found = texts.join(wanted, ["id", "th"]).groupBy("class").agg(F.first("text").alias("text")).select(F.col("class").alias("id"), "text")
    sets = materialize(map_arrow(found, _sets(words), "id long, elements array<long>"), "sets")
    items = classes.select(F.col("class").alias("id"), "n", "bits", F.col("bands").alias("buckets"))
    finer = lambda x: map_arrow(x, _fine(), "id long, fine array<long>")
    near = linked_components(items, members, sets, percent, 128, finer, lambda x, y: unequal_bits(x, y, FINE) <= most_unequal(FINE, percent))
    told = classes.select("class", "id", "th").join(near.select(F.col("id").alias("class"), "component"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    smallest = told.groupBy("component").agg(F.min(F.struct("id", "th")).alias("least"))
    of_class = told.join(smallest, "component").select("class", "least")
    own = F.struct("id", "th")
    joined = sketches.select("id", "th", "n", "class").join(of_class, "class", "left").withColumn("least", F.when(F.col("n") > 0, F.col("least")).otherwise(own))
    return joined.select("id", "th", "n", F.col("least.id").alias("component_id"), (F.col("least") == own).alias("kept"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """(key, n_shingles, component_id, kept) for every row: the size of its set, the smallest id reachable by links, and whether it is the row kept."""
    key_type = docs.schema[key].dataType
    shown = lambda c: F.when(F.col(c) != _NO_ID, F.col(c)).cast(key_type)
    return marked(docs, key, text, words, percent).select(shown("id").alias(key), F.col("n").alias("n_shingles"), shown("component_id").alias("component_id"), "kept")


def op8_minhash(spark, sf_dir: str) -> DataFrame:
    """Every document's component of near duplicates, on 4-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"), words=4)

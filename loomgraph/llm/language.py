"""Language identification by rank-order profiles.

A profile is the list of a language's most frequent letter n-grams (1 to 3 letters, words padded with a space), by rank.  A document's
own most frequent n-grams are compared with each profile: the out-of-place distance adds up how far each n-gram's rank is
from its rank in the profile, and a fixed amount for n-grams that the profile lacks.  The nearest language wins.

Null texts and texts without a letter are ``und`` with score 0; so is everything if nothing was learned.  Ties go to the language that
sorts first.  Whole texts are counted, however long.  Repeated rows give equal rows.  Extra columns pass through ``predict``; its output
columns replace columns of the same name.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, map_arrow, materialize, table

_SPACE = 32
#: Rows of picked keys up to which they are broadcast.
MOST_BROADCAST = 200_000


@cache
def _letters() -> np.ndarray:
    """By code point: whether it is a letter or a mark, which words consist of."""
    out = np.zeros(0x110000, bool)
    for c in range(0x110000):
        out[c] = unicodedata.category(chr(c))[0] in "LM"
    return out


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a whole text, as numbers made of code points, and their counts."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    points = np.where(_letters()[points], points, _SPACE)
    points = np.concatenate(([_SPACE], points, [_SPACE]))
    points = points[np.concatenate(([True], (points[1:] != _SPACE) | (points[:-1] != _SPACE)))]
    two = points[:-1] << 21 | points[1:]
    three = two[:-1] << 21 | points[2:]
    inside = points[1:-1] != _SPACE
    return np.unique(np.concatenate((points[points != _SPACE], two, three[inside])), return_counts=True)


def _top(grams: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams in order; ties by the n-gram."""
    return grams[np.lexsort((grams, -counts))[:size]]


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = 1000, size: int = 300) -> dict[str, list[int]]:
    """The profiles of the languages of ``lang``, from ``per_language`` documents of each at most, those of the smallest hash of their key.

    ``per_language`` and ``size`` bound what is read and what reaches the driver; rows with null text or lang are left out."""
    labelled = docs.filter(F.col(text).isNotNull() & F.col(lang).isNotNull())
    order = Window.partitionBy("_lang").orderBy(F.xxhash64("_key"), "_key")
    picked = labelled.select(F.col(lang).alias("_lang"), F.col(key).alias("_key")).withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= per_language)
    picked = materialize(picked.select("_lang", "_key").distinct(), "picked")
    few = F.broadcast if picked.count() <= MOST_BROADCAST else lambda x: x
    sample = labelled.select(F.col(lang).alias("_lang"), F.col(key).alias("_key"), F.col(text).alias("_text")).join(few(picked), ["_lang", "_key"], "left_semi")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, list] = {}
        for part in chunks(batches, "_text"):
            for name, content in zip(part.column("_lang").to_pylist(), part.column("_text").to_pylist(), strict=True):
                totals.setdefault(name, []).append(ngrams(content))
            for name, found in totals.items():
                grams, at = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
                sums = np.zeros(len(grams), np.int64)
                np.add.at(sums, at, np.concatenate([c for _, c in found]))
                totals[name] = [(grams, sums)]
        for name, ((grams, sums),) in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(grams), pa.string()), pa.array(grams), pa.array(sums)], names=["lang", "gram", "n"])

    counted = map_arrow(sample.select("_lang", "_text"), count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    rows = counted.withColumn("rank", rank).filter(F.col("rank") <= size).collect()
    profiles: dict[str, list[int]] = {}
    for row in sorted(rows, key=lambda r: (r["lang"], r["rank"])):
        profiles.setdefault(row["lang"], []).append(row["gram"])
    return profiles


class Profiles:
    """Profiles ready to be compared with documents."""

    def __init__(self, profiles: dict[str, list[int]], size: int):
        self.names, self.size, self.tables = sorted(profiles), size, []
        for name in self.names:
            grams = np.array(profiles[name], np.int64)
            order = np.argsort(grams)
            self.tables.append((grams[order], order))

    def nearest(self, text: str | None) -> tuple[str, float]:
        """The nearest language, and 1 minus its distance's share of the largest distance possible."""
        if not self.names or not any(map(str.isalpha, text or "")):
            return "und", 0.0
        grams, counts = ngrams(text)
        grams = _top(grams, counts, self.size)
        ranks = np.arange(len(grams))
        distances = []
        for known, rank in self.tables:
            at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
            distances.append(int(np.where(known[at] == grams, np.abs(rank[at] - ranks), self.size).sum()))
        best = int(np.argmin(distances))
        return self.names[best], 1.0 - distances[best] / (self.size * len(grams))


def predict(docs: DataFrame, profiles: dict[str, list[int]], text: str = "text", size: int = 300) -> DataFrame:
    """``docs`` with lang_pred and score."""
    kept = docs.drop(*[c for c in ("lang_pred", "score") if c != text])
    schema = T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Profiles(profiles, size)
        for part in chunks(batches, text):
            found = [known.nearest(x) for x in part.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=schema.names)

    return map_arrow(kept, run, schema)


def op7_language(spark, sf_dir: str) -> DataFrame:
    """Every document's language; learned from the documents whose checksum isn't divisible by five."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    profiles = learn(docs.filter(~held_out))
    return predict(docs.select("doc_id", held_out.alias("held_out"), "text"), profiles).select("doc_id", "held_out", "lang_pred", "score")

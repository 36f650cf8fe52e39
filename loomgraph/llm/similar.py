"""Exact links between similar sets, from shared min-hash buckets (DataFrame operations only).

Items have an ``id``, the size ``n`` of their set, 1-bit min-hashes packed in longs (``bits``) and a row (id, bucket) for each band.  A
group's pairs are not emitted as such:

1. Every member of a bucket is paired with one pivot of it, the member with the smallest share of elements that no other candidate
   has.  Bounds rule pairs out, the others are confirmed on the full sets, and the links' components are found.
2. Buckets whose members are in one component need nothing more.  In the others, members of different components are compared by
   the same bounds and by a finer one that the caller has, in the first bucket that they share, and what passes is confirmed on the full sets.  Inside
   such a bucket the bounds are looked at for each two members of different components; only pairs that pass them leave the join.

The bounds: sizes must allow the similarity; so must the elements that occur in two candidates at all (an element of one candidate only
is in no intersection); and the packed min-hashes must agree as far as a similarity at the threshold would bring about within 4.5 standard deviations.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize
from .components import components


def shared_buckets(buckets: DataFrame) -> DataFrame:
    """The rows (id, bucket) whose bucket has another id."""
    several = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("bucket")
    return buckets.join(several, "bucket").select("id", "bucket")


def unequal_bits(x: Column, y: Column, n_bits: int) -> Column:
    """The number of unequal bits of two arrays of longs."""
    return sum((F.bit_count(x[i].bitwiseXOR(y[i])) for i in range(n_bits // 64)), F.lit(0))


def most_unequal(n_bits: int, percent: int, deviations: float = 4.5) -> int:
    """The number of unequal 1-bit min-hashes that a pair at the similarity passes with a probability of less than 1e-5."""
    p = (1 - percent / 100) / 2
    return math.floor(n_bits * p + deviations * math.sqrt(n_bits * p * (1 - p)))


def _could_link(x: str, y: str, percent: int, n_bits: int) -> Column:
    """Whether two items can have the similarity, by sizes, shared elements and packed min-hashes."""
    n = lambda s: F.col(f"{s}.n")
    largest = F.least(f"{x}.shared", f"{y}.shared")
    unequal = unequal_bits(F.col(f"{x}.bits"), F.col(f"{y}.bits"), n_bits)
    return (100 * F.least(n(x), n(y)) >= percent * F.greatest(n(x), n(y))) & (100 * largest >= percent * (n(x) + n(y) - largest)) & (unequal <= most_unequal(n_bits, percent))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have the similarity."""
    first = pairs.join(sets.select(F.col("id").alias("a"), F.col("elements").alias("ea")), "a")
    both = first.join(sets.select(F.col("id").alias("b"), F.col("elements").alias("eb")), "b")
    common = both.select("a", "b", (F.size("ea") + F.size("eb")).alias("total"), F.size(F.array_intersect("ea", "eb")).alias("common"))
    return common.filter(100 * F.col("common") >= percent * (F.col("total") - F.col("common"))).select("a", "b")


def _pairs(x: DataFrame, percent: int, n_bits: int) -> DataFrame:
    return x.filter(_could_link("x", "y", percent, n_bits)).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def linked_components(items: DataFrame, members: DataFrame, sets: DataFrame, percent: int, n_bits: int, finer: Callable[[DataFrame], DataFrame], could_be: Callable[[Column, Column], Column]) -> DataFrame:
    """(id, component) of the items that have a link: two items link if their sets' Jaccard similarity is ``percent`` or more.

    items: (id, n, bits, buckets), an id once; members: ``shared_buckets``; sets: (id, elements) of the members, elements distinct.
    finer: makes (id, fine) of rows of sets, could_be: a condition on two values of fine that every link meets."""
    elements = sets.select("id", F.explode("elements").alias("e"))
    alone = elements.groupBy("e").agg(F.count(F.lit(1)).alias("k"), F.min("id").alias("id")).filter("k = 1").groupBy("id").agg(F.count(F.lit(1)).alias("alone"))
    candidates = sets.select("id").join(alone, "id", "left").join(items, "id").select("id", "n", "bits", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("shared"))
    # an item links only if another candidate has the share of its elements that the similarity asks for
    candidates = candidates.filter(100 * F.col("shared") >= percent * F.col("n"))
    about = materialize(candidates.select("id", F.struct("id", "n", "shared", "bits").alias("x")), "candidates")
    told = members.join(about, "id").select("bucket", "x")
    pivots = told.groupBy("bucket").agg(F.min(F.struct((-F.col("x.shared") / F.col("x.n")).alias("order"), F.col("x.id").alias("id"), F.col("x").alias("y"))).alias("p")).select("bucket", "p.y")
    star = materialize(_confirmed(_pairs(told.join(pivots, "bucket").filter("x.id <> y.id"), percent, n_bits), sets, percent), "links")
    found = components(star)
    parts = told.select("bucket", "x.id").join(found, "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("component"))
    open_ = parts.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("bucket")
    open_rows = materialize(parts.join(open_, "bucket"), "open")
    asked = open_rows.select("id").distinct()
    fine = materialize(finer(sets.join(asked, "id")).join(items.select("id", "buckets"), "id").select("id", F.struct("fine", "buckets").alias("z")), "fine")
    rest = open_rows.join(about, "id").join(fine, "id").select("bucket", "component", "x", "z")
    others = rest.select("bucket", F.col("component").alias("other"), F.col("x").alias("y"), F.col("z").alias("u"))
    first_shared = F.array_min(F.array_intersect("z.buckets", "u.buckets")) == F.col("bucket")
    pairs = rest.join(others, "bucket").filter((F.col("x.id") < F.col("y.id")) & (F.col("component") != F.col("other")) & _could_link("x", "y", percent, n_bits) & could_be(F.col("z.fine"), F.col("u.fine")) & first_shared)
    more = materialize(_confirmed(pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")), sets, percent), "links")
    if not more.isEmpty():
        found = components(star.unionByName(more))
    for x in (open_rows, fine, more):
        discard(x)
    return found

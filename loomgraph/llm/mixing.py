"""Mixing to target weights with soft membership (DataFrame operations only).

1. A naive Bayes classifier is fitted on labelled documents, ``per_domain`` of each domain at most, those of the smallest hash of their id: for
   each hashed token, the documents of each domain that have it.  Tokens that tell domains apart become a table of weights of a fixed size.
2. Every document's evidence is added up over its distinct tokens and gives its posterior over the domains.
3. Nonnegative rates, one for each document, are fitted so that the expected token totals of the domains (rate x tokens x posterior) come to
   the targets: a rate is 1 plus a multiple of each posterior, projected on what is not negative, and the multiples follow the gradient,
   which is the domains' residuals, scaled by the domains' moments among the documents of a positive rate (Newton's method with halved steps).
   An iteration is one aggregation to a row; nothing of a document's size goes to the driver.  It ends when every domain is within the tolerance
   of its own target; targets that can't be met are told of.

Null texts and texts without tokens have the prior as posterior and weigh nothing in the totals.  A domain without labelled documents has the
smoothed prior; without any labels all domains are alike.  Repeated rows get equal rates.  Labels that repeat an id count once, the smallest
domain number first; labels with nulls are left out.  Very long texts are taken whole.  Extra columns do not clash: ``rates`` returns the columns
it names, ``mix`` exactly those it got.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import if_few, materialize, table
from .quality import _NO_ID, _identity

DOMAINS = ("good", "plain", "toxic")
#: Target weights, as multiples of the domains' own shares of the corpus (unless they are asked for as absolute shares).
WEIGHTS = {"good": 1.0, "plain": 1.0, "toxic": 0.3}
_SYMBOLS = "#*$%&|!?"
#: Hash buckets of tokens.
BUCKETS = 1 << 24


def label_domain(quality: Column, toxic: Column) -> Column:
    """The number of a label's domain."""
    return F.when(toxic == 1, 2).when(quality == 1, 0).when(quality == 0, 1)


def _tokens(text: Column) -> Column:
    """Words in lower case: full stops, commas and line ends part words like spaces do, each symbol of ``_SYMBOLS`` is a word."""
    one = F.lower(F.coalesce(text, F.lit("")))
    for x in ".,\n":
        one = F.replace(one, F.lit(x), F.lit(" "))
    for x in _SYMBOLS:
        one = F.replace(one, F.lit(x), F.lit(f" {x} "))
    return F.array_remove(F.split(one, " "), "")


def _bucket(token: Column) -> Column:
    return F.xxhash64(token).bitwiseAND(BUCKETS - 1).cast("int")


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", per_domain: int = 10_000, least_share: float = 0.05, least_deviation: float = 5.0, least_evidence: float = 0.5, most_evidence: float = 3.0) -> tuple[DataFrame, list[float]]:
    """The weights (bucket, w0, w1, ...) and the domains' priors, from labels (key, domain).

    A token's weight for a domain compares its share of the domain's (document, token) pairs with its share of all; only tokens count that some
    domain has ``least_deviation`` standard deviations more or less often than expected and that ``least_share`` of a domain's documents
    have, so that the words of one group of copies don't count as evidence; its weights must differ by ``least_evidence``
    and are held within ``most_evidence``, so that no single token decides."""
    clean = labels.filter(F.col("domain").isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.min("domain").alias("domain"))
    picked = None
    for i in range(len(DOMAINS)):
        part = clean.filter(F.col("domain") == i).orderBy(F.xxhash64(key), key).limit(per_domain)
        picked = part if picked is None else picked.unionByName(part)
    picked = materialize(picked.select(F.col(key).alias("_key"), "domain"), "labelled")
    told = docs.filter(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(picked), "_key")
    own = told.select("domain", F.array_distinct(F.transform(_tokens(F.col("_text")), _bucket)).alias("buckets"))
    per = [F.sum((F.col("domain") == i).cast("long")).alias(f"n{i}") for i in range(len(DOMAINS))]
    counted = own.select("domain", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(*per)
    counted = materialize(counted, "counted")
    found = told.groupBy("domain").count().collect()
    n = [sum(r["count"] for r in found if r["domain"] == i) for i in range(len(DOMAINS))]
    mass = [float(x or 0) for x in counted.agg(*[F.sum(f"n{i}") for i in range(len(DOMAINS))]).first()]
    share = clean.groupBy("domain").count().collect()
    sizes = [sum(r["count"] for r in share if r["domain"] == i) for i in range(len(DOMAINS))]
    total = sum((F.col(f"n{i}") for i in range(len(DOMAINS))), F.lit(0))
    expected = [total * (m / max(sum(mass), 1.0)) for m in mass]
    # smoothed by half a document on both sides: a token that all domains have alike weighs nothing, however many labelled documents each domain has
    weights = [F.log((F.col(f"n{i}") + 0.5) / (e + 0.5)).alias(f"w{i}") for i, e in enumerate(expected)]
    clear = F.greatest(*[F.abs(F.col(f"n{i}") - e) / F.sqrt(e + 1) for i, e in enumerate(expected)]) >= least_deviation
    common = F.greatest(*[F.col(f"n{i}") / max(x, 1) for i, x in enumerate(n)]) >= least_share
    table_ = counted.filter(common & clear).select("bucket", *weights)
    names = [f"w{i}" for i in range(len(DOMAINS))]
    table_ = table_.filter(F.greatest(*names) - F.least(*names) >= least_evidence)
    table_ = table_.select("bucket", *[F.greatest(F.lit(-most_evidence), F.least(F.lit(most_evidence), w)).alias(w) for w in names])
    return materialize(table_, "weights"), [(x + 1) / (sum(sizes) + len(DOMAINS)) for x in sizes]


def posteriors(docs: DataFrame, weights: DataFrame, priors: list[float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(k, th, n_tokens, p0, p1, ...) for each document by ``_identity``: its tokens and its posterior.

    Every weight is of a token that a twentieth of a domain's labelled documents have, so there are at most twenty times as many as such a
    document has tokens on average, however large the corpus is: they are counted, and broadcast if they are that few."""
    import math

    tokens = docs.select(*_identity(key, text), _tokens(F.col(text)).alias("tokens")).select("k", "th", F.size("tokens").cast("long").alias("n"), F.array_distinct("tokens").alias("tokens"))
    exploded = tokens.select("k", "th", "n", F.posexplode_outer("tokens").alias("place", "token")).select("k", "th", "n", _bucket(F.col("token")).alias("bucket"), (F.coalesce("place", F.lit(0)) == 0).alias("first"))
    names = [f"w{i}" for i in range(len(DOMAINS))]
    # whole numbers add up alike in any order
    whole = weights.select(F.col("bucket").alias("b"), *[F.round(F.col(w) * 1e6).cast("long").alias(w) for w in names])
    joined = exploded.join(if_few(whole), F.col("bucket") == F.col("b"), "left")
    # a document's first row stays, and those of evidence; all of them are in one task, so one row of the document is shuffled
    told = joined.filter(F.col("first") | F.col("b").isNotNull())
    added = told.groupBy("k", "th", F.col("n").alias("n_tokens")).agg(F.count("b").alias("hits"), *[F.coalesce(F.sum(w), F.lit(0)).alias(w) for w in names])
    damped = [F.col(w) / 1e6 / F.sqrt(F.greatest(F.lit(1.0), F.col("hits") / 16)) + F.lit(math.log(p)) for w, p in zip(names, priors, strict=True)]
    logits = added.select("k", "th", "n_tokens", *[x.alias(f"l{i}") for i, x in enumerate(damped)])
    most = F.greatest(*[f"l{i}" for i in range(len(DOMAINS))])
    power = [F.exp(F.col(f"l{i}") - most) for i in range(len(DOMAINS))]
    return logits.select("k", "th", "n_tokens", *[F.round(x / sum(power[1:], power[0]), 6).alias(f"p{i}") for i, x in enumerate(power)])


def fit_rates(members: DataFrame, weights: dict[str, float], most_iterations: int = 30, tolerance: float = 0.005, absolute: bool = False) -> tuple[Column, dict]:
    """The rate as a column over (n_tokens, p0, ...), and a report: iterations, targets, totals before and after, the largest relative error, and whether
    it is within the tolerance; a warning tells if it is not.

    A domain's target is its own share of the tokens times its weight, or, if ``absolute``, its weight as a share; targets together come to the tokens
    there are."""
    import warnings

    import numpy as np

    members = members.groupBy("n_tokens", *[f"p{i}" for i in range(len(DOMAINS))]).agg(F.count(F.lit(1)).alias("copies"))
    members = materialize(members, "members")
    mass = F.col("n_tokens") * F.col("copies")
    p = [F.col(f"p{i}") for i in range(len(DOMAINS))]
    totals = [float(x) for x in members.agg(*[F.coalesce(F.sum(mass * x), F.lit(0.0)) for x in p]).first()]
    everything = sum(totals)
    report = {"iterations": 0, "before": totals, "after": totals, "targets": totals, "error": 0.0, "met": True}
    if everything <= 0:
        return F.lit(1.0), report
    asked = [weights[d] * (1.0 if absolute else x) for d, x in zip(DOMAINS, totals, strict=True)]
    targets = [everything * x / (sum(asked) or 1.0) for x in asked]
    # each domain in units of its own total
    scale = np.array([max(x, 1e-9 * everything) for x in totals])
    wanted = np.array(targets) / scale
    pairs = [(i, j) for i in range(len(p)) for j in range(i, len(p))]
    ridge = 1e-6

    def moved(by) -> Column:
        return F.greatest(F.lit(0.0), sum((x * F.lit(float(m * everything / s)) for x, m, s in zip(p, by, scale, strict=True)), F.lit(1.0)))

    def at(by):
        """The totals with these multiples; the value, gradient and second derivatives of the function that is least where the targets are met."""
        weighted = members.select(*p, mass.alias("m"), moved(by).alias("r"))
        m, r = F.col("m"), F.col("r")
        row = weighted.agg(F.sum(m * r * r), *[F.sum(m * r * x) for x in p], *[F.sum(F.when(r > 0, m * p[i] * p[j]).otherwise(0.0)) for i, j in pairs]).first()
        after = np.array([float(x) for x in row[1 : len(p) + 1]])
        second = np.zeros((len(p), len(p)))
        for (i, j), value in zip(pairs, row[len(p) + 1 :], strict=True):
            second[i, j] = second[j, i] = float(value) * everything / (scale[i] * scale[j])
        return after, float(row[0]) / everything / 2 - wanted @ by + ridge / 2 * by @ by, after / scale - wanted + ridge * by, second

    by = np.zeros(len(p))
    after, value, gradient, second = at(by)
    for iteration in range(most_iterations + 1):
        error = max(abs(a - t) / (t or everything) for a, t in zip(after, targets, strict=True))
        report |= {"iterations": iteration, "after": after.tolist(), "targets": targets, "error": float(error), "met": bool(error <= tolerance)}
        # without a gradient this is the best that can be had
        if report["met"] or iteration == most_iterations or max(abs(gradient)) < 1e-5:
            break
        step = -np.linalg.solve(second + (ridge + 1e-9 * np.trace(second)) * np.eye(len(p)), gradient)
        for half in range(10):
            trial = by + step / 2**half
            found = at(trial)
            if found[1] <= value + 1e-4 * gradient @ (trial - by):
                break
        else:
            break
        by, (after, value, gradient, second) = trial, found
    if not report["met"]:
        warnings.warn(f"targets not met within {tolerance}: {report}", stacklevel=2)
    return moved(by), report


def _fitted(docs: DataFrame, labels: DataFrame, weights: dict[str, float], key: str, text: str, per_domain: int, absolute: bool) -> DataFrame:
    table_, priors = fit(docs, labels, key, text, per_domain)
    members = materialize(posteriors(docs, table_, priors, key, text), "posteriors")
    rate, _ = fit_rates(members, weights, absolute=absolute)
    return members.withColumn("rate", F.round(rate, 4))


def rates(docs: DataFrame, labels: DataFrame, weights: dict[str, float] = WEIGHTS, key: str = "doc_id", text: str = "text", per_domain: int = 10_000, absolute: bool = False) -> DataFrame:
    """(key, n_tokens, p_good, p_plain, p_toxic, domain, rate), a row for each distinct document; labels is (key, domain)."""
    fitted = _fitted(docs, labels, weights, key, text, per_domain, absolute)
    best = F.greatest(*[f"p{i}" for i in range(len(DOMAINS))])
    domain = F.coalesce(*[F.when(F.col(f"p{i}") == best, F.lit(d)) for i, d in enumerate(DOMAINS)])
    return fitted.select(F.when(F.col("k") != _NO_ID, F.col("k")).cast(docs.schema[key].dataType).alias(key), "n_tokens", *[F.col(f"p{i}").alias(f"p_{d}") for i, d in enumerate(DOMAINS)], domain.alias("domain"), "rate")


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float] = WEIGHTS, key: str = "doc_id", text: str = "text", per_domain: int = 10_000, absolute: bool = False) -> DataFrame:
    """``docs`` by their rates: a document is there as often as its rate says, the fraction decided by a hash of its key and text."""
    columns = docs.columns
    fitted = _fitted(docs, labels, weights, key, text, per_domain, absolute).select("k", "th", "rate")
    chance = F.xxhash64("k", "th", F.lit("mix")).bitwiseAND((1 << 30) - 1) / (1 << 30)
    times = fitted.select("k", "th", F.floor(F.col("rate") + chance).cast("int").alias("times")).filter("times > 0")
    told = docs.select(F.struct(*columns).alias("row"), *_identity(key, text)).join(times, ["k", "th"])
    return told.select("row", F.explode(F.sequence(F.lit(1), "times"))).select(*[F.col("row")[c].alias(c) for c in columns])


def _labels(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", label_domain(F.col("quality"), F.col("toxic")).alias("domain"))


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    """Every document's posterior over the labels' domains, and its rate in the mixture."""
    return rates(table(spark, sf_dir, "documents"), _labels(spark, sf_dir))

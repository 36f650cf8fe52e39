"""The pipeline and the registered queries on the smallest tables."""

import hashlib
import math
import random
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import tiktoken
from loomgraph.llm import bpe, mixing, queries

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), "test")
        assert docs.columns == columns, name
        assert 0 < docs.count() <= 2 * before
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == docs.count() and last.filter("n_tokens * 4 <> octet_length(ids)").isEmpty()
    assert corpus_pipeline.run(spark, SF).count() == docs.count()


def _near(sets, percent=80):
    """For each set the first one that links of the similarity lead to."""
    first = [*range(len(sets))]
    for _ in sets:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= percent * len(a | b):
                    first[i] = first[j] = min(first[i], first[j])
    return first


def test_stages_against_brute_force(spark):
    """Each stage on what the one before it kept, by plain Python."""
    rng = random.Random(17)
    words = ["".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(3, 9))) for _ in range(500)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, shared = prose(90), prose(20)
    near = base.split(" ")
    near[40] = "x"
    texts = [base, " ".join(near), base, prose(30), "spam eggs " * 60, f"{prose(70)}\n{shared}", f"{prose(70)}\n{shared[:60]}z{shared[61:]}\n{prose(15)}", prose(2000), None, "", *[prose(60 + i) for i in range(20)]]
    rows = [(i if i != 12 else None, x, "en", f"s{i % 2}", None if x is None else len(x)) for i, x in enumerate(texts)] + [(7, texts[7], "en", "s1", len(texts[7]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    held = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)

    def good(text):
        w = (text or "").split()
        windows = Counter(zip(w, w[1:], w[2:]))
        again = {i + o for i in range(len(w) - 2) if windows[w[i], w[i + 1], w[i + 2]] > 1 for o in range(3)}
        return len(w) >= 50 and 100 * len(again) <= 50 * len(w)

    kept = corpus_pipeline.materialize(stages["quality"](spark, docs, SF), "test")
    expected = sorted(((r[0], r[1]) for r in rows if good(r[1])), key=str)
    assert held(kept) == expected

    # equal rows are one document; a null id comes first
    order = sorted(set(expected), key=lambda x: (-1 if x[0] is None else x[0]))
    places = [(k, t, line) for k, t in order for line in t.split("\n")]
    letters = lambda x: {x[i : i + 10] for i in range(max(1, len(x) - 9))}
    first = _near([letters(line.lower()) for _, _, line in places])
    left = {(k, t): "\n".join(line for i, (a, b, line) in enumerate(places) if (a, b) == (k, t) and first[i] == i) for k, t in order}
    after = corpus_pipeline.materialize(stages["lines"](spark, kept, SF), "test")
    assert held(after) == sorted(((k, left[k, t]) for k, t in expected if left[k, t]), key=str)

    again = sorted({(r["doc_id"], r["text"]) for r in after.collect()}, key=lambda x: (1 << 63 if x[0] is None else x[0]))
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for _, t in again for w in [t.lower().split()]]
    first = _near(sets)
    unique = corpus_pipeline.materialize(stages["near duplicates"](spark, after, SF), "test")
    assert held(unique) == sorted((x for i, x in enumerate(again) if first[i] == i), key=str)

    labels = mixing._labels(spark, SF)
    rate = {r["doc_id"]: r["rate"] for r in mixing.rates(unique, labels).collect()}
    mixed = corpus_pipeline.materialize(stages["mixing"](spark, unique, SF), "test")
    times = Counter(r["doc_id"] for r in mixed.collect())
    assert all(math.floor(x) <= times[k] <= math.floor(x) + 1 for k, x in rate.items()) and times.keys() <= rate.keys()

    ranks = bpe.load_ranks(open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read())
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    text_of = {r["doc_id"]: r["text"] for r in unique.collect()}
    for r in stages["encoding"](spark, mixed, SF).collect():
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == library.encode_ordinary(text_of[r["doc_id"]])
        assert r["decoded_sha256"] == hashlib.sha256(text_of[r["doc_id"]].encode()).hexdigest()


def test_ten_operators_are_registered():
    assert {int(name[2:].split("_")[0]) for name in queries.QUERIES} == set(range(1, 11))


def test_oracles_are_sql():
    assert all(isinstance(x, str) for x in queries.ORACLES.values())

"""Each operator on nulls, empty and long texts, repeated rows, ties, empty tables and clashing columns, against brute force."""

import hashlib
import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import corpus_pipeline
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomgraph.llm import bpe, components, language, lines, media, minhash, mixing, passages, quality, substrings, token_counts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k long, w string, bucket int"
RNG = random.Random(11)
WORDS = ["".join(RNG.choice("abcdefghijklmnop") for _ in range(RNG.randint(2, 8))) for _ in range(400)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(text, rate, rng=RNG):
    return " ".join(rng.choice(WORDS) if rng.random() < rate else w for w in text.split(" "))


@pytest.fixture(scope="module")
def texts():
    base, shared, boiler = [prose(120) for _ in range(6)], prose(70), "subscribe to our newsletter today"
    out = [*base, *[edited(base[0], r) for r in (0.01, 0.03, 0.05, 0.1, 0.3)], base[1], base[1], prose(3000), None, "", " \n\t\r\x0b", "one", "one two three", "A", "é̀ß 漢字 ΑΣ İ 🤣 'll It'S <|endoftext|> 12½"]
    out += [f"{prose(60)}\n{shared}\n{prose(40)}" for _ in range(4)] + [f"{prose(80)}\n{boiler}\n\n{boiler}" for _ in range(6)] + ["spam eggs ham " * 40, "a" * 700, f"  {base[2]}\r\n"]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", f"s{i % 2}", 1, 1, "x", 3) for i, t in enumerate(texts)] + [(None, texts[0], None, None, None, None, None, None), (3, texts[3], "en", "s1", 1, 1, "x", 3)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_bpe(docs, nothing, texts):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = bpe.load_ranks(open(path, "rb").read())
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoded = bpe.encode(docs, path, public_tokenizers.PATTERN, outputs=("ids", "n_tokens", "decoded_sha256"))
    found = encoded.collect()
    assert len(found) == docs.count() and set(docs.columns) < set(encoded.columns)
    for r in found:
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == library.encode_ordinary(r["text"] or "")
        assert r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() for r in bpe.decode(encoded.select("text", "ids"), path).collect())
    assert bpe.encode(nothing, path, public_tokenizers.PATTERN).isEmpty()
    # a merge of lower rank that comes up waits for nothing
    odd = {bytes([b]): b for b in range(256)} | {b"bc": 256, b"abc": 300, b"abca": 301, b"ab": 400}
    assert bpe.MergeReplay(odd, r"\w+").encode(["abcabcabc", "ababc"])[0] == np.array(tiktoken.Encoding("o", pat_str=r"\w+", mergeable_ranks=odd, special_tokens={}).encode_ordinary("abcabcabc"), "<u4").tobytes()


def test_token_counts(docs, nothing, texts):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    for r in token_counts.count_tokens(docs, path, 100, with_prefixes=True).collect():
        text = r["text"] or ""
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (count(text), len(text.encode()), count(text) > 100)
        assert (r["prefix_tokens"] or [0])[-1] == r["n_tokens"]
    counter = token_counts.PrefixCounter(open(path).read())
    for word in ("internationalization", "thththe", "x", "zzyzzx"):
        assert counter.prefixes(word) == [count(word[:i]) for i in range(1, len(word) + 1)]
    text = texts[0]
    fit = counter.words_within(text, 50)
    assert count(" ".join(text.split(" ")[:fit])) <= 50 < count(" ".join(text.split(" ")[: fit + 1]))
    long = "internationalization of counterrevolutionaries " + text
    for budget in (0, 1, 2, 3, 4, 5, 7, 30, 10_000):
        k, letters = counter.fit(long, budget)
        split = long.split(" ")
        cut = lambda i, k=k: " ".join([*split[:k], split[k][:i]]) if k < len(split) else long
        fits = [i for i in range(len(split[k]) + 1) if count(cut(i).rstrip(" ")) <= budget] if k < len(split) else [0]
        assert letters == max(fits), budget
    assert counter.fit(None, 5) == counter.fit("", 5) == (0, 0)
    assert token_counts.count_tokens(nothing, path, 100).isEmpty()


def test_media(spark, docs, nothing):
    page = '<html><head><title>t</title></head><body>One <b>two</b><figure><img src="/m/%s.png" alt="x"><figcaption>Cap <i>1</i></figcaption></figure><script>no</script>three<p>four<img src="b.png"></body>'
    payload = b"some bytes \x00\xff" * 9
    stored = media.store(spark.createDataFrame([(payload,), (payload,), (None,)], "c binary"), "c")
    payloads = media.read_payloads(stored)
    digest = next(r["digest"] for r in payloads.collect() if r["n_bytes"] == len(payload))
    pages = spark.createDataFrame([(1, page % digest, 5), (1, page % digest, 5), (None, page % ("0" * 64), 5), (3, None, 5), (4, "", 5)], "k long, html string, items int")
    found = media.resolve(media.parse_pages(pages, "k", "html"), "k", payloads).collect()
    assert Counter(r["k"] for r in found) == {1: 2, None: 1, 3: 1, 4: 1}
    for r in found:
        got = [(x["position"], x["kind"], x["text"] if x["kind"] == "text" else x["caption"], x["media"] and x["media"]["payload_sha256"]) for x in r["items"]]
        padded = payload + bytes(-len(payload) % 64)
        sha = hashlib.sha256(padded).hexdigest() if r["k"] == 1 else None
        assert got == ([] if r["k"] in (3, 4) else [(0, "text", "One two", None), (1, "media", "Cap 1", sha), (2, "text", "three", None), (3, "text", "four", None), (4, "media", None, None)])
    row = next(r for r in payloads.collect() if r["n_bytes"] == len(payload))
    assert (row["payload_bytes"], row["tail_crc32"], row["media_sha256"]) == (len(padded := payload + bytes(-len(payload) % 64)), zlib.crc32(padded[-64:]), digest)
    assert media.read_payloads(media.store(nothing.select(F.col("text").cast("binary").alias("c")), "c")).isEmpty()


def test_captions_and_heads_of_real_pages(spark):
    told = lambda html: [(x["kind"], x["text"], x["caption"]) for x in media.page_items(html)]
    a, b = ("media", "a.png", "C d"), ("media", "b.png", "C d")
    assert told("<figure><figcaption>C <i>d</i></figcaption><img src=a.png><img src=b.png></figure>x") == [a, b, ("text", "x", None)]
    assert told("<figure><img src=a.png><figcaption>C d</figcaption><img src=b.png></figure>x") == [a, b, ("text", "x", None)]
    assert told("<figure><img src=a.png><figcaption>C d</figure>x") == [a, ("text", "x", None)]
    assert told("y<figure><img src=a.png><figcaption>C d") == [("text", "y", None), a]
    assert told("<figure><figure><img src=a.png><figcaption>C d</figcaption></figure><img src=b.png><figcaption>outer</figcaption></figure>") == [a, ("media", "b.png", "outer")]
    assert told("<figure><img src=a.png></figure><figcaption>z</figcaption>") == [("media", "a.png", None), ("text", "z", None)]
    for head in ("<html><head><title>t</title><body>", "<head><meta x><title>t</title>", "<title>t</title>", "<head><script>var x = '<p>no</p>'</script>", "<head><noscript><link></head><body>"):
        assert told(f"{head}<p>one<img src=q.png><p>two") == [("text", "one", None), ("media", "q.png", None), ("text", "two", None)], head
    assert told("<head>one<p>two") == [("text", "one", None), ("text", "two", None)]


def test_every_page_of_the_table(spark):
    """Media in the order of their tags, whatever stands around them, and every visible word in order."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    html = {r["page_id"]: r["html"] or "" for r in pages.collect()}
    found = {r["page_id"]: r["items"] for r in media.parse_pages(pages, "page_id", "html").collect()}
    assert found.keys() == html.keys()
    for k, page in html.items():
        shown = re.sub(r"(?is)<!--.*?-->|<(script|style|noscript|template|title)\b.*?(</\1\s*>|$)", " ", page)
        shown = re.sub(r"(?is)<head\b.*?(</head>|(?=<(?!/|meta|link|base|head)))", " ", shown)
        sources = [m[2] or m[3] or m[4] for m in re.finditer(r"""(?is)<(img|video|audio|source|embed)\b[^>]*?\bsrc\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", shown)]
        assert [x["text"] for x in found[k] if x["kind"] == "media"] == [x.strip() for x in sources if x.strip()], k
        assert [x["position"] for x in found[k]] == [*range(len(found[k]))]


def test_substrings(docs, nothing, texts):
    raw = [(r["doc_id"], (r["text"] or "").encode()) for r in docs.collect()]
    for length in (200, 60):
        seen = Counter(b[i : i + length] for _, b in raw for i in range(len(b) - length + 1))
        expected = []
        for key, b in raw:
            gone = np.zeros(len(b), bool)
            for i in range(len(b) - length + 1):
                if seen[b[i : i + length]] > 1:
                    gone[i : i + length] = True
            edges = np.diff(np.concatenate(([0], gone.astype(int), [0])))
            expected.append((key, len(b), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
        for most in (10_000, 1):
            assert rows_of(substrings.remove_repeated(docs, length, most_classes=most)) == sorted(expected, key=str)
    full = substrings.remove_repeated(docs, with_text=True).collect()
    assert all(sum(b - a for a, b in r["removed"]) == r["n_removed"] and len(r["kept"]) == r["n_bytes"] - r["n_removed"] for r in full)
    assert substrings.remove_repeated(nothing).isEmpty()


def test_suffix_sort():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 99, 400).astype(np.uint8)
    start = np.sort(rng.choice(350, 120, replace=False))
    group = rng.integers(0, 3, 120)
    size = np.full(120, 50)
    suffixes = substrings.SuffixSort(data, start, size, group)
    key = lambda i: (group[i], data[start[i] : start[i] + 50].tobytes())
    assert [key(i) for i in suffixes.order] == sorted(map(key, range(120)))


def _linked(sets, ids, percent=80):
    """The smallest id reachable of every row, rows of one id together."""
    smallest = {i: i for i in ids}

    def find(i):
        while smallest[i] != i:
            i = smallest[i]
        return i

    for x in range(len(sets)):
        for y in range(x):
            a, b = sets[x], sets[y]
            if a and b and 100 * len(a & b) >= percent * len(a | b) and find(ids[x]) != find(ids[y]):
                smallest[max(find(ids[x]), find(ids[y]))] = min(find(ids[x]), find(ids[y]))
    return {i: find(i) for i in ids}


def test_minhash(docs, nothing):
    none = (1 << 63) - 1
    rows = [(none if r["doc_id"] is None else r["doc_id"], r["text"]) for r in docs.collect()]
    for size in (4, 5):
        sets = []
        for _, t in rows:
            w = words_of(lowered(t))
            sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
        found = _linked(sets, [i for i, _ in rows])
        shown = lambda i: None if i == none else i
        expected = sorted(((shown(i), len(s), shown(found[i]), found[i] == i) for (i, _), s in zip(rows, sets, strict=True)), key=str)
        assert rows_of(minhash.near_duplicates(docs, words=size)) == expected
    assert minhash.near_duplicates(nothing).isEmpty()


def test_rows_without_an_id_of_their_own(spark):
    rng = random.Random(21)
    five, nine, *rest = (prose(80, rng) for _ in range(8))
    rows = [(5, five), (9, nine), (None, five), (None, nine), *[(None, x) for x in rest[:4]], (7, rest[4]), (7, rest[5]), (None, rest[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    found = {(r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(df).collect()}
    assert found == {(5, 5, True), (9, 9, True), (None, 5, False), (None, 9, False), (None, None, True), (7, 7, True)}
    left = corpus_pipeline.near_stage(spark, df, "")
    assert sorted(r["text"] for r in left.collect()) == sorted([five, nine, *rest])


def test_near_copies_that_miss_the_pivot(spark):
    rng = random.Random(5)
    base = prose(60, rng)
    rows = [(i, edited(base, rng.choice((0.02, 0.04, 0.06)), rng)) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [{tuple(w[i : i + 4]) for i in range(len(w) - 3)} for _, t in rows for w in [t.split(" ")]]
    found = _linked(sets, [i for i, _ in rows])
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df, words=4).collect()} == found


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (5, 5), (None, 1), (7, 8), (8, 7)] + [(i, i + 1) for i in range(100, 160)]
    found = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert found == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 7: 7, 8: 7, **dict.fromkeys(range(100, 161), 100)}
    assert components.components(spark.createDataFrame([], "x long, y long"), "x", "y").isEmpty()


def letters_of(line, size=10):
    units = [line.encode("utf-16-be")[i : i + 2] for i in range(0, 2 * (len(line.encode("utf-16-be")) // 2), 2)]
    return {b"".join(units[i : i + size]) for i in range(max(1, len(units) - size + 1))}


def test_lines_are_shingled_whole(spark):
    """Long words, addresses and scripts without spaces: what differs late in a line tells lines apart, and small edits do not."""
    rng = random.Random(41)
    kanji = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(n))
    shared, word = kanji(12), "".join(rng.choice("abcdef") for _ in range(300))
    texts = ["https://example.com/alpha/one", "https://example.org/zeta/two", "https://example.com/alpha/one?x=2", shared + kanji(40), shared + kanji(40), word, word[:150] + "z" + word[151:], word[:10] + word[::-1][:290]]
    texts += ["ab" * 200, "ab" * 30, "abc" * 30, "\U0001f923" * 30, "\U0001f923" * 9, "short", "shorter"]
    long_line = kanji(200)
    texts += [long_line, long_line[:100] + "x" + long_line[101:], "y" * 20_000 + long_line]
    found = dict(map(tuple, lines.line_components(spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "id long, line string")).collect()))
    expected = _linked([letters_of(x) for x in texts], [*range(len(texts))])
    assert {i: found.get(i, i) for i in range(len(texts))} == expected


def test_recall_of_similar_lines(spark):
    """Pairs at a similarity of 0.8 to 0.9, from short lines to long ones: at most 1 in 200 is missed, and nothing else is linked."""
    rng = random.Random(43)
    rows, similar, k = [], set(), 0
    while k < 1200:
        line = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(rng.choice((4, 8, 16, 40, 90))))
        other = list(line)
        for _ in range(rng.randint(1, max(1, len(line) // 90))):
            other[rng.randrange(len(line))] = rng.choice("0123456789")
        other = ("".join(other))[rng.randint(0, len(line) // 12) :]
        a, b = letters_of(line), letters_of(other)
        if 0.75 * len(a | b) <= len(a & b) < 0.9 * len(a | b):
            rows += [(2 * k, line), (2 * k + 1, other)]
            similar |= {k} if 100 * len(a & b) >= 80 * len(a | b) else set()
            k += 1
    found = dict(map(tuple, lines.line_components(spark.createDataFrame(rows, "id long, line string")).collect()))
    linked = {k for k in range(1200) if found.get(2 * k + 1) == 2 * k}
    assert len(similar) > 500 and linked <= similar and len(similar - linked) <= 0.005 * len(similar)


def test_bounds_on_pairs_of_lines(spark):
    """Every pair at the similarity may link; of short lines with other lengths or with more of their own than the similarity allows, none."""
    rng = np.random.default_rng(74)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), 6))
    rows = []
    for _ in range(40):
        words = [word() for _ in range(12)]
        for k in range(6):
            rows.append((len(rows), " ".join([*words[: 12 - k // 2], *(word() for _ in range(k % 2))])))
    sets = {i: letters_of(line) for i, line in rows}
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    about = lines._fine(spark.createDataFrame(rows, "id long, line string"), 10)
    side = lambda n: about.select((F.col("id") / 6).cast("int").alias("family"), F.struct(*about.columns).alias(n))
    met = side("x").join(side("y"), "family").filter("x.id < y.id").select("x.id", F.col("y.id").alias("other"), lines._could_link("x", "y", 80).alias("may")).collect()
    assert len(met) == 40 * 15 and all(r["may"] for r in met if alike(r["id"], r["other"]) >= 0.8)
    assert not any(r["may"] for r in met if alike(r["id"], r["other"]) < 0.7)
    # short lines of similarity 0.5
    short = []
    for _ in range(40):
        words = [word() for _ in range(4)]
        short += [(len(short), " ".join(words)), (len(short) + 1, " ".join([*words[:3], word()]))]
    about = lines._fine(spark.createDataFrame(short, "id long, line string"), 10).select(F.floor(F.col("id") / 2).alias("pair"), F.struct("*").alias("x"))
    both = about.join(about.select("pair", F.col("x").alias("y")), "pair").filter("x.id < y.id")
    assert both.count() == 40 and both.filter(lines._could_link("x", "y", 80)).isEmpty()


def test_odd_numbers_of_shingles(spark):
    """Of lines of 291 shingles, three changed characters leave a similarity of 0.81 and four one of 0.76."""
    rng = random.Random(31)
    rows = []
    for i in range(60):
        line = [rng.choice("abcdefghijklmnopqrst") for _ in range(300)]
        changed = [*line]
        for k in range(3 + i % 2):
            changed[30 + 60 * k] = "z"
        rows += [(2 * i, "".join(line)), (2 * i + 1, "".join(changed))]
    about = lines._fine(spark.createDataFrame(rows, "id long, line string"), 10).select(F.floor(F.col("id") / 2).alias("pair"), F.struct("*").alias("x"))
    both = about.filter("x.id % 2 = 0").join(about.select("pair", F.col("x").alias("y")).filter("y.id % 2 = 1"), "pair")
    may = {r["pair"] for r in both.filter(lines._could_link("x", "y", 80)).collect()}
    assert both.count() == 60 and may >= {*range(0, 60, 2)} and len(may) < 33


def test_pairs_of_lines_leave_one_bucket(spark):
    """Lines that share several buckets meet in one of them only."""
    line = "the quick brown fox jumps over the lazy dog and runs away"
    about = lines._fine(spark.createDataFrame([(i, f"{line} {i}") for i in range(6)], "id long, line string"), 10)
    dealt = spark.createDataFrame([(b, i, [*range(1, 5 + i)]) for i in range(6) for b in range(1, 5 + i)], "bucket long, id long, buckets array<long>")
    rest = dealt.join(about, "id").select("bucket", F.struct("id", F.col("id").alias("component"), "buckets", *about.columns[1:]).alias("x"))
    assert sorted(map(tuple, lines._met(rest, 80).collect())) == [(i, j) for i in range(6) for j in range(i + 1, 6)]


def test_many_variants_of_a_line(spark):
    rng = random.Random(47)
    base = prose(30, rng)
    made = {edited(base, rng.choice((0.03, 0.06)), rng) for _ in range(150)}
    rows = [(i, x) for i, x in enumerate(sorted(made))]
    found = dict(map(tuple, lines.line_components(spark.createDataFrame(rows, "id long, line string")).collect()))
    assert {i: found.get(i, i) for i, _ in rows} == _linked([letters_of(x) for _, x in rows], [i for i, _ in rows])


def test_lines(docs, nothing):
    rows = sorted({(-1 if r["doc_id"] is None else r["doc_id"], r["text"]) for r in docs.collect()}, key=lambda x: (x[0], x[1] or ""))
    all_lines = [(k, p, x) for k, t in rows for p, x in enumerate([y for y in (re.sub(r"[\x20\x09-\x0D]+", " ", z).strip(" ").lower() for z in (t or "").split("\n")) if y])]
    distinct = sorted({x for _, _, x in all_lines})
    group = _linked([letters_of(x) for x in distinct], [*range(len(distinct))])
    place = {x: group[i] for i, x in enumerate(distinct)}
    seen, removed = set(), defaultdict(list)
    for k, p, x in all_lines:
        if place[x] in seen:
            removed[k].append(p)
        seen.add(place[x])
    for r in lines.line_report(docs).collect():
        k = -1 if r["doc_id"] is None else r["doc_id"]
        assert r["removed"] == ",".join(map(str, removed[k])) and r["n_removed"] == len(removed[k])
    left = lines.drop_lines(docs)
    assert left.columns == docs.columns
    counts = {r["doc_id"]: len([x for x in (r["text"] or "").split("\n") if x.strip(" \t\r\x0b\x0c")]) for r in left.collect()}
    sizes = Counter(k for k, _, _ in all_lines)
    assert all(counts.get(None if k == -1 else k, 0) == sizes[k] - len(removed[k]) for k in sizes)
    assert lines.line_report(nothing).isEmpty() and lines.drop_lines(nothing).isEmpty()


def test_quality(spark, docs, nothing):
    found = {r["doc_id"]: r for r in quality.quality(docs, min_documents=2, share=0.0).collect()}
    for r in docs.collect():
        text, told = r["text"] or "", found[r["doc_id"]]
        w = words_of(text)
        windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        repeated = {i + o for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for o in range(3)}
        some = [x for x in text.split("\n") if words_of(x)]
        assert (told["n_words"], told["word_chars"], told["n_symbols"], told["n_dup_lines"], told["n_repeat_words"]) == (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(some) - len(set(some)), len(repeated))
        assert told["base_failed"] == (len(w) < 50 or 100 * len(repeated) > 50 * len(w))
    boiler = [r for r in docs.collect() if "newsletter" in (r["text"] or "")]
    assert all(found[r["doc_id"]]["n_removed_lines"] == 2 and found[r["doc_id"]]["kept"] for r in boiler)
    kept = quality.apply_rules(docs, min_documents=2, share=0.0)
    assert kept.columns == docs.columns and not any("newsletter" in r["text"] for r in kept.collect())
    assert {r["doc_id"] for r in kept.collect()} == {k for k, r in found.items() if r["kept"]}
    line = prose(60)
    many = spark.createDataFrame([(i, f"{line}\n{prose(5)}", "h") for i in range(9)] + [(20, prose(60), "h")], "doc_id long, text string, source string")
    assert {r["doc_id"] for r in quality.quality(many, min_documents=5).filter("kept").collect()} == {20}
    assert quality.quality(nothing).isEmpty() and quality.apply_rules(nothing).isEmpty()
    # copies under ids of their own are documents of their own, repeated rows are not
    copy = prose(60)
    copies = spark.createDataFrame([(i, copy, "h") for i in range(9)] + [(30, line, "h")] * 9, "doc_id long, text string, source string")
    assert {r["doc_id"]: r["n_removed_lines"] for r in quality.quality(copies, min_documents=5).distinct().collect()} == {**dict.fromkeys(range(9), 1), 30: 0}


def test_passages(docs, nothing):
    found = {r["doc_id"]: r for r in passages.repeated_passages(docs).collect()}
    w = {r["doc_id"]: words_of(lowered(r["text"])) for r in docs.collect()}
    seen = defaultdict(set)
    for k, x in w.items():
        for i in range(len(x) - 49):
            seen[tuple(x[i : i + 50])].add(" ".join(x))
    copies = Counter(r["text"] for r in docs.collect())
    for r in docs.collect():
        k, x = r["doc_id"], w[r["doc_id"]]
        again = {p for i in range(len(x) - 49) if len(seen[tuple(x[i : i + 50])]) > 1 or copies[r["text"]] > 1 for p in range(i, i + 50)}
        told = {p for part in found[k]["passages"].split(",") if part for p in range(*map(int, part.split("-")))}
        assert again <= told and (again or not told or any(k2 for k2 in range(6, 11)))
    assert passages.repeated_passages(nothing).isEmpty()
    tree = passages.compact_windows(np.array([5, 3, 8, 1, 9, 2], np.uint64), 2)
    assert sorted(tree) == [(0, 1, 2), (0, 3, 5), (4, 5, 5)]
    rng = np.random.default_rng(6)
    for sizes, least in (((46, 60, 500, 46), 46), ((300, 1, 5), 1), ((77, 7, 30), 7)):
        values = rng.integers(0, 1 << 63, sum(sizes), np.uint64)
        values[: sizes[0] : 3] = values[1]
        expected, start = [], 0
        for n in sizes:
            expected += sorted(start + c for _, c, _ in passages.compact_windows(values[start : start + n], least))
            start += n
        assert passages.centres(values, np.array(sizes), least).tolist() == expected


def _shingled(words, size=5):
    return np.array([zlib.crc32(" ".join(words[i : i + size]).encode()) for i in range(len(words) - size + 1)], np.uint64)


def test_edited_passages_are_verified():
    rng = random.Random(8)
    fresh = lambda n: [f"w{rng.randrange(10**8)}" for _ in range(n)]
    for size in (50, 70, 90, 100):
        passage, m = fresh(size), size // 2
        for changed in ([*passage[:m], "x", *passage[m + 1 :]], [*passage[:m], "x", *passage[m:]], [*passage[:m], *passage[m + 1 :]], [*passage[m:], *passage[:m]], ["x", *passage[1:]]):
            a, b = _shingled(fresh(80) + passage + fresh(70)), _shingled(fresh(60) + changed + fresh(90))
            for x, y in ((a, b), (b, a)):
                (low, high, start, stop), *rest = passages.verified(x, y, 46, 80)
                one, other = set(x[low : high + 1].tolist()), set(y[start : stop + 1].tolist())
                assert not rest and min(len(one), len(other)) >= 46 and len(one & other) >= 0.8 * len(one | other)
                assert high - low + 1 >= len(changed) - 8 and abs(low - (80 if x is a else 60)) <= 4
    passage = fresh(44)
    assert not passages.verified(_shingled(fresh(80) + passage + fresh(80)), _shingled(fresh(80) + passage + fresh(80)), 46, 80)


def _slow_chain(first, place, sizes):
    """The heaviest chain by comparing all runs; of equal ones the first."""
    weight, previous = sizes.tolist(), [-1] * len(first)
    for i in range(len(first)):
        fits = [j for j in range(i) if place[j] + sizes[j] <= place[i]]
        if fits:
            previous[i] = max(fits, key=lambda j: (weight[j], -j))
            weight[i] += weight[previous[i]]
    out, i = [], weight.index(max(weight))
    while i >= 0:
        out.append(i)
        i = previous[i]
    return out[::-1]


def test_chains_of_runs(monkeypatch):
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 40, 90):
        for span in (n, 10 * n):
            sizes = rng.integers(1, 5, n)
            first, place = np.cumsum(sizes + 1) - sizes, rng.integers(0, span, n)
            assert passages._chain(first, place, sizes).tolist() == _slow_chain(first, place, sizes)
    # two texts of the same sentences in different orders: once the heaviest chain is too light for a passage, others aren't looked for
    calls, chain = [], passages._chain
    monkeypatch.setattr(passages, "_chain", lambda *x: calls.append(1) or chain(*x))
    sentences = [rng.integers(0, 1 << 63, 4, np.uint64) for _ in range(60)]
    a, b = (np.concatenate([np.append(sentences[i], rng.integers(0, 1 << 63, 1, np.uint64)) for i in order]) for order in (range(60), range(59, -1, -1)))
    assert not passages.verified(a, b, 46, 80) and len(calls) == 1


def test_edited_passages_are_found(spark):
    rng = random.Random(12)
    fresh = lambda n: [f"w{rng.randrange(10**8)}" for _ in range(n)]
    rows, expected = [], {}
    for k in range(60):
        passage = fresh((70, 90, 100)[k % 3])
        changed = list(passage)
        changed[len(passage) // 2] = "x"
        for i, x in ((2 * k, passage), (2 * k + 1, changed)):
            rows.append((i, " ".join(fresh(60) + x + fresh(60))))
            expected[i] = range(60 + 4, 60 + len(passage) - 4)
    found = {r["doc_id"]: r for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    told = {k: {p for part in r["passages"].split(",") if part for p in range(*map(int, part.split("-")))} for k, r in found.items()}
    assert all(set(expected[k]) <= told[k] and found[k]["component_id"] == k - k % 2 and found[k]["n_links"] == 1 for k in expected)


#: (words of a passage, words of it changed): with five-word shingles all are at a similarity of 0.8 or more.
EDITS = [(50, 0), (60, 0), (60, 1), (100, 1), (100, 2), (200, 3)]


def test_recall_of_passages_by_edits(spark):
    """Of the passages of each kind nine in ten are found in both documents or more, and nothing is found in documents that share 40 words only."""
    rng = random.Random(23)
    fresh = lambda n: [f"w{rng.randrange(10**8)}" for _ in range(n)]
    rows, pairs = [], []
    for size, edits in EDITS:
        for _ in range(40):
            passage = fresh(size)
            changed = list(passage)
            # edits that part the passage evenly
            for e in range(edits):
                changed[(e + 1) * size // (edits + 1)] = fresh(1)[0]
            pairs.append((len(rows), size, edits))
            rows += [" ".join(fresh(40) + x + fresh(50)) for x in (passage, changed)]
    apart = len(rows)
    for _ in range(40):
        passage = fresh(40)
        rows += [" ".join(fresh(60) + passage + fresh(60)) for _ in range(2)]
    found = {r["doc_id"]: r for r in passages.repeated_passages(spark.createDataFrame([*enumerate(rows)], "doc_id long, text string")).collect()}
    told = lambda i: {p for part in found[i]["passages"].split(",") if part for p in range(*map(int, part.split("-")))}
    caught = Counter()
    for i, size, edits in pairs:
        expected = set(range(40 + 4, 40 + size - 4))
        caught[size, edits] += all(len(expected & told(j)) >= 0.9 * len(expected) and found[j]["component_id"] == i for j in (i, i + 1))
    print(dict(caught))
    assert all(caught[x] >= 36 for x in EDITS), caught
    assert all(found[i]["n_passages"] == 0 and found[i]["component_id"] == i for i in range(apart, len(rows)))


def test_passages_behind_unrelated_texts(spark):
    """One sentence of 30 words that every text has; pairs of texts have more around it."""
    rng = random.Random(13)
    fresh = lambda n: [f"w{rng.randrange(10**8)}" for _ in range(n)]
    sentence, rows = fresh(30), []
    for k in range(40):
        before, after = fresh(11), fresh(11)
        rows += [(2 * k, " ".join(fresh(60) + before + sentence + after + fresh(60))), (2 * k + 1, " ".join(fresh(60) + before + sentence + after + fresh(60)))]
    rows += [(100 + i, " ".join(fresh(60) + sentence + fresh(60))) for i in range(40)]
    found = {r["doc_id"]: r for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(found[i]["component_id"] == i - i % 2 and found[i]["n_passages"] == 1 for i in range(80))
    assert all(found[i]["n_links"] == 0 and found[i]["component_id"] == i for i in range(100, 140))


def test_chains_of_passages(spark):
    """Each text is near the one before it only: what has matched one text still meets those of other components."""
    rng = np.random.default_rng(71)
    fresh = lambda n: [f"w{x:x}" for x in rng.integers(0, 1 << 60, n)]
    rows, size = [], 24
    for chain in range(12):
        passage = fresh(60)
        for k in range(size):
            passage = [*passage]
            passage[(15, 30, 44, 22, 37)[k % 5]] = f"x{chain}-{k}"
            rows.append((len(rows), " ".join(fresh(60) + passage + fresh(60))))
    found = {r["doc_id"]: r["component_id"] for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {i: i - i % size for i in range(len(rows))}


def test_rarest_shingles_of_a_window():
    """Whatever a near duplicate lacks, one of the rarest shingles of some window of the stretch is in it."""
    rng = np.random.default_rng(5)
    n = passages.rarest_needed(46, 80)
    assert 10 <= n <= 16
    for _ in range(300):
        size = int(rng.integers(46, 140))
        lacking = np.zeros(size, bool)
        start = int(rng.integers(0, size))
        lacking[(start + np.arange(size * 20 // 100)) % size] = True
        lacking = rng.permutation(lacking) if rng.random() < 0.5 else lacking
        fewest = min(int(lacking[i : i + 46].sum()) for i in range(size - 45))
        assert fewest < n
        # rare by chance, and the texts of what is lacking are others
        texts = rng.integers(2, 50, size)
        found = passages.rarest(rng.permutation(size).astype(np.int64), texts, 46, 80)
        assert (~lacking[found]).any()
    assert passages.candidate_stretches(np.repeat([False, True, False], (60, 40, 60)), 46, 80) == []
    assert passages.candidate_stretches(np.repeat([False, True, False], (60, 42, 60)), 46, 80) == [(60, 101)]


def test_stretches_that_no_near_duplicate_can_have():
    """Repeats in a row count once, and a near duplicate lacks shingles on its own side of a gap; what is near a duplicate stays."""
    rng = random.Random(29)
    fresh = lambda n: [f"w{rng.randrange(10**8)}" for _ in range(n)]
    told = lambda a, b: passages.candidate_stretches(np.isin(x := _shingled(a), _shingled(b)), 46, 80, x, passages.lacking_at_gaps(passages.word_hashes(" ".join(a)), 5))
    # one word 47 times is 43 equal shingles, and no stretch of 46 positions has a similarity of 0.8 with a text that has the word six times
    assert told(fresh(60) + ["be"] * 47 + fresh(60), fresh(40) + ["be"] * 6 + fresh(40)) == []
    assert told(fresh(60) + ["be"] * 55 + fresh(60), fresh(40) + ["be"] * 6 + fresh(40)) == [(60, 110)]
    for every, found in ((20, False), (60, True)):
        passage = fresh(240)
        changed = [x if i % every != every // 2 else "x" for i, x in enumerate(passage)]
        a, b = fresh(60) + passage + fresh(60), fresh(60) + changed + fresh(60)
        assert bool(told(a, b)) is bool(passages.verified(_shingled(a), _shingled(b), 46, 80)) is found
    for _ in range(200):
        passage = [f"v{rng.randrange(rng.choice((20, 10**6)))}" for _ in range(rng.randint(50, 150))]
        changed = [*passage]
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(changed))
            changed[k : k + rng.randint(0, 3)] = fresh(rng.randint(0, 3))
        a, b = fresh(30) + passage + fresh(30), fresh(40) + changed + fresh(40)
        for low, high, *_ in passages.verified(_shingled(a), _shingled(b), 46, 80):
            assert any(x <= high and low <= y for x, y in told(a, b))


def _plain_grams(text):
    words = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in text.lower()).split()
    joined = " " + " ".join(words) + " "
    grams = [joined[i : i + n] for n in (1, 2, 3) for i in range(len(joined) - n + 1)]
    return Counter(g for g in grams if g != " " and not (len(g) == 3 and g[1] == " "))


def _number(gram):
    return sum(ord(c) << 21 * i for i, c in enumerate(reversed(gram)))


def test_language_against_plain_distances(spark):
    """Every distance by dictionaries, and the accuracy on documents that nothing was learned from."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    rows = [r for r in df.collect() if r["text"] is not None]
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    learned, ranked = defaultdict(Counter), {}
    for r in rows:
        if r not in held and r["lang"] is not None:
            learned[r["lang"]].update(_plain_grams(r["text"]))
    top = lambda c: sorted(c, key=lambda g: (-c[g], _number(g)))[:300]
    ranked = {lang: {g: i for i, g in enumerate(top(c))} for lang, c in learned.items()}
    found = {r["doc_id"]: r for r in language.op7_language(spark, "/root/testdata/sf0.001").collect()}
    for r in rows:
        own = top(_plain_grams(r["text"]))
        distance = {lang: sum(abs(i - known[g]) if g in known else 300 for i, g in enumerate(own)) for lang, known in ranked.items()}
        best = min(sorted(distance), key=distance.get) if own else "und"
        told = found[r["doc_id"]]
        assert told["lang_pred"] == best and (not own or abs(told["score"] - (1 - distance[best] / (300 * len(own)))) < 1e-9)
    right = [found[r["doc_id"]]["lang_pred"] == r["lang"] for r in held if r["lang"] is not None]
    assert len(right) >= 20 and sum(right) >= 0.95 * len(right)


def test_mixing(spark, docs, nothing):
    rng = random.Random(4)
    kinds = {0: "fine good", 1: "| ## |", 2: "idiot scum trash"}
    made = [(i, prose(40, rng) + " " + kinds[i % 10 if i % 10 < 3 else 0], "s", None) for i in range(300)]
    df = spark.createDataFrame(made + [(900, None, None, 1), (901, "", None, 1), (5, made[5][1], "s", None)], "doc_id long, text string, source string, rate int")
    labels = spark.createDataFrame([(i, i % 10 if i % 10 < 3 else 0) for i in range(200)] + [(1, 1), (None, 0), (7, None)], "doc_id long, domain int")
    targets = {"good": 1.0, "plain": 1.2, "toxic": 0.5}
    found = {r["doc_id"]: r for r in mixing.rates(df, labels, targets).collect()}
    truth = lambda i: mixing.DOMAINS[i % 10 if i % 10 < 3 else 0]
    assert sum(found[i]["domain"] == truth(i) for i in range(200, 300)) >= 97
    table, priors = mixing.fit(df, labels)
    members = mixing.posteriors(df, table, priors)
    _, report = mixing.fit_rates(members, targets)
    assert all(abs(a - t) <= 0.03 * sum(report["targets"]) for a, t in zip(report["after"], report["targets"], strict=True))
    assert all(r["rate"] >= 0 for r in found.values())
    mixed = mixing.mix(df, labels, targets)
    assert mixed.columns == df.columns and mixed.filter("text like '%scum%'").count() < 26
    assert {x["domain"] for x in mixing.rates(docs, labels.limit(0)).collect()} == {"good"}
    assert mixing.rates(nothing, labels).isEmpty() and mixing.mix(nothing, labels).isEmpty()


def test_lines_are_dealt_out_once_in_a_write(spark, monkeypatch):
    """No write of the line dedup keeps two shuffles of all buckets on disk, and tables of whole lines are written with zstd."""
    dealt, codecs, write = {}, {}, lines.materialize

    def looked(df, label="cut", compression="snappy"):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        dealt[label], codecs[label] = max(dealt.get(label, 0), plan.count("explode(buckets")), compression
        return write(df, label, compression)

    monkeypatch.setattr(lines, "materialize", looked)
    line = prose(30)
    df = spark.createDataFrame([(1, line), (2, line + " x"), (3, prose(30))], "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in lines.line_report(df).collect()} == {1: 0, 2: 1, 3: 0}
    assert dealt["ends"] == dealt["members"] == 1
    assert codecs["occurrences"] == codecs["texts"] == "zstd"


def test_evidence_follows_shares_not_labels(spark):
    """A word that a small domain has three times as often as a large one speaks for the small one, and one that all have alike for none."""
    made = [(i, f"{prose(30)} common {'tilt' if i % 4 < (3 if i >= 400 else 1) else ''} {'scum' if i >= 400 and i % 4 < 2 else ''}", 2 if i >= 400 else 0) for i in range(460)]
    df = spark.createDataFrame(made, "doc_id long, text string, domain int")
    table, priors = mixing.fit(df, df.select("doc_id", "domain"))
    bucket = {w: spark.range(1).select(mixing._bucket(F.lit(w))).first()[0] for w in ("common", "tilt", "scum")}
    found = {r["bucket"]: r for r in table.collect()}
    assert bucket["common"] not in found
    assert all(found[bucket[w]]["w2"] > 0 > found[bucket[w]]["w0"] for w in ("tilt", "scum"))
    toxic = {r["k"] for r in mixing.posteriors(df, table, priors).filter("p2 > 0.5").collect()}
    assert {i for i, text, _ in made if "scum" in text} <= toxic and not any(i < 400 and "tilt" not in text and i in toxic for i, text, _ in made)


def test_targets_are_met_under_skewed_shares(spark):
    shares = (0.01, 0.8, 0.19)
    rows = [(100 + i % 7, *[0.98 if j == k else 0.01 for j in range(3)]) for k, share in enumerate(shares) for i in range(int(2000 * share))]
    members = spark.createDataFrame(rows, "n_tokens long, p0 double, p1 double, p2 double")
    for weights, absolute in ((mixing.WEIGHTS, False), ({"good": 0.75, "plain": 0.2, "toxic": 0.05}, True), ({"good": 1.0, "plain": 1.0, "toxic": 1.0}, True)):
        rate, report = mixing.fit_rates(members, weights, absolute=absolute)
        after = members.agg(*[F.sum(F.col("n_tokens") * F.col(f"p{i}") * rate) for i in range(3)]).first()
        assert report["met"] and all(abs(a - t) <= 0.005 * t for a, t in zip(after, report["targets"], strict=True))
        if absolute:
            assert all(abs(t / sum(report["targets"]) - weights[d] / sum(weights.values())) < 1e-9 for t, d in zip(report["targets"], mixing.DOMAINS, strict=True))
    with pytest.warns(UserWarning, match="not met"):
        assert not mixing.fit_rates(members, {"good": 1.0, "plain": 0.0, "toxic": 0.0}, absolute=True)[1]["met"]

"""Quality rules with cross-document line frequency (DataFrame operations only).

Base rules look at one document: too few words, or too many words inside repeated 3-word windows.  Then lines are normalised (white space
runs become one space, lower case) and hashed; for each host and line, the distinct documents that have it are counted.
Lines above the limit are removed: over ``min_documents`` and over ``share`` of the host's documents.  A document that keeps less than
``keep_percent`` of its words is depleted and rejected.

A line's rows are first counted, which partial sums do before the shuffle, and only lines with many rows are looked at document by
document, so a line that a third of all documents have is a few rows of each task.

Null texts are empty; without words a document fails the base rules.  A null host is a host of its own.  Rows are told apart by
key and text: equal rows get equal results.  Very long texts are taken whole.  Extra columns do not clash: rules return the columns they name,
and ``apply_rules`` returns exactly the columns it got.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, table

_SPACES, _SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
_SEPARATOR, _WORD = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"
_NO_ID = -(1 << 63)


def words(text: Column) -> Column:
    """The words of a text."""
    return F.array_remove(F.split(text, _SEPARATOR), "")


def without(text: Column, letters: str) -> Column:
    """A text without some characters."""
    return reduce(lambda c, x: F.replace(c, F.lit(x), F.lit("")), letters, text)


def normal_line(line: Column) -> Column:
    """A line for comparison."""
    return F.lower(F.trim(F.regexp_replace(line, _SEPARATOR, " ")))


def line_hash(line: Column) -> Column:
    """The hash by which lines are counted."""
    return F.xxhash64(normal_line(line))


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(_WORD))


def base_features(docs: DataFrame, text: str, *keep: Column) -> DataFrame:
    """``keep`` and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of every row."""
    names = [f"_k{i}" for i in range(len(keep))]
    content = F.coalesce(F.col(text), F.lit(""))
    with_words = docs.select(*[c.alias(n) for c, n in zip(keep, names, strict=True)], content.alias("t"), words(content).alias("w"))
    window = lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2))
    hashed = with_words.select(*names, "t", F.size("w").cast("long").alias("n_words"), F.when(F.size("w") > 3, F.transform(F.slice("w", F.lit(1), F.size("w") - 2), window)).alias("h"))
    repeated = F.size(F.array_distinct("h")) < F.size("h")
    placed = hashed.select(*names, "t", "n_words", F.when(repeated, F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).alias("s"))
    same = lambda x, k: F.get("s", k)["h"] == x["h"]
    twice = F.filter("s", lambda x, k: ((k > 0) & same(x, k - 1)) | ((k + 1 < F.size("s")) & same(x, k + 1)))
    at = placed.select(*names, "t", "n_words", F.array_sort(F.transform(twice, lambda x: x["i"])).alias("p"), _lines(F.col("t")).alias("l"))
    covered = F.aggregate("p", F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")), lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(3), x - a["last"])).alias("n")), lambda a: a["n"])
    return at.select(
        *names,
        "n_words",
        F.char_length(without(F.col("t"), _SPACES)).cast("long").alias("word_chars"),
        (F.octet_length("t") - F.octet_length(without(F.col("t"), _SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def _identity(key: str, text: str) -> list[Column]:
    return [F.coalesce(F.col(key).cast("long"), F.lit(_NO_ID)).alias("k"), F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.col(key).isNull()).alias("th")]


def frequent_lines(docs: DataFrame, key: str, text: str, host: str, min_documents: int, share: float) -> DataFrame:
    """(k, th, line, n_words, n_lines): for each document (by ``_identity``), its lines above the limit, by hash, with their words and number in it."""
    of_host = docs.select(F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.col(host).isNull().alias("no_host"), *_identity(key, text))
    hosts = of_host.distinct().groupBy("host", "no_host").agg(F.count(F.lit(1)).alias("documents"))
    normal = F.transform(_lines(F.coalesce(F.col(text), F.lit(""))), normal_line)
    figures = lambda x: F.struct(F.xxhash64(x).alias("line"), (F.octet_length(x) - F.octet_length(F.replace(x, F.lit(" "), F.lit(""))) + 1).alias("n"))
    exploded = docs.select(*_identity(key, text), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.col(host).isNull().alias("no_host"), F.explode(F.transform(normal, figures)).alias("x"))
    lines = exploded.select("k", "th", "host", "no_host", "x.line", "x.n")
    many = lines.groupBy("host", "no_host", "line").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > min_documents).drop("rows")
    looked = materialize(lines.join(many, ["host", "no_host", "line"]).groupBy("host", "no_host", "line", "k", "th").agg(F.max("n").alias("words"), F.count(F.lit(1)).alias("copies")), "lines")
    per_line = looked.groupBy("host", "no_host", "line").agg(F.count(F.lit(1)).alias("found")).join(hosts, ["host", "no_host"])
    above = per_line.filter((F.col("found") > min_documents) & (F.col("found") > share * F.col("documents"))).select("host", "no_host", "line")
    return looked.join(above, ["host", "no_host", "line"]).groupBy("k", "th", "line").agg(F.max(F.col("words") * F.col("copies")).alias("n_words"), F.max("copies").alias("n_lines"))


def quality(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", min_words: int = 50, repeat_percent: int = 50, min_documents: int = 50, share: float = 0.01, keep_percent: int = 25) -> DataFrame:
    """The verdict on every row: (key, the base figures, base_failed, n_removed_words, n_removed_lines, kept).

    min_words, repeat_percent: base rules; min_documents, share: the limit for lines; keep_percent: the words a document must keep."""
    key_type = docs.schema[key].dataType
    base = base_features(docs, text, *_identity(key, text)).withColumnsRenamed({"_k0": "k", "_k1": "th"})
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    removed = frequent_lines(docs, key, text, host, min_documents, share).groupBy("k", "th").agg(F.sum("n_words").cast("long").alias("gone"), F.sum("n_lines").cast("long").alias("gone_lines"))
    told = base.join(removed, ["k", "th"], "left").withColumns({"gone": F.coalesce("gone", F.lit(0)), "gone_lines": F.coalesce("gone_lines", F.lit(0))})
    kept = ~failed & (100 * (F.col("n_words") - F.col("gone")) >= keep_percent * F.col("n_words"))
    return told.select(F.when(F.col("k") != _NO_ID, F.col("k")).cast(key_type).alias(key), *base.columns[2:], failed.alias("base_failed"), F.col("gone").alias("n_removed_words"), F.col("gone_lines").alias("n_removed_lines"), kept.alias("kept"))


def apply_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", n_chars: str | None = "n_chars", min_words: int = 50, repeat_percent: int = 50, min_documents: int = 50, share: float = 0.01, keep_percent: int = 25) -> DataFrame:
    """The documents that ``quality`` keeps, without their lines above the limit; ``n_chars``, if there is such a column, follows the text."""
    columns = docs.columns
    lines = frequent_lines(docs, key, text, host, min_documents, share).groupBy("k", "th").agg(F.sum("n_words").alias("gone"), F.collect_set("line").alias("gone_lines"))
    base = base_features(docs, text, F.struct(*[F.col(c) for c in columns]), *_identity(key, text)).select(F.col("_k0").alias("row"), F.col("_k1").alias("k"), F.col("_k2").alias("th"), "n_words", "n_repeat_words")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    # one condition on both sides of the join: the optimizer would copy the base figures' expressions into a filter below it
    enough = F.when(failed, F.lit(False)).otherwise(100 * (F.col("n_words") - F.coalesce("gone", F.lit(0))) >= keep_percent * F.col("n_words"))
    told = base.join(lines, ["k", "th"], "left").filter(enough)
    left = F.when(F.col("gone_lines").isNull(), F.col("row")[text]).otherwise(F.array_join(F.filter(F.split(F.col("row")[text], "\n"), lambda x: ~F.coalesce(F.array_contains("gone_lines", line_hash(x)), F.lit(False))), "\n"))
    cleaned = told.select("row", left.alias("left"))
    new = {text: F.col("left")} | ({n_chars: F.char_length("left").cast(docs.schema[n_chars].dataType)} if n_chars in columns else {})
    return cleaned.select(*[new.get(c, F.col("row")[c]).alias(c) for c in columns])


def op3_quality(spark, sf_dir: str) -> DataFrame:
    """Every document's base figures and verdict."""
    return quality(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
with d as (select doc_id, coalesce(text, '') as t, coalesce(source, '') as host, source is null as no_host from documents),
w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from d),
p as (select doc_id, t, unnest(range(1, len(w) - 1)) as i, w from w where len(w) > 3),
g as (select doc_id, t, i, count(*) over (partition by doc_id, t, w[i], w[i + 1], w[i + 2]) as n from p),
c as (select doc_id, t, count(distinct i + o) as n from g, (values (0), (1), (2)) v(o) where n > 1 group by 1, 2),
b as (select w.*, len(w.w) as n_words, coalesce(c.n, 0) as n_repeat_words from w left join c on c.doc_id is not distinct from w.doc_id and c.t = w.t),
x as (select doc_id, t, host, no_host, unnest(list_transform(l, lambda x: lower(trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g'))))) as line from w),
a as (select x.host, x.no_host, line from x join (select host, no_host, count(distinct {'d': doc_id, 't': t}) as documents from d group by 1, 2) h on h.host = x.host and h.no_host = x.no_host
      group by 1, 2, 3 having count(distinct {'d': doc_id, 't': t}) > 50 and count(distinct {'d': doc_id, 't': t}) > 0.01 * max(documents)),
r as (select doc_id, t, sum(len(string_split(line, ' '))) as gone, count(*) as gone_lines from x semi join a using (host, no_host, line) group by 1, 2)
select b.doc_id, n_words, cast(length(regexp_replace(b.t, '[\x20\x09-\x0D]', '', 'g')) as bigint) as word_chars,
  cast(length(b.t) - length(regexp_replace(b.t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols, cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines, n_repeat_words,
  n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, cast(coalesce(gone, 0) as bigint) as n_removed_words, cast(coalesce(gone_lines, 0) as bigint) as n_removed_lines,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and 100 * (n_words - coalesce(gone, 0)) >= 25 * n_words as kept
from b left join r on r.doc_id is not distinct from b.doc_id and r.t = b.t
"""

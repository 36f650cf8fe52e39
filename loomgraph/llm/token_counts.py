"""Token counts by prefix dynamic programming.

For every prefix of a word, ``last`` holds the last token of the prefix's encoding: the one token ending there that may stand
after the last token of what precedes it.  Two tokens may stand side by side if the merges leave them as they are, which depends on
these two alone.  So the count at every prefix follows from a shorter prefix without encoding anything again, and a text has an
exact count at the end of each of its words, and at each letter of a word that is asked for; truncation and budget questions are answered by
bisecting these counts.  A corpus-wide count asks for whole words only, each distinct word of a task once.

Nulls and empty texts count as no tokens, zero bytes.  A very long text is one row of its own slice.  Repeated rows give equal
rows.  Extra columns pass through; the operator's output columns replace columns of the same name.
"""

from __future__ import annotations

import json
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate, islice

import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import chunks, map_arrow


def byte_letters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable bytes stand for themselves, others from U+0100 on."""
    shown = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, extra = [], 0
    for b in range(256):
        out.append(chr(b) if b in shown else chr(256 + extra))
        extra += b not in shown
    return out


class PrefixCounter:
    """Exact token counts of texts and of their prefixes, for a byte-level BPE whose words end in a suffix."""

    def __init__(self, content: str, table_size: int = 500_000):
        spec = json.loads(content)
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = model["vocab"]
        self.names = {i: t for t, i in self.ids.items()}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merge = {(self.ids[a], self.ids[b]): (rank, self.ids[a + b]) for rank, (a, b) in reversed([*enumerate(merges)])}
        self.longest = max(len(t.removesuffix(self.end)) for t in self.ids)
        self.letters = dict(enumerate(byte_letters()))
        self.specials = {x["content"] for x in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")").split if self.specials else lambda t: [t]
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        self.beside: dict[tuple[int, int], bool] = {}
        self.alone: dict[int, bool] = {}
        self.table: dict[str, int] = {}
        self.table_size = table_size

    def _symbols(self, token: int) -> list[int]:
        name = self.names[token]
        body = name.removesuffix(self.end) if self.end and len(name) > len(self.end) else name
        parts = [*body[:-1], body[-1] + name[len(body) :]]
        return [self.ids[p] for p in parts]

    def _merged(self, symbols: list[int]) -> list[int]:
        """Merges in rank order, leftmost first, until none applies."""
        while len(symbols) > 1:
            found = [(self.merge[pair][0], i) for i in range(len(symbols) - 1) if (pair := (symbols[i], symbols[i + 1])) in self.merge]
            if not found:
                break
            _, i = min(found)
            symbols[i : i + 2] = [self.merge[symbols[i], symbols[i + 1]][1]]
        return symbols

    def _stands_alone(self, token: int) -> bool:
        known = self.alone.get(token)
        if known is None:
            known = self.alone[token] = self._merged(self._symbols(token)) == [token]
        return known

    def _may_follow(self, left: int, right: int) -> bool:
        key = (left, right)
        known = self.beside.get(key)
        if known is None:
            if len(self.beside) >= 1_000_000:
                self.beside.clear()
            known = self.beside[key] = self._merged(self._symbols(left) + self._symbols(right)) == [left, right]
        return known

    def prefixes(self, word: str, every: bool = True) -> list[int]:
        """The token count of the word's first 1, 2, ... letters (bytes), each taken as a whole word; of the whole word only, unless ``every``."""
        letters = word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters)
        n, ids, longest, end, follow = len(letters), self.ids.get, self.longest, self.end, self._may_follow
        last, count, out = [-1] * (n + 1), [0] * (n + 1), []
        for i in range(1, n + 1):
            for suffix, told in ((end, True), ("", False)):
                if told and not every and i < n or not told and i == n:
                    continue
                for j in range(max(0, i - longest), i):
                    token = ids(letters[j:i] + suffix)
                    if token is None or j and last[j] < 0:
                        continue
                    if follow(last[j], token) if j else self._stands_alone(token):
                        if told:
                            out.append(count[j] + 1)
                        else:
                            last[i], count[i] = token, count[j] + 1
                        break
                else:
                    raise ValueError(f"no token ends at letter {i} of {word!r}")
        return out

    def pieces(self, text: str) -> Iterator[str]:
        """The words of a text and the special tokens in it, in order."""
        for part in self.cut(text):
            if part in self.specials:
                yield part
            elif part:
                yield from self.words(self._normal(part))

    @staticmethod
    def _normal(part: str) -> str:
        if part.isascii():
            return part.lower()
        return unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()

    def _counts(self, pieces: list[str]) -> Iterator[int]:
        known = self.table
        missing = set(pieces).difference(known)
        if missing:
            if len(known) + len(missing) > self.table_size:
                known.clear()
                missing = set(pieces)
            for word in missing:
                known[word] = 1 if word in self.specials else self.prefixes(word, every=False)[-1]
        return map(known.__getitem__, pieces)

    def count(self, text: str | None) -> int:
        """The token count of a text."""
        return sum(self._counts([*self.pieces(text)])) if text else 0

    def cumulated(self, text: str | None) -> list[int]:
        """The token count up to the end of each word of a text."""
        return [*accumulate(self._counts([*self.pieces(text)]))] if text else []

    def words_within(self, text: str | None, budget: int) -> int:
        """How many words from the start of the text fit into a budget of tokens."""
        return bisect_right(self.cumulated(text), budget)

    def fit(self, text: str | None, budget: int) -> tuple[int, int]:
        """How many words from the start of the text fit into a budget of tokens, and how many letters (bytes) of the next word at most."""
        counts = self.cumulated(text)
        words = bisect_right(counts, budget)
        if words == len(counts):
            return words, 0
        left = budget - (counts[words - 1] if words else 0)
        word = next(islice(self.pieces(text), words, None))
        inside = [] if word in self.specials else self.prefixes(word)
        return words, max((i for i, n in enumerate(inside, 1) if n <= left), default=0)


def count_tokens(docs: DataFrame, vocabulary_path: str, limit: int, text: str = "text", with_prefixes: bool = False) -> DataFrame:
    """``docs`` with n_bytes, n_tokens, over_limit (n_tokens above ``limit``) and, if asked for, prefix_tokens (the count at each word's end).

    The vocabulary file is read on the driver and sent to the executors; its size is that of the tokenizer, not of the data.
    """
    with open(vocabulary_path, encoding="utf-8") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())
    made = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]
    if with_prefixes:
        made.append(T.StructField("prefix_tokens", T.ArrayType(T.LongType())))
    new = {x.name for x in made}
    schema = T.StructType([*[x for x in docs.schema.fields if x.name not in new or x.name == text], *made])

    def run(batches):
        counter = PrefixCounter(vocabulary.value)
        for part in chunks(batches, text):
            texts = part.column(text).to_pylist()
            counts = [counter.count(x) for x in texts]
            columns = {
                "n_bytes": pa.compute.fill_null(pa.compute.binary_length(part.column(text)), 0).cast(pa.int64()),
                "n_tokens": pa.array(counts, pa.int64()), "over_limit": pa.array([n > limit for n in counts], pa.bool_()),
            }
            if with_prefixes:
                columns["prefix_tokens"] = pa.array([counter.cumulated(x) for x in texts], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([columns[n] if n in new else part.column(n) for n in schema.names], names=schema.names)

    return map_arrow(docs, run, schema)


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    """Every document's size, token count and whether it is over 2,048 tokens."""
    import public_tokenizers

    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), 2048).select("doc_id", "n_bytes", "n_tokens", "over_limit")

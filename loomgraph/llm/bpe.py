"""Byte-level BPE encoding and decoding by corpus-level merge replay.

The texts of a slice of the corpus are cut by the tokenizer's pattern into pieces.  The distinct pieces form a
small corpus of words on which all merges are replayed in rank order: an inverted index leads from a merge's rank to the
positions where it applies, and a merge updates only the entries of its two neighbours.  Pieces already replayed are kept in
a bounded table, so that a worker replays frequent pieces once.  No row leaves its task: encoding needs no shuffle.

Nulls and empty texts encode to no tokens.  A very long text is one row of its own slice.  Repeated rows give equal rows.
Extra columns pass through ``encode``; its own output columns replace columns of the same name.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, map_arrow

_GONE = -1


def load_ranks(content: bytes) -> dict[bytes, int]:
    """Token bytes to rank, from the content of a ``.tiktoken`` file."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in content.splitlines() if line)}


class MergeReplay:
    """Replays the merges of ``ranks`` over sets of pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, table_size: int = 500_000):
        self.ranks, self.table_size = ranks, table_size
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.split = regex.compile(pattern).findall
        self.single = [ranks[bytes([b])] for b in range(256)]
        self.pair_rank: dict[tuple[int, int], int] = {}
        self.table: dict[str, bytes] = {}

    def _rank(self, left: int, right: int) -> int:
        """The rank of the merge of two tokens, or -1."""
        key = (left, right)
        rank = self.pair_rank.get(key)
        if rank is None:
            if len(self.pair_rank) >= 2_000_000:
                self.pair_rank.clear()
            rank = self.pair_rank[key] = self.ranks.get(self.tokens[left] + self.tokens[right], -1)
        return rank

    def replay(self, pieces: Iterable[str]) -> dict[str, bytes]:
        """Each piece's token ids as little-endian unsigned 32-bit integers."""
        done: dict[str, bytes] = {}
        token: list[int] = []
        before: list[int] = []
        after: list[int] = []
        starts: list[tuple[str, int]] = []
        index: dict[int, list[int]] = {}
        single, rank_of, whole_of = self.single, self._rank, self.ranks.get
        for piece in pieces:
            raw = piece.encode("utf-8", "surrogatepass")
            whole = whole_of(raw)
            if whole is not None:
                done[piece] = whole.to_bytes(4, "little")
                continue
            start, n = len(token), len(raw)
            starts.append((piece, start))
            token.extend(map(single.__getitem__, raw))
            before.extend(range(start - 1, start + n - 1))
            after.extend(range(start + 1, start + n + 1))
            before[start] = after[start + n - 1] = _GONE
            for i in range(start, start + n - 1):
                rank = rank_of(token[i], token[i + 1])
                if rank >= 0:
                    index.setdefault(rank, []).append(i)
        waiting = list(index)
        heapq.heapify(waiting)
        while waiting:
            rank = heapq.heappop(waiting)
            positions = index.pop(rank, None)
            if positions is None:
                continue
            positions.sort()
            for k, i in enumerate(positions):
                left = token[i]
                j = after[i]
                if left == _GONE or j == _GONE or rank_of(left, token[j]) != rank:
                    continue
                token[i] = rank
                token[j] = _GONE
                n = after[i] = after[j]
                p = before[i]
                lower = False
                if n != _GONE:
                    before[n] = i
                    new = rank_of(rank, token[n])
                    if new >= 0:
                        if new not in index:
                            index[new] = []
                            heapq.heappush(waiting, new)
                        index[new].append(i)
                        lower = new < rank
                if p != _GONE:
                    new = rank_of(token[p], rank)
                    if new >= 0:
                        if new not in index:
                            index[new] = []
                            heapq.heappush(waiting, new)
                        index[new].append(p)
                        lower = lower or new < rank
                if lower and k + 1 < len(positions):
                    # a merge of lower rank has come up; what is left of this one waits behind it
                    index.setdefault(rank, []).extend(positions[k + 1 :])
                    heapq.heappush(waiting, rank)
                    break
        for piece, start in starts:
            ids = array("I")
            i = start
            while i != _GONE:
                ids.append(token[i])
                i = after[i]
            done[piece] = ids.tobytes()
        return done

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        cut = [self.split(text) if text else [] for text in texts]
        known = self.table
        missing = set().union(*cut).difference(known)
        if len(known) + len(missing) > self.table_size:
            known.clear()
            missing = set().union(*cut)
        known.update(self.replay(missing))
        return [b"".join(map(known.__getitem__, pieces)) for pieces in cut]

    def decode(self, ids: bytes) -> bytes:
        """The bytes that ids stand for."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _encoder(vocabulary, pattern: str, text: str, outputs: list[str], schema_names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replayer = MergeReplay(load_ranks(vocabulary.value), pattern)
        for part in chunks(batches, text, 1 << 20):
            ids = replayer.encode(part.column(text).to_pylist())
            made = {"ids": lambda: pa.array(ids, pa.binary()), "n_tokens": lambda: pa.array([len(x) // 4 for x in ids], pa.int64()), "ids_sha256": lambda: pa.array([hashlib.sha256(x).hexdigest() for x in ids]), "decoded_sha256": lambda: pa.array([hashlib.sha256(replayer.decode(x)).hexdigest() for x in ids])}
            yield pa.RecordBatch.from_arrays([made[n]() if n in outputs else part.column(n) for n in schema_names], names=schema_names)

    return run


_TYPES = {"ids": T.BinaryType(), "n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}


def encode(docs: DataFrame, vocabulary_path: str, pattern: str, text: str = "text", outputs: tuple[str, ...] = ("ids", "n_tokens")) -> DataFrame:
    """``docs`` with the token ids of ``text`` and figures of them.

    outputs: of ``ids`` (binary, little-endian unsigned 32-bit integers), ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``
    (of the bytes the ids decode to).  The vocabulary file is read on the driver and sent to the executors; its size is that of
    the tokenizer, not of the data.
    """
    with open(vocabulary_path, "rb") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())
    kept = docs.drop(*[c for c in docs.columns if c in outputs and c != text])
    schema = T.StructType([*[x for x in kept.schema.fields if x.name not in outputs], *[T.StructField(n, _TYPES[n]) for n in outputs]])
    return map_arrow(kept, _encoder(vocabulary, pattern, text, list(outputs), schema.names), schema)


def decode(encoded: DataFrame, vocabulary_path: str, ids: str = "ids", output: str = "decoded") -> DataFrame:
    """``encoded`` with the text of the column of ids as bytes; null ids give null."""
    with open(vocabulary_path, "rb") as f:
        vocabulary = encoded.sparkSession.sparkContext.broadcast(f.read())
    kept = encoded.drop(output)
    schema = T.StructType([*kept.schema.fields, T.StructField(output, T.BinaryType())])

    def run(batches):
        tokens = {rank: token for token, rank in load_ranks(vocabulary.value).items()}
        for part in chunks(batches, ids, 1 << 20):
            made = [None if x is None else b"".join(map(tokens.__getitem__, np.frombuffer(x, "<u4").tolist())) for x in part.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(made, pa.binary())], names=schema.names)

    return map_arrow(kept, run, schema)


def op5_bpe(spark, sf_dir: str) -> DataFrame:
    """Every document's token count and digests of its ids and of what they decode to."""
    import public_tokenizers

    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, outputs=("n_tokens", "ids_sha256", "decoded_sha256")).select(F.col("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")

"""Exact substring dedup with a hash-compared suffix sort.

Every byte covered by a string of ``length`` bytes that also starts anywhere else is found, for all documents at once:

1. Each window of ``length`` bytes picks the ``gram``-byte string in it whose hash is least, its anchor, so that equal windows pick
   the same string at the same offset.  Runs of windows with one anchor form a span.  About 2 in 160 positions are anchors, and only they
   are shuffled: anchors whose string is unique hold no repeated window.
2. Spans that are equal as a whole, by a digest of 128 bits of two prefix hashes, are repeated as a whole.  One span of each class goes on, if its anchor has other classes.
3. Spans with one anchor are sorted by what follows the anchor: a mergesort in which two suffixes are compared by the longest common
   extension, found by binary search over polynomial prefix hashes, and the next byte.  Common extensions of neighbours are checked
   on the bytes.  Windows with ``l`` bytes before the anchor are equal if no extension of ``length - l`` is missing between
   them in the sorted order and the ``l`` bytes before are equal, which is checked on the bytes too.
4. An anchor with very many classes is not sorted in one task: its windows are dealt out by their digest and counted.

Null texts are empty; texts under ``length`` bytes keep everything.  Equal rows are occurrences of their own: each makes the other
repeat.  Very long texts are worked on in segments.  The operator selects the columns it names, so extra columns do not clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, map_arrow, materialize, table

#: Bytes of an anchor's string, bytes of a segment of a long text, and classes of spans that one task sorts for an anchor.
GRAM, SEGMENT, MOST_CLASSES = 40, 1 << 19, 10_000
_NO_ID = -(1 << 63)
_POSITION = np.uint64((1 << 20) - 1)


class Prefixes:
    """Polynomial prefix hashes modulo 2^64 of a byte array: a random number for each byte value, times a power of an odd base."""

    powers: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, seed: int = 1):
        n = len(data)
        values, up, down = self.powers.get(seed, (None, np.ones(0), None))
        if len(up) < n + 1:
            rng = np.random.default_rng(seed)
            values = rng.integers(0, 1 << 64, 256, np.uint64)
            base = int(rng.integers(0, 1 << 63)) * 8 + 5 & (1 << 64) - 1
            size = n + n // 4 + 1024
            up, down = (np.full(size, b, np.uint64) for b in (base, pow(base, -1, 1 << 64)))
            for x in (up, down):
                x[0] = 1
                np.multiply.accumulate(x, out=x)
            self.powers[seed] = (values, up, down)
        self.down = down
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values[data] * up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, size) -> np.ndarray:
        """Hashes of the strings that start at ``start``."""
        return (self.sums[start + size] - self.sums[start]) * self.down[start]

    def every(self, size: int) -> np.ndarray:
        """Hashes of the strings of one size at every position."""
        return (self.sums[size:] - self.sums[:-size]) * self.down[: len(self.sums) - size]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def spans(data: np.ndarray, length: int, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """The spans of a text: anchor hash, the two halves of its class (a digest of 128 bits), first window's start, anchor less start, last window's start less first."""
    out = []
    for begin in range(0, len(data) - length + 1, SEGMENT):
        part = data[begin : begin + SEGMENT + length - 1]
        prefixes, others = Prefixes(part), Prefixes(part, 2)
        least = _mixed(prefixes.every(gram)) & ~_POSITION
        least |= np.arange(len(least), dtype=np.uint64)
        width, wanted = 1, length - gram + 1
        while width * 2 <= wanted:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if wanted > width:
            least = np.minimum(least[: len(least) - (wanted - width)], least[wanted - width :])
        at = (least & _POSITION).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        more = np.append(first[1:], len(at)) - 1 - first
        anchor = at[first]
        kind = _mixed(prefixes.of(first, more + length)) ^ _mixed((anchor - first).astype(np.uint64) << np.uint64(10) | more.astype(np.uint64))
        out.append((prefixes.of(anchor, gram), kind, _mixed(others.of(first, more + length)), first + begin, anchor - first, more))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class SuffixSort:
    """Sorts suffixes inside groups.  Suffix i starts at ``start[i]`` of ``data``, has ``size[i]`` bytes and belongs to ``group[i]``."""

    def __init__(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, group: np.ndarray):
        self.data, self.start, self.size, self.group = data, start, size, group
        for seed in range(1, 9):
            self.prefixes = Prefixes(data, seed)
            self.order = self._sorted()
            left, right = self.order[:-1], self.order[1:]
            self.common = np.where(group[left] == group[right], self.extension(left, right), -1)
            if same_bytes(data, start[left], start[right], np.maximum(self.common, 0)).all():
                return
        raise ArithmeticError("prefix hashes collide for every seed")

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The longest common extension of suffixes, by binary search over the prefix hashes."""
        low, high = np.zeros(len(a), np.int64), np.minimum(self.size[a], self.size[b])
        from_a, from_b = self.start[a], self.start[b]
        while (open_ := low < high).any():
            middle = (low + high + 1) >> 1
            equal = self.prefixes.of(from_a, middle) == self.prefixes.of(from_b, middle)
            low = np.where(open_ & equal, middle, low)
            high = np.where(open_ & ~equal, middle - 1, high)
        return low

    def below(self, a: np.ndarray, b: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        """Whether suffix a sorts before b, or where ``or_equal`` isn't after it."""
        common = self.extension(a, b)
        ends_a, ends_b = common == self.size[a], common == self.size[b]
        byte = lambda x, ends: np.where(ends, -1, self.data[np.minimum(self.start[x] + common, len(self.data) - 1)].astype(np.int64))
        byte_a, byte_b = byte(a, ends_a), byte(b, ends_b)
        return (byte_a < byte_b) | (or_equal & (byte_a == byte_b))

    def _sorted(self) -> np.ndarray:
        """A mergesort from runs of one suffix, all groups at once: each suffix's place is its place in its run and its rank in the run beside it."""
        order = np.argsort(self.group, kind="stable")
        if not len(order):
            return order
        bounds = np.flatnonzero(np.concatenate(([True], np.diff(self.group[order]) != 0, [True])))
        sizes = np.diff(bounds)
        base, limit = np.repeat(bounds[:-1], sizes), np.repeat(bounds[1:], sizes)
        width, largest = 1, sizes.max()
        while width < largest:
            slots = np.flatnonzero(limit - base > width)
            own_base, own_limit, item = base[slots], limit[slots], order[slots]
            local = slots - own_base
            pair = own_base + local // (2 * width) * (2 * width)
            in_left = local // width % 2 == 0
            low = np.where(in_left, np.minimum(pair + width, own_limit), pair)
            first, high = low.copy(), np.where(in_left, np.minimum(pair + 2 * width, own_limit), pair + width)
            while len(open_ := np.flatnonzero(low < high)):
                middle = (low[open_] + high[open_]) >> 1
                goes_up = self.below(order[middle], item[open_], ~in_left[open_])
                low[open_] = np.where(goes_up, middle + 1, low[open_])
                high[open_] = np.where(goes_up, high[open_], middle)
            merged = order.copy()
            merged[pair + local % width + (low - first)] = item
            order, width = merged, width * 2
        return order


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the strings of ``size`` bytes at a and b are equal, byte by byte."""
    out = np.ones(len(a), bool)
    for k in range(0, len(a), 8192):
        s = size[k : k + 8192]
        steps = np.arange(s.max(initial=0))
        inside = steps < s[:, None]
        x, y = (np.where(inside, z[k : k + 8192, None] + steps, 0) for z in (a, b))
        out[k : k + 8192] = (data[x] == data[y]).all(1)
    return out


def repeated_windows(data: np.ndarray, begin: np.ndarray, before: np.ndarray, more: np.ndarray, group: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(span, window) numbers of the windows that equal a window of another span of the group with as many bytes before the anchor."""
    anchor = begin + before
    suffixes = SuffixSort(data, anchor, more + length - before, group)
    order, common = suffixes.order, suffixes.common
    for ahead in range(int(before.max(initial=-1)) + 1):
        run = np.concatenate(([0], np.cumsum(common < length - ahead)))
        valid = (before[order] >= ahead) & (before[order] - more[order] <= ahead)
        item, run = order[valid], run[valid]
        if len(item) < 2:
            continue
        start = anchor[item] - ahead
        key = suffixes.prefixes.of(start, ahead)
        by = np.lexsort((key, run))
        item, run, key, start = item[by], run[by], key[by], start[by]
        near = np.flatnonzero((run[1:] == run[:-1]) & (key[1:] == key[:-1]))
        near = near[same_bytes(data, start[near], start[near + 1], np.full(len(near), ahead))]
        found = item[np.unique(np.concatenate((near, near + 1)))]
        yield found, before[found] - ahead


def _runs(item: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(span, first, last) of runs of consecutive windows."""
    if not len(item):
        return item, window, window
    by = np.lexsort((window, item))
    item, window = item[by], window[by]
    first = np.concatenate(([True], (item[1:] != item[:-1]) | (window[1:] != window[:-1] + 1)))[: len(item)]
    at = np.flatnonzero(first)
    return item[at], window[at], window[np.append(at[1:], len(item)) - 1]


def _anchors(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text", 2 << 20):
            found, rows = [], []
            for i, text in enumerate(part.column("text")):
                data = np.frombuffer(text.as_buffer(), np.uint8) if text.is_valid else ()
                if len(data) >= length:
                    found.append(spans(data, length))
                    rows.append(np.full(len(found[-1][0]), i))
            if found:
                gram, kind, other, first, before, more = (np.concatenate(x) for x in zip(*found, strict=True))
                owner = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(kind.view(np.int64)), pa.array(other.view(np.int64)), part.column("k").take(owner), part.column("th").take(owner), pa.array(first << 16 | before << 8 | more)], names=["gram", "kind", "other", "k", "th", "place"])

    return run


def _places(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return place >> 16, place >> 8 & 255, place & 255


def _cut(length: int):
    """Takes the bytes of the wanted spans out of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text", 2 << 20):
            out: dict[str, list] = {n: [] for n in ("gram", "k", "th", "place", "hot", "bytes")}
            for k, th, text, wanted in zip(*(part.column(n).to_pylist() for n in ("k", "th", "text", "wanted")), strict=True):
                raw = text.encode()
                for x in wanted:
                    first, more = x["place"] >> 16, x["place"] & 255
                    for name, value in (("gram", x["gram"]), ("k", k), ("th", th), ("place", x["place"]), ("hot", x["hot"]), ("bytes", raw[first : first + more + length])):
                        out[name].append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out["gram"], pa.int64()), pa.array(out["k"], pa.int64()), pa.array(out["th"], pa.int32()), pa.array(out["place"], pa.int64()), pa.array(out["hot"], pa.bool_()), pa.array(out["bytes"], pa.binary())], names=[*out])

    return run


def _sort_spans(length: int, most: int = 5_000):
    """Over rows sorted by anchor: sorts whole groups of spans, about ``most`` spans at a time."""

    def work(rows: pa.Table) -> pa.RecordBatch:
        content = rows.column("bytes").to_pylist()
        data = np.frombuffer(b"".join(content), np.uint8)
        begin = np.concatenate(([0], np.cumsum([len(x) for x in content])))[:-1].astype(np.int64)
        first, before, more = _places(rows.column("place").to_numpy())
        group = np.unique(rows.column("gram").to_numpy(), return_inverse=True)[1]
        found = [*repeated_windows(data, begin, before, more, group, length)]
        item, low, high = _runs(*(np.concatenate(x) for x in zip(*found, strict=True))) if found else (np.zeros(0, np.int64),) * 3
        return pa.RecordBatch.from_arrays([rows.column("k").take(item).combine_chunks(), rows.column("th").take(item).combine_chunks(), pa.array(first[item] + low), pa.array(first[item] + high)], names=["k", "th", "low", "high"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) > most:
                rows = pa.Table.from_batches(held).combine_chunks()
                gram = rows.column("gram").to_numpy()
                ends = np.flatnonzero(gram[1:] != gram[:-1])
                if len(ends):
                    yield work(rows.slice(0, ends[-1] + 1))
                    held = rows.slice(ends[-1] + 1).to_batches()
        if held:
            yield work(pa.Table.from_batches(held).combine_chunks())

    return run


def _windows(length: int):
    """The digest of every window of a span, for anchors with very many classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "bytes", 1 << 18):
            out: list[list] = [[], [], [], []]
            for k, th, place, raw in zip(*(part.column(n).to_pylist() for n in ("k", "th", "place", "bytes")), strict=True):
                for i in range((place & 255) + 1):
                    for values, x in zip(out, (hashlib.blake2b(raw[i : i + length], digest_size=16, key=bytes([(place >> 8 & 255) - i])).digest(), k, th, (place >> 16) + i), strict=True):
                        values.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.binary(), pa.int64(), pa.int32(), pa.int64()), strict=True)], names=["digest", "k", "th", "start"])

    return run


def _removed(text: str | None, ranges: list[dict] | None, length: int) -> tuple[list[tuple[int, int]], bytes]:
    """The maximal removed runs of a text, and its remaining bytes."""
    raw = (text or "").encode()
    runs: list[list[int]] = []
    for low, high in sorted((x["low"], x["high"]) for x in ranges or ()):
        if runs and low <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], high + length)
        else:
            runs.append([low, high + length])
    ends = [0, *(x for run in runs for x in run), len(raw)]
    return [(a, b) for a, b in runs], b"".join(raw[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True))


def _report(length: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text", 2 << 20):
            found = [_removed(text, ranges, length) for text, ranges in zip(part.column("text").to_pylist(), part.column("ranges").to_pylist(), strict=True)]
            n_bytes = pa.compute.fill_null(pa.compute.binary_length(part.column("text")), 0).cast(pa.int64())
            columns = [part.column("k"), n_bytes, pa.array([sum(b - a for a, b in runs) for runs, _ in found], pa.int64()), pa.array([len(runs) for runs, _ in found], pa.int64()), pa.array([hashlib.sha256(kept).hexdigest() for _, kept in found])]
            names = ["k", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                columns.append(pa.array([kept for _, kept in found], pa.binary()))
                columns.append(pa.array([runs for runs, _ in found], pa.list_(pa.list_(pa.int64()))) if found else pa.array([], pa.list_(pa.list_(pa.int64()))))
                names += ["kept", "removed"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def remove_repeated(docs: DataFrame, length: int = 200, key: str = "doc_id", text: str = "text", with_text: bool = False, most_classes: int = MOST_CLASSES) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) of every document; with_text adds ``kept`` (the remaining bytes) and ``removed`` (the runs).

    length: bytes of a repeated string, over 40 and up to 295."""
    if not GRAM < length <= GRAM + 255:
        raise ValueError(f"length must be over {GRAM} and at most {GRAM + 255}")
    key_type = docs.schema[key].dataType
    texts = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(_NO_ID)).alias("k"), F.hash(F.col(key), F.col(text)).alias("th"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    anchors = map_arrow(texts, _anchors(length), "gram long, kind long, other long, k long, th int, place long")
    again = anchors.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("gram")
    shared = materialize(anchors.join(again, "gram"), "anchors")
    classes = materialize(shared.groupBy("gram", "kind", "other").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k", "th", "place")).alias("one")), "spans")
    whole = shared.join(classes.filter("n > 1").select("gram", "kind", "other"), ["gram", "kind", "other"]).select("k", "th", F.shiftright("place", 16).alias("low"), (F.shiftright("place", 16) + F.col("place").bitwiseAND(255)).alias("high"))
    several = classes.groupBy("gram").agg(F.count(F.lit(1)).alias("classes")).filter("classes > 1")
    wanted = classes.join(several, "gram").select("one.k", "one.th", F.struct("gram", "one.place", (F.col("classes") > most_classes).alias("hot")).alias("x")).groupBy("k", "th").agg(F.collect_list("x").alias("wanted"))
    cut = materialize(map_arrow(texts.join(wanted, ["k", "th"]), _cut(length), "gram long, k long, th int, place long, hot boolean, bytes binary"), "cut")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = map_arrow(cut.filter("not hot").drop("hot").repartition(parts, "gram").sortWithinPartitions("gram"), _sort_spans(length), "k long, th int, low long, high long")
    windows = map_arrow(cut.filter("hot"), _windows(length), "digest binary, k long, th int, start long")
    often = windows.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest")
    dealt = windows.join(often, "digest").select("k", "th", F.col("start").alias("low"), F.col("start").alias("high"))
    ranges = whole.unionByName(sorted_).unionByName(dealt).groupBy("k", "th").agg(F.collect_set(F.struct("low", "high")).alias("ranges"))
    schema = "k long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary, removed array<array<long>>" * with_text
    told = map_arrow(texts.join(ranges, ["k", "th"], "left").select("k", "text", "ranges"), _report(length, with_text), schema)
    return told.select(F.when(F.col("k") != _NO_ID, F.col("k")).cast(key_type).alias(key), *told.columns[1:])


def op6_substrings(spark, sf_dir: str) -> DataFrame:
    """Every document without the bytes that 200-byte strings repeat."""
    return remove_repeated(table(spark, sf_dir, "documents"))

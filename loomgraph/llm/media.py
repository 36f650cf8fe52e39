"""Media columns: interleaved document sequences.

``parse_pages`` turns HTML into an ordered array of structs, text and media references in document order, each reference with
its alternative text, its caption and the digest it names.  ``store`` writes payloads as 8-bit images into a content-addressed table.
``resolve`` joins the references of all pages with what was read back from the store by digest, and puts every item back
at its position.

A figure's caption, before or after its media, is that of all media in it; a caption outside a figure is text.  Null or empty HTML gives an empty
sequence; unclosed tags are read as far as they go, and a head also ends at the first element or text that can't be in it.  A reference whose digest is in no store keeps
its position with null payload columns.  Payload rows with equal digests count once.  Repeated pages give repeated sequences.  The
operators select the columns they name, so extra columns do not clash.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, map_arrow, materialize, table

#: The width of a stored image: payloads are padded to whole rows of it.
WIDTH = 64
ITEM = "struct<position:int,kind:string,text:string,digest:string,alt:string,caption:string>"
#: Elements that end a run of text.
_BLOCKS = frozenset("p div section article header footer main aside nav ul ol li table tr td th h1 h2 h3 h4 h5 h6 figure figcaption blockquote pre br hr body html".split())
_MEDIA = frozenset("img video audio source embed".split())
_SILENT = frozenset("script style head title noscript template".split())
#: Elements that may stand in a head; any other one ends it, as does text.
_IN_HEAD = frozenset("title meta link base script style noscript template".split())
_DIGEST = re.compile(r"(?:^|[:/])([0-9a-f]{64})(?:\.[a-z0-9]+)?$")


class _Sequence(HTMLParser):
    """Collects the items of one page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.run: list[str] = []
        self.silent: list[str] = []
        # open figures: where their items start, their caption so far, and whether it is open
        self.figures: list[dict] = []

    def close_run(self) -> None:
        text = " ".join("".join(self.run).split())
        self.run = []
        if text:
            self.items.append({"kind": "text", "text": text, "digest": None, "alt": None, "caption": None})

    def close_figure(self) -> None:
        """The caption, wherever it stands in the figure, goes to all media of it that have none of a figure inside."""
        self.close_run()
        figure = self.figures.pop()
        if figure["caption"] is not None:
            caption = " ".join("".join(figure["caption"]).split())
            for item in self.items[figure["start"] :]:
                if item["kind"] == "media" and item["caption"] is None:
                    item["caption"] = caption

    def end_head(self) -> None:
        """A head ends without its end tag too."""
        if "head" in self.silent:
            del self.silent[self.silent.index("head") :]

    def handle_starttag(self, tag, attrs):
        if tag == "body" or self.silent[-1:] == ["head"] and tag not in _IN_HEAD:
            self.end_head()
        if tag in _SILENT:
            self.silent.append(tag)
        if self.silent:
            return
        if tag in _BLOCKS or tag in _MEDIA:
            self.close_run()
        if tag == "figure":
            self.figures.append({"start": len(self.items), "caption": None, "open": False})
        elif tag == "figcaption" and self.figures:
            self.figures[-1] |= {"caption": self.figures[-1]["caption"] or [], "open": True}
        elif tag in _MEDIA:
            named = dict(attrs)
            source = (named.get("src") or "").strip()
            if source:
                found = _DIGEST.search(source)
                self.items.append({"kind": "media", "text": source, "digest": found and found[1], "alt": named.get("alt"), "caption": None})

    def handle_endtag(self, tag):
        if self.silent:
            if tag in self.silent:
                # what is still open inside ends with it
                del self.silent[len(self.silent) - 1 - self.silent[::-1].index(tag) :]
            return
        if tag == "figcaption" and self.figures:
            self.figures[-1]["open"] = False
        elif tag == "figure":
            if self.figures:
                self.close_figure()
        elif tag in _BLOCKS:
            self.close_run()

    def handle_data(self, data):
        if self.silent == ["head"] and data.strip():
            self.end_head()
        if not self.silent:
            (self.figures[-1]["caption"] if self.figures and self.figures[-1]["open"] else self.run).append(data)


def page_items(html: str | None) -> list[dict]:
    """The items of a page in document order, positions from 0."""
    parser = _Sequence()
    parser.feed(html or "")
    parser.close()
    while parser.figures:
        parser.close_figure()
    parser.close_run()
    return [{"position": i, **item} for i, item in enumerate(parser.items)]


def parse_pages(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, items): the ordered items of each page."""
    wanted = pages.select(F.col(key), F.col(html))
    schema = T.StructType([wanted.schema[0], T.StructField("items", T.ArrayType(T._parse_datatype_string(ITEM)))])
    kind = pa.list_(pa.struct([("position", pa.int32()), *((n, pa.string()) for n in ("kind", "text", "digest", "alt", "caption"))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, html):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([page_items(x) for x in part.column(1).to_pylist()], kind)], names=schema.names)

    return map_arrow(wanted, run, schema)


def as_image(content: Column) -> Column:
    """Bytes as a grey 8-bit image (PGM): zero bytes are appended up to a positive multiple of the width; a comment tells the true size."""
    size = F.octet_length(content)
    rows = F.greatest(F.lit(1), F.ceil(size / WIDTH)).cast("long")
    head = F.concat(F.lit("P5\n#"), size.cast("string"), F.lit(f"\n{WIDTH} "), rows.cast("string"), F.lit("\n255\n"))
    return F.concat(head.cast("binary"), content, F.unhex(F.repeat(F.lit("00"), (rows * WIDTH - size).cast("int"))))


def store(payloads: DataFrame, content: str) -> DataFrame:
    """Writes the images of a binary column into a table (digest, media) in the shared folder, and returns the table as it is read back.

    Rows may repeat a digest; readers count a digest once."""
    media = payloads.select(as_image(F.coalesce(F.col(content), F.lit(b""))).alias("media"))
    return materialize(media.select(F.sha2("media", 256).alias("digest"), "media"), "media")


_PAYLOAD = "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _read_image(media: bytes) -> tuple[int, np.ndarray]:
    """The true size and the samples of a stored image; ValueError if it isn't one of ``store``."""
    found = re.match(rb"P5\n#(\d+)\n(\d+) (\d+)\n255\n", media)
    if not found or len(media) - found.end() != int(found[2]) * int(found[3]):
        raise ValueError("not an image of this store")
    return int(found[1]), np.frombuffer(media, np.uint8, offset=found.end()).reshape(int(found[3]), int(found[2]))


def image_feature(samples: np.ndarray) -> str:
    """Mean, deviation and the average hash over an 8 x 8 grid: 64 bits tell which cells are brighter than the image."""
    columns = samples.reshape(len(samples), 8, -1).mean(2)
    edges = np.linspace(0, len(samples), 9)
    cells = np.array([columns[int(a) : max(int(np.ceil(b)), int(a) + 1)].mean(0) for a, b in zip(edges[:-1], edges[1:], strict=True)])
    bits = np.packbits((cells > samples.mean()).ravel()).tobytes().hex()
    return f"{samples.mean():.3f}:{samples.std():.3f}:{bits}"


def read_payloads(stored: DataFrame) -> DataFrame:
    """One row for each digest of a store: the payload's figures, computed on the bytes read back.  A row whose bytes don't have its digest is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "media"):
            rows = []
            for digest, media in zip(part.column("digest").to_pylist(), part.column("media").to_pylist(), strict=True):
                if hashlib.sha256(media).hexdigest() != digest:
                    raise ValueError(f"the stored bytes of {digest} have changed")
                size, samples = _read_image(media)
                payload = samples.tobytes()
                rows.append((digest, size, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(media), digest, image_feature(samples)))
            names = ["digest", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    read = map_arrow(stored.select("digest", "media"), run, _PAYLOAD)
    return read.groupBy("digest").agg(*[F.first(c).alias(c) for c in read.columns[1:]])


def resolve(sequences: DataFrame, key: str, payloads: DataFrame) -> DataFrame:
    """(key, items): the items of ``parse_pages`` with the payload's columns in ``media`` where the digest is known, still in order.

    Texts without references take no part in the join.  A digest that a third of the pages name is one row on the payload side; the pages'
    side can be split."""
    pages = sequences.select(F.struct(F.col(key), F.xxhash64("items").alias("h")).alias("page"), "items")
    refs = pages.select("page", F.explode("items").alias("item")).filter("item.digest is not null").select("page", "item.position", "item.digest").distinct()
    found = refs.join(payloads, "digest").groupBy("page").agg(F.map_from_entries(F.collect_list(F.struct("position", F.struct(*payloads.columns)))).alias("found"))
    joined = pages.join(found, "page", "left")
    return joined.select(F.col("page").getField(key).alias(key), F.transform("items", lambda x: x.withField("media", F.col("found")[x["position"]])).alias("items"))


def op1_media(spark, sf_dir: str) -> DataFrame:
    """Every document's text as a stored image: a page refers to it by digest, the join brings back what was read from the store."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("content"))
    payloads = read_payloads(store(docs, "content"))
    page = F.concat(F.lit('<p>Document</p><figure><img src="sha256:'), F.sha2(as_image(F.col("content")), 256), F.lit('" alt="text"><figcaption>text as samples</figcaption></figure>'))
    pages = docs.select("doc_id", page.alias("html"))
    items = resolve(parse_pages(pages, "doc_id", "html"), "doc_id", payloads).select("doc_id", F.explode("items").alias("item")).filter("item.kind = 'media'")
    return items.select("doc_id", *[F.col("item.media").getField(c).alias(c) for c in payloads.columns if c != "digest"], "item.position", "item.caption")

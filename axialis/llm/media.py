"""Interleaved document sequences with media columns.

HTML is parsed into an ordered array of structs (pos, kind, text, digest, caption): runs of text and media
references in the order of the page, each reference with the caption of its own figure (or its alt text).
References carry a digest, the SHA-256 of the stored media, and are resolved by an equi-join on it; the join
moves one small row a distinct digest, payloads stay where they were stored, and a digest of most references is
spread by salts. `media_round_trip` stores every text as an image, makes of what it reads back a page with the
whole text in paragraphs and the image, captioned, in their middle, and takes its rows from the parsed sequences.

Media are 8-bit greyscale images of width 64 in binary PGM, a lossless form: a payload is padded with zero bytes
to a positive multiple of 64 and one byte is one sample. Features are computed from bytes read back.

Defined cases: a null text is an empty payload (64 zero bytes); equal texts share one digest and get equal
values; a reference whose digest is unknown keeps its place with null media columns; unclosed tags end with the
page; repeated rows each give a row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_chunks, salted_join, shared_folder, text_chunks

WIDTH = 64
SKIP = {"script", "style", "template", "noscript"}
BLOCK = {"p", "div", "figure", "section", "article", "li", "ul", "ol", "table", "tr", "td", "h1", "h2", "h3", "h4", "h5", "h6", "br", "blockquote", "pre", "header", "footer", "title", "body"}
MEDIA = {"img", "video", "audio", "source", "embed"}
ITEM = pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())])
SEQUENCE = "array<struct<pos:int,kind:string,text:string,digest:string,caption:string>>"


class Interleave(HTMLParser):
    """Collects text runs and media references in page order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.run: list[str] = []
        self.skip = 0
        self.caption: list[str] | None = None
        self.figure: int | None = None

    def flush(self) -> None:
        text = " ".join("".join(self.run).split())
        self.run = []
        if text:
            self.items.append({"kind": "text", "text": text, "digest": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        if tag in SKIP:
            self.skip += 1
        elif tag == "figcaption":
            self.flush()
            self.caption = []
        elif tag in MEDIA:
            own = dict(attrs)
            if src := own.get("src"):
                self.flush()
                digest = src.rpartition(":")[2] if src.startswith("media:") else None
                self.items.append({"kind": tag, "text": None if digest else src, "digest": digest, "caption": own.get("alt") or None})
        elif tag in BLOCK:
            self.flush()
            if tag == "figure":
                self.figure = len(self.items)

    def handle_endtag(self, tag):
        if tag in SKIP:
            self.skip = max(0, self.skip - 1)
        elif tag == "figcaption":
            self.close_caption()
        elif tag in BLOCK:
            self.flush()
            if tag == "figure":
                self.figure = None

    def handle_data(self, data):
        if not self.skip:
            (self.run if self.caption is None else self.caption).append(data)

    def close_caption(self) -> None:
        if self.caption is not None and (text := " ".join("".join(self.caption).split())):
            for item in self.items[self.figure or 0 :] if self.figure is not None else []:
                if item["kind"] != "text":
                    item["caption"] = text
        self.caption = None


def parse(page: str) -> list[dict]:
    parser = Interleave()
    parser.feed(page)
    parser.close()
    parser.close_caption()
    parser.flush()
    return [{"pos": i, **x} for i, x in enumerate(parser.items)]


def interleaved(pages: DataFrame, key: str = "page_id", column: str = "html") -> DataFrame:
    """key and `sequence` of each page."""

    def run(batches):
        for batch in text_chunks(batches, column):
            got = [parse(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.list_(ITEM))], [key, "sequence"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, column).mapInArrow(run, f"{key} {kind}, sequence {SEQUENCE}")


def pad(data: bytes) -> bytes:
    return data + bytes(-len(data) % WIDTH or (0 if data else WIDTH))


def to_pgm(payload: bytes) -> bytes:
    return b"P5\n%d %d\n255\n" % (WIDTH, len(payload) // WIDTH) + payload


def from_pgm(data: bytes) -> bytes:
    kind, size, most, samples = data.split(b"\n", 3)
    width, height = map(int, size.split())
    if kind != b"P5" or most != b"255" or len(samples) != width * height:
        raise ValueError("not a greyscale image as written here")
    return samples


def described(samples: bytes) -> str:
    """Size, mean, deviation and a 64-bit average hash of an 8 x 8 reduction."""
    x = np.frombuffer(samples, np.uint8)
    rows = x.reshape(-1, WIDTH)
    cuts = np.arange(9) * len(rows) // 8
    bands = np.stack([rows[a : max(b, a + 1)].sum(0, dtype=np.int64) * 1.0 / max(1, b - a) for a, b in zip(np.minimum(cuts, len(rows) - 1), cuts[1:], strict=False)])
    small = bands.reshape(8, 8, 8).sum(2)
    bits = np.packbits((small > small.mean()).reshape(-1)).tobytes().hex()
    return f"{WIDTH}x{len(rows)};mean={x.mean():.4f};std={x.std():.4f};ahash={bits}"


def store_texts(docs: DataFrame, path: str) -> DataFrame:
    """Stores each text as an image; returns the table, read again: doc_id, n_bytes, digest, media."""

    def run(batches):
        for batch in text_chunks(batches):
            data = [text.encode() for text in batch.column(1).to_pylist()]
            media = [to_pgm(pad(x)) for x in data]
            digests = [hashlib.sha256(x).hexdigest() for x in media]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in data], pa.int64()), pa.array(digests), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "digest", "media"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, digest string, media binary"
    docs.select("doc_id", "text").mapInArrow(run, schema).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(schema).parquet(path)


def page_of(text: str, digest: str, n_bytes: int) -> str:
    """A page of the text's lines as paragraphs, with the image in their middle."""
    lines = [f"<p>{html.escape(x)}</p>" for x in text.split("\n")]
    figure = f"<figure><img src='media:{digest}'><figcaption>{n_bytes} bytes</figcaption></figure>"
    return "<article>" + "".join([*lines[: len(lines) // 2], figure, *lines[len(lines) // 2 :]]) + "</article>"


def pages_of(table: DataFrame) -> DataFrame:
    """page (doc_id, n_bytes) and html of each stored text, from the stored bytes."""

    def run(batches):
        for batch in byte_chunks(batches, (3,)):
            pages = []
            for n, digest, image in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                pages.append(page_of(from_pgm(image)[:n].decode(), digest, n))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pages)], ["doc_id", "n_bytes", "html"])

    made = table.mapInArrow(run, f"doc_id {table.schema['doc_id'].dataType.simpleString()}, n_bytes long, html string")
    return made.select(F.struct("doc_id", "n_bytes").alias("page"), "html")


def media_features(media: DataFrame) -> DataFrame:
    """One row a distinct digest: sizes, checksums and feature of the stored bytes."""

    def run(batches):
        for batch in byte_chunks(batches, (1,)):
            rows = []
            for digest, image in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                samples = from_pgm(image)
                rows.append((digest, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-WIDTH:]), len(image), hashlib.sha256(image).hexdigest(), described(samples)))
            names = ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    schema = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    found = media.select("digest", "media").mapInArrow(run, schema)
    first = [F.min(c).alias(c) for c in found.columns if c != "digest"]
    return found.groupBy("digest").agg(*first)


def resolved(sequences: DataFrame, media: DataFrame, key: str) -> DataFrame:
    """One row a sequence item: key, pos, kind, text, digest, caption and the media columns, null where unknown."""
    items = sequences.select(key, F.explode("sequence").alias("i")).select(key, "i.*", F.coalesce("i.digest", F.lit("")).alias("__ref"))
    return salted_join(items, media.withColumnRenamed("digest", "__ref"), "__ref", key, "left").drop("__ref")


def media_round_trip(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, pos, n_items,
    caption and words_sha256 (of the text runs of the page, joined by a space) of each row."""
    table = store_texts(docs, shared_folder(docs.sparkSession, "media"))
    sequences = interleaved(pages_of(table), "page")
    runs = F.array_join(F.transform(F.filter("sequence", lambda i: i["kind"] == "text"), lambda i: i["text"]), " ")
    page = F.struct("page.doc_id", "page.n_bytes", F.size("sequence").alias("n_items"), F.sha2(runs, 256).alias("words_sha256"))
    refs = resolved(sequences.select(page.alias("page"), "sequence"), media_features(table), "page").where(F.col("kind") == "img")
    return refs.select("page.doc_id", "page.n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pos", "page.n_items", "caption", "page.words_sha256")

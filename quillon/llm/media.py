"""Interleaved document sequences with media columns.

HTML is parsed into an ordered array of structs, text runs and media references alternating as they stand in the
page; a figure's caption stays with the figure's references, whether it stands before or after them. References name
payloads by digest. A join on the digest resolves them; the element's position and caption travel with it, so the
sequence comes back aligned.

Payloads are stored as 8-bit greyscale PNG images, 192 samples a row, and read back from the stored bytes.
Null html is a sequence without elements; a reference without payload resolves to null. Equal payloads are one
payload, whichever documents hold them. Every row is a page of its own with a number, so rows that repeat an id, or have
none, come back each for itself, and nothing depends on ties. Other columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import discard, materialize, short

WIDTH = 192
ELEMENT = "array<struct<pos:int,kind:string,text:string,digest:string,caption:string>>"
SIGNATURE = b"\x89PNG\r\n\x1a\n"


class _Sequence(HTMLParser):
    """Collects elements; script and style are no text.

    A figcaption belongs to the media of the figure it stands in, the innermost one; their alt texts give way to it.
    Outside a figure it is text. A caption that isn't closed ends with its figure or the page. The sources of a video,
    audio or picture are ways to get that one medium: the first one with a digest names it.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.elements: list[list] = []
        self.run: list[str] = []
        self.caption: list[str] | None = None
        self.figures: list[dict] = []  # the open figures: caption and the places of their media
        self.medium: tuple[str, int] | None = None  # the open video, audio or picture and its place
        self.skipped = 0

    def flush(self) -> None:
        text = " ".join("".join(self.run).split())
        self.run = []
        if text:
            self.elements.append(["text", text, None, None])

    def end_caption(self) -> None:
        if self.caption is not None:
            text, self.caption = " ".join("".join(self.caption).split()), None
            self.figures[-1]["caption"] = text

    def end_figure(self) -> None:
        self.end_caption()
        figure = self.figures.pop()
        for at in figure["media"] if figure["caption"] is not None else ():
            self.elements[at][3] = figure["caption"]

    def handle_starttag(self, tag, attrs):
        named = dict(attrs)
        digest = next((v.removeprefix("sha256:") for v in (named.get("src"), named.get("data-digest")) if v and v.startswith("sha256:")), None)
        if tag in ("script", "style"):
            self.skipped += 1
        elif tag == "figure":
            self.flush()
            self.end_caption()
            self.figures.append({"caption": None, "media": []})
        elif tag == "figcaption" and self.figures:
            self.flush()
            self.caption = []
        elif self.medium and (tag == "source" or (tag == "img" and self.medium[0] == "picture")):
            element = self.elements[self.medium[1]]
            element[2], element[3] = element[2] or digest, element[3] or named.get("alt")
        elif tag in ("img", "video", "audio", "picture"):
            self.flush()
            if self.figures:
                self.figures[-1]["media"].append(len(self.elements))
            if tag != "img":
                self.medium = (tag, len(self.elements))
            self.elements.append(["media", None, digest, named.get("alt")])
        elif tag in ("p", "div", "br", "h1", "h2", "h3", "h4", "li", "tr", "section", "article", "figcaption"):
            self.run.append("\n")

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skipped = max(0, self.skipped - 1)
        elif self.medium and tag == self.medium[0]:
            self.medium = None
        elif tag == "figcaption":
            self.end_caption()
        elif tag == "figure" and self.figures:
            self.flush()
            self.end_figure()

    def handle_data(self, data):
        if not self.skipped:
            (self.run if self.caption is None else self.caption).append(data)

    def finish(self) -> None:
        self.close()
        self.flush()
        while self.figures:
            self.end_figure()


def parse(html: str | None) -> list[dict]:
    """The ordered elements of a page."""
    p = _Sequence()
    p.feed(html or "")
    p.finish()
    return [{"pos": i, "kind": k, "text": t, "digest": d, "caption": c} for i, (k, t, d, c) in enumerate(p.elements)]


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(samples: bytes) -> bytes:
    """A greyscale image of 8-bit samples; their number is a positive multiple of the width."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    filtered = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each row starts with filter 0, none
    filtered[:, 1:] = rows
    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(filtered.tobytes(), 1)) + _chunk(b"IEND", b"")


def from_png(data: bytes) -> np.ndarray:
    """Samples of an image that `to_png` wrote, as rows; anything else raises."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG")
    at, packed, size = 8, [], None
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("broken chunk")
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + n
    width, height, *rest = size
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
    if rest != [8, 0, 0, 0, 0] or rows[:, 0].any():
        raise ValueError("not an unfiltered 8-bit greyscale image")
    return rows[:, 1:]


def padded(text: str | None) -> tuple[bytes, int]:
    """UTF-8 with spaces up to a positive multiple of the width, and the length before."""
    raw = (text or "").encode()
    return raw.ljust(max(1, -(-len(raw) // WIDTH)) * WIDTH, b" "), len(raw)


def features(samples: np.ndarray) -> str:
    """Sample count, sum, sum of squares, differing neighbours in a row, and an 8-bin histogram."""
    x = samples.astype(np.int64)
    bins = np.bincount(samples.ravel() >> 5, minlength=8)
    return f"n={x.size};sum={x.sum()};sq={(x * x).sum()};edges={np.count_nonzero(np.diff(x, axis=1))};hist={','.join(map(str, bins))}"


def _page(text: str, digest: str, strip: str, n: int) -> str:
    """A page that shows a text: its first words, a figure of the whole, and a strip of its size between its last words.

    The caption stands before or after the image by turns of the length.
    """
    words = text[:80].split()[:4]
    last = text[-60:].split()[-2:]
    image, caption = f'<img src="sha256:{digest}" alt="text">', f"<figcaption>{n} bytes</figcaption>"
    figure = caption + image if n % 2 else image + caption
    return f'<article><h1>{escape(" ".join(words))}</h1><figure>{figure}</figure><p>{escape(" ".join(last[:1]))} <img src="sha256:{strip}" alt="size"> {escape(" ".join(last[1:]))}</p></article>'


def compose(docs: DataFrame) -> DataFrame:
    """A page for each document, with two references: page (its number), doc_id, html, stored array<struct<digest,media>>.

    The media are the padded text and a strip with the bits of its length, which most of the corpus shares a few of. In
    one batch, equal payloads are stored once.
    """

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("digest", pa.string()), ("media", pa.binary())]))]
        for b in short(batches):
            htmls, stored, seen = [], [], set()
            for text in b.column(1).to_pylist():
                payload, n = padded(text)
                new, digests = [], []
                for part in (payload, padded(f"{n.bit_length()} bits")[0]):
                    digests.append(hashlib.sha256(part).hexdigest())
                    if digests[-1] not in seen:
                        new.append({"digest": digests[-1], "media": to_png(part)})
                        seen.add(digests[-1])
                htmls.append(_page(text or "", *digests, n))
                stored.append(new)
            pages = np.arange(number, number + b.num_rows)
            number += b.num_rows
            columns = [pages, b.column(0), htmls, stored]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["page", "doc_id", "html", "stored"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "page bigint, doc_id bigint, html string, stored array<struct<digest:string,media:binary>>")


def sequences(pages: DataFrame, *, id_column: str = "doc_id", html_column: str = "html") -> DataFrame:
    """id and elements of every page."""
    kind = pages.schema[id_column].dataType.simpleString()
    element = pa.struct([("pos", pa.int32()), *((n, pa.string()) for n in ("kind", "text", "digest", "caption"))])

    def run(batches):
        for b in short(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([parse(h) for h in b.column(1).to_pylist()], pa.list_(element))], names=[id_column, "elements"])

    return pages.select(f"`{id_column}`", f"`{html_column}`").mapInArrow(run, f"`{id_column}` {kind}, elements {ELEMENT}")


def read_media(stored: DataFrame) -> DataFrame:
    """What the stored images hold, by the digest they are stored under: one row per digest."""

    def run(batches):
        for b in short(batches):
            out = []
            for digest, media in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                samples = from_png(media)
                payload = samples.tobytes()
                out.append({"digest": digest, "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-16:]), "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "feature": features(samples)})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("digest", pa.string()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]))

    schema = "digest string, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return stored.where(F.col("media").isNotNull()).select("digest", "media").mapInArrow(run, schema).dropDuplicates(["digest"])


def resolved(elements: DataFrame, media: DataFrame) -> DataFrame:
    """Every media element of `sequences` with its payload's columns: the id, pos, caption and the columns of media.

    media has one row per digest. A digest that a third of all references share is one key on the one side only, so
    the join splits its rows among tasks.
    """
    names = [c for c in elements.columns if c != "elements"]
    refs = elements.select(*names, F.explode("elements").alias("e")).where(F.col("e.kind") == "media")
    flat = refs.select(*names, F.col("e.pos").alias("pos"), F.col("e.caption").alias("caption"), F.col("e.digest").alias("ref"))
    return flat.join(media, flat["ref"] == media["digest"], "left").drop("ref")


def interleave(elements: DataFrame, media: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Sequences with the resolved payload row in each media element, in page order. Ids must be unique and not null."""
    parts = elements.select(F.col(id_column), F.explode_outer("elements").alias("e"))
    flat = lambda found: F.when(F.col("e").isNotNull(), F.struct(F.col("e.pos").alias("pos"), *[F.col(f"e.{c}").alias(c) for c in ("kind", "text", "digest", "caption")], found.alias("media"))).alias("e")
    none = F.lit(None).cast(T.StructType(media.schema.fields))
    # elements without a digest have nothing to meet, and would all meet in one task
    text = parts.where("e.digest is null").select(id_column, flat(none))
    refs = parts.where("e.digest is not null").join(media, F.col("e.digest") == media["digest"], "left")
    found = F.when(F.col("digest").isNotNull(), F.struct(*[F.col(c) for c in media.columns])).otherwise(none)
    both = text.union(refs.select(id_column, flat(found)))
    return both.groupBy(id_column).agg(F.array_sort(F.collect_list("e"), lambda a, b: a["pos"] - b["pos"]).alias("elements")).select(id_column, "elements")


def store_and_read(docs: DataFrame) -> DataFrame:
    """Compose, store, read back, and resolve each page's references; the first one is the whole text's."""
    spark = docs.sparkSession
    stored, path = materialize(spark, compose(docs), "media")
    media, media_at = materialize(spark, read_media(stored.select(F.inline("stored"))), "media-read")
    refs, refs_at = materialize(spark, sequences(stored.select("page", "html"), id_column="page"), "sequences")
    pages, pages_at = materialize(spark, stored.select("page", "doc_id"), "media-pages")
    discard(spark, path)
    whole = interleave(refs, media, "page")
    figure = F.filter("elements", lambda e: e["kind"] == "media")
    shown = whole.select("page", F.get(figure, F.lit(0)).alias("e"), F.get(figure, F.lit(1)).alias("last"))
    flat = shown.select("page", F.regexp_extract("e.caption", "^(\\d+) bytes$", 1).cast("bigint").alias("n_bytes"), *[F.col(f"e.media.{c}").alias(c) for c in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")], F.col("e.pos").alias("pos"), F.col("last.media.payload_sha256").alias("strip_sha256"))
    out, _ = materialize(spark, pages.join(flat, "page").drop("page"), "media-rows")
    discard(spark, media_at, refs_at, pages_at)
    return out

"""WARC archives: writing captures, reading records back, and assembling transactions.

A capture is three records. The response (or revisit) carries the payload; a request and a metadata record name it in
WARC-Concurrent-To. Archives are plain WARC 1.1 streams in gzip, written by Spark's text sink (records end with an
empty line, which is the sink's line separator) and read back by Content-Length, so payloads may hold anything.

Payloads of at least `least` bytes that occur more than once are stored once, with the smallest page_id; the others
become revisit records that refer to it. Null html counts as empty, null urls as empty. Rows with a null page_id are
responses. Every row is a capture: of rows repeated whole (same page_id, url and html) each has its own number in its
record identifier. Rows that share the smallest page_id of a payload are all responses. An empty table gives an archive
without records. Other columns are ignored.

Files are bounded by bytes: payloads up to SMALL bytes go PER_FILE to a file, larger ones as many as FILE bytes hold.
They are read as streams, so a reader holds the compressed file and one record.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import discard, materialize, new_path, partitions, short

END = "\r\n\r\n"
#: Bytes of a file's payloads at most (but for a single larger one), of a small payload, small payloads of a file.
FILE, SMALL, PER_FILE = 1 << 28, 1 << 16, 1 << 12
#: Rows repeated whole that one task writes.
COPIES = 1000
RECORD = (
    "record_id string, type string, concurrent_to string, refers_to string, target_uri string, date string, "
    "declared_digest string, payload_bytes bigint, payload_digest string, fields map<string,string>"
)


def _urn(*parts: Column) -> Column:
    """A record identifier in UUID form that depends on the parts alone."""
    h = F.md5(F.concat_ws("\0", *[F.coalesce(p.cast("string"), F.lit("\1")) for p in parts]))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _record(kind: Column | str, record_id: Column, headers: list[tuple[str, Column]], content_type: str, block: Column) -> Column:
    parts: list[Column] = [F.lit("WARC/1.1\r\nWARC-Type: "), F.lit(kind) if isinstance(kind, str) else kind, F.lit("\r\nWARC-Record-ID: "), record_id]
    for name, value in headers:
        parts.append(F.when(value.isNull(), F.lit("")).otherwise(F.concat(F.lit(f"\r\n{name}: "), value)))
    parts += [F.lit(f"\r\nContent-Type: {content_type}\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(END), block]
    return F.concat(*parts)


def _pages(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest, and own, the identifier of the capture that equal rows share."""
    html = F.coalesce("html", F.lit(""))
    page = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.regexp_replace(F.coalesce("url", F.lit("")), "[\\r\\n]", "%0A").alias("url"),
        html.alias("html"),
        F.sha2(html.cast("binary"), 256).alias("digest"),
    )
    return page.withColumn("own", _urn(F.lit("response"), F.col("page_id"), F.col("url"), F.col("digest")))


def _numbered(full: DataFrame, repeated: DataFrame) -> DataFrame:
    """The rows with copy, the number of each among rows repeated whole. repeated: own and n of these.

    Repeated rows are counted and made again from one of them, a bounded number in each task.
    """
    once = full.join(repeated, "own", "left_anti").withColumn("copy", F.lit(0).cast("bigint"))
    one_each = full.join(repeated, "own").groupBy("own", "n").agg(*[F.first(c).alias(c) for c in full.columns if c != "own"])
    low = F.col("chunk") * COPIES
    many = (
        one_each.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / COPIES))))
        .repartition(partitions(full.sparkSession), "own", "chunk")
        .withColumn("copy", F.explode(F.sequence(low, F.least(low + COPIES, F.col("n")) - 1)))
    )
    return once.unionByName(many.select(*once.columns))


def write_archives(pages: DataFrame, *, least: int = 100, date: str = "2024-01-01T00:00:00Z") -> str:
    """Write request, response or revisit, and metadata of every page; returns the archive's folder.

    The payload is shuffled once, by page; which pages revisit which is found on digests alone.
    """
    spark = pages.sparkSession
    page = _pages(pages)
    size = F.octet_length("html")
    kept, kept_at = materialize(spark, page.groupBy("own", "page_id", "url", "digest", size.alias("size")).agg(F.count("*").alias("n")), "warc-rows")
    repeated, most = kept.where("n > 1").select("own", "n"), kept.agg(F.max("size")).first()[0] or 0
    light = kept.where((F.col("size") >= least) & F.col("page_id").isNotNull())
    first = light.groupBy("digest").agg(F.min(F.struct("page_id", "own")).alias("first"), F.max("page_id").alias("last")).where(F.col("first.page_id") < F.col("last"))
    again = light.join(first, "digest").where(F.col("page_id") > F.col("first.page_id")).select("own", F.col("first.own").alias("first"))
    some = not repeated.isEmpty()
    path = new_path(spark, "warc")
    classes = [(page.where(size <= SMALL), PER_FILE, "small")] if most <= SMALL else [(page.where(size <= SMALL), PER_FILE, "small"), (page.where(size > SMALL), max(1, FILE // most), "large")]
    for rows, per_file, name in classes:
        full = rows.join(again, "own", "left")
        full = _numbered(full, repeated) if some else full.withColumn("copy", F.lit(0).cast("bigint"))
        lines = full.select(F.concat_ws(END, *_records(full, date)).alias("value"))
        lines.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(f"{path}/{name}")
    discard(spark, kept_at)
    return path


def _records(full: DataFrame, date: str) -> list[Column]:
    own = F.when(F.col("copy") == 0, F.col("own")).otherwise(_urn(F.col("own"), F.col("copy")))
    length, revisit = F.octet_length("html").cast("string"), F.col("first").isNotNull()
    uri, when = ("WARC-Target-URI", F.col("url")), ("WARC-Date", F.lit(date))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), length, F.lit(END))
    beside = ("WARC-Concurrent-To", own)
    profile = F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    return [
        _record("request", _urn(F.lit("request"), own), [when, uri, beside], "application/http; msgtype=request", F.concat(F.lit("GET / HTTP/1.1\r\nAccept: text/html\r\nReferer: "), F.col("url"), F.lit(END))),
        _record(
            F.when(revisit, "revisit").otherwise("response"), own,
            [when, uri, ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))), ("WARC-Refers-To", F.col("first")), ("WARC-Profile", profile)],
            "application/http; msgtype=response", F.when(revisit, head).otherwise(F.concat(head, F.col("html"))),
        ),
        _record("metadata", _urn(F.lit("metadata"), own), [when, uri, beside], "application/warc-fields", F.concat(F.lit("page_id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("\r\npayload_bytes: "), length)),
    ]


class _Stream:
    """The bytes of a file, decompressed as they are asked for; gzip members follow each other."""

    def __init__(self, data: bytes):
        self.rest, self.zip = memoryview(data), None
        if data[:2] == b"\x1f\x8b":
            self.zip = zlib.decompressobj(31)
        self.held = bytearray()

    def more(self) -> bool:
        """Whether some more bytes are held now."""
        if not len(self.rest):
            return False
        if self.zip is None:
            self.held += self.rest[: 1 << 20]
            self.rest = self.rest[1 << 20 :]
            return True
        self.held += self.zip.decompress(self.rest, 1 << 20)
        if self.zip.eof:
            self.rest, self.zip = memoryview(self.zip.unused_data), zlib.decompressobj(31)
        else:
            self.rest = memoryview(self.zip.unconsumed_tail)
            if not len(self.rest):
                self.held += self.zip.flush()
        return True

    def until(self, end: bytes) -> bytes | None:
        """What stands before the next end, which is passed over; None if there is none."""
        at = 0
        while (found := self.held.find(end, at)) < 0:
            at = max(0, len(self.held) - len(end) + 1)
            if not self.more():
                return None
        out = bytes(self.held[:found])
        del self.held[: found + len(end)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.held) < n and self.more():
            pass
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of a WARC file, compressed or not."""
    stream = _Stream(data)
    while stream.held or stream.more():
        if not stream.held:
            continue
        lines = stream.until(b"\r\n\r\n")
        if lines is None or lines[:5] != b"WARC/":
            raise ValueError("no WARC record where one should begin")
        headers = {}
        for line in lines.decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            headers[name.strip().lower()] = value.strip()
        size = int(headers["content-length"])
        block = stream.take(size)
        if len(block) < size or stream.take(4) != b"\r\n\r\n":
            raise ValueError("a record does not end where it should")
        yield headers, block


def read_records(spark, path: str, *, with_payload: bool = False) -> DataFrame:
    """One row per record of all archives under a path (RECORD; with_payload adds payload binary).

    The payload of http records is what follows the http headers. Its length and digest are taken from the bytes
    read; a revisit's are null. Warc-fields blocks become the map `fields`.
    """
    kinds = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("concurrent_to", pa.string()), ("refers_to", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("declared_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("fields", pa.map_(pa.string(), pa.string()))])
    if with_payload:
        kinds = kinds.append(pa.field("payload", pa.binary()))
    names = ("warc-record-id", "warc-type", "warc-concurrent-to", "warc-refers-to", "warc-target-uri", "warc-date")

    def rows(batches):
        for b in short(batches, 1):
            out, held = [[] for _ in kinds], 0
            for h, body in parse(b.column(0)[0].as_py()):
                kind, fields, payload = h.get("warc-type"), None, None
                if h.get("content-type", "").startswith("application/http"):
                    if kind == "response":
                        payload = body.partition(b"\r\n\r\n")[2]
                elif h.get("content-type") == "application/warc-fields":
                    fields = [tuple(x.strip() for x in line.partition(":")[::2]) for line in body.decode().split("\r\n") if line]
                elif kind in ("resource", "conversion"):
                    payload = body
                known = (None, None) if payload is None else (len(payload), hashlib.sha256(payload).hexdigest())
                values = (*map(h.get, names), h.get("warc-payload-digest", "").removeprefix("sha256:") or None, *known, fields, payload)
                for column, v in zip(out, values, strict=False):
                    column.append(v)
                held += len(payload) if with_payload and payload else 0
                if held > 1 << 24 or len(out[0]) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, kinds, strict=True)], schema=kinds)
                    out, held = [[] for _ in kinds], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, kinds, strict=True)], schema=kinds)

    schema = RECORD + (", payload binary" if with_payload else "")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.select("content").mapInArrow(rows, schema)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, main struct, requests and metadata arrays.

    Requests and metadata find their capture by WARC-Concurrent-To; those that name no record that exists come back
    as captures whose main record is null. Records of one capture are few, so the arrays are small.
    """
    columns = [c for c in records.columns if c != "concurrent_to"]
    row = F.struct(*columns)
    is_main = F.col("type").isin("response", "revisit", "resource", "conversion")
    comparable = F.struct("record_id", F.struct(*[c for c in columns if c != "fields"]).alias("main"))
    beside = F.coalesce("concurrent_to", "record_id")
    return (
        records.groupBy(F.when(is_main, F.col("record_id")).otherwise(beside).alias("capture_id"))
        .agg(
            F.max(F.when(is_main, comparable))["main"].alias("main"),
            F.collect_list(F.when(F.col("type") == "request", F.col("record_id"))).alias("requests"),
            F.collect_list(F.when(F.col("type") == "metadata", row)).alias("metadata"),
        )
        .withColumn("requests", F.array_distinct("requests"))
    )


def resolve(captures: DataFrame) -> DataFrame:
    """Adds payload_bytes, payload_digest and referred (the metadata of the response that a revisit refers to)."""
    page = F.try_element_at("metadata", F.lit(1))["fields"]
    flat = captures.withColumn("page", page)
    stored = flat.where(F.col("main.type") != "revisit").withColumns({"payload_bytes": F.col("main.payload_bytes"), "payload_digest": F.col("main.payload_digest"), "referred": F.lit(None).cast("map<string,string>")})
    source = flat.where(F.col("main.type") == "response").select(F.col("capture_id").alias("source"), F.col("main.payload_bytes").alias("payload_bytes"), F.col("main.payload_digest").alias("payload_digest"), F.col("page").alias("referred"))
    revisits = flat.where(F.col("main.type") == "revisit").join(source, F.col("main.refers_to") == F.col("source"), "left").drop("source")
    return stored.unionByName(revisits)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages as WARC, read the archives back, assemble the captures: a row per page."""
    path = write_archives(pages)
    found = resolve(assemble(read_records(pages.sparkSession, path)))
    return found.select(
        F.col("page")["page_id"].try_cast("bigint").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        F.col("main.type").alias("record_type"),
        F.col("referred")["page_id"].try_cast("bigint").alias("refers_to"),
        F.col("main.target_uri").alias("url"),
        (F.col("main.declared_digest") == F.col("payload_digest")).alias("digest_holds"),
    )




"""Images and sequences round trip; references resolve with position and caption."""

import hashlib
import zlib

from quillon.llm.media import compose, from_png, interleave, padded, parse, sequences, store_and_read, to_png

TEXTS = ["", None, "a", "é" * 96, "x" * 192, "x" * 193, "line\n" * 5000, "same", "same", "\0\0", "tail   ", "<b>&amp;</b>"]


def test_png_is_lossless():
    for t in TEXTS:
        payload, n = padded(t)
        assert len(payload) % 192 == 0 and len(payload) >= 192 and payload[:n] == (t or "").encode() and not payload[n:].strip(b" ")
        assert from_png(to_png(payload)).tobytes() == payload


def test_parse_keeps_order_and_captions():
    html = "<p>one &amp; two<script>var x;</script></p><figure><img src='sha256:aa'><figcaption>cap <b>A</b></figcaption></figure>mid<img alt=plain src='http://x'><p>end"
    assert [(e["kind"], e["text"], e["digest"], e["caption"]) for e in parse(html)] == [
        ("text", "one & two", None, None), ("media", None, "aa", "cap A"), ("text", "mid", None, None), ("media", None, None, "plain"), ("text", "end", None, None),
    ]
    assert parse(None) == parse("") == [] and parse("<img") is not None


def test_captions_stay_with_their_figures():
    def media(html):
        return [(e["digest"], e["caption"]) for e in parse(html) if e["kind"] == "media"]

    assert media("<figure><figcaption>before</figcaption><img src='sha256:a' alt=x></figure>") == [("a", "before")]
    assert media("<img src='sha256:a' alt=x><figcaption>alone</figcaption><img src='sha256:b'>") == [("a", "x"), ("b", None)]
    assert media("<figure><img src='sha256:a'><figure><img src='sha256:b'><figcaption>in</figcaption></figure><figcaption>out</figcaption></figure>") == [("a", "out"), ("b", "in")]
    assert media("<figure><img src='sha256:a'><figcaption>open <b>end") == [("a", "open end")]
    assert media("<figure><img src='sha256:a'><img src='sha256:b'><figcaption>both</figcaption></figure><img src='sha256:c' alt=own>") == [("a", "both"), ("b", "both"), ("c", "own")]
    assert media("<video><source src='sha256:v'><source src='sha256:w'></video><picture><source><img src='sha256:p' alt=q></picture>") == [("v", None), ("p", "q")]
    assert [e["text"] for e in parse("<img src='sha256:a'><figcaption>alone</figcaption>") if e["kind"] == "text"] == ["alone"]
    assert [(e["kind"], e["text"]) for e in parse("one<figure>two<img src='sha256:a'>three<figcaption>cap</figcaption>four</figure>five")] == [("text", "one"), ("text", "two"), ("media", None), ("text", "three"), ("text", "four"), ("text", "five")]


def test_images_by_an_independent_decoder(spark):
    jvm = spark._jvm
    for t in TEXTS:
        payload, _ = padded(t)
        image = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(bytearray(to_png(payload))))
        assert (image.getWidth(), image.getHeight()) == (192, len(payload) // 192)
        data = image.getRaster().getDataBuffer()
        at = range(0, len(payload), max(1, len(payload) // 400))
        assert data.getSize() == len(payload) and [data.getElem(i) for i in at] == [payload[i] for i in at]


def test_pages_have_several_references(spark):
    rows = [(1, "start of one " * 40 + "the same end " * 30), (1, "start of one " * 40 + "the same end " * 30), (None, "short"), (None, None), (2, "start of two " * 40 + "the same end " * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    pages = compose(docs)
    kinds = [[e["kind"] for e in parse(r.html)] for r in pages.collect()]
    assert kinds[0] == ["text", "media", "text", "media", "text"] and kinds[3] == ["media", "media"]
    captions = [[e["caption"] for e in parse(r.html) if e["kind"] == "media"] for r in pages.collect()]
    assert captions == [[f"{len((t or '').encode())} bytes", "size"] for _, t in rows]
    got = store_and_read(docs).collect()
    assert sorted((r.doc_id or 0, r.n_bytes) for r in got) == sorted((i or 0, len((t or "").encode())) for i, t in rows)
    for r in got:
        assert r.strip_sha256 == hashlib.sha256(f"{r.n_bytes.bit_length()} bits".ljust(192).encode()).hexdigest()


def test_query_rows(spark):
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(TEXTS)], "doc_id long, text string, digest string, pos int")
    got = {r.doc_id: r for r in store_and_read(docs).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        payload, n = padded(t)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (n, len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-16:]) and r.media_sha256 == hashlib.sha256(to_png(payload)).hexdigest()
    assert got[7].feature == got[8].feature and store_and_read(docs.limit(0)).count() == 0


def test_interleave_aligns(spark):
    pages = spark.createDataFrame([(1, "a<img src='sha256:d1' alt=c1>b<img src='sha256:none'><img src='sha256:d1'>"), (2, None), (None, "<img src='sha256:d2'>")], "doc_id long, html string")
    media = spark.createDataFrame([("d1", 10), ("d2", 20)], "digest string, size int")
    got = {r.doc_id: r.elements for r in interleave(sequences(pages), media).collect()}
    assert [(e.pos, e.kind, e.caption, e.media and e.media.size) for e in got[1]] == [(0, "text", None, None), (1, "media", "c1", 10), (2, "text", None, None), (3, "media", None, None), (4, "media", None, 10)]
    assert got[2] == [] and got[None][0].media.size == 20

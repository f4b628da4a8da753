"""Round trips through archives on disk; assembly; the record format."""

import gzip
import hashlib
from pathlib import Path

import pytest

from quillon.llm.warc import assemble, parse, read_records, round_trip, write_archives

SCHEMA = "page_id long, url string, html string, record_type string, digest int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def expected(rows):
    first = {}
    for i, _, html in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        if len((html or "").encode()) >= 100:
            first.setdefault(html, i)
    out = set()
    for i, _, html in rows:
        raw = (html or "").encode()
        refers = first.get(html) if i is not None else None
        again = refers is not None and refers != i
        out.add((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", refers if again else None))
    return out


def test_round_trip(spark):
    long = "<p>é payload</p>" * 10
    rows = [
        (5, "http://a/5", long), (3, "http://a/3", long), (9, "http://b/9", long), (1, "http://a/1", "short"), (2, "u", "short"),
        (4, None, None), (6, "http://c\r\nX: y", "WARC/1.1\r\n\r\n\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" * 4), (7, "", ""), (None, "n", long), (8, "tail", "x" * 99 + "\n"), (10, "tail2", "x" * 99 + "\n"),
    ]
    got = round_trip(frame(spark, rows)).collect()
    assert len(got) == len(rows) and all(r.digest_holds is not False for r in got)
    assert {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got} == expected(rows)
    assert round_trip(frame(spark, [])).count() == 0


def test_every_row_comes_back(spark, monkeypatch):
    """Rows repeated whole, and rows without page_id, are captures of their own."""
    long = "<p>é payload</p>" * 10
    rows = [(1, "u", long), (1, "u", long), (None, "u", "x"), (None, "u", "x"), (2, "v", long)]
    got = round_trip(frame(spark, rows)).collect()
    assert sorted((r.page_id or 0, r.record_type, r.refers_to) for r in got) == [(0, "response", None)] * 2 + [(1, "response", None)] * 2 + [(2, "revisit", 1)]
    monkeypatch.setattr("quillon.llm.warc.COPIES", 7)
    many = [(1, "u", long)] * 40 + [(2, "u", long)] * 23 + [(None, None, None)] * 15 + [(3, "w", "once")]
    path = write_archives(frame(spark, many))
    records = read_records(spark, path)
    assert records.select("record_id").distinct().count() == records.count() == 3 * len(many)
    got = round_trip(frame(spark, many)).groupBy("page_id", "record_type", "refers_to").count().collect()
    assert {(r.page_id, r.record_type, r.refers_to): r["count"] for r in got} == {(1, "response", None): 40, (2, "revisit", 1): 23, (None, "response", None): 15, (3, "response", None): 1}


def test_very_long_payloads(spark, monkeypatch):
    monkeypatch.setattr("quillon.llm.warc.FILE", 5_000_000)
    rows = [(i, f"http://a/{i}", f"{i} " * 700_000) for i in range(5)] + [(9, "s", "small")]
    path = write_archives(frame(spark, rows))
    files = list(Path(path.removeprefix("file:")).rglob("*.gz"))
    assert max(sum(h["warc-type"] == "response" for h, _ in parse(f.read_bytes())) for f in files if f.parent.name == "large") <= 3
    got = {r.page_id: r for r in round_trip(frame(spark, rows)).collect()}
    for i, _, html in rows:
        assert got[i].payload_bytes == len(html) and got[i].payload_digest == hashlib.sha256(html.encode()).hexdigest()


def test_parse_of_members_and_broken_files():
    one = b"WARC/1.1\r\nWARC-Type: metadata\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    for data in (one * 3, gzip.compress(one * 3), gzip.compress(one) * 3):
        assert [b for _, b in parse(data)] == [b"abc"] * 3
    for data in (b"HTTP/1.1\r\n\r\n", one[:-3], gzip.compress(one[:-9])):
        with pytest.raises(ValueError):
            list(parse(data))
    assert list(parse(b"")) == []


def test_archives_are_warc(spark):
    path = write_archives(frame(spark, [(1, "http://a/1", "héllo"), (2, "http://a/2", "z" * 200)]))
    data = b"".join(gzip.decompress(p.read_bytes()) for p in Path(path.removeprefix("file:")).rglob("*.gz"))
    records = list(parse(data))
    assert sorted(h["warc-type"] for h, _ in records) == ["metadata"] * 2 + ["request"] * 2 + ["response"] * 2
    ids = {h["warc-record-id"] for h, _ in records}
    assert len(ids) == 6 and all(h["warc-concurrent-to"] in ids for h, _ in records if "warc-concurrent-to" in h)
    bodies = {h["warc-target-uri"]: bytes(b).partition(b"\r\n\r\n")[2] for h, b in records if h["warc-type"] == "response"}
    assert bodies == {"http://a/1": "héllo".encode(), "http://a/2": b"z" * 200}


def test_nested_captures_and_orphans(spark):
    path = write_archives(frame(spark, [(1, "http://a/1", "one"), (2, "http://a/2", "two")]))
    records = read_records(spark, path, with_payload=True)
    rows = assemble(records).collect()
    assert len(rows) == 2 and {bytes(r.main.payload) for r in rows} == {b"one", b"two"}
    assert all(len(r.requests) == 1 and r.metadata[0].fields["page_id"] in "12" for r in rows)
    lone = assemble(records.where("type <> 'response'")).collect()
    assert len(lone) == 2 and all(r.main is None and len(r.requests) == 1 for r in lone)

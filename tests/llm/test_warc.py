"""WARC archives: records against the definition, an exact round trip, and damaged archives."""

from __future__ import annotations

import gzip
import hashlib
import io

import pytest

from sitrep.llm import warc as W

DDL = "page_id long, url string, html string"
LONG = "<p>" + "x" * 120 + "</p>"


def brute(rows):
    """Rows of the result: of equal long payloads the first by id, then url (nulls last), is stored."""
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or ""))
    first, out = {}, []
    for page_id, url, html in order:
        payload = (html or "").encode()
        kind, refers = "response", None
        if len(payload) >= 100 and payload in first:
            kind, refers = "revisit", first[payload]
        first.setdefault(payload, page_id)
        out.append((page_id, len(payload), hashlib.sha256(payload).hexdigest(), kind, refers, url))
    return sorted(out, key=str)


def found(spark, rows, ddl=DDL):
    out = W.round_trip(spark.createDataFrame(rows, ddl))
    assert out.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
    return sorted((tuple(r) for r in out.collect()), key=str)


@pytest.fixture
def rows():
    return [
        (5, "http://a/5", LONG),
        (3, "http://a/3", LONG),
        (4, "http://b/4", LONG + "more"),
        (6, "http://b/6", "short"),
        (7, "http://b/7", "short"),
        (8, "line\r\nend", ""),
        (9, None, None),
        (-2, "http://b/-2", "ß" * 50),
        (10, "http://b/10", "ß" * 50),
        (None, "http://c", LONG),
        (None, None, None),
        (11, "http://d", "\x00\r\n\r\nHTTP/1.1 \U0001f600 WARC/1.1\r\n" * 9),
        (12, "http://e", "long " * 400_000),
    ]


def test_round_trip(spark, rows):
    want = [(*r[:-1], r[-1].replace("\r\n", "%0D%0A") if r[-1] else None) for r in brute(rows)]
    assert found(spark, rows) == sorted(want, key=str)


def test_repeated_rows_and_other_columns(spark, rows, monkeypatch):
    """Equal rows are one response and its revisits, whether written by one task or by several."""
    repeated = [r for r in rows if r[0] in (5, 6, -2)] * 7
    want = brute(repeated)
    assert found(spark, repeated) == want
    monkeypatch.setattr(W, "COPIES", 2)
    clash = [(*r, "d", 1, 2, "p") for r in repeated]
    more = DDL + ", digest string, id int, copies int, payload string"
    assert found(spark, clash, more) == want


def test_empty_table(spark):
    assert found(spark, []) == []


def test_payloads_come_back(spark, rows):
    manifest = W.write_archives(spark.createDataFrame(rows, DDL))
    assert manifest.agg({"records": "sum"}).first()[0] == len(rows)
    got = {bytes(r.payload) for r in W.read_archives(manifest).collect() if r.payload is not None}
    assert got == {(r[2] or "").encode() for r in rows}


def test_archives_are_plain_gzip_members(spark, rows):
    """Any reader can open them: one member per record, headers and blocks as the format has them."""
    manifest = W.write_archives(spark.createDataFrame(rows, DDL)).collect()
    for row in manifest:
        with open(row.archive.removeprefix("file:").replace("///", "/"), "rb") as f:
            data = f.read()
        records = list(W.members(io.BytesIO(data)))
        assert len(records) == row.records and b"".join(records) == gzip.decompress(data)
        assert all(r.startswith(b"WARC/1.1\r\n") and r.endswith(b"\r\n\r\n") for r in records)


def test_members_across_blocks(monkeypatch):
    monkeypatch.setattr(W, "BLOCK", 3)
    data = [b"a" * 100, b"", b"b", bytes(range(256)) * 50]
    assert list(W.members(io.BytesIO(b"".join(map(W.member, data))))) == data


def test_damage_is_told():
    payload = b"x" * 200
    digest = hashlib.sha256(payload).hexdigest()
    good = W.record("urn:page:1:a", payload, 200, digest)
    assert W.page_of(W.parse(good))[4:6] == (200, digest)
    with pytest.raises(ValueError, match="block digest"):
        W.parse(good.replace(b"xxxx", b"xxyx", 1))
    with pytest.raises(ValueError, match="Content-Length"):
        W.parse(good[:-5] + good[-4:])
    with pytest.raises(ValueError, match="not a WARC"):
        W.parse(b"hello\r\n\r\n")
    with pytest.raises(ValueError, match="payload digest"):
        W.page_of(W.parse(W.record("urn:page:1:a", payload, 200, "0" * 64)))
    with pytest.raises(ValueError, match="breaks off"):
        list(W.members(io.BytesIO(W.member(good)[:-3])))

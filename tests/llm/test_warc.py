"""Archives: round trips, chunk rows, revisits, and what damaged files do."""

import base64
import gzip
import hashlib
import io
import random

import pytest

from tradewind.llm import warc


def sha(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def expected(pages):
    groups = {}
    for page, url, html in pages:
        groups.setdefault((html or "").encode(), []).append((page is None, page or 0, url is None, url or "", page))
    out = []
    for payload, rows in groups.items():
        rows.sort(key=lambda r: r[:4])
        for k, row in enumerate(rows):
            out.append((row[4], len(payload), sha(payload), "revisit" if k else "response", rows[0][4] if k else None, True))
    return sorted(out, key=str)


def pages():
    r = random.Random(2)
    rows = [(k, f"http://h/{k}", f"<p>{r.random()}</p>\r\nWARC/1.1\r\n\r\n{'é' * (k % 50)}") for k in range(200)]
    rows += [(500 + k, f"http://copy/{k}", "<p>common</p>") for k in range(150)]
    rows += [(300, None, None), (301, "http://e/\r\nX-Evil: 1 é", ""), (None, "http://n/", "no id"), (None, "http://n/", "no id"), (302, "u", "no id")]
    rows += [(303, "same", "same row")] * 3 + [(304, "long", "xyz\n" * 900_000), (305, "long2", "y" * warc.CHUNK), (306, "ctl", "\x00\x1f﻿😀")]
    return rows


SCHEMA = "page_id long, url string, html string"


def test_round_trip(spark):
    rows = pages()
    frame = spark.createDataFrame([(*r, "x", 1, b"k") for r in rows], SCHEMA + ", payload string, chunk int, key binary").repartition(3)
    assert sorted(map(tuple, warc.round_trip(frame).collect()), key=str) == expected(rows)


def test_chunks_carry_digests_and_join_to_the_payload(spark):
    rows = pages()
    frame = spark.createDataFrame(rows, SCHEMA)
    folder = warc.shared_folder(spark, "test-warc")
    archives = warc.write_archives(warc.records(frame), folder, archive_bytes=4000)
    assert archives.count() > 3
    chunks = [r.asDict() for r in warc.read_archives(archives).where("page_id IN (304, 305, 306)").collect()]
    by_page = {p: sorted((c for c in chunks if c["page_id"] == p), key=lambda c: c["chunk"]) for p in (304, 305, 306)}
    texts = {p: h for p, _, h in rows}
    assert [len(by_page[p]) for p in (304, 305, 306)] == [4, 1, 1]
    for page, parts in by_page.items():
        whole = b""
        for c in parts:
            assert len(c["payload"]) <= warc.CHUNK
            whole += c["payload"]
            assert (c["payload_bytes"], c["payload_digest"]) == (len(whole), sha(whole))
        assert whole.decode() == texts[page]
        assert [c["last"] for c in parts] == [False] * (len(parts) - 1) + [True]


def test_small_payloads_are_all_responses(spark):
    rows = [(1, "a", "abc"), (2, "b", "abc"), (2, "b", "abc"), (3, "c", "longer text"), (4, "d", "longer text")]
    got = warc.round_trip(spark.createDataFrame(rows, SCHEMA), least_bytes=4).collect()
    assert sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in got if r["page_id"] < 4) == [(1, "response", None), (2, "response", None), (2, "response", None), (3, "response", None)]
    assert [(r["record_type"], r["refers_to"]) for r in got if r["page_id"] == 4] == [("revisit", 3)]


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).collect() == []


def record(payload: bytes, claimed: str) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n"
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x>\r\nWARC-Payload-Digest: sha1:{claimed}\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: {len(http) + len(payload)}\r\n\r\n"
    return head.encode() + http + payload + b"\r\n\r\n"


@pytest.mark.parametrize("zipped", [True, False])
@pytest.mark.parametrize("step", [1, 7, 1 << 16])
def test_parse_at_any_step(zipped, step):
    payloads = [b"", b"\r\n\r\nWARC/1.1\r\n", bytes(range(256)) * 9]
    pack = gzip.compress if zipped else bytes
    raw = b"".join(pack(record(p, sha(p))) for p in payloads)
    got = list(warc.parse(warc._Stream(io.BytesIO(raw), zipped, step), chunk=100))
    whole = [r for r in got if r["last"]]
    assert [(r["payload_bytes"], r["payload_digest"], r["intact"]) for r in whole] == [(len(p), sha(p), True) for p in payloads]
    assert b"".join(r["payload"] for r in got) == b"".join(payloads)


def test_damaged_archives():
    good = record(b"payload", sha(b"payload"))
    (row,) = warc.parse(warc._Stream(io.BytesIO(record(b"changed", sha(b"payload"))), False))
    assert row["intact"] is False and row["payload_digest"] == sha(b"changed")
    for cut in (10, len(good) - 8):
        with pytest.raises(ValueError, match="ends within"):
            list(warc.parse(warc._Stream(io.BytesIO(good[:cut]), False)))
    with pytest.raises(ValueError, match="no WARC record"):
        list(warc.parse(warc._Stream(io.BytesIO(b"hello\n"), False)))

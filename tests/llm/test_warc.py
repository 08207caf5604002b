from __future__ import annotations

import hashlib
import time
import uuid

import pytest

from notewright.llm import warc

HOT = "x" * 200
INNER = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 10\r\n\r\n0123456789"
PAGES = [
    (1, "u", INNER), (2, "u\r\nX: 1", INNER * 5), (3, None, None), (4, "u", ""), (5, "u", HOT), (6, "u", HOT), (7, "u", "short"), (8, "u", "short"),
    (None, "u", HOT), (9, "u", "y" * 100_000 + "\r\n"), (10, "u", "\r\n"), (11, "u", "é" * 3000 + "\r"), (5, "u", HOT), (12, "u", "WARC/1.1\r\n"),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, "clash", 1) for p in PAGES], "page_id long, url string, html string, record_type string, offset int").coalesce(2)


@pytest.fixture()
def folder(tmp_path):
    return f"file://{tmp_path}/{uuid.uuid4().hex}"


@pytest.mark.parametrize("block", [64, 1000, 1 << 20])
def test_round_trip(spark, pages, folder, block):
    warc.write_archives(pages, folder)
    records = warc.read_records(spark, folder, block)
    assert records.count() == len(PAGES) and records.where("not intact").count() == 0
    got = sorted((str(r["page_id"]), bytes(r["html"]).decode()) for r in warc.read_pages(spark, folder, block).collect())
    assert got == sorted((str(i), h or "") for i, _, h in PAGES)


def test_report(pages, rows):
    got = rows(warc.archive_report(pages), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    want = []
    for i, _, h in PAGES:
        raw = (h or "").encode()
        same = [j for j, _, g in PAGES if j is not None and g == h]
        first = min(same) if len(raw) >= 100 and same and i is not None else i
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if first != i else "response", first if first != i else None))
    assert got == sorted(want, key=repr)


def test_chain_stops_at_damage(spark, tmp_path):
    """A broken length ends its file's chain; another file is read whole."""
    good = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    bad = good + good.replace("Content-Length: 3", "Content-Length: three") + good
    (tmp_path / "part-0").write_bytes(bad.encode())
    (tmp_path / "part-1").write_bytes((good * 3).encode())
    with pytest.raises(ValueError, match="part-0"):
        warc.read_records(spark, f"file://{tmp_path}", 50)
    found = warc.read_records(spark, f"file://{tmp_path}", 50, strict=False).groupBy("file").count().collect()
    assert sorted(r["count"] for r in found) == [1, 3]


def test_empty_table(pages):
    assert warc.archive_report(pages.limit(0)).count() == 0


def test_headers_longer_than_blocks(spark, folder):
    pages = [(i, "u" * (300_000 if i % 3 == 0 else 5), f"page {i} " * 5000) for i in range(9)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    warc.write_archives(df, folder)
    for block in (1000, 70_000):
        records = warc.read_records(spark, folder, block)
        assert sorted((int(r["page_id"]), r["url"], r["payload_bytes"]) for r in records.collect()) == [(i, u, len(h)) for i, u, h in pages]


@pytest.mark.parametrize("line", ["WARC/1.1\r\n", "X: WARC/1.1\r\n", "WARC/1.1\r\nA: b\r\n", "WARC/1.1\r\nContent-Length: 1\r\nWARC-Type: x\r\n\r\n"])
def test_payloads_of_nothing_but_magic(spark, folder, line):
    """Linear in the payload: a megabyte of magic is read in seconds, also in blocks that it leaves."""
    pages = [(1, "u", "first"), (2, "u", line * (1_000_000 // len(line))), (3, "u", "last")]
    warc.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1), folder)
    began = time.perf_counter()
    for block in (1 << 20, 1 << 18):
        records = warc.read_records(spark, folder, block)
        assert sorted((r["page_id"], r["payload_bytes"], r["intact"]) for r in records.collect()) == [(str(i), len(h), True) for i, _, h in pages]
    assert time.perf_counter() - began < 90


def test_ids_of_any_text(spark, folder):
    ids = ["a b", "c\r\nd", "é>%41", "", "<urn:page:x>", None]
    df = spark.createDataFrame([(i, "u", "x" * 200) for i in ids] + [("z", "u", "own")], "page_id string, url string, html string")
    got = warc.archive_report(df).collect()
    assert sorted((r["page_id"] for r in got), key=repr) == sorted([*ids, "z"], key=repr)
    assert {r["refers_to"] for r in got} == {None, ""}

from __future__ import annotations

import random
import zlib

import pytest

from notewright.llm import sharding


def brute(sizes, n):
    """Least capacity of a contiguous partition into n parts, by trying each."""

    def fits(c):
        used, parts = 0, 1
        for s in sizes:
            if s > c:
                return False
            if used + s > c:
                used, parts = 0, parts + 1
            used += s
        return parts <= n

    low, high = max(sizes), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid) else (mid + 1, high)
    return low


@pytest.mark.parametrize("seed", range(4))
def test_capacity_is_the_optimum(spark, seed):
    r = random.Random(seed)
    groups = sorted({(r.getrandbits(64) - (1 << 63), r.randint(1, 200 if seed % 2 else 5)) for _ in range(800)})
    n = 7
    alone, starts, capacity = sharding.minimax(spark.createDataFrame(groups, "h long, bytes long"), n)
    rest = [b for h, b in groups if h not in alone]
    assert capacity == brute(rest, n - len(alone))
    loads = {}
    for h, b in groups:
        if h not in alone:
            k = sum(h >= s for s in starts)
            loads[k] = loads.get(k, 0) + b
    assert max(loads.values()) <= capacity and len(starts) <= n - len(alone) - 1
    assert len(loads) == n - len(alone) and min(loads.values()) > 0.9 * sum(loads.values()) / len(loads)


def test_large_groups_stand_alone(spark):
    groups = [(1, 1000), (2, 3), (3, 4), (4, 5), (5, 6), (6, 700)]
    alone, starts, capacity = sharding.minimax(spark.createDataFrame(groups, "h long, bytes long"), 4)
    assert alone == [1, 6] and capacity == 11 and len(starts) == 1  # 3 + 4 | 5 + 6


def test_shards(documents):
    texts = [None, "", "é" * 30, "same", "same", "same"] + [f"text {i} " * (i % 9 + 1) for i in range(200)]
    rows = [(i if i % 50 else None, t, "s") for i, t in enumerate(texts)]
    got = [r.asDict() for r in sharding.shard(documents(rows), shards=5).collect()]
    assert sorted((r["size"], r["text_crc32"]) for r in got) == sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for t in texts)
    assert {r["law"] for r in got} == {"bytes"} and {r["grown_shard"] for r in got} == {None}
    by_text, slots = {}, {}
    for r in got:
        by_text.setdefault(r["text_crc32"], set()).add(r["shard"])
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(len(s) == 1 for s in by_text.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) == set(range(5))


def test_few_or_no_groups(documents):
    assert sharding.shard(documents([]), shards=3).count() == 0
    got = sharding.shard(documents([(1, "a", "s"), (1, "a", "s"), (2, "b", "s")]), shards=9).collect()
    assert len(got) == 3 and len({r["shard"] for r in got}) == 2


def test_documents_go_with_their_shards(documents, rows):
    texts = [None, "", "é" * 30, "same", "same"] + [f"text {i} " * (i % 9 + 1) for i in range(100)]
    docs = documents([(i, t, "s") for i, t in enumerate(texts)]).drop("shard")
    want = rows(sharding.shard(docs, shards=5), "doc_id", "size", "text_crc32", "shard", "slot")
    got = sharding.shard_documents(docs, shards=5)
    assert got.columns == [*docs.columns, "size", "text_crc32", "shard", "slot"] and rows(got, "doc_id", "size", "text_crc32", "shard", "slot") == want
    assert rows(got, "doc_id", "text", "kind", "node") == rows(docs, "doc_id", "text", "kind", "node")
    assert sharding.shard_documents(docs.limit(0), shards=3).count() == 0

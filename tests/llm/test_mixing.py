from __future__ import annotations

import math
from collections import Counter

import pytest

from notewright.llm import mixing


def test_rates_and_distribution(documents):
    docs = documents([(i, "x" * 10, None if i % 10 == 0 else "a" if i % 10 < 9 else "b") for i in range(3000)])
    table = {r["source"]: r for r in mixing.rates(docs, {"a": 1, "b": 2, None: 1}).collect()}
    assert table["b"]["rate"] == pytest.approx(0.5 / 0.1) and table[None]["rate"] == pytest.approx(0.25 / 0.1) and table["a"]["rate"] == pytest.approx(0.25 / 0.8)
    cdf = table["b"]["cdf"]
    assert cdf[0] == pytest.approx(math.exp(-5)) and cdf[-1] == pytest.approx(1.0) and cdf == sorted(cdf)
    out = mixing.mix(docs, {"a": 1, "b": 2, None: 1})
    n = Counter(r["source"] for r in out.select("source").collect())
    for s, share in (("a", 0.25), ("b", 0.5), (None, 0.25)):
        assert abs(n[s] - 3000 * share) < 5 * math.sqrt(3000 * share)
    counts = Counter(r["doc_id"] for r in out.where("source = 'b'").collect())
    k = Counter(counts.values())
    assert k[5] > k[1] and max(k) > 9


def test_order_copies_and_determinism(documents, rows):
    docs = documents([(i % 40, f"t{i % 40}", "a" if i % 2 else "b") for i in range(80)] + [(None, None, None)])
    one, two = mixing.mix(docs), mixing.mix(docs.repartition(5))
    keys = [r["__key"] for r in one.collect()]
    assert keys == sorted(keys) and rows(one, "doc_id", "__copy", "__key") == rows(two, "doc_id", "__copy", "__key")
    assert one.select(*docs.columns).columns == docs.columns


def test_large_means_and_zero_weights(documents):
    docs = documents([(i, "x", "a" if i else "b") for i in range(400)])
    r = {x["source"]: x for x in mixing.rates(docs, {"b": 1.0}).collect()}
    assert r["a"]["rate"] == 0 and r["b"]["rate"] == pytest.approx(400) and r["b"]["parts"] == 7
    n = mixing.mix(docs, {"b": 1.0}).count()
    assert 300 < n < 500
    assert mixing.mix(docs, {}).count() == 0 and mixing.mix(documents([])).count() == 0


def test_joined_by_shuffle_when_sources_are_many(documents, rows, monkeypatch):
    docs = documents([(i, f"t{i}", f"s{i % 30}") for i in range(90)])
    few = rows(mixing.mix(docs), "doc_id", "__copy")
    monkeypatch.setattr(mixing, "SOURCES_TO_BROADCAST", 3)
    assert rows(mixing.mix(docs), "doc_id", "__copy") == few

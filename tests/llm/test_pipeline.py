from __future__ import annotations

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from notewright.llm import decontam, mixing, neardup, quality
from notewright.llm.common import tokenizer_dir

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "near-duplicates", "decontamination", "mixing", "sharding"]
    stages = dict(corpus_pipeline.STAGES)
    own = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    good = stages["quality rules"](spark, docs, SF)
    assert good.columns == docs.columns
    assert own(good) == {r["doc_id"] for r in quality.report(docs).where("kept").collect()}
    one = stages["near-duplicates"](spark, good, SF)
    classes = neardup.classes(good).collect()
    assert own(one) == {r["class_id"] for r in classes} and one.columns == docs.columns
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    clean = stages["decontamination"](spark, one, SF)
    assert clean.columns == docs.columns and decontam.contamination(clean, bench).where("n_hit > 0").count() == 0
    gone = {r["doc_id"] for r in decontam.contamination(one, bench).where("contaminated").collect()}
    assert own(clean) == own(one) - gone
    mixed = stages["mixing"](spark, clean, SF)
    assert mixed.columns == docs.columns and own(mixed) <= own(clean)
    shards = stages["sharding"](spark, mixed, SF)
    assert shards.count() == mixed.count() and shards.agg({"shard": "max"}).first()[0] <= 39


WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def good(text, lang):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    five = Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))
    twice = {j for i in range(len(ws) - 4) if five[tuple(ws[i : i + 5])] > 1 for j in range(i, i + 5)}
    if len(ws) < 10 or 100 * len(twice) > 20 * len(ws):
        return False
    return not quality.verdict(lang, text, quality.fertility(text, tokenizer_dir()), quality.BANDS)


def one_of_each(docs):
    """The least doc_id of each component of texts with a plain Jaccard similarity of 0.8."""
    sets = {}
    for d in docs:
        w = (d[1] or "").translate(SMALL).split()
        sets[d[0]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            root[max(find(a), find(b))] = min(find(a), find(b))
    return [d for d in docs if find(d[0]) == d[0]]


def without_benchmark(docs, bench):
    windows = defaultdict(set)
    for item, t in bench:
        ws = WORD.findall((t or "").translate(SMALL))
        k = min(8, len(ws))
        for i in range(len(ws) - k + 1) if ws else ():
            windows[tuple(ws[i : i + k])].add(item)
    sizes = {len(w) for w in windows}
    for d, t, *rest in docs:
        found = list(WORD.finditer(t or ""))
        ws = [m[0].translate(SMALL) for m in found]
        hit, items = set(), set()
        for k in sizes:
            for i in range(len(ws) - k + 1):
                if own := windows.get(tuple(ws[i : i + k])):
                    hit |= set(range(i, i + k))
                    items |= own
        if len(items) < 2:
            ends = [0, *(m.end() for m in found)]
            cut = "".join(t[ends[i] : ends[i + 1]] for i in range(len(found)) if i not in hit) + t[ends[-1] :] if hit else t
            yield (d, cut, *rest)


def mixed(docs):
    h = lambda *parts: int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:13], 16)
    size = Counter()
    for _, t, _, source in docs:
        size[source] += max(1, len((t or "").encode()))
    for d, t, _, source in docs:
        m = sum(size.values()) / len(size) / size[source]
        assert m <= mixing.PART
        mark = hashlib.md5(t.encode()).hexdigest()
        u, p, total, k = h(mixing.SEED, d, mark, 1) / 2**52, math.exp(-m), math.exp(-m), 0
        while total <= u:
            k += 1
            p *= m / k
            total += p
        yield from [(d, t)] * k


def test_run_against_brute_force(spark):
    """Every stage by a plain program of its own, over the whole small table."""
    docs = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = list(mixed(list(without_benchmark(one_of_each([d for d in docs if good(d[1], d[2])]), bench))))
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == sorted(want) and want
    slots, homes = defaultdict(list), defaultdict(set)
    for r in got:
        assert r["size"] == len(r["text"].encode()) + 16 and r["text_crc32"] == zlib.crc32(r["text"].encode())
        slots[r["shard"]].append(r["slot"])
        homes[r["text"]].add(r["shard"])
    assert set(slots) <= set(range(40)) and all(sorted(x) == list(range(len(x))) for x in slots.values()) and all(len(x) == 1 for x in homes.values())


def test_run_is_the_stages(spark):
    first = sorted(tuple(r) for r in corpus_pipeline.run(spark, SF).select("doc_id", "size", "shard").collect())
    again = sorted(tuple(r) for r in corpus_pipeline.run(spark, SF).select("doc_id", "size", "shard").collect())
    assert first == again and first

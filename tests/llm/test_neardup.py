from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from notewright.llm import neardup


def words(r, n):
    return ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(n)]


def edited(r, ws, k):
    out = list(ws)
    for i in r.sample(range(len(out)), k):
        out[i] = "edit" + str(r.randrange(10**9))
    return out


def brute(texts, limit=0.8):
    """Components of plain Jaccard over the distinct texts; -1 for texts without words."""
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and len(a & sets[j]) >= limit * len(a | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))]


def partition(labels):
    groups = defaultdict(set)
    for i, x in labels.items():
        groups[x].add(i)
    return {frozenset(g) for g in groups.values()}


def test_classes_of_planted_groups(documents):
    r = random.Random(5)
    texts = [None, None, "", " \n", "a b", "A  B", "short text", "short text"]
    for _ in range(12):
        base = words(r, 120)
        texts += [" ".join(base)] * r.randint(1, 3) + [" ".join(edited(r, base, 1)) for _ in range(r.randint(0, 4))]
        texts.append(" ".join(edited(r, base, 40)))
    texts += [" ".join(words(r, 80)) for _ in range(30)]
    got = {x["doc_id"]: x["class_id"] for x in neardup.classes(documents([(i, t, "s") for i, t in enumerate(texts)])).collect()}
    want = dict(enumerate(brute(texts)))
    assert partition(got) == partition(want)
    assert all(c == min(i for i, x in got.items() if x == c) for c in got.values())


def test_a_group_of_many_chunks(documents, monkeypatch):
    """Copies that are alike through their base alone, in a class of many chunks: pivots or blocks find every link."""
    monkeypatch.setattr(neardup, "CHUNK", 8)
    monkeypatch.setattr(neardup, "BLOCK", 4)
    r = random.Random(9)
    base = words(r, 300)
    texts = [" ".join(base)] + [" ".join(edited(r, base, 4)) for _ in range(70)]
    for pivots in (8, 0):
        monkeypatch.setattr(neardup, "PIVOTS", pivots)
        got = {x["doc_id"]: x["class_id"] for x in neardup.classes(documents([(i, t, "s") for i, t in enumerate(texts)])).collect()}
        assert set(got.values()) == {0}


def test_buckets_join_what_chunks_keep_apart(documents, monkeypatch):
    """A class of several groups that a common passage chains together: without pivots, buckets alone bring each group together."""
    monkeypatch.setattr(neardup, "CHUNK", 4)
    monkeypatch.setattr(neardup, "BLOCK", 2)
    monkeypatch.setattr(neardup, "PIVOTS", 0)
    r = random.Random(6)
    shared = words(r, 60)
    texts = []
    for _ in range(8):
        base = shared + words(r, 60)
        texts += [" ".join(base)] + [" ".join(edited(r, base, 2)) for _ in range(5)]
    got = {x["doc_id"]: x["class_id"] for x in neardup.classes(documents([(i, t, "s") for i, t in enumerate(texts)])).collect()}
    assert partition(got) == partition(dict(enumerate(brute(texts))))


def test_other_repeat_counts_of_one_line(documents):
    """Equal sets of shingles are linked, however often a line repeats."""
    r = random.Random(3)
    own, line = words(r, 60), words(r, 10)
    texts = [" ".join(own + line * k) for k in (4, 9, 40)] + [" ".join(words(r, 60) + line * 4)]
    got = {x["doc_id"]: x["class_id"] for x in neardup.classes(documents([(i, t, "s") for i, t in enumerate(texts)])).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3}


def test_repeated_rows_null_ids_and_the_stage(documents):
    r = random.Random(2)
    a, b = " ".join(words(r, 60)), " ".join(words(r, 60))
    docs = documents([(1, a, "s")] * 4 + [(None, a, "s"), (3, b, "s"), (None, b, "t"), (None, None, "s"), (9, "", "s")])
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((x["doc_id"], x["text"]) for x in kept.where("text <> ''").collect()) == sorted([(1, a), (3, b)])
    assert kept.where("text is null or text = ''").count() == 2
    assert neardup.classes(documents([])).count() == 0 and neardup.classes(documents([(None, "x y z", "s")])).first()["class_id"] is None


def test_samples_agree_as_often_as_weights_overlap():
    """The share of equal samples estimates weighted Jaccard similarity."""
    r = np.random.default_rng(1)
    keys = r.integers(0, 2**63, 60).astype(np.uint64)
    wa, wb = r.uniform(0.5, 4, 60), r.uniform(0.5, 4, 60)
    wa[50:], wb[:10] = 0, 0
    n = 1500
    draw = lambda w: neardup.samples(keys[w > 0], np.array([0]), np.log(w[w > 0]).astype(np.float32), n)[0]
    true = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    assert abs((draw(wa) == draw(wb)).mean() - true) < 4 * math.sqrt(true * (1 - true) / n)


@pytest.mark.parametrize("m", [5, 40])
def test_links_against_brute_force(m):
    r = random.Random(m)
    base = words(r, 30) * 2
    texts = [" ".join(edited(r, base, r.randint(0, 6))) for _ in range(m)]
    idf = np.random.default_rng(0).uniform(0.5, 5, neardup.BUCKETS).astype(np.float32)
    got = set(neardup._links(list(enumerate(texts)), np.zeros(m, int), idf, 0.6))
    count = []
    for t in texts:
        h, _ = neardup.shingles(pa.array([t]))
        count.append(Counter(h.tolist()))
    weight = lambda x: float(idf[x % neardup.BUCKETS])
    times = lambda n: 1 + math.log(n) if n else 0.0
    for i in range(m):
        for j in range(i + 1, m):
            a, b = count[i], count[j]
            s = sum(weight(x) * times(min(a[x], b[x])) for x in a) / sum(weight(x) * times(max(a[x], b[x])) for x in a | b)
            plain = len(a.keys() & b.keys()) / len(a.keys() | b.keys())
            if abs(s - 0.6) > 1e-3 and abs(plain - 0.6) > 1e-3:
                assert ((i, j) in got) == (max(s, plain) >= 0.6)

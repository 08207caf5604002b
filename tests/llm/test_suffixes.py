from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from notewright.llm import suffixes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs):
    at = {n: [m.span() for m in WORD.finditer(t or "")] for n, (_, t) in enumerate(docs)}
    ws = {n: [docs[n][1][a:b] for a, b in at[n]] for n in at}
    rank = lambda n: docs[n][0] if docs[n][0] is not None else suffixes.LAST
    key = {n: (docs[n][0], docs[n][1]) for n in at}
    seen = defaultdict(set)
    for n, w in ws.items():
        for i in range(len(w) - suffixes.LEAST + 1):
            seen[tuple(w[i : i + suffixes.LEAST])].add(n)
    out = {}
    for n, w in ws.items():
        rep, drop = set(), set()
        for i in range(len(w) - suffixes.LEAST + 1):
            own = seen[tuple(w[i : i + suffixes.LEAST])]
            if len({key[m] for m in own}) > 1:
                rep.update(range(i, i + suffixes.LEAST))
                if min(map(rank, own)) < rank(n):
                    drop.update(range(i, i + suffixes.LEAST))
        out[n] = (docs[n][0], len(w), len(rep), len(drop))
    return sorted(out.values(), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(documents, rows, seed):
    r = random.Random(seed)
    vocabulary = ["w" + str(i) for i in range(400)] + ["é", "漢", "x,"]
    some = lambda n: [r.choice(vocabulary) for _ in range(n)]
    passages = [some(n) for n in (49, 50, 51, 60, 140)]
    docs = []
    for i in range(60):
        w = some(r.randint(0, 120))
        for p in r.sample(passages, r.randint(0, 3)):
            k = r.randint(0, len(w))
            w[k:k] = p
        docs.append((100 + i, r.choice([" ", "\n", "  "]).join(w)))
    whole = " ".join(some(90))
    docs += [(5, whole), (6, whole), (6, whole), (7, None), (8, ""), (9, "loop " * 300), (10, "loop " * 200), (11, " ".join(some(3000) + passages[3])), (None, whole + " tail")]
    got = suffixes.report(documents([(i, t, "s") for i, t in docs]))
    assert rows(got, "doc_id", "n_words", "n_repeated", "n_dropped") == brute(docs)
    by_id = {d: t for d, t in docs}
    for x in got.where("doc_id is not null").collect():
        left = suffixes.cut(by_id[x["doc_id"]], x["spans"])
        assert len(WORD.findall(left or "")) >= x["n_words"] - x["n_dropped"]
        assert bool(x["first_docs"]) == (x["n_dropped"] > 0) and all(f < x["doc_id"] for f in x["first_docs"])


@pytest.mark.parametrize("n", [0, 1, 25, 26, 27, 500])
def test_every_window_has_one_owner(n):
    g = np.random.default_rng(3).integers(0, 50, n).astype(np.uint64)
    own = [i + int(np.argmin(g[i : i + suffixes.SPAN])) for i in range(max(0, n - suffixes.SPAN + 1))]
    assert suffixes.owners(g).tolist() == own
    place, near, far = suffixes.kept(g)
    assert sorted(int(p - o) for p, a, b in zip(place, near, far) for o in range(a, b + 1)) == list(range(len(own)))
    assert all(own[p - o] == p for p, a, b in zip(place, near, far) for o in range(a, b + 1))


def test_longest_matches_against_all_rows():
    r = random.Random(4)
    rows = sorted((r.randrange(2), b"".join(r.choice([b"a ", b"ab ", b"\x01 "]) for _ in range(6)), (r.randrange(3), 0)) for _ in range(80))
    got = suffixes.longest_matches([h for h, _, _ in rows], [t for _, _, t in rows], [w for _, w, _ in rows])
    want = [max((suffixes.shared_words(w, x) for g, x, u in rows if g == h and u != t), default=0) for h, w, t in rows]
    assert all(n >= x for n, x in zip(got, want))  # more only at the edges, whose neighbours aren't seen
    assert sum(n == x for n, x in zip(got, want)) > 70


def test_hashes_that_collide_change_nothing(documents, rows, monkeypatch):
    """The prefix hash only chooses and groups: with a handful of values, neighbours' words tell suffixes apart."""
    whole = suffixes.prefix_hashes
    monkeypatch.setattr(suffixes, "prefix_hashes", lambda h: whole(h) % np.uint64(5))
    r = random.Random(8)
    some = lambda n: [r.choice("abcdefghij") + str(r.randrange(30)) for _ in range(n)]
    passages = [some(n) for n in (50, 70)]
    docs = [(i, " ".join(some(40) + (passages[i % 2] if i % 3 else []) + some(40))) for i in range(30)]
    got = suffixes.report(documents([(i, t, "s") for i, t in docs]))
    assert rows(got, "doc_id", "n_words", "n_repeated", "n_dropped") == brute(docs)


def test_ids_of_other_types(spark, rows):
    p = " ".join(f"p{i}" for i in range(60))
    docs = spark.createDataFrame([("b-1", f"x {p}"), ("a-1", f"y {p} z"), (None, p), ("c", p)], "doc_id string, text string")
    got = suffixes.report(docs)
    assert rows(got, "doc_id", "n_dropped", "first_docs") == sorted([("b-1", 60, ["a-1"]), ("a-1", 0, []), (None, 60, ["c"]), ("c", 60, ["a-1"])], key=repr)


def test_texts(documents, rows):
    p = " ".join(f"p{i}" for i in range(60))
    docs = documents([(1, f"one {p} end", "s"), (2, f"two {p} end", "s"), (3, None, "s")])
    got = suffixes.remove_repeats(docs)
    assert got.columns == docs.columns
    assert rows(got, "doc_id", "text", "n_chars") == [(1, f"one {p} end", len(p) + 8), (2, "two ", 4), (3, None, None)]
    assert suffixes.report(documents([])).count() == 0

from __future__ import annotations

import hashlib
import re
import time

import pytest

from notewright.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, bench, n=8):
    wins = {}
    for item, t in bench:
        ws = WORD.findall((t or "").translate(LOWER))
        k = min(n, len(ws))
        for i in range(len(ws) - k + 1) if ws else ():
            wins.setdefault(tuple(ws[i : i + k]), set()).add(str(item))
    out = []
    for d, t in docs:
        ws = WORD.findall((t or "").translate(LOWER))
        hit, items = set(), set()
        for k in {len(w) for w in wins}:
            for i in range(len(ws) - k + 1):
                if (own := wins.get(tuple(ws[i : i + k]))) is not None:
                    hit.update(range(i, i + k))
                    items |= own
        out.append((d, len(ws), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), len(items) >= 2))
    return sorted(out, key=repr)


PASSAGE = "One two, three FOUR five-six seven eight nine ten É eleven"
BENCH = [(10, PASSAGE), (9, "short Item"), (11, PASSAGE), (12, None), (13, ""), (14, "..."), (15, "x1 x2 x3 x4 x5 x6 x7 x8")]
DOCS = [
    (1, "before " + PASSAGE + " after short item end"), (1, "before " + PASSAGE + " after short item end"), (2, None), (3, ""), (4, "?!"), (5, "SHORT, item."),
    (6, "one two three four five six seven nine"), (7, " ".join(["x1 x2 x3 x4 x5 x6 x7 x8"] * 3)), (None, "x1 x2 x3 x4 x5 x6 x7 x8"), (8, "é È word " * 3000 + "short item"),
    (9, "x1 x2 x3 x4 x5 x6 x7 short item"),
]


def test_against_brute_force(spark, documents, rows):
    docs = documents([(i, t, "s") for i, t in DOCS])
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    got = decontam.contamination(docs, bench)
    assert rows(got, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == brute(DOCS, BENCH)


@pytest.mark.parametrize("bits", [1 << 27, 128])
def test_a_benchmark_beyond_the_broadcast(spark, documents, rows, monkeypatch, bits):
    """Hashes go through a filter of a fixed size and are joined; what the filter passes by chance is not verified."""
    monkeypatch.setattr(decontam, "WINDOWS_TO_BROADCAST", 3)
    monkeypatch.setattr(decontam, "FILTER_BITS", bits)
    monkeypatch.setattr(decontam, "SPANS_TO_BROADCAST", 0)
    docs = documents([(i, t, "s") for i, t in DOCS])
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    got = decontam.contamination(docs, bench)
    assert rows(got, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == brute(DOCS, BENCH)
    left = decontam.decontaminate(docs, bench)
    assert decontam.contamination(left, bench).where("n_hit > 0").count() == 0 and left.count() == sum(not x[5] for x in brute(DOCS, BENCH))


def test_a_large_benchmark_and_a_very_long_text(spark, rows):
    """A million windows and a text of 400,000 words: one scan, no text leaves it, time as in proportion."""
    bench = spark.range(25_000).selectExpr("id as item_id", "array_join(transform(sequence(0, 46), i -> concat('b', id * 47 + i)), ' ') as text")
    long_ = "array_join(transform(sequence(1, 400000), i -> concat('w', i)), ' ')"
    docs = spark.range(3).selectExpr("id as doc_id", f"if(id = 0, concat({long_}, ' b47 b48 b49 b50 b51 b52 b53 b54'), concat('b94 b95 b96 b97 b98 b99 b100 b101 x', id)) as text")
    began = time.perf_counter()
    got = decontam.contamination(docs, bench)
    assert rows(got, "doc_id", "n_words", "n_hit", "n_items") == [(0, 400_008, 8, 1), (1, 9, 8, 1), (2, 9, 8, 1)]
    assert time.perf_counter() - began < 120


def test_empty_tables(spark, documents, rows):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    assert decontam.contamination(documents([]), bench).count() == 0
    got = decontam.contamination(documents([(1, "a b", "s")]), bench.limit(0))
    assert rows(got, "doc_id", "n_words", "n_hit", "n_items", "contaminated") == [(1, 2, 0, 0, False)]


def test_spans_and_documents_go(spark, documents, rows):
    bench = spark.createDataFrame([(1, "a1 a2 a3 a4 a5 a6 a7 a8 a9"), (2, "b1 b2 b3 b4 b5 b6 b7 b8")], "item_id long, text string")
    docs = documents([(1, "Keep, a1 a2 a3 a4 a5 a6 a7 a8 a9! stay.", "s"), (2, "a1 a2 a3 a4 a5 a6 a7 a8 b1 b2 b3 b4 b5 b6 b7 b8", "s"), (3, "clean text.", "s"), (4, None, "s")])
    got = decontam.decontaminate(docs, bench)
    assert got.columns == docs.columns
    assert rows(got, "doc_id", "text", "n_chars", "shard") == [(1, "Keep! stay.", 11, "own"), (3, "clean text.", 11, "own"), (4, None, None, "own")]
    left = decontam.contamination(got, bench)
    assert all(r["n_items"] == 0 for r in left.collect())


def test_capitals_are_words_of_the_text(spark, documents, rows):
    passage = "a1 a2 a3 a4 a5 a6 a7 a8"
    bench = spark.createDataFrame([(1, passage), (2, "seven of these words are in capital letters")], "item_id long, text string")
    docs = documents([
        (1, f"I say: USA, McDonald {passage} stay here.", "s"), (2, f"Keep this. {passage.upper()}! Stay.", "s"),
        (3, "A McDonald SEVEN OF THESE WORDS ARE IN CAPITAL LETTERS", "s"), (4, "Seven Of These WORDS are In capital leTTers: I STAY IN THE USA.\n", "s"),
    ])
    got = decontam.decontaminate(docs, bench)
    assert rows(got, "doc_id", "text") == [(1, "I say: USA, McDonald stay here."), (2, "Keep this! Stay."), (3, "A McDonald"), (4, ": I STAY IN THE USA.\n")]

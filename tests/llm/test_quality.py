from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from notewright.llm import quality
from notewright.llm.common import tokenizer_dir

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(t):
    t = t or ""
    ws = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    c = Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))
    rep = {j for i in range(len(ws) - 4) if c[tuple(ws[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep)


def test_base_measures(documents):
    r = random.Random(1)
    words = ["a", "bé", "漢字", "x#", "<&>", "no break", "\x0b", "end."]
    texts = [None, "", " ", "\n\n", "one", "w " * 30_000] + ["".join(r.choice(words) + r.choice([" ", "\n", "\t", "  "]) for _ in range(r.randint(1, 60))) for _ in range(200)]
    got = {r["doc_id"]: r for r in quality.report(documents([(i, t, "s") for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        g = got[i]
        want = brute(t)
        assert tuple(g[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want, t
        failed = want[0] < 10 or 100 * want[4] > 20 * want[0]
        assert g["base_failed"] == failed and (not failed or not g["kept"])


def test_fertility_against_the_libraries():
    folder = tokenizer_dir()
    pytest.importorskip("tiktoken")
    sp = quality.fallback(folder).pieces
    for t in ("The quick brown fox, it said.", "Größe über alles — ça va", "日本語のテキスト mixed", "ꙮ𓂀 rare"):
        n, chars, lost, entropy = quality.fertility(t, folder)
        ids = quality.encoder(folder).encode_ordinary(t)
        share = [c / len(ids) for c in Counter(ids).values()]
        assert n == len(ids) and chars == pytest.approx(len(t) / n) and entropy == pytest.approx(-sum(p * math.log2(p) for p in share))
        spelled = sum(sp.is_byte(i) for i in sp.encode(t))
        assert round(lost * len(t.encode())) == spelled


def test_verdicts():
    good = quality.Band(2.0)
    bands = {"en": good, "LATIN": good, "CYRILLIC": quality.Band(0.1), "OTHER": good}
    assert quality.verdict("en", "x", (500, 3.0, 0.0, 7.0), bands) == ""
    assert quality.verdict("en", "x", (500, 1.0, 0.5, 3.0), bands) == "chars_per_token,byte_fallback,entropy"
    assert quality.verdict("en", "x", (10, 0.7, 0.2, 3.0), bands) == "" and quality.verdict("en", "x", (10, 0.6, 0.4, 3.0), bands) == "chars_per_token,byte_fallback"
    assert quality.verdict("en", "x", (50, 1.4, 0.0, 5.0), bands) == "chars_per_token" and quality.verdict("en", "x", (50, 1.5, 0.0, 5.0), bands) == ""
    assert quality.verdict(None, "привет", (500, 1.0, 0.0, 7.0), bands) == "" and quality.script("привет ab") == "CYRILLIC"
    assert quality.verdict(None, "", (0, 0.0, 0.0, 0.0), bands) == ""


def test_clean_documents_stay(spark):
    """On the labelled table: every good text that passes the base rules is kept, most bad ones go."""
    sf = "/root/testdata/sf0.01"
    got = quality.report(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    good = [r for r in got if r["quality"] == 1 and not r["base_failed"]]
    bad = [r for r in got if r["quality"] == 0]
    assert good and all(r["kept"] for r in good)
    assert sum(not r["kept"] for r in bad) >= 0.8 * len(bad)


def test_stage(documents, rows):
    docs = documents([(1, None, "s"), (2, "short", "s"), (3, "same same same same same same same same same same same same", "s")])
    assert quality.keep_good(docs).columns == docs.columns and quality.keep_good(docs).count() == 0
    assert quality.report(documents([])).count() == 0

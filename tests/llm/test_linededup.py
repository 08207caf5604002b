from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import pytest

from notewright.llm import linededup

SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, limit):
    own = defaultdict(set)
    split = [(d, (t or "").split("\n")) for d, t in docs]
    key = lambda x: x.strip(SPACE).translate(LOWER)
    for n, (d, lines) in enumerate(split):
        for x in lines:
            if key(x):
                own[key(x)].add(n)
    out = []
    for d, lines in split:
        kept = [x for x in lines if len(own.get(key(x), ())) < limit]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("parts", [1, 4, 37])
def test_against_brute_force(spark, documents, rows, parts):
    r = random.Random(parts)
    pool = ["Licensed.", " licensed. ", "ÉCOLE", "école", "x", "", "  ", "\tTab\x0b", "rare", " no-break "] + [f"line {i}" for i in range(30)]
    docs = [(i if i % 17 else None, "\n".join(r.choice(pool) for _ in range(r.randint(0, 12)))) for i in range(120)]
    docs += [(500, None), (501, ""), (502, "x\n" * 5000), (503, "y" * 200_000), (504, "rep\nrep"), (504, "rep\nrep")]
    docs += [(600, "same\nrows\nsame")] * 5 + [(601, "few\nrows")] * 4 + [(602, "x\nsome\nx\n")] * 3
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = linededup.line_report(documents([(i, t, "s") for i, t in docs]), 5)
        assert rows(got, "doc_id", "n_lines", "n_dropped", "kept_sha256") == brute(docs, 5)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_a_hot_line_in_many_partitions(spark, documents, rows):
    """One line makes most rows, so its run spans partitions and is decided from counts at their edges."""
    docs = [(i, f"hot\nown {i}") for i in range(300)] + [(1000 + i, "warm\nz") for i in range(4)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", 64)
    try:
        got = linededup.line_report(documents([(i, t, "s") for i, t in docs]), 10)
        assert rows(got, "doc_id", "n_lines", "n_dropped", "kept_sha256") == brute(docs, 10)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_rows_that_repeat_count_one_by_one(spark, documents, rows, duck, tmp_path):
    docs = [(1, "a line\nanother\na line")] * 12 + [(2, "own\nnine")] * 9 + [(3, "nine"), (None, None), (None, None)]
    df = documents([(i, t, "s") for i, t in docs])
    names = ("doc_id", "n_lines", "n_dropped", "kept_sha256")
    got = rows(linededup.line_report(df), *names)
    assert got == brute(docs, 10)
    df.write.parquet(f"file://{tmp_path}/documents.parquet")
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    done = con.execute(linededup.oracle_sql())
    order = [[d[0] for d in done.description].index(n) for n in names]
    assert got == sorted((tuple(r[i] for i in order) for r in done.fetchall()), key=repr)


def test_texts(documents, rows):
    docs = documents([(i, f"Shared\n{i}", "s") for i in range(3)] + [(9, None, "s")])
    got = linededup.dedup_lines(docs, 3)
    assert got.columns == docs.columns
    assert rows(got, "doc_id", "text", "n_chars") == [(0, "0", 1), (1, "1", 1), (2, "2", 1), (9, None, None)]
    assert linededup.line_report(documents([])).count() == 0

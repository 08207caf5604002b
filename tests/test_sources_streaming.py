from __future__ import annotations

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from notewright.operators import linkage
from notewright.sources import notes, workbook
from notewright.streaming import ingest


def test_notes(spark, tmp_path):
    (tmp_path / "CLM_7_N2.txt").write_bytes(b"\xef\xbb\xbf[MED_NOTE] h\xc3\xa9")
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe")
    (tmp_path / "skip.md").write_text("x")
    strict = {r["doc_id"]: r for r in notes.read_notes_strict(spark, f"file://{tmp_path}").collect()}
    assert strict["CLM_7_N2"]["text"] == "[MED_NOTE] hé" and not strict["bad"]["valid"] and len(strict) == 2
    assert notes.read_notes(spark, f"file://{tmp_path}").count() == 2
    d = spark.createDataFrame([("a", "[MED_NOTE] x"), ("b", "y")], "doc_id string, text string")
    index = spark.createDataFrame([("a", "c1", "o1")], "doc_id string, claim_id string, occurrence_id string")
    got = {r["doc_id"]: r for r in notes.ingest(d, index).collect()}
    assert got["a"]["category"] == "med_note" and got["b"]["claim_id"] == "UNKNOWN"
    names = spark.createDataFrame([(1, "C_1_N10"), (2, "C_1_N2"), (3, "_x"), (4, "C_1_N2")], "id int, stem string")
    p = notes.parse_names(names, "stem", "id").withColumn("k", notes.natural("note")).orderBy("k", "id").collect()
    assert [(r["id"], r["duplicate"]) for r in p] == [(2, False), (4, True), (1, False)]
    h = notes.hashes(d)
    notes.verify_hashes(h, h)
    with pytest.raises(notes.HashMismatch, match="1 changed"):
        notes.verify_hashes(h, notes.hashes(d.withColumn("text", F.when(F.col("doc_id") == "a", "z").otherwise(F.col("text")))))


def test_firm_csv(spark, tmp_path):
    f = tmp_path / "firm.csv"
    f.write_text('﻿Claim_Number,ENTITY_NAME,entity_zip,extra\n"c1","Ann ""A"" Lee",00501,"two\nlines"\nc1,Bob,,\n,nobody,,\n', encoding="utf-8")
    rows, warnings = notes.read_firm_csv(spark, f"file://{f}")
    got = {r["row_id"]: r for r in rows.collect()}
    assert set(got) == {"c1#1", "c1#2"} and got["c1#1"]["entity_name"] == 'Ann "A" Lee' and got["c1#1"]["entity_zip_code"] == "00501" and "entity_TIN" in warnings[0]
    with pytest.raises(ValueError, match="ambiguous"):
        notes.firm_rows(spark.createDataFrame([("a", "b", 0)], "entity_zip string, entity_zip_code string, __order int"))
    with pytest.raises(ValueError, match="at least"):
        notes.firm_rows(spark.createDataFrame([("a", 0)], "x string, __order int"))


def book(cells: str, style: str = "") -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns:r="r"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<R><Relationship Id="r1" Type="x/worksheet" Target="worksheets/s.xml"/></R>')
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>Ann</t></si><si><r><t>B</t></r><r><t>ob</t></r></si></sst>")
        z.writestr("xl/styles.xml", '<s><numFmts><numFmt numFmtId="9" formatCode="00000"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="9"/></cellXfs></s>')
        z.writestr("xl/worksheets/s.xml", f"<ws><sheetData>{cells}</sheetData></ws>")
    return out.getvalue()


def test_workbook(spark, tmp_path):
    raw = book('<row><c r="A1" t="s"><v>1</v></c><c r="C1" s="1"><v>501</v></c></row><row/><row><c r="B3" t="inlineStr"><is><t>x</t></is></c></row>')
    assert list(workbook.sheets(raw)) == [("S", 0, ["Bob", "", "00501"]), ("S", 1, ["", "x"])]
    for bad in ('<row><c r="A1"><f>1+1</f></c></row>', '<row><c r="A1" t="e"><v>#REF!</v></c></row>', '<row><c r="1A"/></row>', '<row><c r="ZZZZ1"/></row>'):
        with pytest.raises(workbook.UnsafeWorkbook):
            list(workbook.sheets(book(bad)))
    (tmp_path / "a.xlsx").write_bytes(raw)
    (tmp_path / "b.xlsx").write_bytes(b"no zip")
    got = workbook.read(spark, f"file://{tmp_path}").collect()
    assert sorted(r["error"] is None for r in got) == [False, True, True]


def frames(docs):
    """A toy extractor: a document is one mention, its text the name."""
    name = F.lower("text")
    return docs.select("doc_id", F.col("doc_id").cast("long").alias("mention_id"), F.lit(1).alias("claim_id"), name.alias("full_name"), name.alias("name_sorted"), F.element_at(F.split(name, " "), 1).alias("first_name"), F.element_at(F.split(name, " "), -1).alias("last_name"))


MODEL = linkage.default_model(["full_name", "name_sorted"])


def test_backfill_ingest_and_stream(spark, tmp_path):
    store = ingest.Store(spark, f"file://{tmp_path}/store")
    note = lambda *rows: spark.createDataFrame(rows, "doc_id string, text string")
    with pytest.raises(ingest.NotBackfilled):
        ingest.ingest(store, note(("9", "x")), frames, MODEL)
    ingest.backfill(store, note(("1", "Ann Lee"), ("2", "Ann Lee"), ("3", "Bob Ito")), frames, MODEL)
    assert store.read("entities").select("entity_id").distinct().count() == 2
    report = {r["entity_id"]: (r["change"], r["n_new"]) for r in ingest.ingest(store, note(("4", "Ann Lee"), ("5", "Cy Poe")), frames, MODEL).collect()}
    assert report == {1: ("grew", 1), 5: ("created", 1)}
    edges = store.read("edges").count()
    ingest.ingest(store, note(("4", "Ann Lee")), frames, MODEL)
    assert store.read("edges").count() == edges and store.read("documents").count() == 5
    seen = []
    inbox = f"file://{tmp_path}/inbox"
    ingest.deliver(note(("6", "Bob Ito"), ("7", "New One")), inbox)

    def on_batch(df, _):
        seen.extend((r["entity_id"], r["change"]) for r in ingest.ingest(store, df, frames, MODEL).collect())

    for _ in range(2):
        q = ingest.stream(spark, inbox, f"file://{tmp_path}/checkpoint", on_batch, once=True)
        q.awaitTermination()
    assert sorted(seen) == [(3, "grew"), (7, "created")]


def test_duplicates_across_batches(spark, tmp_path):
    """Near copies of stored segments take their groups, also in a third batch; other near copies have groups of their own."""
    store = ingest.Store(spark, f"file://{tmp_path}/segments")
    words = lambda c, n=40: [f"{c}{i}" for i in range(n)]
    near = lambda c, k: " ".join([*words(c)[:k], "new", *words(c)[k + 1 :]])
    rows = lambda *xs: spark.createDataFrame([(i, n, 0, t) for n, (i, t) in enumerate(xs)], "segment_id string, order int, char_start int, text string")
    got = lambda df: sorted(tuple(r) for r in df.collect())
    first = ingest.recognise_duplicates(store, rows(("s1", " ".join(words("a"))), ("s2", "too short"), ("s3", "too short")))
    assert got(first) == [("s1", "s1", 1), ("s2", "s2", 1), ("s3", "s3", 1)]
    second = ingest.recognise_duplicates(store, rows(("n1", near("a", 0)), ("n2", " ".join(words("b"))), ("n3", near("b", 39)), ("n4", None)))
    assert got(second) == [("n1", "s1", 0), ("n2", "n2", 1), ("n3", "n2", 0), ("n4", "n4", 1)]
    third = ingest.recognise_duplicates(store, rows(("t1", near("b", 0)), ("t2", near("a", 39)), ("n1", near("a", 0))))
    assert got(third) == [("n1", "s1", 0), ("t1", "n2", 0), ("t2", "s1", 0)]
    assert store.read("segments").count() == 9

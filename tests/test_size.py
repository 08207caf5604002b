"""Steps that must not grow faster than their input, or whose rows depend on which copy is read: the plans' shape, and the rows by brute force."""

from __future__ import annotations

from itertools import combinations

from notewright.operators import linkage

PAIR_FRAME = "mention_id long, email string, npi string, name_soundex string, first_name string"


def by_hand(rows, rules):
    names = PAIR_FRAME.replace(" string", "").replace(" long", "").split(", ")
    out = {}
    for a, b in combinations([dict(zip(names, r, strict=True)) for r in rows], 2):
        hit = [i for i, rule in enumerate(rules) if all(c in a and a[c] is not None and a[c] == b[c] for c in rule)]
        if hit and a["mention_id"] != b["mention_id"]:
            key = tuple(sorted((a["mention_id"], b["mention_id"])))
            out[key] = min(hit[0], out.get(key, 99))
    return sorted((*k, v) for k, v in out.items())


def test_pairs_are_made_without_a_shuffle_of_pairs(spark, monkeypatch):
    """values of many mentions over several shares; a repeated mention's pairs still come once."""
    monkeypatch.setattr(linkage, "LEFT_SHARE", 3)
    monkeypatch.setattr(linkage, "RIGHT_SHARE", 4)
    rules = (("email",), ("npi",), ("name_soundex", "first_name"))
    rows = [(i, f"e{i % 3}" if i % 2 else None, f"n{i % 5}" if i % 3 else None, f"s{i % 2}", "f" if i % 7 else None) for i in range(40)]
    for own, plain in ((rows, True), ([*rows, (3, "e0", "n9", "s0", "f")], False)):
        got = linkage.block(spark.createDataFrame(own, PAIR_FRAME), rules)
        assert sorted(tuple(r) for r in got.collect()) == by_hand(own, rules)
        assert ("Aggregate [id_l" not in got._jdf.queryExecution().optimizedPlan().toString()) == plain  # which would shuffle all pairs
    new = spark.createDataFrame([(5,), (6,)], "mention_id long")
    got = linkage.block(spark.createDataFrame(rows, PAIR_FRAME), rules, new_ids=new).collect()
    assert sorted(tuple(r) for r in got) == [r for r in by_hand(rows, rules) if {5, 6} & set(r[:2])]


def test_overlaps_of_repeated_and_missing_spans(spark):
    """rows are told apart by what they hold, never by a number that a second reading may deal otherwise."""
    from pyspark.sql import functions as F

    from notewright.operators.intervals import overlap_join

    kind = "doc_id long, start int, end int, tag string"
    left = spark.createDataFrame([(1, 0, 9000, "a"), (1, 0, 9000, "b"), (1, 0, 9000, "b"), (1, 9001, 9002, "c"), (2, 0, 5, "d"), (None, 0, 5, "e"), (1, None, 5, "f")], kind)
    right = spark.createDataFrame([(1, 5, 8999, "x"), (1, 7, 8, "y")], kind)
    tags = lambda how, df: sorted(r["tag"] for r in overlap_join(df, right, how=how).collect())
    assert tags("left_semi", left) == ["a", "b", "b"] and tags("left_anti", left) == ["c", "d", "e", "f"]
    # Rows that come in another order at each reading, as those of a shuffle may on a cluster.
    unsteady = spark.range(2000, numPartitions=4).select((F.col("id") % 50).alias("doc_id"), F.col("id").cast("int").alias("start"), (F.col("id") + 1).cast("int").alias("end"), F.col("id").cast("string").alias("tag")).orderBy(F.rand())
    some = spark.range(0, 2000, 3).select((F.col("id") % 50).alias("doc_id"), F.col("id").cast("int").alias("start"), (F.col("id") + 1).cast("int").alias("end"))
    assert sorted(int(r["tag"]) for r in overlap_join(unsteady, some, how="left_semi").collect()) == list(range(0, 2000, 3))
    assert "monotonically" not in overlap_join(unsteady, some, how="left_anti")._jdf.queryExecution().toString()


def test_citations_of_empty_and_very_long_documents(spark, duck, tmp_path):
    """F16: a document without characters is known, and one of more than 900,000 has bounds too."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    import __spark_entry__ as entry

    texts = ["", "", "x", "x", "", "y" * 20, "z" * 900_001, "x", "x", "w" * 70]
    pq.write_table(pa.table({"doc_id": list(range(10)), "text": texts}), tmp_path / "documents.parquet")
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet'")
    want = con.execute(entry.oracle_sql()["j03_citations"]).fetchall()
    got = [tuple(r) for r in entry.queries()["j03_citations"](spark, str(tmp_path)).select("citation_id", "reason").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_pairs_are_counted_without_being_made(spark):
    """counts of each rule as by hand, and no join in the plan."""
    rules = (("email",), ("vin",), ("npi",), ("name_soundex", "first_name"))
    rows = [(i, f"e{i % 3}" if i % 2 else None, f"n{i % 5}" if i % 3 else None, f"s{i % 2}", "f" if i % 7 else None) for i in range(40)]
    for own, plain in ((rows, True), ([*rows, (3, "e0", "n9", "s0", "f")], False)):
        got = linkage.rule_counts(spark.createDataFrame(own, PAIR_FRAME), rules)
        want = [r[2] for r in by_hand(own, rules)]
        assert sorted(tuple(r) for r in got.collect()) == [(k, want.count(k)) for k in sorted(set(want))]
        assert (" Join" not in got._jdf.queryExecution().optimizedPlan().toString()) == plain


def test_links_are_no_more_than_mentions(spark):
    """the components of all pairs from a link a mention and rule."""
    from notewright.operators.components import connected_components

    rules = (("email",), ("npi",))
    rows = [(i, f"e{i // 4}" if i % 3 else None, f"n{i % 11}" if i % 5 == 0 else None, None, None) for i in range(60)]
    f = spark.createDataFrame(rows, PAIR_FRAME)
    few = linkage.links(f, rules)
    assert few.count() <= sum(r[1] is not None for r in rows) + sum(r[2] is not None for r in rows)
    every = spark.createDataFrame([r[:2] for r in by_hand(rows, rules)], "a long, b long")
    parts = lambda e: sorted(tuple(r) for r in connected_components(e, f.select("mention_id")).collect())
    assert parts(few) == parts(every)


def test_shared_attributes_without_a_shuffle_of_pairs(spark, monkeypatch):
    """pairs and their values as by hand, of entities with few and with many attributes; the nearest as of all."""
    from notewright.operators import graph, retrieve

    rows = [(i, "phone", str(i % 4)) for i in range(20)] + [(i, "email_domain", f"d{i % 3}") for i in range(20)] + [(i, "npi", "7") for i in range(0, 20, 9)] + [(2, "phone", "")]
    held = {i: {r[1:] for r in rows if r[0] == i and r[2]} for i in range(20)}
    want = []
    for a in held:
        for b in held:
            if a != b and (s := held[a] & held[b]):
                want.append((a, b, sorted(f"{f}={v}" for f, v in s), min(2 if f == "email_domain" else 1 for f, _ in s)))
    i = spark.createDataFrame(rows, "entity_id long, field string, value string")
    got = graph.shared_attributes(i)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert "Aggregate [entity_id" not in got._jdf.queryExecution().optimizedPlan().toString()
    near = lambda links: sorted(tuple(r) for r in retrieve.enrich(i.select("entity_id").distinct(), links, 3).collect())
    assert near(graph.shared_attributes(i, nearest=3)) == near(got)
    monkeypatch.setattr(graph, "FEW_ATTRIBUTES", 2)
    assert sorted(tuple(r) for r in graph.shared_attributes(i).collect()) == sorted(want)


def test_equal_records_are_met_once(spark):
    """the least uid of the agreeing records, nulls included, from one row for equal records."""
    from notewright.operators import annotate

    r = spark.createDataFrame([(5, "a", None), (3, "a", None), (4, "b", 1), (9, "b", 1)], "uid long, note string, field int")
    c = spark.createDataFrame([(1, "a", None), (2, "b", 1), (3, "b", 2)], "candidate_id long, note string, field int")
    got = annotate.identical(r, c, ["note", "field"])
    assert sorted(tuple(x) for x in got.collect()) == [(1, 3), (2, 4)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("min(uid") == 2  # before the join and after it


def test_equal_surfaces_are_met_once(spark):
    """F8: bindings as before, with the least mention of equal texts; mentions are grouped before they are joined."""
    from notewright.sources import notes

    relations = spark.createDataFrame([(1, "red car"), (2, "red ca"), (3, "red ca"), (4, "zzz"), (5, None), (6, "a red car here")], "rel long, t string")
    mentions = spark.createDataFrame([(7, "red car"), (6, "red car"), (8, "old red car"), (9, None)], "mention long, s string")
    got = notes.bind_surfaces(relations, mentions)
    assert sorted(tuple(x) for x in got.select("rel", "mention", "how").collect()) == [(1, 6, "exact"), (2, 6, "partial"), (3, 6, "partial"), (6, 6, "partial")]
    assert "Aggregate [s" in got._jdf.queryExecution().optimizedPlan().toString()

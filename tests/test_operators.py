from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from notewright.functions import drafts, gazetteers
from notewright.operators import annotate, components, coref, evaluate, extract, generators, graph, intervals, linkage, profile, retrieve, vectors

SPAN = "doc_id long, span_id int, start int, end int"


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def spans(spark):
    r = random.Random(4)
    out = []
    for i in range(300):
        a = r.choice([r.randrange(50), r.randrange(3 * intervals.STRETCH)])
        out.append((r.randrange(3), i, a, a + r.choice([1, 5, 40, 9000])))
    out += out[:3]
    return out, spark.createDataFrame(out, SPAN)


def test_overlap_join_against_loops(spans):
    data, df = spans
    left, right = data[:150], data[150:]
    split = F.col("span_id") < 150
    a, b = df.where(split), df.where(~split)
    data_a, data_b = [s for s in data if s[1] < 150], [s for s in data if s[1] >= 150]
    meets = lambda x, y: x[0] == y[0] and x[2] < y[3] and y[2] < x[3]
    assert rows(intervals.overlap_join(a, b), "span_id", "span_id_r") == sorted(((x[1], y[1]) for x in data_a for y in data_b if meets(x, y)), key=repr)
    assert rows(intervals.overlap_join(a, b, how="left_semi"), "span_id") == sorted(((x[1],) for x in data_a if any(meets(x, y) for y in data_b)), key=repr)
    assert rows(intervals.overlap_join(a, b, how="left_anti"), "span_id") == sorted(((x[1],) for x in data_a if not any(meets(x, y) for y in data_b)), key=repr)
    assert len(left) and len(right)


def test_span_union_depends_on_order_not_on_rows(spark):
    s = [(1, 0, 5, "Marge", "person", ["a"], 0.5, None), (1, 0, 12, "Marge Wilson", "attorney", ["b"], 0.7, "d"), (1, 13, 15, "x", "person", ["a"], 0.1, None), (2, 0, 3, "Ann", "person", ["a"], 0.2, None)]
    kind = "doc_id long, start int, end int, text string, label string, extractors array<string>, score double, description string"
    for data in (s, s[::-1]):
        got = intervals.union_spans(spark.createDataFrame(data, kind))
        assert rows(got, "doc_id", "text", "label", "extractors", "score") == [(1, "Marge Wilson", "attorney", ["a", "b"], 0.7), (1, "x", "person", ["a"], 0.1), (2, "Ann", "person", ["a"], 0.2)]
    assert intervals.union_spans(spark.createDataFrame([], kind)).count() == 0


def test_components_against_union_find(spark):
    r = random.Random(7)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(1, 1), (None, 3)] + [(500 + i, 501 + i) for i in range(60)] + [(900, 900 + i) for i in range(40)]
    parent = {i: i for i in [*range(200), *range(500, 561), *range(900, 940), 7777]}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a in parent and b in parent:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long"), spark.createDataFrame([(i,) for i in parent], "v long"))
    assert dict(rows(got, "node", "component")) == {i: find(i) for i in parent}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_threshold_sweep_is_monotone(spark):
    r = random.Random(1)
    e = spark.createDataFrame([(r.randrange(60), r.randrange(60), r.random()) for _ in range(80)], "a long, b long, probability double")
    got = rows(components.threshold_sweep(e, spark.range(60).toDF("v"), [0.2, 0.5, 0.8]), "threshold", "n_components")
    counts = [n for _, n in got]
    assert counts == sorted(counts) and counts[-1] <= 60


def test_chunks_cover_and_overlap(spark):
    text = "\n " + " ".join(f"w{i}" for i in range(500)) + "  \n"
    d = spark.createDataFrame([(1, text), (2, ""), (3, "one two")], "doc_id long, text string")
    got = [r.asDict() for r in generators.chunks(d).orderBy("doc_id", "index").collect()]
    own = [c for c in got if c["doc_id"] == 1]
    assert own[0]["char_start"] == 0 and own[-1]["char_end"] == len(text) and all(text[c["char_start"] : c["char_end"]] == c["text"] for c in own)
    assert [c["n_words"] for c in own][:2] == [230, 230] and all(b["char_start"] <= a["char_end"] for a, b in zip(own, own[1:], strict=False))
    assert [c["char_end"] for c in got if c["doc_id"] > 1] == [0, 7]


def test_segments_tile(spark):
    text = "Hello\n> a\n>> b\n\nBye\n"
    got = sorted(rows(generators.segments(spark.createDataFrame([(1, text), (2, "")], "doc_id long, text string")), "char_start", "char_end", "kind", "text"))
    assert [g[3] for g in got] == ["Hello\n", "> a\n>> b\n", "\nBye\n"] and [g[2] for g in got] == ["body", "quoted", "body"] and got[-1][1] == len(text)


def test_gazetteer(spark):
    t = "NPI 1568291037, call (555) 010-9999; dx M54.5 SSN 123-45-6789 at 12 Oak St, Salem, OR 97301."
    got = {r["label"]: (r["text"], r["valid"]) for r in gazetteers.scan(spark.createDataFrame([(1, t), (2, None)], "doc_id long, text string")).collect()}
    assert got["npi"] == ("1568291037", True) and got["icd10"] == ("M54.5", True) and got["ssn"][0] == "123-45-6789" and got["phone"][1]
    assert got["address"][0].startswith("12 Oak St") and "zip" not in got
    assert {r["label"] for r in gazetteers.scan_checksum_verified(spark.createDataFrame([(1, t)], "doc_id long, text string")).collect()} == {"npi"}


FRAME = "mention_id long, claim_id long, full_name string, name_sorted string, first_name string, last_name string, email string, npi string, phone7 string"


def test_blocking_nulls_and_first_rule(spark):
    f = spark.createDataFrame([(1, 1, "a b", "a b", "a", "b", "x@y", None, None), (2, 1, "a b", "a b", "a", "b", "x@y", None, None), (3, 1, "q", "q", "q", "q", None, "7", None), (4, 2, "r", "r", "r", "r", None, "7", None), (5, 2, None, None, None, None, None, None, None)], FRAME)
    assert rows(linkage.block(f), "id_l", "id_r", "match_key") == [(1, 2, 0), (3, 4, 1)]
    assert rows(linkage.block(f, new_ids=f.where("mention_id = 4").select("mention_id")), "id_l", "id_r") == [(3, 4)]
    with pytest.raises(ValueError):
        linkage.block(f, (("nothing",),))


def test_model_is_refused_for_other_data(spark):
    f = spark.createDataFrame([(1, 1, "a b", "a b", "a", "b", "x@y", None, "1"), (2, 1, "a b", "a b", "a", "b", "x@y", "8", "1")], FRAME)
    levels = linkage.gammas(linkage.paired(linkage.block(f), f))
    model = linkage.default_model(["full_name", "name_sorted", "email", "npi", "phone7"])
    s = linkage.score(levels, model).first()
    assert s["gamma_npi"] == -1 and s["gamma_full_name"] == 5 and s["probability"] > 0.9 and s["uncalibrated"] == ""
    with pytest.raises(linkage.UncalibratedModel):
        linkage.score(levels, linkage.default_model(["email"]))
    model.estimated["email"][4] = False
    assert linkage.score(levels, model).first()["uncalibrated"] == "email"
    lineage = linkage.contributions(levels, model).orderBy("step").collect()
    assert lineage[-1]["running_probability"] == pytest.approx(s["probability"])


def test_em_separates_matches():
    u = {"a": [0.9, 0.1], "b": [0.9, 0.1], "c": [0.9, 0.1]}
    counts = [({"a": 1, "b": 1, "c": 1}, 90), ({"a": 1, "b": 1, "c": 0}, 10), ({"a": 0, "b": 0, "c": 0}, 800), ({"a": 1, "b": 0, "c": 0}, 90), ({"a": 0, "b": 1, "c": 0}, 90), ({"a": 0, "b": 0, "c": -1}, 9)]
    m, seen = linkage.expectation_maximisation(counts, u, 0.1)
    assert m["a"][1] > 0.8 and m["c"][1] > 0.7 and seen["c"] == [True, True]


def test_cannot_link(spark):
    c = ["full_name", "address_key", "npi", "tin", "ssn"]
    kind = ", ".join(f"{x}_{s} string" for x in c for s in "lr")
    data = [("ann lee jr", "ann lee sr", "k", "k", None, None, None, None, None, None), ("a", "b", None, None, "1", "2", None, None, None, None), ("a", "b", None, None, "1", None, None, None, "3", "3")]
    assert [r["x"] for r in spark.createDataFrame(data, kind).select(linkage.cannot_link().alias("x")).collect()] == ["jr_sr_conflict", "conflicting_npi", None]


def test_coref_and_views(spark):
    t = "Ann Lee saw Oak Clinic. She liked it; the shop did not shopping."
    d = spark.createDataFrame([(1, t)], "doc_id long, text string")
    m = spark.createDataFrame([(1, 1, 0, 7, "claimant", "Ann Lee"), (1, 2, 12, 22, "medical_provider", "Oak Clinic")], "doc_id long, mention_id int, start int, end int, label string, surface string")
    links = coref.resolve(d, m)
    assert rows(links, "surface", "antecedent_surface") == [("She", "Oak Clinic"), ("it", "Oak Clinic")]
    body, marks = coref.view(t, [(24, 27, "Ann Lee")])
    assert body.startswith("Ann Lee saw Oak Clinic. Ann Lee liked") and coref.project(32, 37, marks, len(t)) == (28, 33)
    assert coref.resolved_views(d, links).first()["resolved"].count("Oak Clinic") == 3


def test_knn_and_buckets(spark):
    import numpy as np

    r = np.random.default_rng(0)
    data = [(i, i % 2, r.normal(size=8).tolist()) for i in range(60)] + [(99, 0, [0.0] * 8)]
    df = spark.createDataFrame(data, "vec_id long, class int, vector array<double>")
    got = {(x["vec_id"], x["rank"]): x["other"] for x in vectors.knn(df, 3).collect()}
    unit = {i: np.array(v) / np.linalg.norm(v) for i, _, v in data if any(v)}
    for i in range(60):
        best = sorted((-float(unit[i] @ unit[j]), j) for j in unit if j != i and j % 2 == i % 2)[:3]
        assert [got[i, k + 1] for k in range(3)] == [j for _, j in best]
    with pytest.raises(vectors.NoRealVectors):
        vectors.embedding_buckets(df, real=False)
    assert abs(sum(x * x for x in vectors.hashed_embedding("abc")) - 1) < 1e-9


def test_annotation_log(spark):
    log = spark.createDataFrame([(1, 1, "accepted", "a"), (1, 2, "accepted", "b"), (2, 1, "accepted", "c"), (2, 2, "retired", "c")], "uid long, revision long, state string, value string")
    assert rows(annotate.current(log), "uid", "value") == [(1, "b")]
    after, refused = annotate.undo(log, spark.createDataFrame([(1, '{"state":"accepted","value":"a"}', '{"state":"accepted","value":"b"}'), (2, None, "{}")], "uid long, before string, after string"))
    assert rows(refused, "uid") == [(2,)] and rows(annotate.current(after), "uid", "revision", "value") == [(1, 3, "a")]


def test_answers_are_rescued():
    assert drafts.rescue('{"a": 1,}')[0] == {"a": 1} and drafts.rescue("{“a”: 1}")[0] == {"a": 1} and drafts.rescue("{'a': None}")[0] == {"a": None} and drafts.rescue("nothing")[0] is None
    found, broken, left = drafts.objects('x {"a": "}"} y\n{"b": {"c": 1}} {"d":')
    assert left == [(1, "x  y")]
    assert found == [(1, '{"a": "}"}'), (2, '{"b": {"c": 1}}')] and broken
    assert drafts.locate("He said “the  end”", '"the end"')[:3] == ("normalized", 8, 18) and drafts.locate("the he", "he")[1:3] == (4, 6)
    assert drafts.locate("a b a b", "a")[0] == "ambiguous" and drafts.locate("a b a b", "a", occurrence=2)[1] == 4 and drafts.locate("a b x a b", "a", before="x")[1] == 6


def test_lanes_and_sweep(spark):
    t = "Contacted James Moore. Dr. Alicia Reyes and Reyes, Alicia; counsel Bell at Harbor Injury Group."
    found = {t[a:b]: label for a, b, label, _ in extract.name_spans(t)}
    assert found["James Moore"] == "person" and found["Dr. Alicia Reyes"] == "medical_provider" and found["Reyes, Alicia"] == "person" and "Harbor Injury Group" in found
    chunks = spark.createDataFrame([(1, 0, t)], "doc_id long, char_start int, text string")
    spans = extract.extract(chunks, {"token_ner": extract.names_lane, "llm": extract.salient_lane})
    assert all(r["text"] == t[r["start"] : r["end"]] for r in spans.collect())
    assert any(len(r["extractors"]) == 2 for r in spans.collect())
    with pytest.raises(extract.NoModel):
        extract.lane(chunks, None, "llm")
    left = extract.sweep(chunks, spans)
    assert ("Bell",) in rows(left, "text") and ("Bell", "attorney") in rows(extract.promote(left), "text", "label")
    assert extract.promote(left, structure_only=True).count() == 0


def test_relations(spark):
    raw = spark.createDataFrame([(1, "Ann", "went to", "Oak Clinic", "asserted", "Ann went to Oak", "Ann went to Oak Clinic."), (1, "He", "has npi", "1", "sure", "not said", "Ann.")], "doc_id long, subject string, predicate string, object string, polarity string, evidence string, text string")
    got = rows(extract.relations(raw), "predicate", "refused", "polarity_coerced", "subject_is_descriptor")
    assert got == [("HAS_NPI", "identifier", True, True), ("TREATED_BY", None, False, False)]


def test_plans():
    p = retrieve.plan_question("Which attorneys share the same phone on several claims?")
    assert p.entity_class == "attorney" and p.link_via == ("phone",) and p.cross_reference
    assert retrieve.plan_question("Who is named Ann Lee?").filters == (retrieve.Filter("name", "fuzzy", "Ann Lee"),)
    with pytest.raises(retrieve.UnknownField):
        retrieve.matches(retrieve.Filter("shoe", "eq", "9"))
    for f in retrieve.FIELDS:
        for op in retrieve.OPS:
            retrieve.matches(retrieve.Filter(f, op, "x")) if op != "fuzzy" else None


def test_scores_without_anything_to_score(spark):
    kind = "claim long, entity_id long, field string, value string"
    got = evaluate.detail_scores(spark.createDataFrame([], kind), spark.createDataFrame([], kind)).first()
    assert got["reported"] == 0 and got["detail_accuracy"] is None and got["missed_rate"] is None
    four = [(1, i, "phone", str(i)) for i in range(4)]
    reported = [(1, 0, "phone", "0"), (1, 1, "phone", "1"), (1, 3, "phone", "2"), (1, 3, "phone", "9")]
    got = evaluate.detail_scores(spark.createDataFrame(reported, kind), spark.createDataFrame(four, kind)).first()
    assert (got["detail_accuracy"], got["missed_rate"], got["made_up_rate"]) == (0.75, 0.5, 0.25) and got["right_owner_rate"] == pytest.approx(2 / 3)


def test_graph_and_profile(spark):
    e = spark.createDataFrame([("a", "b", "visits"), ("b", "c", "mentioned in"), ("b", "c", "treats"), ("c", "d", "x")], "src string, dst string, predicate string")
    clean = graph.clean_edges(e)
    assert clean.count() == 3
    got = rows(graph.neighbours(clean, spark.createDataFrame([("a",)], "id string"), 2), "src", "dst", "hop")
    assert got == [("a", "b", 1), ("b", "c", 2)]
    a = spark.createDataFrame([(1, "has_npi", "1568291037", "llm", "asserted", 1, None), (1, "has_npi", "123", "llm", "asserted", 2, None), (1, "x", "v", "llm", "retracted", 3, None)], "entity_id long, attribute string, value_norm string, extractor string, polarity string, seq int, valid_from string")
    s = profile.survivorship(a.withColumn("tier", profile.tier(F.col("attribute"), F.col("extractor"), F.col("value_norm"))))
    assert rows(s, "value_norm", "tier", "known_to", "conflict_flag") == [("123", "narrative", None, 0), ("1568291037", "validated_id", None, 0), ("v", "narrative", "retracted", 0)]


def test_scoped_answer_reads_all_documents(spark, tmp_path):
    import __spark_entry__ as entry

    docs = [(1, "the token of the claim", "src0"), (13, "the token of a claim", "src0"), (20, "nothing alike here", "src0"), (21, "the token of the claim", "src1")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = entry.queries()["j02_scoped_answer"](spark, str(tmp_path))
    assert rows(got, "src", "dst", "predicate", "hop") == [("ent:1", "claim:src0", "PARTY_TO", 1), ("ent:6", "claim:src0", "PARTY_TO", 1)]

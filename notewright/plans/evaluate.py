"""Queries over measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from notewright.operators import annotate, evaluate
from notewright.plans import query, table
from notewright.plans.generators import SPANS_SQL, spans

# Items of orders: a customer's remainder is the system's entity, another the gold one.
ITEMS_SQL = "(SELECT o_orderkey AS item, o_custkey % 120 AS pred, (o_custkey % 120) // 2 + o_orderkey % 13 // 12 AS gold FROM orders)"


def items(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item"), (F.col("o_custkey") % 120).alias("pred"), (F.floor(F.col("o_custkey") % 120 / 2) + F.floor(F.col("o_orderkey") % 13 / 12)).alias("gold"))


CUBED = "SELECT count(*) AS n, avg(c / np) AS p, avg(c / ng) AS r FROM (SELECT count(*) OVER (PARTITION BY pred, gold) AS c, count(*) OVER (PARTITION BY pred) AS np, count(*) OVER (PARTITION BY gold) AS ng FROM {})"


@query("e06_b_cubed", f"SELECT n, round(p, 9) AS precision, round(r, 9) AS recall, round(2 * p * r / (p + r), 9) AS f1 FROM ({CUBED.format(ITEMS_SQL)})")
def e06(spark, sf_dir):
    b = evaluate.b_cubed(items(spark, sf_dir))
    return b.select("n", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query("e07_b_cubed_sweep", " UNION ALL ".join(f"SELECT CAST({t} AS DOUBLE) AS threshold, n, round(p, 9) AS precision, round(r, 9) AS recall FROM ({CUBED.format(f'(SELECT o_orderkey AS item, o_custkey % {int(t * 100)} AS pred, o_custkey % 60 AS gold FROM orders)')})" for t in (0.3, 0.6, 0.9)))
def e07(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    labels = o.select(F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), (F.col("o_custkey") % int(t * 100)).alias("pred")) for t in (0.3, 0.6, 0.9)])).alias("x"), F.col("o_orderkey").alias("item")).select("x.*", "item")
    s = evaluate.b_cubed_sweep(labels, o.select(F.col("o_orderkey").alias("item"), (F.col("o_custkey") % 60).alias("gold")))
    return s.select("threshold", "n", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


@query("e08_merges", f"SELECT 'over' AS kind, CAST(pred AS VARCHAR) AS id, count(*) AS n, count(DISTINCT gold) AS parts FROM {ITEMS_SQL} GROUP BY pred HAVING count(DISTINCT gold) > 1 UNION ALL SELECT 'under', CAST(gold AS VARCHAR), count(*), count(DISTINCT pred) FROM {ITEMS_SQL} GROUP BY gold HAVING count(DISTINCT pred) > 1")
def e08(spark, sf_dir):
    return evaluate.merges(items(spark, sf_dir))


GOLD = f"(SELECT * FROM ({SPANS_SQL}) WHERE label = 'person')"
FOUND = f"(SELECT * FROM ({SPANS_SQL}) WHERE label <> 'person')"
HIT = f"EXISTS (SELECT 1 FROM {FOUND} f WHERE f.doc_id = g.doc_id AND g.lo < f.hi AND f.lo < g.hi)"


@query("e09_span_recall", f"SELECT CAST(span_id AS VARCHAR) AS span_id, count(*) AS total, count(*) FILTER (h) AS hits, count(*) FILTER (h) / count(*) AS recall FROM (SELECT span_id, {HIT} AS h FROM {GOLD} g) GROUP BY span_id")
def e09(spark, sf_dir):
    s = spans(spark, sf_dir)
    return evaluate.recall_by(s.where("label = 'person'"), s.where("label <> 'person'"), "span_id")


@query("e09_recall_by_tag", f"SELECT tag AS tags, count(*) AS total, count(*) FILTER (h) AS hits, count(*) FILTER (h) / count(*) AS recall FROM (SELECT unnest(CASE span_id % 3 WHEN 0 THEN ['(none)'] WHEN 1 THEN ['x'] ELSE ['x', 'y'] END) AS tag, {HIT} AS h FROM {GOLD} g) GROUP BY tag")
def e09_tag(spark, sf_dir):
    s = spans(spark, sf_dir)
    k = F.col("span_id") % 3
    gold = s.where("label = 'person'").withColumn("tags", F.when(k == 0, F.array().cast("array<string>")).when(k == 1, F.array(F.lit("x"))).otherwise(F.array(F.lit("x"), F.lit("y"))))
    return evaluate.recall_by_tag(gold, s.where("label <> 'person'"), "tags")


@query("e10_mention_precision", f"""SELECT concat_ws(':', f.doc_id, f.span_id, f.lo, f.hi, f.label) AS mention_id, g.span_id AS gt_id FROM (SELECT DISTINCT * FROM {FOUND}) f LEFT JOIN {GOLD} g ON f.doc_id = g.doc_id AND f.lo < g.hi AND g.lo < f.hi
QUALIFY row_number() OVER (PARTITION BY f.doc_id, f.span_id, f.lo, f.hi, f.label ORDER BY g.lo, g.hi, g.span_id) = 1""")
def e10(spark, sf_dir):
    s = spans(spark, sf_dir)
    found = s.where("label <> 'person'").withColumn("mention_id", F.concat_ws(":", "doc_id", "span_id", "start", "end", "label")).distinct()
    return evaluate.mention_precision(found, s.where("label = 'person'").withColumnRenamed("span_id", "gt_id"))


@query("e11_identifier_recall", f"SELECT label AS identifier_kind, span_id % 2 = 0 AS orphan, count(*) AS total, count(*) FILTER (h) AS hits, count(*) FILTER (h) / count(*) AS recall FROM (SELECT label, span_id, EXISTS (SELECT 1 FROM {GOLD} f WHERE f.doc_id = g.doc_id AND g.lo < f.hi AND f.lo < g.hi) AS h FROM {FOUND} g) GROUP BY 1, 2")
def e11(spark, sf_dir):
    s = spans(spark, sf_dir)
    gold = s.where("label <> 'person'").withColumn("identifier_kind", F.col("label")).withColumn("orphan", F.col("span_id") % 2 == 0)
    return evaluate.identifier_recall(gold, s.where("label = 'person'"))


@query("e12_coref_accuracy", """SELECT hops, count(*) AS total, count(e) AS attempted, count(*) FILTER (e = r) AS correct, count(e) / count(*) AS coverage, CASE WHEN count(e) > 0 THEN count(*) FILTER (e = r) / count(e) END AS of_attempted, count(*) FILTER (e = r) / count(*) AS of_all
FROM (SELECT o_custkey % 3 AS hops, o_custkey % 7 AS r, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 7 END AS e FROM orders) GROUP BY hops""")
def e12(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    chains = o.select(F.col("o_orderkey").alias("anaphor"), (F.col("o_custkey") % 7).alias("referent"), (F.col("o_custkey") % 3).alias("hops"))
    links = o.where("o_orderkey % 4 > 0").select(F.col("o_orderkey").alias("anaphor"), (F.col("o_orderkey") % 7).alias("antecedent_entity"))
    return evaluate.coref_accuracy(chains, links, "hops")


@query("e14_majority_mapping", f"SELECT pred, gold, CAST(n AS BIGINT) AS n, c / n AS share FROM (SELECT pred, gold, count(*) AS c, sum(count(*)) OVER (PARTITION BY pred) AS n FROM {ITEMS_SQL} GROUP BY pred, gold) QUALIFY row_number() OVER (PARTITION BY pred ORDER BY c DESC, gold) = 1")
def e14(spark, sf_dir):
    return evaluate.majority_mapping(items(spark, sf_dir))


@query("e14_never_recovered", f"WITH m AS (SELECT pred, gold FROM (SELECT pred, gold, count(*) AS c FROM {ITEMS_SQL} GROUP BY pred, gold) QUALIFY row_number() OVER (PARTITION BY pred ORDER BY c DESC, gold) = 1) SELECT DISTINCT gold FROM {ITEMS_SQL} WHERE gold NOT IN (SELECT gold FROM m)")
def e14_never(spark, sf_dir):
    i = items(spark, sf_dir)
    return evaluate.never_recovered(i, evaluate.majority_mapping(i))


@query("e16_top_misses", f"SELECT name, total, recall FROM (SELECT CAST(span_id AS VARCHAR) AS name, count(*) AS total, count(*) FILTER (h) / count(*) AS recall FROM (SELECT span_id, {HIT} AS h FROM {GOLD} g) GROUP BY span_id) WHERE total >= 20 AND recall < 0.95 ORDER BY recall, total DESC, name LIMIT 6")
def e16(spark, sf_dir):
    s = spans(spark, sf_dir)
    r = evaluate.recall_by(s.where("label = 'person'"), s.where("label <> 'person'"), "span_id")
    return evaluate.top_misses(r.withColumnRenamed("span_id", "name")).select("name", "total", "recall")


@query("e17_ablation", """WITH g AS (SELECT o_orderkey AS k FROM orders), f AS (SELECT 0 AS position, k FROM g WHERE k % 3 = 0 UNION ALL SELECT 1, k FROM g WHERE k % 3 = 0 OR k % 5 = 0 UNION ALL SELECT 2, k FROM g WHERE k % 5 = 0 OR k % 2 = 0),
n AS (SELECT position, count(*) AS n_found FROM f GROUP BY position), t AS (SELECT count(*) AS total FROM g),
r AS (SELECT a.position, count(*) AS c FROM f a WHERE NOT EXISTS (SELECT 1 FROM f b WHERE b.k = a.k AND b.position = a.position - 1) GROUP BY a.position),
l AS (SELECT a.position + 1 AS position, count(*) AS c FROM f a WHERE NOT EXISTS (SELECT 1 FROM f b WHERE b.k = a.k AND b.position = a.position + 1) GROUP BY a.position)
SELECT ['token', 'union', 'sweep'][n.position + 1] AS stage, n_found, round(n_found / total, 9) AS recall, round(n_found / total - lag(n_found / total) OVER (ORDER BY n.position), 9) AS lift, coalesce(r.c, 0) AS newly_rescued, coalesce(l.c, 0) AS newly_lost FROM n, t LEFT JOIN r ON r.position = n.position LEFT JOIN l ON l.position = n.position""")
def e17(spark, sf_dir):
    g = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("gold_id"))
    k = F.col("gold_id")
    found = g.where(k % 3 == 0).withColumn("stage", F.lit("token")).union(g.where((k % 3 == 0) | (k % 5 == 0)).withColumn("stage", F.lit("union"))).union(g.where((k % 5 == 0) | (k % 2 == 0)).withColumn("stage", F.lit("sweep")))
    a = evaluate.ablation(found, g, ["token", "union", "sweep"])
    return a.select("stage", "n_found", F.round("recall", 9).alias("recall"), F.round("lift", 9).alias("lift"), "newly_rescued", "newly_lost")


@query(
    "e18_literal_recall",
    """SELECT kind, count(*) AS total, count(*) FILTER (pos < doc_id % 60 AND doc_id % 60 > 0) AS hits, count(*) FILTER (pos < doc_id % 60 AND doc_id % 60 > 0) / count(*) AS recall
FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'odd' END AS kind, instr(text, substr(text, 41, 10)) - 1 AS pos FROM documents WHERE length(text) >= 60) GROUP BY kind""",
)
def e18(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("length(text) >= 60")
    values = d.select("doc_id", F.when(F.col("doc_id") % 2 == 0, "even").otherwise("odd").alias("kind"), F.substring("text", 41, 10).alias("value"))
    found = d.select("doc_id", F.lit(0).alias("start"), (F.col("doc_id") % 60).cast("int").alias("end"))
    return evaluate.literal_recall(d.select("doc_id", "text"), values, found)


FLAGS_SQL = "(SELECT o_orderkey AS k, 60 + o_custkey % 41 AS similarity, ['same', 'different', 'cant_tell'][o_orderkey % 3 + 1] AS decision FROM orders)"


def flags(spark, sf_dir):
    d = F.element_at(F.array(*[F.lit(x) for x in ("same", "different", "cant_tell")]), (F.col("o_orderkey") % 3 + 1).cast("int"))
    m = F.when(F.col("o_custkey") % 2 == 0, F.array(F.lit("exact"))).otherwise(F.array(F.lit("exact"), F.lit("genai")))
    return table(spark, sf_dir, "orders").select((60 + F.col("o_custkey") % 41).alias("similarity"), d.alias("decision"), m.alias("methods"))


@query("e25_similarity_bins", f"""SELECT CASE WHEN similarity >= 95 THEN '95–100' WHEN similarity >= 85 THEN '85–94' WHEN similarity >= 75 THEN '75–84' ELSE 'below 75' END AS range, count(*) AS flags, count(*) FILTER (decision = 'same') AS confirmed_same, count(*) FILTER (decision = 'cant_tell') AS cant_tell,
 count(*) FILTER (decision = 'same') / count(*) FILTER (decision <> 'cant_tell') AS rate FROM {FLAGS_SQL} GROUP BY 1""")
def e25(spark, sf_dir):
    return evaluate.similarity_bins(flags(spark, sf_dir))


@query("e25_watchlist_methods", """SELECT method, count(*) FILTER (d = 'same') AS same, count(*) FILTER (d = 'different') AS different, count(*) FILTER (d = 'cant_tell') AS cant_tell, count(*) FILTER (d = 'same') / count(*) FILTER (d <> 'cant_tell') AS precision
FROM (SELECT unnest(CASE WHEN o_custkey % 2 = 0 THEN ['exact'] ELSE ['exact', 'genai'] END) AS method, ['same', 'different', 'cant_tell'][o_orderkey % 3 + 1] AS d FROM orders) GROUP BY method""")
def e25_methods(spark, sf_dir):
    return evaluate.watchlist_methods(flags(spark, sf_dir))


GOLD_D = "(SELECT DISTINCT o_custkey % 50 AS claim, o_custkey % 400 AS entity_id, 'phone' AS field, CAST(o_orderkey % 97 AS VARCHAR) AS value FROM orders WHERE o_orderkey % 3 > 0)"
FIRM_D = "(SELECT o_custkey % 50 AS claim, CASE WHEN o_orderkey % 5 > 0 THEN o_custkey % 400 END AS entity_id, 'phone' AS field, CAST(o_orderkey % 101 AS VARCHAR) AS value FROM orders WHERE o_orderkey % 2 = 0)"


@query("e24_firm_scores", f"""WITH g AS {GOLD_D}, f AS {FIRM_D}, m AS (SELECT *, EXISTS (SELECT 1 FROM g WHERE g.claim = f.claim AND g.field = f.field AND g.value = f.value) AS c, EXISTS (SELECT 1 FROM g WHERE g.claim = f.claim AND g.entity_id = f.entity_id AND g.field = f.field AND g.value = f.value) AS o FROM f),
r AS (SELECT count(*) AS reported, count(*) FILTER (c) AS correct, count(*) FILTER (o) AS right_owner, count(*) FILTER (NOT c) AS made_up FROM m), n AS (SELECT count(*) AS gold_details, count(*) FILTER (NOT EXISTS (SELECT 1 FROM f WHERE g.claim = f.claim AND g.entity_id = f.entity_id AND g.field = f.field AND g.value = f.value)) AS missed FROM g)
SELECT *, correct / reported AS detail_accuracy, right_owner / correct AS right_owner_rate, made_up / reported AS made_up_rate, missed / gold_details AS missed_rate FROM r, n""")
def e24(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    claim, phone = (F.col("o_custkey") % 50).alias("claim"), F.lit("phone").alias("field")
    gold = o.where("o_orderkey % 3 > 0").select(claim, (F.col("o_custkey") % 400).alias("entity_id"), phone, (F.col("o_orderkey") % 97).cast("string").alias("value"))
    firm = o.where("o_orderkey % 2 = 0").select(claim, F.when(F.col("o_orderkey") % 5 > 0, F.col("o_custkey") % 400).alias("entity_id"), phone, (F.col("o_orderkey") % 101).cast("string").alias("value"))
    return evaluate.detail_scores(firm, gold)


@query("e26_draft_scores", """WITH d AS (SELECT o_custkey % 20 AS claim, o_custkey % 7 AS note, CASE WHEN o_orderkey % 3 = 0 THEN 'accepted' WHEN o_orderkey % 3 = 1 THEN 'dismissed' ELSE 'ready' END AS status, o_orderkey % 6 = 0 AS edited FROM orders WHERE o_custkey % 2 = 0),
r AS (SELECT o_custkey % 20 AS claim, o_custkey % 7 AS note, CASE WHEN o_orderkey % 4 = 0 THEN 'manual' ELSE 'draft' END AS source FROM orders)
SELECT (SELECT count(*) FILTER (status = 'accepted') / count(*) FILTER (status IN ('accepted', 'dismissed')) FROM d) AS draft_precision, (SELECT count(*) FILTER (status = 'accepted' AND edited) / count(*) FILTER (status = 'accepted') FROM d) AS correction_rate,
 (SELECT count(*) FILTER (source = 'manual') / count(*) FROM r WHERE (claim, note) IN (SELECT (claim, note) FROM d)) AS miss_rate""")
def e26(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    claim, note, k = (F.col("o_custkey") % 20).alias("claim"), (F.col("o_custkey") % 7).alias("note"), F.col("o_orderkey")
    drafts = o.where("o_custkey % 2 = 0").select(claim, note, F.when(k % 3 == 0, "accepted").when(k % 3 == 1, "dismissed").otherwise("ready").alias("status"), (k % 6 == 0).alias("edited"))
    records = o.select(claim, note, F.when(k % 4 == 0, "manual").otherwise("draft").alias("source"))
    return evaluate.draft_scores(drafts, records)


REC_SQL = "(SELECT l_orderkey % 200 AS claim, l_orderkey % 3 AS note, 'r' || CAST(l_suppkey % 3 AS VARCHAR) AS reviewer, 'detail' AS kind, l_partkey % 20 AS lo, l_partkey % 20 + 5 AS hi, CASE WHEN l_linenumber % 2 = 0 THEN 'phone' END AS field FROM lineitem)"


@query("e27_agreement", f"""WITH s AS (SELECT claim, note, reviewer, list_distinct(list(kind || ':' || lo || ':' || hi || ':' || coalesce(field, ''))) AS s FROM {REC_SQL} GROUP BY claim, note, reviewer)
SELECT a.claim, a.note, a.reviewer AS reviewer_a, b.reviewer AS reviewer_b, CAST(len(list_intersect(a.s, b.s)) AS BIGINT) AS shared, CAST(len(list_distinct(list_concat(a.s, b.s))) AS BIGINT) AS either, len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))) AS agreement FROM s a JOIN s b ON a.claim = b.claim AND a.note = b.note AND a.reviewer < b.reviewer""")
def e27(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    r = li.select((F.col("l_orderkey") % 200).alias("claim"), (F.col("l_orderkey") % 3).alias("note"), F.concat(F.lit("r"), (F.col("l_suppkey") % 3).cast("string")).alias("reviewer"), F.lit("detail").alias("kind"), (F.col("l_partkey") % 20).alias("start"), (F.col("l_partkey") % 20 + 5).alias("end"), F.when(F.col("l_linenumber") % 2 == 0, "phone").alias("field"))
    a = evaluate.jaccard_agreement(r)
    return a.withColumn("shared", F.col("shared").cast("long")).withColumn("either", F.col("either").cast("long"))


@query("e28_completeness", """SELECT claim, count(*) AS n_rows, count(d) AS n_decided, bool_and(d IS NOT NULL) AS complete, sha256(string_agg(m, '|' ORDER BY m)) AS digest FROM (SELECT o_custkey % 300 AS claim, o_orderkey, CASE WHEN o_custkey % 4 > 0 THEN o_orderstatus END AS d, CAST(o_orderkey AS VARCHAR) || ':' || coalesce(CASE WHEN o_custkey % 4 > 0 THEN o_orderstatus END, '') AS m FROM orders) GROUP BY claim""")
def e28(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    rows = o.select((F.col("o_custkey") % 300).alias("claim"), F.col("o_orderkey").alias("row_id"))
    return annotate.completeness(rows, o.where("o_custkey % 4 > 0").select(F.col("o_orderkey").alias("row_id"), F.col("o_orderstatus").alias("decision")))


@query("e29_head_nouns", """WITH n AS (SELECT string_split(lower(p_name), ' ') AS w FROM part), e AS (SELECT w[-1] AS token, count(DISTINCT array_to_string(w[1:len(w) - 1], ' ')) AS n FROM n WHERE len(w) >= 2 GROUP BY w[-1])
SELECT token FROM e WHERE n >= 3 AND token NOT IN (SELECT w[1] FROM n WHERE len(w) >= 2)""")
def e29(spark, sf_dir):
    return evaluate.head_nouns(table(spark, sf_dir, "part").select(F.split(F.lower("p_name"), " ").alias("words")))


@query("e30_micro_macro", "SELECT round(sum(n) / sum(d), 12) AS micro, round(avg(CASE WHEN d > 0 THEN n / d END), 12) AS macro, count(*) AS groups FROM (SELECT o_custkey % 100 AS g, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS n, sum(CASE WHEN o_orderstatus IN ('F', 'O') THEN 1 ELSE 0 END) AS d FROM orders GROUP BY 1)")
def e30(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 100).alias("g"), (F.col("o_orderstatus") == "F").cast("int").alias("n"), F.col("o_orderstatus").isin("F", "O").cast("int").alias("d"))
    return evaluate.micro_macro(o, "g", "n", "d").select(F.round("micro", 12).alias("micro"), F.round("macro", 12).alias("macro"), "groups")


@query("e31_progress", "SELECT c_nationkey AS claim, count(DISTINCT c_custkey) AS notes, count(DISTINCT o_custkey) AS done FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_nationkey")
def e31(spark, sf_dir):
    done = table(spark, sf_dir, "orders").select("o_custkey").distinct()
    j = table(spark, sf_dir, "customer").join(done, F.col("c_custkey") == F.col("o_custkey"), "left")
    return j.groupBy(F.col("c_nationkey").alias("claim")).agg(F.count("c_custkey").alias("notes"), F.count("o_custkey").alias("done"))


OVER_SQL = f"""WITH g AS (SELECT DISTINCT doc_id, lo, hi FROM {GOLD}), f AS (SELECT DISTINCT doc_id, lo, hi FROM {FOUND})
SELECT doc_id, lo AS "start", hi AS "end", CASE WHEN EXISTS (SELECT 1 FROM g WHERE g.doc_id = f.doc_id AND g.lo < f.hi AND f.lo < g.hi) THEN 'TP' ELSE 'FP' END AS verdict FROM f
UNION ALL SELECT doc_id, lo, hi, 'FN' FROM g WHERE NOT EXISTS (SELECT 1 FROM f WHERE g.doc_id = f.doc_id AND g.lo < f.hi AND f.lo < g.hi)"""


@query("j11_overlay", OVER_SQL)
def j11(spark, sf_dir):
    s = spans(spark, sf_dir)
    return evaluate.overlay(s.where("label <> 'person'"), s.where("label = 'person'"))


@query("f10_worst_documents", f"SELECT doc_id, count(*) AS problems FROM ({OVER_SQL}) WHERE verdict <> 'TP' GROUP BY doc_id ORDER BY problems DESC, doc_id LIMIT 40")
def f10(spark, sf_dir):
    s = spans(spark, sf_dir)
    return evaluate.worst_documents(evaluate.overlay(s.where("label <> 'person'"), s.where("label = 'person'")))


@query("j12_contamination", f"WITH i AS {ITEMS_SQL}, m AS (SELECT pred, count(*) AS n FROM i WHERE gold = 5 GROUP BY pred) SELECT i.pred AS component, any_value(m.n) AS of_gold, count(*) FILTER (i.gold <> 5) AS others FROM i JOIN m ON i.pred = m.pred GROUP BY i.pred")
def j12(spark, sf_dir):
    i = items(spark, sf_dir)
    return evaluate.contamination(i.select("item", F.col("pred").alias("component")), i.select("item", "gold"), F.lit(5))


@query("e10_label_quality", "SELECT quality, toxic, count(*) AS n, avg(length(text)) AS chars FROM labels JOIN documents USING (doc_id) GROUP BY quality, toxic")
def e10_quality(spark, sf_dir):
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").groupBy("quality", "toxic").agg(F.count("*").alias("n"), F.avg(F.length("text")).alias("chars"))



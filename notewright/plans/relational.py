"""Queries over sources, joins, order and sets (A, D9-D13, D20-D22, F, G)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from notewright.operators import annotate, duplicates
from notewright.plans import query, table
from notewright.sources import notes


@query("a01_note_scan", "SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars FROM documents WHERE doc_id IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 7 = 0)")
def a01(spark, sf_dir):
    wanted = table(spark, sf_dir, "orders").where("o_orderkey % 7 = 0").select(F.col("o_orderkey").alias("doc_id"))
    return notes.named(table(spark, sf_dir, "documents"), wanted).select("doc_id", F.length("text").cast("long").alias("n_chars"))


@query(
    "a02_document_ingest",
    """SELECT doc_id, coalesce(CAST(o_custkey AS VARCHAR), 'UNKNOWN') AS claim_id, CASE WHEN o_custkey IS NULL THEN 'UNKNOWN' ELSE CAST(o_custkey % 10 AS VARCHAR) END AS occurrence_id,
  lower(regexp_extract('[' || upper(source) || '_NOTE] ' || text, '^\\[([A-Z0-9_]+)\\]', 1)) AS category, CAST(length('[' || upper(source) || '_NOTE] ' || text) AS BIGINT) AS n_chars FROM documents LEFT JOIN orders ON doc_id = o_orderkey AND o_orderkey % 2 = 0""",
)
def a02(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("["), F.upper("source"), F.lit("_NOTE] "), "text").alias("text"))
    index = table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").cast("string").alias("claim_id"), (F.col("o_custkey") % 10).cast("string").alias("occurrence_id"))
    return notes.ingest(d, index).select("doc_id", "claim_id", "occurrence_id", "category", "n_chars")


@query(
    "a03_note_names",
    """WITH n AS (SELECT c_custkey AS id, 'CLM_' || CAST(c_nationkey AS VARCHAR) || '_N' || CAST(c_custkey % 40 AS VARCHAR) AS stem FROM customer),
p AS (SELECT id, regexp_extract(stem, '^(.+)_([^_]+)$', 1) AS claim, regexp_extract(stem, '^(.+)_([^_]+)$', 2) AS note FROM n)
SELECT id, claim, note, row_number() OVER (PARTITION BY claim, note ORDER BY id) > 1 AS duplicate, row_number() OVER (PARTITION BY claim ORDER BY CAST(substr(note, 2) AS INTEGER), id) AS position FROM p""",
)
def a03(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("CLM_"), F.col("c_nationkey").cast("string"), F.lit("_N"), (F.col("c_custkey") % 40).cast("string")).alias("stem"))
    p = notes.parse_names(c, "stem", "id")
    w = Window.partitionBy("claim").orderBy(notes.natural("note"), "id")
    return p.select("id", "claim", "note", "duplicate", F.row_number().over(w).cast("long").alias("position"))


@query("a12_replace_documents", "SELECT o_orderkey AS doc_id, o_custkey AS v FROM orders WHERE o_orderkey % 5 <> 0 UNION ALL SELECT o_orderkey, -1 FROM orders WHERE o_orderkey % 5 = 0")
def a12(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("v"))
    new = o.where("doc_id % 5 = 0").withColumn("v", F.lit(-1).cast("long"))
    return annotate.replace_documents(o, new, new)


@query("a11_upsert", "SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_custkey % 4 <> 0 UNION ALL SELECT c_custkey, 0.0 FROM customer WHERE c_custkey % 4 = 0")
def a11(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    return annotate.upsert(c, c.where("k % 4 = 0").withColumn("v", F.lit(0.0)), "k")


@query(
    "a15_corrections",
    """SELECT l_orderkey AS doc_id, CAST(CASE WHEN l_linenumber = 1 THEN 1001 WHEN l_linenumber = 2 THEN 2050 ELSE l_linenumber * 1000 END AS INTEGER) AS "start", CAST(CASE WHEN l_linenumber = 1 THEN 1012 WHEN l_linenumber = 2 THEN 2060 ELSE l_linenumber * 1000 + 10 END AS INTEGER) AS "end",
  CASE WHEN l_linenumber = 2 THEN 'g9' WHEN l_linenumber = 1 THEN 'g1' ELSE 'g0' END AS gt_id FROM lineitem""",
)
def a15(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    at = (F.col("l_linenumber") * 1000).cast("int")
    p = li.select(F.col("l_orderkey").alias("doc_id"), at.alias("start"), (at + 10).alias("end"), F.lit("entity").alias("kind"), F.lit("g0").alias("gt_id"))
    n = F.lit(None).cast("int")
    one = li.where("l_linenumber = 1").select("l_orderkey", F.lit(1000).alias("os"), F.lit(1010).alias("oe"), F.lit(1001).alias("s"), F.lit(1012).alias("e"), F.lit("g1").alias("g"), F.lit(1).alias("seq"))
    # the second span is first moved, then renamed at the place it was moved to
    two = li.where("l_linenumber = 2").select("l_orderkey", F.lit(2000).alias("os"), F.lit(2010).alias("oe"), F.lit(2050).alias("s"), F.lit(2060).alias("e"), F.lit("g8").alias("g"), F.lit(2).alias("seq"))
    three = li.where("l_linenumber = 2").select("l_orderkey", n.alias("os"), n.alias("oe"), F.lit(2050).alias("s"), F.lit(2060).alias("e"), F.lit("g9").alias("g"), F.lit(3).alias("seq"))
    c = one.union(two).union(three).select(F.col("l_orderkey").alias("doc_id"), F.col("os").alias("orig_start"), F.col("oe").alias("orig_end"), F.col("s").alias("start"), F.col("e").alias("end"), F.lit("entity").alias("kind"), F.col("g").alias("gt_id"), "seq")
    return annotate.corrected(p, c).select("doc_id", "start", "end", "gt_id")


@query(
    "a21_hash_verify",
    """WITH b AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 10 <> 1), a AS (SELECT doc_id, sha256(CASE WHEN doc_id % 10 = 3 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 10 <> 2)
SELECT coalesce(b.doc_id, a.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'missing' WHEN b.doc_id IS NULL THEN 'extra' ELSE 'changed' END AS change FROM b FULL JOIN a ON b.doc_id = a.doc_id WHERE a.doc_id IS NULL OR b.doc_id IS NULL OR a.h <> b.h""",
)
def a21(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    before = notes.hashes(d.where("doc_id % 10 <> 1"))
    after = notes.hashes(d.where("doc_id % 10 <> 2").withColumn("text", F.when(F.col("doc_id") % 10 == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text"))))
    return annotate.three_way(before, after, "doc_id", "hash").select("doc_id", "change")


@query("d09_default_claim", "SELECT doc_id, coalesce(CAST(o_custkey AS VARCHAR), 'UNKNOWN') AS claim FROM documents LEFT JOIN orders ON doc_id = o_orderkey")
def d09(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").cast("string").alias("claim"))
    return table(spark, sf_dir, "documents").join(o, "doc_id", "left").select("doc_id", F.coalesce("claim", F.lit("UNKNOWN")).alias("claim"))


@query("d10_semi_scope", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def d10(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").where("o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("d11_anti_gold_only", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def d11(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query(
    "d12_surface_bind",
    """WITH m AS (SELECT p_partkey, lower(p_name) AS s FROM part), r AS (SELECT s_suppkey AS rel, CASE WHEN s_suppkey % 2 = 0 THEN x.s ELSE substr(x.s, 1, length(x.s) - 3) END AS t FROM supplier JOIN m x ON x.p_partkey = s_suppkey),
e AS (SELECT rel, min(p_partkey) AS hit FROM r JOIN m ON t = s GROUP BY rel),
p AS (SELECT rel, p_partkey AS hit FROM r JOIN m ON t <> s AND (contains(s, t) OR contains(t, s)) AND abs(length(s) - length(t)) <= 12 WHERE rel NOT IN (SELECT rel FROM e) QUALIFY row_number() OVER (PARTITION BY rel ORDER BY p_partkey) = 1)
SELECT rel, hit, 'exact' AS how FROM e UNION ALL SELECT rel, hit, 'partial' FROM p""",
)
def d12(spark, sf_dir):
    m = table(spark, sf_dir, "part").select("p_partkey", F.lower("p_name").alias("s"))
    r = table(spark, sf_dir, "supplier").join(m, F.col("p_partkey") == F.col("s_suppkey")).select(F.col("s_suppkey").alias("rel"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s")).otherwise(F.expr("substr(s, 1, length(s) - 3)")).alias("t"))
    return notes.bind_surfaces(r, m.toDF("mention", "s")).select("rel", F.col("mention").alias("hit"), "how")


@query(
    "d13_owner_binding",
    "SELECT o_orderkey AS ident, c_custkey AS owner, CASE WHEN c_custkey IS NULL THEN 'unbound' ELSE 'named' END AS method FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_mktsegment = 'BUILDING'",
)
def d13(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'")
    j = table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
    return j.select(F.col("o_orderkey").alias("ident"), F.col("c_custkey").alias("owner"), F.when(F.col("c_custkey").isNull(), "unbound").otherwise("named").alias("method"))


LOG_SQL = "(SELECT user_id AS uid, event_id AS revision, CASE WHEN event_type = 'purchase' THEN 'retired' ELSE 'accepted' END AS state, value FROM events)"


def event_log(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("uid"), F.col("event_id").alias("revision"), F.when(F.col("event_type") == "purchase", "retired").otherwise("accepted").alias("state"), "value")


@query("d20_latest_revision", f"SELECT * FROM (SELECT * FROM {LOG_SQL} QUALIFY row_number() OVER (PARTITION BY uid ORDER BY revision DESC) = 1) WHERE state = 'accepted'")
def d20(spark, sf_dir):
    return annotate.current(event_log(spark, sf_dir))


@query(
    "d21_diff",
    "SELECT c_custkey AS key, CASE WHEN c_custkey % 9 = 0 THEN 'missing' WHEN c_custkey % 9 = 1 THEN 'extra' ELSE 'changed' END AS change FROM customer WHERE c_custkey % 9 IN (0, 1, 2)",
)
def d21(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), "c_name")
    after = c.where("key % 9 <> 0").withColumn("c_name", F.when(F.col("key") % 9 == 2, "x").otherwise(F.col("c_name")))
    return annotate.three_way(c.where("key % 9 <> 1"), after, "key", "c_name").select("key", "change")


@query(
    "d22_watchlist_eligible",
    """SELECT row_id, note FROM (SELECT c_custkey AS row_id, unnest(CASE WHEN c_custkey % 5 = c_custkey % 3 THEN [c_custkey % 5] ELSE [c_custkey % 5, c_custkey % 3] END) AS note FROM customer WHERE c_mktsegment = 'MACHINERY') WHERE note <> 2""",
)
def d22(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    rows = c.select(k.alias("row_id"), (F.col("c_mktsegment") == "MACHINERY").alias("flagged"), F.array_distinct(F.array(k % 5, k % 3)).alias("notes"))
    done = c.select(k.alias("row_id"), F.lit(2).cast("long").alias("note"))
    return annotate.watchlist_eligible(rows, done)


@query("f02_top_k_per_group", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def f02(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders").withColumn("n", F.row_number().over(w)).where("n <= 3").select("o_custkey", "o_orderkey")


@query("f04_best_of_pair", "SELECT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b, max(l_extendedprice) AS score FROM lineitem GROUP BY 1, 2")
def f04(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.least("l_partkey", "l_suppkey").alias("a"), F.greatest("l_partkey", "l_suppkey").alias("b")).agg(F.max("l_extendedprice").alias("score"))


@query("f05_canonical_copy", "SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS dup_group, CASE WHEN row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1 THEN 1 ELSE 0 END AS is_canonical FROM documents")
def f05(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    first = duplicates.first_copies(d, "h", ["doc_id"])
    names = first.where("is_canonical_dup = 1").select("h", F.col("doc_id").alias("dup_group"))
    return first.join(names, "h").select("doc_id", "dup_group", F.col("is_canonical_dup").alias("is_canonical"))


@query("f06_capped_lists", "SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS first_five FROM (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 5) GROUP BY o_custkey")
def f06(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    few = table(spark, sf_dir, "orders").withColumn("n", F.row_number().over(w)).where("n <= 5")
    return few.groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string")), ",").alias("first_five"))


@query("f07_draft_order", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN value IS NULL THEN 1 ELSE 0 END, value, CASE WHEN event_type = 'view' THEN 0 ELSE 1 END, event_id) AS position FROM events")
def f07(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy(F.col("value").asc_nulls_last(), F.when(F.col("event_type") == "view", 0).otherwise(1), "event_id")
    return table(spark, sf_dir, "events").select("event_id", F.row_number().over(w).cast("long").alias("position"))


@query("f09_running_lag", "SELECT event_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS lift, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS running FROM events")
def f09(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("event_id", (F.col("value") - F.lag("value").over(w)).alias("lift"), F.count("*").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("running"))


@query("g01_union_lanes", "SELECT 'c' AS lane, c_custkey AS k FROM customer UNION ALL SELECT 's', s_suppkey FROM supplier")
def g01(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.lit("c").alias("lane"), F.col("c_custkey").alias("k"))
    return c.unionByName(table(spark, sf_dir, "supplier").select(F.lit("s").alias("lane"), F.col("s_suppkey").alias("k")))


@query("g02_reviewers", "SELECT c_nationkey AS n FROM customer UNION SELECT s_nationkey FROM supplier")
def g02(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n")).union(table(spark, sf_dir, "supplier").select("s_nationkey")).distinct()


@query("g03_set_difference", "SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A' EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R'")
def g03(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.where("l_returnflag = 'A'").select(F.col("l_partkey").alias("k")).subtract(li.where("l_returnflag = 'R'").select("l_partkey"))


@query("g04_jaccard", "WITH s AS (SELECT o_custkey AS c, list_distinct(list(o_orderpriority)) AS p FROM orders GROUP BY o_custkey) SELECT a.c AS a, b.c AS b, round(len(list_intersect(a.p, b.p)) / len(list_distinct(list_concat(a.p, b.p))), 6) AS j FROM s a JOIN s b ON b.c = a.c + 1")
def g04(spark, sf_dir):
    s = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("a")).agg(F.collect_set("o_orderpriority").alias("p"))
    t = s.select((F.col("a") - 1).alias("a"), F.col("a").alias("b"), F.col("p").alias("q"))
    return s.join(t, "a").select("a", "b", F.round(F.size(F.array_intersect("p", "q")) / F.size(F.array_union("p", "q")), 6).alias("j"))


@query("i01_coref_links")
def i01(spark, sf_dir):
    from notewright.operators import coref

    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("Ann Lee met the shop. He said it was late. "), "text").alias("text"))
    m = d.select("doc_id", F.lit(1).alias("mention_id"), F.lit(0).alias("start"), F.lit(7).alias("end"), F.lit("claimant").alias("label"), F.lit("Ann Lee").alias("surface"))
    return coref.resolve(d, m).select("doc_id", "start", "end", "surface", "antecedent_surface", "kind", "confidence")



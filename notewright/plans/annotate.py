"""Queries over annotation logs (K) and drafts."""

from __future__ import annotations

from pyspark.sql import functions as F

from notewright.operators import annotate
from notewright.plans import query, table
from notewright.plans.relational import LOG_SQL, event_log


@query("k01_retire", f"WITH l AS {LOG_SQL}, c AS (SELECT * FROM (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY uid ORDER BY revision DESC) = 1) WHERE state = 'accepted' AND uid % 2 = 0) SELECT uid, revision, state FROM l UNION ALL SELECT uid, revision + 1, 'retired' FROM c")
def k01(spark, sf_dir):
    log = event_log(spark, sf_dir).withColumn("reason", F.lit(None).cast("string"))
    return annotate.retire(log, log.where("uid % 2 = 0").select("uid").distinct(), "duplicate").select("uid", "revision", "state")


@query(
    "k02_violations",
    """WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS uid, ['mention', 'detail', 'unclear', 'note'][l_partkey % 4 + 1] AS kind, CASE WHEN l_suppkey % 3 > 0 THEN l_suppkey % 20 END AS entity_id, CASE WHEN l_suppkey % 2 = 0 THEN 'name' END AS form, CASE WHEN l_linenumber > 2 THEN 'phone' END AS field, CASE WHEN l_quantity > 20 THEN '5' END AS value, l_partkey % 50 AS lo, l_partkey % 50 + l_linenumber % 3 AS hi FROM lineitem)
SELECT uid, unnest(list_filter([CASE WHEN kind = 'note' THEN 'unknown kind' END, CASE WHEN kind IN ('mention', 'detail') AND entity_id IS NULL THEN 'no owner' END, CASE WHEN entity_id % 5 = 4 THEN 'owner of another claim' END, CASE WHEN entity_id >= 15 THEN 'unknown owner' END,
 CASE WHEN kind = 'mention' AND form IS NULL THEN 'no form' END, CASE WHEN kind = 'detail' AND field IS NULL THEN 'no field' END, CASE WHEN kind = 'detail' AND value IS NULL THEN 'no value' END, CASE WHEN kind = 'unclear' THEN 'no reason' END, CASE WHEN NOT (lo < hi AND hi <= 50) THEN 'bad span' END], lambda x: x IS NOT NULL)) AS problem
FROM (SELECT *, NULL FROM r WHERE entity_id IS NULL OR entity_id % 5 <> 4 OR entity_id < 15 UNION ALL SELECT *, NULL FROM r WHERE entity_id % 5 = 4 AND entity_id >= 15)""".replace("CASE WHEN entity_id % 5 = 4 THEN 'owner of another claim' END", "CASE WHEN entity_id % 5 = 4 AND entity_id < 15 THEN 'owner of another claim' END"),
)
def k02(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("mention", "detail", "unclear", "note")]), (F.col("l_partkey") % 4 + 1).cast("int"))
    none = F.lit(None).cast("string")
    r = li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("uid"), kind.alias("kind"), F.lit("c").alias("claim"), F.lit("r").alias("reviewer"),
        F.when(F.col("l_suppkey") % 3 > 0, (F.col("l_suppkey") % 20).cast("string")).alias("entity_id"), none.alias("entity2_id"), F.when(F.col("l_suppkey") % 2 == 0, "name").alias("form"),
        F.when(F.col("l_linenumber") > 2, "phone").alias("field"), F.when(F.col("l_quantity") > 20, "5").alias("value"), none.alias("reason"),
        (F.col("l_partkey") % 50).alias("start"), (F.col("l_partkey") % 50 + F.col("l_linenumber") % 3).alias("end"), F.lit(50).alias("note_length"), F.lit("q").alias("quote"),
    )
    e = table(spark, sf_dir, "supplier").where("s_suppkey < 15 and s_suppkey >= 0").select(F.col("s_suppkey").cast("string").alias("entity_id"), F.when(F.col("s_suppkey") % 5 == 4, "other").otherwise("c").alias("claim"), F.lit("r").alias("reviewer"))
    zero = spark.createDataFrame([("0", "c", "r")], "entity_id string, claim string, reviewer string")
    return annotate.violations(r, e.union(zero).dropDuplicates(["entity_id"]), ("phone", "address"))


@query("k03_identical", "SELECT c.c_custkey AS candidate_id, min(o_orderkey) AS uid FROM customer c JOIN orders ON o_custkey % 500 = c.c_custkey % 500 AND CASE WHEN o_custkey % 3 > 0 THEN o_custkey % 7 END IS NOT DISTINCT FROM CASE WHEN c.c_custkey % 3 > 0 THEN c.c_custkey % 7 END GROUP BY c.c_custkey")
def k03(spark, sf_dir):
    part = lambda k: [(k % 500).alias("note"), F.when(k % 3 > 0, k % 7).alias("field")]
    r = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("uid"), *part(F.col("o_custkey")))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("candidate_id"), *part(F.col("c_custkey")))
    return annotate.identical(r, c, ["note", "field"])


@query("k04_stale_decisions", "SELECT DISTINCT o_custkey AS entity_id FROM orders WHERE o_orderkey % 50 = 0")
def k04(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("entity_id"), "o_orderkey", "o_totalprice")
    before = annotate.basis(o)
    after = annotate.basis(o.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 50 == 0, -1.0).otherwise(F.col("o_totalprice"))))
    return annotate.stale(before, after).select("entity_id")


@query("k05_category_rules", """SELECT c_custkey AS entity_id, unnest(list_filter([CASE WHEN c_custkey % 3 = 0 AND c_custkey % 5 = 0 THEN 'assigned without support' END, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 7 = 0 THEN 'assigned without category' END, CASE WHEN c_custkey % 3 = 1 AND c_custkey % 4 = 0 THEN 'conflicting without conflict' END, CASE WHEN c_custkey % 11 = 0 AND c_custkey % 2 = 0 THEN 'subcategory not quoted' END], lambda x: x IS NOT NULL)) AS problem FROM customer""")
def k05(spark, sf_dir):
    k = F.col("c_custkey")
    d = table(spark, sf_dir, "customer").select(k.alias("entity_id"), F.when(k % 3 == 0, "assigned").when(k % 3 == 1, "conflicting").otherwise("open").alias("status"), F.when(k % 7 > 0, "Medical").alias("category"), (k % 5).alias("n_supports"), (k % 4).alias("n_conflicts"), F.when(k % 11 == 0, "Clinic").alias("subcategory"), (k % 2 == 1).alias("subcategory_quoted"))
    return annotate.category_problems(d)


@query("k07_undo", "SELECT uid, CAST(max(revision) AS BIGINT) AS revision, count(*) AS revisions FROM (SELECT c_custkey AS uid, 1 AS revision FROM customer UNION ALL SELECT c_custkey, 2 FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, 3 FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 = 0) GROUP BY uid")
def k07(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    one = c.select(F.col("c_custkey").alias("uid"), F.lit(1).cast("long").alias("revision"), F.lit("accepted").alias("state"), F.col("c_name").alias("value"))
    two = one.where("uid % 3 = 0").withColumn("revision", F.lit(2).cast("long")).withColumn("value", F.lit("x"))
    body = F.to_json(F.struct("state", "value"))
    # the action's result was changed again for odd ids, so those refuse
    action = one.where("uid % 3 = 0").select("uid", body.alias("before")).join(two.select("uid", F.when(F.col("uid") % 2 == 0, body).otherwise("{}").alias("after")), "uid")
    log, _ = annotate.undo(one.union(two), action)
    return log.groupBy("uid").agg(F.max("revision").alias("revision"), F.count("*").alias("revisions"))


@query("k08_accepted_drafts", "SELECT o_orderkey AS draft_id, o_orderkey AS uid, o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 AS edited FROM orders WHERE o_orderkey % 2 = 0")
def k08(spark, sf_dir):
    k = F.col("o_orderkey")
    d = table(spark, sf_dir, "orders").select(k.alias("draft_id"), F.when(k % 2 == 0, "accepted").otherwise("dismissed").alias("status"), F.lit("v").alias("value"), F.when(k % 7 > 0, "f").alias("field"))
    r = table(spark, sf_dir, "orders").select(k.alias("uid"), k.alias("draft_id"), F.when(k % 5 == 0, "w").otherwise("v").alias("value"), F.lit("f").alias("field"))
    return annotate.accepted_drafts(d, r, ["value", "field"])


@query("k09_repeats_by_order", """WITH d AS (SELECT o_orderkey AS draft_id, o_custkey AS note, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rank, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders), o AS (SELECT o_custkey AS note, o_orderkey * 3 AS s FROM orders WHERE o_custkey % 2 = 0 OR o_orderkey % 2 = 0),
r AS (SELECT note, s, row_number() OVER (PARTITION BY note ORDER BY s) AS rank, count(*) OVER (PARTITION BY note) AS n FROM o) SELECT draft_id, d.note, s AS "start" FROM d LEFT JOIN r ON d.note = r.note AND d.rank = r.rank AND d.n = r.n""")
def k09(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("note"), F.lit("q").alias("quote"), F.col("o_orderkey").alias("draft_id"), F.col("o_orderkey").alias("seq"))
    places = o.where("note % 2 = 0 or draft_id % 2 = 0").select("note", "quote", (F.col("draft_id") * 3).alias("start"))
    return annotate.resolve_repeats(o, places).select("draft_id", "note", "start")


@query("k10_pairings", "SELECT firm_row_id, reviewer, e AS entity_id, n AS not_in_notes, e IS NOT NULL AND n AS problem FROM (SELECT o_custkey AS firm_row_id, o_orderkey % 2 AS reviewer, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 10 END AS e, o_orderkey % 4 = 0 AS n, o_orderkey FROM orders) QUALIFY row_number() OVER (PARTITION BY firm_row_id, reviewer ORDER BY o_orderkey DESC) = 1")
def k10(spark, sf_dir):
    k = F.col("o_orderkey")
    p = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("firm_row_id"), (k % 2).alias("reviewer"), F.when(k % 3 > 0, k % 10).alias("entity_id"), (k % 4 == 0).alias("not_in_notes"), k.alias("seq"))
    return annotate.exclusive_pairings(p)


@query("b33_locate_quotes")
def b33(spark, sf_dir):
    from notewright.functions import drafts

    d = table(spark, sf_dir, "documents").where("length(text) >= 80")
    quote = F.when(F.col("doc_id") % 3 == 0, F.substring("text", 31, 20)).when(F.col("doc_id") % 3 == 1, F.upper(F.substring("text", 31, 20))).otherwise(F.lit("not there at all"))
    return d.select("doc_id", drafts.locate_quote("text", quote, F.lit(None).cast("string"), F.lit(None).cast("int")).alias("r")).select("doc_id", "r.status", "r.start", "r.end", "r.how")


@query("b41_normalize_items", """SELECT event_id, lower(CASE event_id % 3 WHEN 0 THEN 'detail' WHEN 1 THEN 'fact' ELSE event_type END) AS raw_kind, CASE event_id % 3 WHEN 0 THEN 'detail' WHEN 1 THEN 'detail' END AS kind, CAST(user_id AS VARCHAR) AS quote, CASE WHEN event_id % 3 = 2 THEN 'unknown kind' ELSE 'bad field' END AS problem FROM events""")
def b41(spark, sf_dir):
    from notewright.functions import drafts

    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_id") % 3 == 0, "Detail").when(F.col("event_id") % 3 == 1, "fact").otherwise(F.col("event_type"))
    name = F.when(F.col("event_id") % 2 == 0, "quote").otherwise("text")
    body = F.to_json(F.map_from_arrays(F.array(F.lit("kind"), name), F.array(kind, F.col("user_id").cast("string"))))
    n = drafts.normalize_item(body)
    return e.select("event_id", F.lower(kind).alias("raw_kind"), n["kind"].alias("kind"), n["quote"].alias("quote"), F.get(n["problems"], 0).alias("problem"))


@query("c16_read_answers")
def c16(spark, sf_dir):
    from notewright.functions import drafts

    d = table(spark, sf_dir, "documents").where("length(text) >= 80")
    quote = F.substring("text", 31, 20)
    answer = F.concat(F.lit("Here you are:\n"), F.to_json(F.struct(F.lit("detail").alias("kind"), F.lit("phone").alias("field"), quote.alias("quote"), F.lit("5").alias("value"))), F.lit("\n{\"kind\": \"mention\", \"quote\": \"nowhere\",}\n{\"kind\": "))
    runs = d.select(F.col("doc_id").alias("run_id"), "text", answer.alias("answer"))
    return drafts.read_answers(runs).select("run_id", "seq", "kind", "status", "start", "end", F.array_join("problems", ",").alias("problems"))


@query("c18_queue_snapshot")
def c18(spark, sf_dir):
    from notewright.functions import drafts

    d = table(spark, sf_dir, "documents").where("length(text) >= 80")
    k = F.col("doc_id")
    action = F.when(k % 7 == 0, "dance").otherwise("detail")
    c = d.select((k % 5).alias("snapshot_id"), F.when(k % 11 == 0, F.lit("same")).otherwise(k.cast("string")).alias("candidate_key"), k.alias("note"), action.alias("action"), F.when(k % 3 == 0, "not there at all").otherwise(F.substring("text", 31, 20)).alias("quote"), F.lit(9).alias("occurrence"))
    seen = spark.createDataFrame([(4,)], "snapshot_id long")
    return drafts.queue_snapshot(c, d.select(k.alias("note"), "text"), seen).select("snapshot_id", "candidate_key", "note", "state", "reason", "start")


@query("c18_next_candidate", "SELECT o_custkey AS note, o_orderkey AS candidate_key FROM (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey + 1 END AS need FROM orders WHERE o_orderkey % 4 > 0) a WHERE need IS NULL OR need NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 4 > 0) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 50, CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 1 END, o_orderkey) = 1")
def c18_next(spark, sf_dir):
    from notewright.functions import drafts

    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders")
    queue = o.select(F.col("o_custkey").alias("note"), k.alias("candidate_key"), F.when(k % 2 == 0, "entity").otherwise("detail").alias("action"), (k % 50).alias("start"), (k % 4 == 0).alias("done"))
    needs = o.where("o_orderkey % 3 = 0").select(k.alias("candidate_key"), (k + 1).alias("entity_key"))
    return drafts.next_candidates(queue, needs).select("note", "candidate_key")

"""Queries over retrieval plans and citations (J, JD, N5, M)."""

from __future__ import annotations

from pyspark.sql import functions as F

from notewright.operators import retrieve
from notewright.plans import query, table
from notewright.streaming import ingest

ENTITIES_SQL = "(SELECT c_custkey AS entity_id, lower(c_mktsegment) AS entity_class, c_name AS canonical_name, c_custkey % 9 AS n_mentions FROM customer)"
INDEX_SQL = "(SELECT c_custkey AS entity_id, unnest(['name', 'phone', 'email_domain', 'claim']) AS field, unnest([c_name, CAST(c_custkey % 400 AS VARCHAR), 'd' || CAST(c_custkey % 300 AS VARCHAR) || '.com', CAST(c_nationkey AS VARCHAR)]) AS value FROM customer UNION ALL SELECT c_custkey, 'claim', 'x' FROM customer WHERE c_custkey % 3 = 0)"


def entities(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity_id"), F.lower("c_mktsegment").alias("entity_class"), F.col("c_name").alias("canonical_name"), (F.col("c_custkey") % 9).alias("n_mentions"))


def index(spark, sf_dir):
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer")
    m = F.create_map(F.lit("name"), F.col("c_name"), F.lit("phone"), (k % 400).cast("string"), F.lit("email_domain"), F.concat(F.lit("d"), (k % 300).cast("string"), F.lit(".com")), F.lit("claim"), F.col("c_nationkey").cast("string"))
    return c.select(k.alias("entity_id"), F.explode(m).alias("field", "value")).union(c.where("c_custkey % 3 = 0").select("c_custkey", F.lit("claim"), F.lit("x")))


@query("j07_plan_filters", f"SELECT entity_id, n_mentions FROM {ENTITIES_SQL} WHERE entity_class = 'building' AND entity_id IN (SELECT entity_id FROM {INDEX_SQL} WHERE field = 'email_domain' AND value LIKE 'd1%') AND entity_id IN (SELECT entity_id FROM {INDEX_SQL} WHERE field = 'phone' AND contains(value, '2'))")
def j07(spark, sf_dir):
    p = retrieve.Plan("building", (retrieve.Filter("email_domain", "startswith", "d1"), retrieve.Filter("phone", "contains", "2")))
    return retrieve.execute(p, entities(spark, sf_dir), index(spark, sf_dir)).select("entity_id", "n_mentions")


@query("j08_filter_eq", f"SELECT DISTINCT entity_id FROM {INDEX_SQL} WHERE field = 'claim' AND value = '7'")
def j08(spark, sf_dir):
    p = retrieve.Plan(None, (retrieve.Filter("claim", "eq", "7"), retrieve.Filter("name", "exists")))
    return retrieve.execute(p, entities(spark, sf_dir), index(spark, sf_dir)).select("entity_id")


@query("j08_filter_fuzzy")
def j08_fuzzy(spark, sf_dir):
    p = retrieve.Plan(None, (retrieve.Filter("name", "fuzzy", "customer#000000123"),))
    return retrieve.execute(p, entities(spark, sf_dir), index(spark, sf_dir)).select("entity_id")


@query("j09_sharing", f"SELECT DISTINCT entity_id FROM {INDEX_SQL} WHERE field = 'phone' AND value IN (SELECT value FROM {INDEX_SQL} WHERE field = 'phone' GROUP BY value HAVING count(DISTINCT entity_id) > 1)")
def j09(spark, sf_dir):
    return retrieve.sharing(index(spark, sf_dir), ("phone",))


@query("j10_inverted_index", f"SELECT field, value, count(DISTINCT entity_id) AS n FROM {INDEX_SQL} GROUP BY field, value")
def j10(spark, sf_dir):
    return index(spark, sf_dir).groupBy("field", "value").agg(F.count_distinct("entity_id").alias("n"))


@query("j07_cross_reference", f"SELECT entity_id FROM {INDEX_SQL} WHERE field = 'claim' GROUP BY entity_id HAVING count(DISTINCT value) > 1")
def j07_cross(spark, sf_dir):
    p = retrieve.plan_question("Which parties share the same phone and appear on several claims?")
    return retrieve.execute(retrieve.Plan(None, (), (), p.cross_reference), entities(spark, sf_dir), index(spark, sf_dir)).select("entity_id")


@query("f01_name_search")
def f01(spark, sf_dir):
    return retrieve.search_name(entities(spark, sf_dir), "Customer#000000123").select("entity_id", F.round("score", 6).alias("score"))


CITE = "CASE doc_id % 5 WHEN 0 THEN 'D' || CAST(doc_id AS VARCHAR) || ':0-20' WHEN 1 THEN '[D' || CAST(doc_id AS VARCHAR) || ': 5 - 900000]' WHEN 2 THEN 'see note' WHEN 3 THEN 'X9:0-5' ELSE 'D' || CAST(doc_id AS VARCHAR) || ':60-70' END"


@query("j03_citations", "SELECT doc_id AS citation_id, CASE doc_id % 5 WHEN 2 THEN 'unparseable' WHEN 3 THEN 'unknown doc_id' WHEN 1 THEN 'span out of bounds' WHEN 0 THEN CASE WHEN length(text) < 20 THEN 'span out of bounds' END ELSE CASE WHEN length(text) < 70 THEN 'span out of bounds' ELSE 'span outside retrieved evidence' END END AS reason FROM documents")
def j03(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    name = F.concat(F.lit("D"), F.col("doc_id").cast("string"))
    k = F.col("doc_id") % 5
    cite = F.when(k == 0, F.concat(name, F.lit(":0-20"))).when(k == 1, F.concat(F.lit("["), name, F.lit(": 5 - "), F.greatest(F.lit(900000), F.length("text") + 1), F.lit("]"))).when(k == 2, "see note").when(k == 3, "X9:0-5").otherwise(F.concat(name, F.lit(":60-70")))
    docs = d.select(name.alias("doc_id"), F.length("text").alias("n_chars"))
    return retrieve.verify_citations(d.select(F.col("doc_id").alias("citation_id"), cite.alias("citation")), docs, docs.select("doc_id", F.lit(0).alias("start"), F.lit(50).alias("end")))


@query("j13_scope_proof", "SELECT count(*) FILTER (source = 'src1') AS in_a, count(*) FILTER (source = 'src2') AS in_b, CAST(0 AS BIGINT) AS leaked FROM documents WHERE length(text) > 500")
def j13(spark, sf_dir):
    return retrieve.scope_proof(table(spark, sf_dir, "documents").withColumnRenamed("source", "claim_id"), F.lit("src1"), F.lit("src2"), F.length("text") > 500)


WS = "list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> '')"


@query("jd2_bm25", f"""WITH d AS (SELECT doc_id, {WS} AS ws FROM documents), t AS (SELECT count(*) AS docs, avg(len(ws)) AS a FROM d), h AS (SELECT doc_id, len(ws) AS n, w AS term, count(*) AS tf FROM (SELECT doc_id, ws, unnest(ws) AS w FROM d) WHERE w IN ('the', 'stupid', 'token') GROUP BY doc_id, len(ws), w), f AS (SELECT term, count(*) AS df FROM h GROUP BY term)
SELECT doc_id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * n / a))), 6) AS score FROM h JOIN f USING (term), t GROUP BY doc_id""")
def jd2(spark, sf_dir):
    return retrieve.bm25(table(spark, sf_dir, "documents"), ["the", "stupid", "token"]).select("doc_id", F.round("score", 6).alias("score"))


@query("jd2_rank_fusion", """WITH l AS (SELECT 'price' AS lane, o_orderkey AS doc_id, o_totalprice AS s FROM orders UNION ALL SELECT 'cust', o_orderkey, CAST(o_custkey AS DOUBLE) FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY s DESC, doc_id) AS rank FROM l)
SELECT doc_id, round(sum(1 / (60 + rank)), 9) AS score, string_agg(lane, '+' ORDER BY lane) AS lanes FROM r GROUP BY doc_id""")
def jd2_fuse(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    a = o.select(F.lit("price").alias("lane"), F.col("o_orderkey").alias("doc_id"), F.col("o_totalprice").alias("score"))
    b = o.select(F.lit("cust").alias("lane"), F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").cast("double").alias("score"))
    return retrieve.fuse(a.union(b)).select("doc_id", F.round("score", 9).alias("score"), "lanes")


@query("jd3_as_of", "SELECT user_id AS key, event_id FROM events WHERE ts <= (SELECT min(ts) + INTERVAL 15 DAY FROM events) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def jd3(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumnRenamed("user_id", "key")
    at = e.agg(F.min("ts")).first()[0]
    return retrieve.temporal(e, "as_of", F.lit(at) + F.expr("INTERVAL 15 DAYS")).select("key", "event_id")


@query("n05_change_report", "SELECT o_custkey % 300 AS entity_id, CASE WHEN bool_and(o_orderkey % 10 = 0) THEN 'created' WHEN count(DISTINCT CASE WHEN o_orderkey % 10 <> 0 THEN o_custkey % 600 END) > 1 THEN 'merged' ELSE 'grew' END AS change, count(*) FILTER (o_orderkey % 10 = 0) AS n_new FROM orders GROUP BY 1 HAVING count(*) FILTER (o_orderkey % 10 = 0) > 0")
def n05(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    before = o.where("o_orderkey % 10 <> 0").select(F.col("o_orderkey").alias("node"), (F.col("o_custkey") % 600).alias("entity_id"))
    after = o.select(F.col("o_orderkey").alias("node"), (F.col("o_custkey") % 300).alias("entity_id"))
    return ingest.change_report(before, after).select("entity_id", "change", "n_new")


@query("m03_grounding", "SELECT count(*) AS n, count(*) FILTER (substr(text, 11, 10) = substr(text, 11, 10)) AS grounded FROM documents WHERE length(text) >= 30")
def m03(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("length(text) >= 30").select("text", F.substring("text", 11, 10).alias("surface"), F.lit(10).alias("s"), F.lit(20).alias("e"))
    return d.agg(F.count("*").alias("n"), F.count_if(F.substring("text", F.col("s") + 1, F.col("e") - F.col("s")) == F.col("surface")).alias("grounded"))

"""Queries over claim-scoped entities, outside records and scoped answers (H24, JD1, J1-J4, H12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from notewright.operators import generators, graph, linkage, local, retrieve, vectors
from notewright.plans import query, table
from notewright.plans.linkage import fixed_model, frame

LOCAL_SQL = """WITH RECURSIVE m AS (SELECT c_custkey AS k, c_nationkey AS claim, ['ann', 'bob', 'cara'][c_custkey % 3 + 1] || CASE WHEN c_custkey % 4 > 0 THEN ' lee' || CAST(c_custkey % 37 AS VARCHAR) ELSE '' END AS name, CASE WHEN c_custkey % 5 = 0 THEN CAST(c_custkey % 90 AS VARCHAR) END AS email FROM customer),
n AS (SELECT claim, name, min(k) AS rep, string_split(name, ' ') AS t FROM m GROUP BY claim, name),
i AS (SELECT s.claim, s.rep AS k, l.rep AS o, l.name AS long FROM n s JOIN n l ON s.claim = l.claim AND len(s.t) = 1 AND len(l.t) = 2 AND s.t[1] = l.t[1]),
e AS (SELECT a.k AS u, b.k AS v FROM m a JOIN m b ON a.claim = b.claim AND a.name = b.name AND a.k <> b.k UNION SELECT a.k, b.k FROM m a JOIN m b ON a.claim = b.claim AND a.email = b.email AND a.k <> b.k
 UNION SELECT k, min(o) FROM i GROUP BY claim, k HAVING count(DISTINCT long) = 1 UNION SELECT min(o), k FROM i GROUP BY claim, k HAVING count(DISTINCT long) = 1),
r(node, root) AS (SELECT k, k FROM m UNION SELECT r.node, e.v FROM r JOIN e ON r.root = e.u),
l AS (SELECT node AS mention_id, min(root) AS local_id FROM r GROUP BY node)"""


def mentions(spark, sf_dir):
    k = F.col("c_custkey")
    first = F.element_at(F.array(*[F.lit(x) for x in ("ann", "bob", "cara")]), (k % 3 + 1).cast("int"))
    name = F.concat(first, F.when(k % 4 > 0, F.concat(F.lit(" lee"), (k % 37).cast("string"))).otherwise(""))
    c = table(spark, sf_dir, "customer")
    m = c.select(k.alias("mention_id"), F.col("c_nationkey").alias("claim_id"), name.alias("full_name"))
    ids = c.where("c_custkey % 5 = 0").select(k.alias("mention_id"), F.lit("email").alias("kind"), (k % 90).cast("string").alias("value"), F.lit(True).alias("validated"))
    return m, ids


@query("h24_local_entities", f"{LOCAL_SQL} SELECT mention_id, claim AS claim_id, local_id FROM l JOIN m ON mention_id = k")
def h24(spark, sf_dir):
    return local.local_entities(*mentions(spark, sf_dir))


@query("h24_identity_links", f"{LOCAL_SQL}, o AS (SELECT DISTINCT local_id, claim, email FROM l JOIN m ON mention_id = k WHERE email IS NOT NULL) SELECT a.local_id AS local_a, b.local_id AS local_b, string_agg(DISTINCT 'email=' || a.email, ',' ORDER BY 'email=' || a.email) AS evidence FROM o a JOIN o b ON a.email = b.email AND a.local_id < b.local_id AND a.claim <> b.claim GROUP BY 1, 2")
def h24_links(spark, sf_dir):
    m, ids = mentions(spark, sf_dir)
    return local.identity_links(local.local_entities(m, ids), ids).select("local_a", "local_b", "evidence")


LEVELS = ", ".join(f"('{c}', {i}, CAST({v!r} AS DOUBLE), CAST({fixed_model().u[c][i]!r} AS DOUBLE))" for c, ms in fixed_model().m.items() for i, v in enumerate(ms))


@query("h12_calibration_report", f"SELECT comparison, level, round(m, 9) AS m, round(u, 9) AS u, round(log2(m / u), 9) AS bits, true AS estimated FROM (VALUES {LEVELS}) v(comparison, level, m, u)")
def h12(spark, sf_dir):
    r = linkage.calibration_report(spark, fixed_model())
    return r.select("comparison", "level", *[F.round(c, 9).alias(c) for c in ("m", "u", "bits")], "estimated")


@query("jd1_match_record")
def jd1(spark, sf_dir):
    f = frame(spark, sf_dir).select("mention_id", "claim_id", "first_name", "last_name", "full_name", "name_sorted", "email", "npi", "tin")
    record = f.where("mention_id in (22, 143)").withColumn("mention_id", -F.col("mention_id") - 1).withColumn("email", F.lit(None).cast("string"))
    joined = f.unionByName(record)
    pairs = linkage.block(joined, (("npi",), ("full_name",), ("last_name",)), new_ids=record.select("mention_id")).where("id_l < 0 and id_r >= 0").select("id_l", "id_r")
    model = linkage.default_model(["full_name", "name_sorted", "email", "npi", "tin"])
    out = local.match_records(record.withColumnRenamed("mention_id", "record_id"), f, model, pairs)
    return out.select("record_id", "mention_id", "band", "name_only", "conflicting", "evidence", "rank")


@query("j02_scoped_answer")
def j02(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    docs = d.select("doc_id", F.col("source").alias("claim_id"))
    index = retrieve.chunk_index(generators.chunks(d), docs)
    seen = d.select("doc_id", F.lit(5).alias("start"), F.lit(9).alias("end"), (F.col("doc_id") % 7).cast("string").alias("entity_id"))
    edges = d.select(F.concat(F.lit("ent:"), (F.col("doc_id") % 7).cast("string")).alias("src"), F.concat(F.lit("claim:"), "source").alias("dst"), F.lit("PARTY_TO").alias("predicate"), F.col("source").alias("claim_id")).distinct()
    got = retrieve.answer(vectors.hashed_embedding("the token of the claim"), "src0", index, seen, edges)
    return got["triples"].select("src", "dst", "predicate", "hop")


@query("j04_enrich", """WITH i AS (SELECT DISTINCT c_custkey AS e, CAST(c_custkey % 400 AS VARCHAR) AS v FROM customer) SELECT a.e AS entity_id, b.e AS other FROM i a JOIN i b ON a.v = b.v AND a.e <> b.e QUALIFY row_number() OVER (PARTITION BY a.e ORDER BY b.e) <= 2""")
def j04(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    i = c.select(F.col("c_custkey").alias("entity_id"), F.lit("has_phone").alias("field"), (F.col("c_custkey") % 400).cast("string").alias("value"))
    return retrieve.enrich(i, graph.shared_attributes(i, nearest=2), 2).select("entity_id", "other")


@query("e13_event_recall", "SELECT event_type, count(*) AS total, count(*) FILTER (value > 50) AS hits, count(*) FILTER (value > 50) / count(*) AS recall FROM events GROUP BY event_type")
def e13(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.count("*").alias("total"), F.count_if(F.col("value") > 50).alias("hits")).withColumn("recall", F.col("hits") / F.col("total"))

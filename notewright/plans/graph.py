"""Queries over vectors, graphs and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from notewright.operators import graph, profile, vectors
from notewright.plans import query, table


def vecs(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("class"), F.col("embedding").alias("vector"))


COS = "(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))))"


@query("d15_knn_same_label", f"SELECT vec_id, other, round(s, 6) AS similarity FROM (SELECT a.vec_id, b.vec_id AS other, {COS} AS s FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, other) <= 5")
def d15(spark, sf_dir):
    return vectors.knn(vecs(spark, sf_dir), 5).select("vec_id", "other", F.round("similarity", 6).alias("similarity"))


@query("d15_knn_edges", f"SELECT least(vec_id, other) AS id_l, greatest(vec_id, other) AS id_r, round(max(s), 6) AS similarity FROM (SELECT * FROM (SELECT a.vec_id, b.vec_id AS other, {COS} AS s FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id) WHERE s >= 0.29 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, other) <= 5) GROUP BY ALL".replace("GROUP BY ALL", "GROUP BY 1, 2"))
def d15_edges(spark, sf_dir):
    return vectors.knn_edges(vecs(spark, sf_dir), 5, 0.29).select("id_l", "id_r", F.round("similarity", 6).alias("similarity"))


QUERY = [1.0 if i % 3 == 0 else -0.5 for i in range(64)]
QUERY_SQL = "[" + ", ".join(map(str, QUERY)) + "]"


@query("d16_filtered_top_k", f"SELECT vec_id, round(s, 6) AS similarity FROM (SELECT vec_id, list_dot_product(CAST(embedding AS DOUBLE[]), CAST({QUERY_SQL} AS DOUBLE[])) / (sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST({QUERY_SQL} AS DOUBLE[]), CAST({QUERY_SQL} AS DOUBLE[])))) AS s FROM embeddings WHERE label IN (1, 2, 3)) ORDER BY s DESC, vec_id LIMIT 10")
def d16(spark, sf_dir):
    return vectors.search(vecs(spark, sf_dir), QUERY, 10, F.col("class").isin(1, 2, 3)).select("vec_id", F.round("similarity", 6).alias("similarity"))


@query("e32_calibration", f"SELECT round(tmin, 6) AS true_min, round(t[len(t) // 2 + 1], 6) AS true_median, round(fmax, 6) AS false_max, round(tmin - fmax, 6) AS margin FROM (SELECT min(s) FILTER (same) AS tmin, list_sort(list(s) FILTER (same)) AS t, max(s) FILTER (NOT same) AS fmax FROM (SELECT {COS} AS s, a.label = b.label AS same FROM embeddings a JOIN embeddings b ON b.vec_id - a.vec_id BETWEEN 1 AND 10))")
def e32(spark, sf_dir):
    v = vecs(spark, sf_dir)
    # Labelled pairs: each vector with the ten after it.
    near = v.toDF("a", "ca", "va").withColumn("b", F.explode(F.sequence(F.col("a") + 1, F.col("a") + 10)))
    pairs = near.join(v.toDF("b", "cb", "vb"), "b")
    c = vectors.calibrate(pairs.select(vectors.cosine(F.col("va"), F.col("vb")).alias("similarity"), (F.col("ca") == F.col("cb")).alias("same")))
    return c.select(*[F.round(x, 6).alias(x) for x in c.columns])


@query("f11_upper_median", "SELECT o_custkey AS key, v[len(v) // 2 + 1] AS value FROM (SELECT o_custkey, list_sort(list(o_totalprice)) AS v FROM orders GROUP BY o_custkey)")
def f11(spark, sf_dir):
    return vectors.upper_median(table(spark, sf_dir, "orders"), "o_custkey", "o_totalprice").toDF("key", "value")


KNN_SQL = f"(SELECT vec_id, other, s FROM (SELECT a.vec_id, b.vec_id AS other, {COS} AS s FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id) WHERE s >= 0.29 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, other) <= 5)"


@query(
    "h15_embedding_buckets",
    f"""WITH RECURSIVE k AS {KNN_SQL}, e AS (SELECT vec_id AS u, other AS v FROM k UNION SELECT other, vec_id FROM k), r(node, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.node, e.v FROM r JOIN e ON r.root = e.u),
c AS (SELECT node, min(root) AS component FROM r GROUP BY node) SELECT node AS vec_id, CASE WHEN count(*) OVER (PARTITION BY component) BETWEEN 2 AND 60 THEN 'EB' || CAST(component AS VARCHAR) END AS emb_bucket FROM c""",
)
def h15(spark, sf_dir):
    return vectors.embedding_buckets(vecs(spark, sf_dir), 5, 0.29)


@query("h16_buckets_for_new")
def h16(spark, sf_dir):
    v = vecs(spark, sf_dir)
    old = vectors.embedding_buckets(v.where("vec_id % 10 <> 0"), 5, 0.29)
    return vectors.buckets_for_new(vectors.knn_edges(v, 5, 0.29), old, v.where("vec_id % 10 = 0").select("vec_id"))


@query("h18_node_text", "SELECT c_custkey, lower(c_name) || ' | class=' || lower(c_mktsegment) || CASE WHEN c_custkey % 2 = 0 THEN ' | ctx: nation ' || CAST(c_nationkey AS VARCHAR) ELSE '' END AS node FROM customer")
def h18(spark, sf_dir):
    context = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("nation "), F.col("c_nationkey").cast("string")))
    return table(spark, sf_dir, "customer").select("c_custkey", vectors.node_text(F.lower("c_name"), F.lower("c_mktsegment"), context).alias("node"))


# The graph of orders: suppliers supply parts within an order, which plays the claim.
EDGE_SQL = "(SELECT DISTINCT 's' || CAST(l_suppkey AS VARCHAR) AS src, 'p' || CAST(l_partkey AS VARCHAR) AS dst, CASE WHEN l_returnflag = 'R' THEN 'REPAIRED_BY' ELSE 'SUPPLIES' END AS predicate, l_orderkey % 20 AS claim_id FROM lineitem)"


def supply_edges(spark, sf_dir):
    s = lambda c: F.col(c).cast("string")
    raw = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), s("l_suppkey")).alias("src"), F.concat(F.lit("p"), s("l_partkey")).alias("dst"), F.when(F.col("l_returnflag") == "R", "repairs").otherwise("supplies").alias("predicate"), (F.col("l_orderkey") % 20).alias("claim_id"))
    return graph.clean_edges(raw).distinct()


@query("d17_two_hops", f"""WITH e AS {EDGE_SQL}, b AS (SELECT src AS x, dst AS y, src, dst, predicate, claim_id FROM e WHERE claim_id = 3 UNION ALL SELECT dst, src, src, dst, predicate, claim_id FROM e WHERE claim_id = 3),
h1 AS (SELECT DISTINCT src, dst, predicate, claim_id FROM b WHERE x IN ('s1', 's2')), n1 AS (SELECT DISTINCT y FROM b WHERE x IN ('s1', 's2')),
h2 AS (SELECT DISTINCT src, dst, predicate, claim_id FROM b WHERE x IN (SELECT y FROM n1)) SELECT src, dst, predicate, CASE WHEN (src, dst, predicate) IN (SELECT (src, dst, predicate) FROM h1) THEN 1 ELSE 2 END AS hop FROM (SELECT * FROM h1 UNION SELECT * FROM h2)""")
def d17(spark, sf_dir):
    start = spark.createDataFrame([("s1",), ("s2",)], "id string")
    return graph.neighbours(supply_edges(spark, sf_dir), start, 2, F.col("claim_id") == 3).select("src", "dst", "predicate", "hop")


@query("d18_cross_claim", f"""WITH e AS {EDGE_SQL}, v AS (SELECT id, list_distinct(list(claim_id)) AS claims FROM (SELECT src AS id, claim_id FROM e UNION ALL SELECT dst, claim_id FROM e) GROUP BY id), b AS (SELECT src, dst, predicate FROM e UNION SELECT dst, src, predicate FROM e)
SELECT DISTINCT b.src, b.dst, b.predicate, CAST(len(list_filter(o.claims, lambda c: c <> 3)) AS BIGINT) AS n_other FROM b JOIN v m ON m.id = b.src AND list_contains(m.claims, 3) JOIN v o ON o.id = b.dst WHERE len(list_filter(o.claims, lambda c: c <> 3)) > 0""")
def d18(spark, sf_dir):
    e = supply_edges(spark, sf_dir)
    seen = e.select(F.col("src").alias("id"), "claim_id").union(e.select("dst", "claim_id"))
    v = seen.groupBy("id").agg(F.collect_set("claim_id").alias("claims"))
    return graph.cross_claim_links(e, v, F.lit(3).cast("long")).select("src", "dst", "predicate", F.size("other_claims").cast("long").alias("n_other"))


@query("d19_identifier_lookup", f"WITH e AS {EDGE_SQL} SELECT replace(src, 's', 'id:supplier:') AS src, dst, predicate FROM e WHERE src = 's7' GROUP BY ALL".replace("GROUP BY ALL", "GROUP BY 1, 2, 3"))
def d19(spark, sf_dir):
    e = supply_edges(spark, sf_dir).withColumn("src", F.regexp_replace("src", "^s", "id:supplier:"))
    return graph.find_by_identifier(e, "supplier", "7").select("src", "dst", "predicate").distinct()


@query("e23_hubs", f"WITH e AS {EDGE_SQL} SELECT id, count(*) AS degree FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY id ORDER BY degree DESC, id LIMIT 10")
def e23(spark, sf_dir):
    return graph.hubs(supply_edges(spark, sf_dir), 10)


@query("e23_graph_stats", f"WITH e AS {EDGE_SQL} SELECT 'edge' AS what, predicate AS kind, count(*) AS n FROM e GROUP BY predicate UNION ALL SELECT 'vertex', left(id, 1), count(*) FROM (SELECT src AS id FROM e UNION SELECT dst FROM e) GROUP BY left(id, 1)")
def e23_stats(spark, sf_dir):
    e = supply_edges(spark, sf_dir)
    v = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct().withColumn("kind", F.left("id", F.lit(1)))
    return graph.stats(v, e)


@query("d14_shared_attributes", """WITH i AS (SELECT DISTINCT c_custkey AS e, f, v FROM (SELECT c_custkey, unnest(['has_phone', 'email_domain']) AS f, unnest([CAST(c_custkey % 400 AS VARCHAR), 'd' || CAST(c_custkey % 300 AS VARCHAR)]) AS v FROM customer))
SELECT a.e AS entity_id, b.e AS other, string_agg(DISTINCT a.f || '=' || a.v, ',' ORDER BY a.f || '=' || a.v) AS shared, min(CASE WHEN a.f = 'email_domain' THEN 2 ELSE 1 END) AS degree FROM i a JOIN i b ON a.f = b.f AND a.v = b.v AND a.e <> b.e GROUP BY a.e, b.e""")
def d14(spark, sf_dir):
    k = F.col("c_custkey")
    i = table(spark, sf_dir, "customer").select(k.alias("entity_id"), F.explode(F.create_map(F.lit("has_phone"), (k % 400).cast("string"), F.lit("email_domain"), F.concat(F.lit("d"), (k % 300).cast("string")))).alias("field", "value"))
    s = graph.shared_attributes(i)
    return s.select("entity_id", "other", F.array_join("shared", ",").alias("shared"), "degree")


@query(
    "h21_graph_build",
    """WITH o AS (SELECT o_orderkey AS k, o_custkey % 100 AS claim, o_custkey % 10 AS occ, o_custkey % 5 AS role, o_custkey % 700 AS ent, o_custkey % 300 AS phone, o_orderkey % 3 > 0 AS owned, o_orderkey % 2 = 0 AS valid FROM orders),
first AS (SELECT claim, arg_min(CAST(ent AS VARCHAR), CAST(k AS VARCHAR)) AS claimant FROM o WHERE role = 0 GROUP BY claim),
v AS (SELECT DISTINCT 'ent:' || CAST(ent AS VARCHAR) AS id, CASE WHEN role = 3 THEN 'organization' ELSE 'party' END AS kind FROM o UNION SELECT 'claim:' || CAST(claim AS VARCHAR), 'claim' FROM o UNION SELECT 'occ:' || CAST(occ AS VARCHAR), 'occurrence' FROM o UNION SELECT 'id:' || CAST(phone AS VARCHAR), 'identifier' FROM o),
e AS (SELECT DISTINCT 'PARTY_TO' AS kind, CAST(ent AS VARCHAR) AS a, CAST(claim AS VARCHAR) AS b, CAST(claim AS VARCHAR) AS c, 1.0 AS p FROM o UNION ALL SELECT DISTINCT 'PART_OF', CAST(claim AS VARCHAR), CAST(occ AS VARCHAR), CAST(claim AS VARCHAR), 1.0 FROM o
  UNION ALL SELECT DISTINCT 'HAS_IDENTIFIER', CAST(ent AS VARCHAR), CAST(phone AS VARCHAR), CAST(claim AS VARCHAR), CASE WHEN valid THEN 0.95 ELSE 0.7 END FROM o WHERE owned UNION ALL SELECT DISTINCT 'OBSERVED_ON', CAST(phone AS VARCHAR), CAST(claim AS VARCHAR), CAST(claim AS VARCHAR), 0.6 FROM o WHERE NOT owned
  UNION ALL SELECT DISTINCT ['', 'REPRESENTED_BY', 'TREATED_BY', 'REPAIRED_BY', 'ADJUSTED_BY'][role + 1], claimant, CAST(ent AS VARCHAR), CAST(claim AS VARCHAR), 0.6 FROM o JOIN first USING (claim) WHERE role > 0 AND CAST(ent AS VARCHAR) <> claimant)
SELECT 'vertex' AS what, kind, count(*) AS n FROM v GROUP BY kind UNION ALL SELECT 'edge', kind, count(*) FROM e GROUP BY kind""",
)
def h21(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    docs = o.select(F.col("o_orderkey").cast("string").alias("doc_id"), (F.col("o_custkey") % 100).cast("string").alias("claim_id"), (F.col("o_custkey") % 10).cast("string").alias("occurrence_id"))
    kind = F.element_at(F.array(*[F.lit(x) for x in ("claimant", "attorney", "medical_provider", "repair_shop", "adjuster")]), (F.col("o_custkey") % 5 + 1).cast("int"))
    members = o.select((F.col("o_custkey") % 700).cast("string").alias("entity_id"), F.col("o_orderkey").cast("string").alias("mention_id"), kind.alias("entity_class"), F.concat(F.lit("name "), (F.col("o_custkey") % 700).cast("string")).alias("surface"), F.col("o_orderkey").cast("string").alias("doc_id"))
    seen = o.select(F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderkey").cast("string")).alias("mention_id"), F.lit("phone").alias("kind"), (F.col("o_custkey") % 300).cast("string").alias("value_norm"), (F.col("o_orderkey") % 2 == 0).alias("validated"), F.col("o_orderkey").cast("string").alias("doc_id"))
    v, e = graph.build(members, seen, docs)
    return graph.stats(v, e)


# Assertions of line items: an order is an entity, a value stands for its attribute with a polarity and a tier.
ASSERT_SQL = """(SELECT l_orderkey AS entity_id, ['has_email', 'has_npi', 'works_at'][l_partkey % 3 + 1] AS attribute, CAST(l_suppkey % 7 AS VARCHAR) AS value_norm, l_linenumber AS seq,
 CASE WHEN l_returnflag = 'R' AND l_linenumber % 2 = 0 THEN 'retracted' ELSE 'asserted' END AS polarity,
 CASE WHEN l_partkey % 3 = 2 AND l_linestatus = 'F' THEN 'template_field' WHEN l_partkey % 3 = 2 THEN 'narrative' WHEN l_partkey % 3 = 1 THEN 'narrative' ELSE 'validated_id' END AS tier FROM lineitem)"""


def assertions(spark, sf_dir):
    k = F.col("l_partkey") % 3
    attribute = F.element_at(F.array(*[F.lit(x) for x in ("has_email", "has_npi", "works_at")]), (k + 1).cast("int"))
    a = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("entity_id"),
        attribute.alias("attribute"),
        (F.col("l_suppkey") % 7).cast("string").alias("value_norm"),
        F.col("l_linenumber").alias("seq"),
        F.when((F.col("l_returnflag") == "R") & (F.col("l_linenumber") % 2 == 0), "retracted").otherwise("asserted").alias("polarity"),
        F.when((k == 2) & (F.col("l_linestatus") == "F"), "template").otherwise("llm").alias("extractor"),
        F.lit(None).cast("string").alias("valid_from"),
    )
    return a.withColumn("tier", profile.tier(F.col("attribute"), F.col("extractor"), F.col("value_norm")))


SURVIVOR_SQL = f"""WITH a AS {ASSERT_SQL}, r AS (SELECT *, CASE tier WHEN 'validated_id' THEN 3 WHEN 'template_field' THEN 2 ELSE 1 END AS rank, bool_or(polarity IN ('retracted', 'negated')) OVER (PARTITION BY entity_id, attribute, value_norm) AS gone FROM a),
f AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY entity_id, attribute, value_norm ORDER BY rank DESC, seq) = 1),
t AS (SELECT *, max(CASE WHEN NOT gone THEN rank END) OVER (PARTITION BY entity_id, attribute) AS top FROM f),
c AS (SELECT *, count(*) FILTER (NOT gone AND rank = top) OVER (PARTITION BY entity_id, attribute) > 1 AS conflict FROM t)
SELECT entity_id, attribute, value_norm, tier, CASE WHEN gone THEN 'retracted' END AS known_to, CASE WHEN conflict AND rank = top THEN 1 ELSE 0 END AS conflict_flag FROM c"""


@query("e19_survivorship", SURVIVOR_SQL)
def e19(spark, sf_dir):
    return profile.survivorship(assertions(spark, sf_dir)).select("entity_id", "attribute", "value_norm", "tier", "known_to", "conflict_flag")


@query("e20_roles_per_claim", """SELECT entity_id, claim_id, CASE role WHEN 'attorney' THEN 'claimant_attorney' WHEN 'medical_provider' THEN 'treating_provider' ELSE role END AS role FROM (SELECT o_custkey % 700 AS entity_id, o_custkey % 50 AS claim_id, ['claimant', 'attorney', 'medical_provider'][o_orderkey % 3 + 1] AS role, o_orderkey FROM orders) QUALIFY row_number() OVER (PARTITION BY entity_id, claim_id ORDER BY o_orderkey) = 1""")
def e20(spark, sf_dir):
    kind = F.element_at(F.array(*[F.lit(x) for x in ("claimant", "attorney", "medical_provider")]), (F.col("o_orderkey") % 3 + 1).cast("int"))
    m = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 700).alias("entity_id"), (F.col("o_custkey") % 50).alias("claim_id"), kind.alias("entity_class"), F.col("o_orderkey").alias("seq"))
    return profile.roles_per_claim(m)


@query("e21_identity_summary", f"WITH a AS {ASSERT_SQL} SELECT entity_id, string_agg(DISTINCT value_norm, ',' ORDER BY value_norm) FILTER (attribute = 'has_email') AS emails, string_agg(DISTINCT value_norm, ',' ORDER BY value_norm) FILTER (attribute = 'has_npi') AS npis FROM a GROUP BY entity_id")
def e21(spark, sf_dir):
    s = profile.identity_summary(assertions(spark, sf_dir).select("entity_id", F.col("attribute").alias("field"), F.col("value_norm").alias("value")))
    text = lambda c: F.when(F.size(c) > 0, F.array_join(c, ","))
    return s.select("entity_id", text("emails").alias("emails"), text("npis").alias("npis"))


@query("e22_dossiers")
def e22(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("length(text) > 60")
    a = d.select((F.col("doc_id") % 50).alias("entity_id"), F.lit("works_at").alias("predicate"), F.lit("asserted").alias("polarity"), F.substring("text", 31, 10).alias("value"), "doc_id", F.lit(30).alias("span_start"), F.lit(40).alias("span_end"))
    attributes = profile.survivorship(assertions(spark, sf_dir)).withColumn("entity_id", F.col("entity_id") % 50)
    return profile.dossiers(profile.evidence(a, d.select("doc_id", "text")), attributes)


@query("f08_timeline", f"""WITH s AS ({SURVIVOR_SQL}) SELECT entity_id, attribute, string_agg(value_norm, '>' ORDER BY CASE tier WHEN 'validated_id' THEN 1 WHEN 'template_field' THEN 2 ELSE 3 END, value_norm) AS timeline FROM s GROUP BY entity_id, attribute""")
def f08(spark, sf_dir):
    t = profile.timelines(profile.survivorship(assertions(spark, sf_dir)))
    return t.select("entity_id", "attribute", F.array_join(F.transform("timeline", lambda x: x["value_norm"]), ">").alias("timeline"))

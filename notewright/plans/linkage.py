"""Queries over linkage (D1, D2, E2, E4, E5, H)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from notewright.operators import components, linkage
from notewright.plans import query, table

# A mention frame of customers: names, identifiers and addresses repeat by the remainders of keys.
FRAME_SQL = """(SELECT c_custkey AS mention_id, c_nationkey % 5 AS claim_id,
  ['ann', 'bob', 'cara', 'dan', 'eve', 'finn', 'gus'][c_custkey % 7 + 1] AS first_name, 'lee' || CAST(c_custkey % 97 AS VARCHAR) AS last_name,
  ['ann', 'bob', 'cara', 'dan', 'eve', 'finn', 'gus'][c_custkey % 7 + 1] || ' lee' || CAST(c_custkey % 97 AS VARCHAR) AS full_name,
  ['ann', 'bob', 'cara', 'dan', 'eve', 'finn', 'gus'][c_custkey % 7 + 1] || ' lee' || CAST(c_custkey % 97 AS VARCHAR) AS name_sorted,
  'L' || lpad(CAST(c_custkey % 97 AS VARCHAR), 3, '0') AS name_soundex,
  CASE WHEN c_custkey % 3 = 0 THEN 'u' || CAST(c_custkey % 211 AS VARCHAR) || '@x' || CAST(c_custkey % 4 AS VARCHAR) || '.com' END AS email,
  CASE WHEN c_custkey % 2 = 0 THEN lpad(CAST(c_custkey % 307 AS VARCHAR), 7, '5') END AS phone7,
  CASE WHEN c_custkey % 11 = 0 THEN CAST(1000000000 + c_custkey % 61 AS VARCHAR) END AS npi,
  CASE WHEN c_custkey % 13 = 0 THEN CAST(100000000 + c_custkey % 31 AS VARCHAR) END AS tin,
  CASE WHEN c_custkey % 5 = 0 THEN CAST(1970 + c_custkey % 23 AS VARCHAR) END AS dob,
  CASE WHEN c_custkey % 4 = 0 THEN CAST(c_custkey % 401 AS VARCHAR) || '|oak|' || CAST(c_nationkey AS VARCHAR) END AS address_key,
  CASE WHEN c_custkey % 4 = 0 THEN CAST(c_custkey % 401 AS VARCHAR) || ' oak st' END AS address_street, CASE WHEN c_custkey % 4 < 2 THEN 'city' || CAST(c_nationkey AS VARCHAR) END AS address_city,
  CASE WHEN c_custkey % 4 < 2 THEN 'il' END AS address_state, CASE WHEN c_custkey % 4 = 0 THEN CAST(60000 + c_nationkey AS VARCHAR) END AS address_zip FROM customer)"""


def frame(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    s = lambda x: x.cast("string")
    first = F.element_at(F.array(*[F.lit(x) for x in ("ann", "bob", "cara", "dan", "eve", "finn", "gus")]), (k % 7 + 1).cast("int"))
    last = F.concat(F.lit("lee"), s(k % 97))
    full = F.concat(first, F.lit(" "), last)
    return c.select(
        k.alias("mention_id"),
        (n % 5).alias("claim_id"),
        first.alias("first_name"),
        last.alias("last_name"),
        full.alias("full_name"),
        full.alias("name_sorted"),
        F.concat(F.lit("L"), F.lpad(s(k % 97), 3, "0")).alias("name_soundex"),
        F.when(k % 3 == 0, F.concat(F.lit("u"), s(k % 211), F.lit("@x"), s(k % 4), F.lit(".com"))).alias("email"),
        F.when(k % 2 == 0, F.lpad(s(k % 307), 7, "5")).alias("phone7"),
        F.when(k % 11 == 0, s(1000000000 + k % 61)).alias("npi"),
        F.when(k % 13 == 0, s(100000000 + k % 31)).alias("tin"),
        F.when(k % 5 == 0, s(1970 + k % 23)).alias("dob"),
        F.when(k % 4 == 0, F.concat(s(k % 401), F.lit("|oak|"), s(n))).alias("address_key"),
        F.when(k % 4 == 0, F.concat(s(k % 401), F.lit(" oak st"))).alias("address_street"),
        F.when(k % 4 < 2, F.concat(F.lit("city"), s(n))).alias("address_city"),
        F.when(k % 4 < 2, F.lit("il")).alias("address_state"),
        F.when(k % 4 == 0, s(60000 + n)).alias("address_zip"),
    )


COLUMNS = {"email", "npi", "tin", "phone7", "address_key", "full_name", "name_sorted", "name_soundex", "first_name", "last_name", "dob", "claim_id"}


def block_sql(rules, frame_name: str = "f") -> str:
    parts = []
    for i, rule in enumerate(rules):
        if set(rule) <= COLUMNS:
            on = " AND ".join(f"a.{c} = b.{c}" for c in rule)
            parts.append(f"SELECT a.mention_id AS id_l, b.mention_id AS id_r, {i} AS rule FROM {frame_name} a JOIN {frame_name} b ON {on} AND a.mention_id < b.mention_id")
    return "SELECT id_l, id_r, min(rule) AS match_key FROM (" + " UNION ALL ".join(parts) + ") GROUP BY id_l, id_r"


BLOCK_SQL = block_sql(linkage.BLOCKING)


@query("d01_block_pairs", f"WITH f AS {FRAME_SQL} {BLOCK_SQL}")
def d01(spark, sf_dir):
    return linkage.block(frame(spark, sf_dir))


@query("d02_composite_rule", f"WITH f AS {FRAME_SQL} {block_sql((('name_soundex', 'first_name'),))}")
def d02(spark, sf_dir):
    return linkage.block(frame(spark, sf_dir), (("name_soundex", "first_name"),))


@query("e03_rule_counts", f"WITH f AS {FRAME_SQL} SELECT match_key, count(*) AS n FROM ({BLOCK_SQL}) GROUP BY match_key")
def e03(spark, sf_dir):
    return linkage.rule_counts(frame(spark, sf_dir))


@query(
    "e02_majority_value",
    """SELECT o_custkey AS key, o_orderpriority AS value FROM (SELECT o_custkey, o_orderpriority, count(*) AS n, min(o_orderkey) AS first FROM orders GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, first) = 1""",
)
def e02(spark, sf_dir):
    m = linkage.majority(table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority", "o_orderkey")
    return m.toDF("key", "value")


@query(
    "e04_first_values",
    """WITH r AS (SELECT l_orderkey AS mention_id, ['email', 'phone', 'npi'][l_partkey % 3 + 1] AS kind, CAST(l_suppkey AS VARCHAR) AS value, l_linenumber AS seq, CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END AS lane, l_linestatus FROM lineitem),
f AS (SELECT * FROM r WHERE lane = 0 OR l_linestatus = 'F' QUALIFY row_number() OVER (PARTITION BY mention_id, kind ORDER BY lane, seq, value) = 1)
SELECT mention_id, max(value) FILTER (kind = 'email') AS email, max(value) FILTER (kind = 'phone') AS phone, max(value) FILTER (kind = 'npi') AS npi FROM f GROUP BY mention_id""",
)
def e04(spark, sf_dir):
    kind = F.element_at(F.array(*[F.lit(x) for x in ("email", "phone", "npi")]), (F.col("l_partkey") % 3 + 1).cast("int"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("mention_id"), kind.alias("kind"), F.col("l_suppkey").cast("string").alias("value"), F.col("l_linenumber").alias("seq"), "l_returnflag", "l_linestatus")
    seen = rows.where("l_returnflag = 'R'")
    told = rows.where("l_returnflag <> 'R'").withColumn("grounded", F.lit(1)).withColumn("polarity", F.when(F.col("l_linestatus") == "F", "asserted").otherwise("negated"))
    return linkage.first_identifiers(seen, told).select("mention_id", "email", "phone", "npi")


@query("e05_mention_frame")
def e05(spark, sf_dir):
    from notewright.plans.scalars import addressed

    a = addressed(spark, sf_dir)
    mentions = a.select(F.col("c_custkey").alias("mention_id"), F.col("c_nationkey").alias("claim_id"), F.concat(F.lit("Dr. Reyes, "), "c_name").alias("surface"))
    seen = a.select(F.col("c_custkey").alias("mention_id"), F.explode(F.create_map(F.lit("email"), "email", F.lit("phone"), "phone", F.lit("address"), "address")).alias("kind", "value"), F.lit(0).alias("seq"))
    return linkage.mention_frame(mentions, linkage.first_identifiers(seen))



def sides(name: str) -> str:
    return f"a.{name} AS {name}_l, b.{name} AS {name}_r"


SIDE_COLUMNS = ("claim_id", "name_sorted", "full_name", "email", "phone7", "npi", "tin", "dob", "address_key", "address_street", "address_city", "address_state", "address_zip")
J_SQL = f"WITH f AS {FRAME_SQL}, p AS ({BLOCK_SQL}), j AS (SELECT id_l, id_r, {', '.join(sides(c) for c in SIDE_COLUMNS)} FROM p JOIN f a ON a.mention_id = id_l JOIN f b ON b.mention_id = id_r)"
ADDRESS_SQL = """CASE WHEN coalesce(address_street_l, address_city_l, address_zip_l) IS NULL OR coalesce(address_street_r, address_city_r, address_zip_r) IS NULL THEN -1
 WHEN address_street_l = address_street_r AND (address_zip_l = address_zip_r OR address_city_l = address_city_r) THEN 3 WHEN address_street_l = address_street_r THEN 2
 WHEN address_zip_l = address_zip_r OR (address_city_l = address_city_r AND address_state_l = address_state_r) THEN 1 ELSE 0 END"""


def exact_sql(c: str) -> str:
    return f"CASE WHEN {c}_l IS NULL OR {c}_r IS NULL THEN -1 WHEN {c}_l = {c}_r THEN 1 ELSE 0 END"


def candidate_pairs(spark, sf_dir):
    return linkage.candidates(frame(spark, sf_dir))


@query("h09_name_levels", f"""{J_SQL} SELECT id_l, id_r, CASE WHEN name_sorted_l = name_sorted_r THEN 5 WHEN s >= 0.95 THEN 4 WHEN s >= 0.88 THEN 3
  WHEN (contains(' ' || name_sorted_l || ' ', ' ' || name_sorted_r || ' ') OR contains(' ' || name_sorted_r || ' ', ' ' || name_sorted_l || ' ')) AND claim_id_l = claim_id_r THEN 2
  WHEN contains(' ' || name_sorted_l || ' ', ' ' || name_sorted_r || ' ') OR contains(' ' || name_sorted_r || ' ', ' ' || name_sorted_l || ' ') THEN 1 ELSE 0 END AS level
FROM (SELECT *, jaro_winkler_similarity(name_sorted_l, name_sorted_r) AS s FROM j)""")
def h09(spark, sf_dir):
    from notewright.functions import names

    similarity = names.jaro_winkler("duckdb")("name_sorted_l", "name_sorted_r")
    return candidate_pairs(spark, sf_dir).select("id_l", "id_r", linkage.name_level(similarity).alias("level"))


@query("h10_address_levels", f"{J_SQL} SELECT id_l, id_r, {ADDRESS_SQL} AS level FROM j")
def h10(spark, sf_dir):
    return candidate_pairs(spark, sf_dir).select("id_l", "id_r", linkage.address_level().alias("level"))


FIXED = ("address", "phone7", "npi", "tin", "dob")


def fixed_model() -> linkage.Model:
    return linkage.default_model(list(FIXED))


def weight_sql(c: str, model: linkage.Model) -> str:
    return "CASE g_" + c + " " + " ".join(f"WHEN {i} THEN {model.bits(c, i)!r}" for i in range(len(model.m[c]))) + " ELSE 0.0 END"


GAMMA_SQL = ", ".join(f"{ADDRESS_SQL if c == 'address' else exact_sql(c)} AS g_{c}" for c in FIXED)
WEIGHT_SQL = f"CAST({math.log2(fixed_model().prior / (1 - fixed_model().prior))!r} AS DOUBLE) + " + " + ".join(f"CAST({weight_sql(c, fixed_model())} AS DOUBLE)" for c in FIXED)


def fixed_levels(spark, sf_dir):
    left_out = ("first_name", "last_name", "full_name", "name_sorted", "email")
    return linkage.gammas(linkage.candidates(frame(spark, sf_dir)).drop(*[f"{c}_{s}" for c in left_out for s in "lr"]))


@query("h04_fs_score", f"{J_SQL} SELECT id_l, id_r, round(w, 6) AS match_weight, round(1 / (1 + pow(2.0, -w)), 9) AS probability FROM (SELECT id_l, id_r, {WEIGHT_SQL} AS w FROM (SELECT id_l, id_r, {GAMMA_SQL} FROM j)) WHERE 1 / (1 + pow(2.0, -w)) >= 0.01")
def h04(spark, sf_dir):
    s = linkage.score(fixed_levels(spark, sf_dir), fixed_model(), 0.01)
    return s.select("id_l", "id_r", F.round("match_weight", 6).alias("match_weight"), F.round("probability", 9).alias("probability"))


@query("h05_prior", f"WITH f AS {FRAME_SQL} SELECT n AS n_mentions, c AS n_caught, c / 0.7 / (n * (n - 1) / 2) AS prior FROM (SELECT count(*) AS n FROM f), (SELECT count(*) AS c FROM ({block_sql(linkage.PRIOR_RULES)}))")
def h05(spark, sf_dir):
    return linkage.estimate_prior(frame(spark, sf_dir))


@query("h07_train_and_score")
def h07(spark, sf_dir):
    f = frame(spark, sf_dir)
    model = linkage.train(f)
    s = linkage.score(linkage.gammas(linkage.paired(linkage.block(f), f)), model)
    return s.select("id_l", "id_r", F.round("probability", 6).alias("probability"), "uncalibrated")


@query("h12_level_frequencies", f"{J_SQL} SELECT level, count(*) AS n FROM (SELECT {ADDRESS_SQL} AS level FROM j) GROUP BY level")
def h12(spark, sf_dir):
    return fixed_levels(spark, sf_dir).groupBy(F.col("gamma_address").alias("level")).agg(F.count("*").alias("n"))


@query("h14_cannot_link", f"""{J_SQL} SELECT id_l, id_r, CASE WHEN npi_l <> npi_r THEN 'conflicting_npi' WHEN tin_l <> tin_r THEN 'conflicting_tin' END AS reason FROM j WHERE npi_l <> npi_r OR tin_l <> tin_r""")
def h14(spark, sf_dir):
    p = candidate_pairs(spark, sf_dir).withColumn("ssn_l", F.lit(None).cast("string")).withColumn("ssn_r", F.lit(None).cast("string"))
    return p.select("id_l", "id_r", linkage.cannot_link().alias("reason")).where("reason is not null")


@query("h20_lineage", f"""{J_SQL}, g AS (SELECT id_l, id_r, {GAMMA_SQL} FROM j),
c AS (SELECT id_l, id_r, 0 AS step, 'prior' AS comparison, -1 AS level, CAST({math.log2(fixed_model().prior / (1 - fixed_model().prior))!r} AS DOUBLE) AS bits FROM g
 {' '.join(f"UNION ALL SELECT id_l, id_r, {i}, '{c}', g_{c}, CAST({weight_sql(c, fixed_model())} AS DOUBLE) FROM g" for i, c in enumerate(FIXED, 1))})
SELECT id_l, id_r, step, comparison, level, round(bits, 6) AS bits, round(1 / (1 + pow(2.0, -sum(bits) OVER (PARTITION BY id_l, id_r ORDER BY step))), 6) AS running_probability FROM c""")
def h20(spark, sf_dir):
    levels = fixed_levels(spark, sf_dir)
    c = linkage.contributions(levels, fixed_model())
    return c.select("id_l", "id_r", "step", "comparison", "level", F.round("bits", 6).alias("bits"), F.round("running_probability", 6).alias("running_probability"))


# Edges for components: customers of a nation that share a phone, and those that share an e-mail's name.
EDGE_SQL = f"WITH RECURSIVE f AS {FRAME_SQL}, e AS ({block_sql((('email',), ('npi',)))}), s AS (SELECT id_l AS u, id_r AS v FROM e UNION SELECT id_r, id_l FROM e), r(node, root) AS (SELECT mention_id, mention_id FROM f UNION SELECT r.node, s.v FROM r JOIN s ON r.root = s.u)"


@query("h01_components", f"{EDGE_SQL} SELECT node, min(root) AS component FROM r GROUP BY node")
def h01(spark, sf_dir):
    f = frame(spark, sf_dir)
    return components.connected_components(linkage.links(f, (("email",), ("npi",))), f.select("mention_id"))


def sweep_sql(thresholds) -> str:
    parts = []
    for i, t in enumerate(thresholds):
        parts.append(f"""SELECT CAST({t} AS DOUBLE) AS threshold, count(DISTINCT c) AS n_components FROM (WITH RECURSIVE s AS (SELECT id_l AS u, id_r AS v FROM e WHERE p >= {t} UNION SELECT id_r, id_l FROM e WHERE p >= {t}), r(node, root) AS (SELECT mention_id, mention_id FROM f UNION SELECT r.node, s.v FROM r JOIN s ON r.root = s.u) SELECT node, min(root) AS c FROM r GROUP BY node)""")
    return f"WITH f AS {FRAME_SQL}, e AS (SELECT id_l, id_r, (id_l * 31 + id_r * 17) % 100 / 100.0 AS p FROM ({block_sql((('email',), ('npi',)))})) " + " UNION ALL ".join(parts)


@query("h02_threshold_sweep", sweep_sql((0.3, 0.6, 0.9)))
def h02(spark, sf_dir):
    f = frame(spark, sf_dir)
    e = linkage.block(f, (("email",), ("npi",))).select("id_l", "id_r", ((F.col("id_l") * 31 + F.col("id_r") * 17) % 100 / 100.0).alias("probability"))
    return components.threshold_sweep(e, f.select("mention_id"), [0.3, 0.6, 0.9])


@query(
    "h19_entities",
    f"""{EDGE_SQL}, c AS (SELECT node, min(root) AS component FROM r GROUP BY node), o AS (SELECT component, node, full_name, md5(CAST(node AS VARCHAR)) AS m FROM c JOIN f ON mention_id = node),
i AS (SELECT component, 'E' || left(sha1(concat_ws(':', bit_xor(CAST('0x' || substr(m, 1, 15) AS BIGINT)), bit_xor(CAST('0x' || substr(m, 16, 15) AS BIGINT)), count(*), min(node))), 12) AS entity_id, count(*) AS n_mentions FROM o GROUP BY component),
n AS (SELECT component, full_name FROM (SELECT component, full_name, count(*) AS k, min(node) AS pos FROM o GROUP BY component, full_name) QUALIFY row_number() OVER (PARTITION BY component ORDER BY k DESC, pos) = 1)
SELECT entity_id, full_name AS canonical_name, 'claimant' AS entity_class, n_mentions FROM i JOIN n USING (component)""",
)
def h19(spark, sf_dir):
    f = frame(spark, sf_dir)
    c = components.connected_components(linkage.links(f, (("email",), ("npi",))), f.select("mention_id"))
    mentions = f.select("mention_id", F.col("full_name").alias("surface"), F.lit("claimant").alias("entity_class"), F.col("mention_id").alias("position"))
    return linkage.materialise(c, mentions)


@query("n02_incremental_pairs", f"WITH f AS {FRAME_SQL} SELECT * FROM ({BLOCK_SQL}) WHERE id_l % 50 = 0 OR id_r % 50 = 0")
def n02(spark, sf_dir):
    f = frame(spark, sf_dir)
    return linkage.block(f, new_ids=f.where("mention_id % 50 = 0").select("mention_id"))

"""Queries over stored tables, duplicates, bindings and other operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from notewright.functions import names, text
from notewright.operators import annotate, duplicates, extract, generators, graph, linkage, retrieve, vectors
from notewright.plans import query, table
from notewright.plans.generators import CHUNK_SQL
from notewright.plans.linkage import FIXED, FRAME_SQL, GAMMA_SQL, J_SQL, WEIGHT_SQL, block_sql, fixed_levels, fixed_model, frame
from notewright.plans.retrieve import ENTITIES_SQL, entities, index
from notewright.plans.scalars import SQL_NAMED, named, quoted
from notewright.sources import notes
from notewright.storage import scratch
from notewright.streaming import ingest


@query("b01_strip_accents", f"SELECT doc_id, strip_accents(name) AS plain FROM {SQL_NAMED}")
def b01(spark, sf_dir):
    return named(spark, sf_dir).select("doc_id", names.strip_accents(F.col("name")).alias("plain"))


KNOWN = [k for k, v in text.DESCRIPTORS.items() if v]
SURFACES = [*KNOWN, "same as above", "nobody"]


@query(
    "b37_descriptor_class",
    f"SELECT event_id, MAP {{{', '.join(chr(39) + k + chr(39) + ': ' + chr(39) + text.DESCRIPTORS[k] + chr(39) for k in KNOWN)}}}[s] AS class FROM (SELECT event_id, [{quoted(SURFACES)}][event_id % {len(SURFACES)} + 1] AS s FROM events)",
)
def b37(spark, sf_dir):
    pick = F.element_at(F.array(*[F.lit(s) for s in SURFACES]), (F.col("event_id") % len(SURFACES) + 1).cast("int"))
    shown = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(" "), F.upper(pick))).otherwise(pick)
    return table(spark, sf_dir, "events").select("event_id", text.descriptor_class(shown).alias("class"))


@query("b38_code_points", "SELECT doc_id, substr(text, 11, 20) AS piece, CAST(instr(text, 'e') - 1 AS BIGINT) AS first_at, CAST(length(text) - length(replace(text, 'e', '')) AS BIGINT) AS n FROM documents")
def b38(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.substring("text", 11, 20).alias("piece"), (F.instr("text", "e") - 1).cast("long").alias("first_at"), (F.length("text") - F.length(F.replace("text", F.lit("e"), F.lit("")))).cast("long").alias("n"))


@query(
    "c13_relations",
    """SELECT doc_id, p AS predicate, CASE WHEN doc_id % 5 = 0 THEN 'asserted' ELSE 'alleged' END AS polarity, doc_id % 5 = 0 AS polarity_coerced, s AS subject_is_descriptor,
  CAST(CASE WHEN f THEN instr(text, e) - 1 END AS INTEGER) AS "start", CAST(CASE WHEN f THEN instr(text, e) - 1 + length(e) END AS INTEGER) AS "end", CASE WHEN p = 'HAS_NPI' THEN 'identifier' WHEN NOT f THEN 'evidence not found' END AS refused
FROM (SELECT *, instr(text, e) > 0 AS f FROM (SELECT doc_id, text, CASE WHEN doc_id % 2 = 0 THEN 'TREATED_BY' ELSE 'HAS_NPI' END AS p, doc_id % 3 = 0 AS s, CASE WHEN doc_id % 4 = 3 THEN 'this stands nowhere at all' ELSE substr(text, 21, 30) END AS e FROM documents WHERE length(text) >= 60 AND regexp_matches(substr(text, 21, 30), '[a-zA-Z]')))""",
)
def c13(spark, sf_dir):
    k = F.col("doc_id")
    d = table(spark, sf_dir, "documents").where("length(text) >= 60").where(F.substring("text", 21, 30).rlike("[a-zA-Z]"))
    raw = d.select(
        "doc_id", F.when(k % 3 == 0, "the claimant").otherwise("Ann Lee").alias("subject"), F.when(k % 2 == 0, "went to").otherwise("has npi").alias("predicate"), F.lit("Oak Clinic").alias("object"),
        F.when(k % 5 == 0, "sure").otherwise("alleged").alias("polarity"), F.when(k % 4 == 3, "this stands nowhere at all").otherwise(F.substring("text", 21, 30)).alias("evidence"), "text",
    )
    return extract.relations(raw).select("doc_id", "predicate", "polarity", "polarity_coerced", "subject_is_descriptor", "start", "end", "refused")


@query("f03_most_mentioned", f"SELECT entity_id, n_mentions FROM {ENTITIES_SQL} WHERE entity_class = 'building' ORDER BY n_mentions DESC, entity_id LIMIT 10")
def f03(spark, sf_dir):
    return retrieve.execute(retrieve.Plan("building"), entities(spark, sf_dir), index(spark, sf_dir)).select("entity_id", "n_mentions").limit(10)


SIMILAR_SQL = f"""t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS ts FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ts[p:p + 4], ' ') AS g FROM (SELECT doc_id, ts, unnest(generate_series(1, len(ts) - 4)) AS p FROM t WHERE len(ts) >= 5)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT x, y, k / (p.n + q.n - k) AS sim FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE k / (p.n + q.n - k) >= {duplicates.LEAST})"""


def segments(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("segment_id"), F.col("doc_id").alias("order"), F.lit(0).alias("char_start"), "text")


@query("h03_near_duplicates", f"WITH RECURSIVE {SIMILAR_SQL}, r(node, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.node, e.y FROM r JOIN e ON r.root = e.x) SELECT node AS segment_id, min(root) AS dup_group_id, CASE WHEN min(root) = node THEN 1 ELSE 0 END AS is_canonical_dup FROM r GROUP BY node")
def h03(spark, sf_dir):
    return duplicates.duplicate_groups(duplicates.sketches(segments(spark, sf_dir)))


@query(
    "n04_duplicates_of_prior",
    f"""WITH RECURSIVE {SIMILAR_SQL}, r(node, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.node, e.y FROM r JOIN e ON r.root = e.x AND e.x % 2 = e.y % 2),
g AS (SELECT node, min(root) AS grp FROM r GROUP BY node),
h AS (SELECT x, y FROM e WHERE x % 2 = 1 AND y % 2 = 0 QUALIFY row_number() OVER (PARTITION BY x ORDER BY sim DESC, y) = 1),
a AS (SELECT g.grp, arg_min(o.grp, g.node) AS adopted FROM h JOIN g ON g.node = h.x JOIN g o ON o.node = h.y GROUP BY g.grp)
SELECT node AS segment_id, coalesce(adopted, grp) AS dup_group_id, CASE WHEN adopted IS NULL AND grp = node THEN 1 ELSE 0 END AS is_canonical_dup FROM g LEFT JOIN a USING (grp) WHERE node % 2 = 1""",
)
def n04(spark, sf_dir):
    """Documents of odd ids arrive after those of even ids were stored."""
    s = segments(spark, sf_dir)
    old = duplicates.sketches(s.where("segment_id % 2 = 0"))
    stored = old.join(duplicates.duplicate_groups(old).select("segment_id", "dup_group_id"), "segment_id")
    return duplicates.duplicate_groups(duplicates.sketches(s.where("segment_id % 2 = 1")), stored)


U_COLUMNS = ("phone7", "npi", "tin", "dob")


def u_sql(c: str) -> str:
    n = lambda level: f"(count(*) FILTER ({level}) + 0.5)"
    same, other = n(f"a.{c} = b.{c}"), n(f"a.{c} <> b.{c}")
    return f"SELECT '{c}' AS comparison, i AS level, round(CASE i WHEN 1 THEN y ELSE x END / (x + y), 9) AS u FROM (SELECT {other} AS x, {same} AS y FROM f a JOIN f b ON a.mention_id < b.mention_id), (VALUES (0), (1)) v(i)"


@query("h06_u_levels", f"WITH f AS {FRAME_SQL} {' UNION ALL '.join(u_sql(c) for c in U_COLUMNS)}")
def h06(spark, sf_dir):
    """All pairs while there are at most 2,000 mentions; a sample of so many beyond."""
    u = linkage.estimate_u(frame(spark, sf_dir).select("mention_id", *U_COLUMNS))
    return spark.createDataFrame([(c, i, round(x, 9)) for c in U_COLUMNS for i, x in enumerate(u[c])], "comparison string, level int, u double")


@query("h08_comparison_levels", f"{J_SQL} SELECT id_l, id_r, {GAMMA_SQL} FROM j")
def h08(spark, sf_dir):
    return fixed_levels(spark, sf_dir).select("id_l", "id_r", *[F.col(f"gamma_{c}").alias(f"g_{c}") for c in FIXED])


HEX = "instr('0123456789abcdef', m[{}]) - 1"


@query(
    "h17_hashed_embedding",
    f"""WITH t AS (SELECT c_custkey, ' ' || lower(trim(c_name)) || ' ' AS t FROM customer), r AS (SELECT c_custkey, md5(t[p:p + k - 1]) AS m FROM (SELECT c_custkey, t, k, unnest(generate_series(1, length(t) - k + 1)) AS p FROM t, (VALUES (3), (4), (5)) v(k))),
d AS (SELECT c_custkey, ({HEX.format(31)}) * 16 + ({HEX.format(32)}) AS low, ({' + '.join('(' + HEX.format(i) + ')' for i in range(1, 33))}) % 3 AS three FROM r),
c AS (SELECT c_custkey, low + 256 * ((three - low % 3 + 3) % 3) AS slot, count(*) AS n FROM d GROUP BY 1, 2)
SELECT c_custkey, slot, round(n / sqrt(sum(n * n) OVER (PARTITION BY c_custkey)), 9) AS value FROM c""",
)
def h17(spark, sf_dir):
    """768 slots: 256 by the digest's last byte, three by its remainder, which is that of the sum of its hex digits."""
    v = vectors.embed(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_name")
    return v.select("c_custkey", F.posexplode("vector").alias("slot", "value")).where("value > 0").select("c_custkey", F.col("slot").cast("long"), F.round("value", 9).alias("value"))


VERTEX_SQL = "(SELECT 'p' || CAST(l_partkey % 200 AS VARCHAR) AS id, l_orderkey % 30 AS claim, l_suppkey AS doc, l_orderkey * 10 + l_linenumber AS seq, l_returnflag AS label FROM lineitem)"


def sighted(spark, sf_dir):
    """Order keys and line numbers repeat: of equal ones the row that stands first in the table is the first, as for arg_min."""
    seq = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    place = F.when(seq.isNotNull(), F.struct(seq, "_metadata.file_path", "_metadata.row_index"))
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("p"), (F.col("l_partkey") % 200).cast("string")).alias("id"), F.lit("part").alias("kind"), F.col("l_returnflag").alias("label"),
        F.array(F.col("l_orderkey") % 30).alias("claims"), F.array("l_suppkey").alias("docs"), place.alias("seq"),
    )


@query("h22_upsert_vertices", f"SELECT id, arg_min(label, seq) AS label, array_to_string(list_sort(list_distinct(list(claim))), ',') AS claims, array_to_string(list_sort(list_distinct(list(doc))), ',') AS docs FROM {VERTEX_SQL} GROUP BY id")
def h22(spark, sf_dir):
    v = graph.upsert_vertices(sighted(spark, sf_dir))
    return v.select("id", "label", F.array_join(F.col("claims").cast("array<string>"), ",").alias("claims"), F.array_join(F.col("docs").cast("array<string>"), ",").alias("docs"))


@query(
    "h23_claim_triples",
    """WITH e AS (SELECT DISTINCT 's' || CAST(l_suppkey AS VARCHAR) AS src, 'p' || CAST(l_partkey AS VARCHAR) AS dst FROM lineitem WHERE l_orderkey % 20 = 3)
SELECT src, dst, s_name || ' -[SUPPLIES]-> ' || p_name AS triple FROM e JOIN supplier ON src = 's' || CAST(s_suppkey AS VARCHAR) JOIN part ON dst = 'p' || CAST(p_partkey AS VARCHAR)""",
)
def h23(spark, sf_dir):
    s = lambda c: F.col(c).cast("string")
    li = table(spark, sf_dir, "lineitem")
    e = li.select(F.concat(F.lit("s"), s("l_suppkey")).alias("src"), F.concat(F.lit("p"), s("l_partkey")).alias("dst"), F.lit("SUPPLIES").alias("predicate"), s("l_orderkey").alias("o")).withColumn("claim_id", (F.col("o").cast("long") % 20).cast("string"))
    own = graph.claim_subgraph(e, "3").select("src", "dst", "predicate").distinct()
    v = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), s("s_suppkey")).alias("id"), F.col("s_name").alias("label")).union(table(spark, sf_dir, "part").select(F.concat(F.lit("p"), s("p_partkey")), "p_name"))
    return graph.triple(own, v)


@query("j01_chunk_index", f"SELECT c.doc_id, c.index AS chunk, char_start, char_end, coalesce(source, 'UNKNOWN') AS claim_id FROM ({CHUNK_SQL}) c LEFT JOIN (SELECT doc_id, source FROM documents WHERE doc_id % 3 > 0) d USING (doc_id)")
def j01(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    claims = d.where("doc_id % 3 > 0").select("doc_id", F.col("source").alias("claim_id"))
    i = retrieve.chunk_index(generators.chunks(d), claims)
    return i.select("doc_id", F.col("index").cast("long").alias("chunk"), F.col("char_start").cast("long"), F.col("char_end").cast("long"), "claim_id")


QUESTIONS = {
    "Which attorneys share the same phone on several claims?": ("attorney", "", "phone", True),
    "Who is named Ann Lee?": (None, "name fuzzy Ann Lee", "", False),
    "Providers with npi 1234567890": ("medical_provider", "npi contains 1234567890", "", False),
    "shops whose name starts with Bay and uses a@b.com": ("repair_shop", "email eq a@b.com;name startswith bay", "", False),
}


def literal(x) -> str:
    return "CAST(NULL AS VARCHAR)" if x is None else str(x).lower() if isinstance(x, bool) else "'" + x + "'"


@query("j06_plan_question", "SELECT * FROM (VALUES " + ", ".join(f"({literal(q)}, {', '.join(map(literal, want))})" for q, want in QUESTIONS.items()) + ") v(question, entity_class, filters, links, several_claims)")
def j06(spark, sf_dir):
    plans = [(q, retrieve.plan_question(q)) for q in QUESTIONS]
    rows = [(q, p.entity_class, ";".join(f"{f.field} {f.op} {f.value}" for f in p.filters), ",".join(p.link_via), p.cross_reference) for q, p in plans]
    return spark.createDataFrame(rows, "question string, entity_class string, filters string, links string, several_claims boolean")


@query("jd4_enough_evidence", "SELECT count(*) AS n_evidence, CASE WHEN count(*) < 3 THEN 'insufficient evidence' END AS reason FROM documents WHERE contains(text, 'stupid')")
def jd4(spark, sf_dir):
    return retrieve.enough(table(spark, sf_dir, "documents").where(F.col("text").contains("stupid")), 3)


@query("m05_served_vocabulary", f"SELECT f AS field, o AS op FROM (SELECT unnest([{quoted(retrieve.FIELDS)}]) AS f), (SELECT unnest([{quoted(retrieve.OPS)}]) AS o)")
def m05(spark, sf_dir):
    """Every declared field and operation makes a condition."""
    served = [(f, o) for f in retrieve.FIELDS for o in retrieve.OPS if retrieve.matches(retrieve.Filter(f, o, "x")) is not None]
    return spark.createDataFrame(served, "field string, op string")


@query("a10_append_and_migrate", "SELECT o_orderkey, o_totalprice, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS o_orderstatus FROM orders WHERE o_totalprice > 1000")
def a10(spark, sf_dir):
    """A table gains a column: older rows lack it, the filter reaches the scan."""
    path = scratch(spark, "orders-table")
    o = table(spark, sf_dir, "orders")
    whole = o.select("o_orderkey", "o_totalprice", "o_orderstatus")
    notes.write_table(o.where("o_orderkey % 2 = 1").select("o_orderkey", "o_totalprice"), path)
    notes.write_table(notes.migrate(whole.where("o_orderkey % 2 = 0"), whole.schema), path)
    return notes.migrate(notes.read_table(spark, path), whole.schema).where("o_totalprice > 1000").select(whole.columns)


@query(
    "a05_firm_csv",
    """SELECT claim_number, entity_name, entity_zip_code, claim_number || '#' || CAST(row_number() OVER (PARTITION BY claim_number ORDER BY k) AS VARCHAR) AS row_id
FROM (SELECT c_custkey AS k, 'C' || CAST(c_nationkey AS VARCHAR) AS claim_number, 'The "' || c_name || '",' || chr(10) || 'Inc' AS entity_name, lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS entity_zip_code FROM customer)""",
)
def a05(spark, sf_dir):
    """A firm's CSV: quotes, commas and line ends in cells, leading zeros, other spellings of headers."""
    path = scratch(spark, "firm")
    c = table(spark, sf_dir, "customer").orderBy("c_custkey")
    rows = c.select(F.concat(F.lit("C"), F.col("c_nationkey").cast("string")).alias("CLAIM_NUMBER"), F.concat(F.lit('The "'), "c_name", F.lit('",\nInc')).alias("Entity_Name"), F.lpad(F.col("c_custkey").cast("string"), 9, "0").alias("entity_zip_code"))
    rows.coalesce(1).write.csv(path, header=True, quote='"', escape='"')
    return notes.read_firm_csv(spark, path)[0].select("claim_number", "entity_name", "entity_zip_code", "row_id")


@query("a18_export_bundle", "SELECT l_orderkey % 50 AS claim, 'r' || CAST(l_suppkey % 3 AS VARCHAR) AS reviewer, l_orderkey AS k, l_linenumber AS line FROM lineitem WHERE (l_orderkey % 50 + l_suppkey % 3) % 2 = 0 AND l_orderkey % 50 <> 7")
def a18(spark, sf_dir):
    """What reviewers have sealed, without the practice claim, written as CSV and read again."""
    li = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 50).alias("claim"), F.concat(F.lit("r"), (F.col("l_suppkey") % 3).cast("string")).alias("reviewer"), F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"))
    sealed = li.select("claim", "reviewer").distinct().where("(claim + cast(substring(reviewer, 2, 1) as int)) % 2 = 0")
    path = scratch(spark, "bundle")
    notes.export_bundle({"records": li}, path, sealed, F.col("claim") == 7)
    return spark.read.schema(li.schema).csv(f"{path}/records", header=True)


@query(
    "a19_comparison_table",
    """SELECT o_orderkey AS row_id, c_custkey AS entity_id, CASE WHEN c_custkey IS NULL THEN 'firm only' ELSE 'both' END AS source FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_mktsegment <> 'BUILDING'
UNION ALL SELECT NULL, c_custkey, 'gold only' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment <> 'BUILDING')""",
)
def a19(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    firm = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), F.lit("c").alias("claim"))
    pairs = table(spark, sf_dir, "orders").join(c.where("c_mktsegment <> 'BUILDING'"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("row_id"), F.col("c_custkey").alias("entity_id"))
    return notes.comparison_table(firm, pairs, c.select(F.lit("c").alias("claim"), F.col("c_custkey").alias("entity_id"))).select("row_id", "entity_id", "source")


@query("a23_delivered_notes", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, sha256(text) AS hash FROM documents WHERE text IS NOT NULL")
def a23(spark, sf_dir):
    """Two deliveries into a watched folder, read as the stream's source reads them."""
    inbox = scratch(spark, "inbox")
    d = table(spark, sf_dir, "documents").where("text is not null")
    ingest.deliver(d.where("doc_id % 2 = 0"), inbox)
    ingest.deliver(d.where("doc_id % 2 = 1"), inbox)
    return notes.hashes(spark.read.schema(ingest.NOTE).parquet(inbox))


@query("d13_identifier_binding", "SELECT o_orderkey AS hit, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'owner ' || CAST(o_custkey % 9 AS VARCHAR) END AS owner, CASE WHEN o_orderkey % 4 = 0 THEN 'unbound' ELSE 'named' END AS method FROM orders")
def d13_binding(spark, sf_dir):
    """Identifiers with the owner that a model names for them; the model spells values its own way, and names none for a quarter."""
    o = table(spark, sf_dir, "orders")
    hits = o.select((F.col("o_orderkey") % 100).alias("doc_id"), F.col("o_orderkey").alias("hit"), F.lit("phone").alias("kind"), F.concat(F.lit("+1 (555) "), F.lpad(F.col("o_orderkey").cast("string"), 10, "0")).alias("value"))
    told = o.where("o_orderkey % 4 <> 0").select((F.col("o_orderkey") % 100).alias("doc_id"), F.lit("phone").alias("kind"), F.concat(F.lit("1555-"), F.lpad(F.col("o_orderkey").cast("string"), 10, "0")).alias("value"), F.concat(F.lit("owner "), (F.col("o_custkey") % 9).cast("string")).alias("owner"))
    return extract.bind_identifiers(hits, told.union(told)).select("hit", "owner", "method")


N01_RULES = (("npi",), ("tin",), ("phone7",), ("address_key",))
N01_COLUMNS = ("mention_id", "claim_id", "phone7", "npi", "tin", "dob", "address_key", "address_street", "address_city", "address_state", "address_zip")


@query(
    "n01_backfill_then_ingest",
    f"""WITH RECURSIVE f AS {FRAME_SQL}, p AS ({block_sql(N01_RULES)}), j AS (SELECT id_l, id_r, {', '.join(f'a.{c} AS {c}_l, b.{c} AS {c}_r' for c in N01_COLUMNS[1:])} FROM p JOIN f a ON a.mention_id = id_l JOIN f b ON b.mention_id = id_r),
w AS (SELECT id_l, id_r, {WEIGHT_SQL} AS w FROM (SELECT id_l, id_r, {GAMMA_SQL} FROM j)), e AS (SELECT id_l, id_r FROM w WHERE 1 / (1 + pow(2.0, -w)) >= 0.95),
s AS (SELECT id_l AS u, id_r AS v FROM e UNION SELECT id_r, id_l FROM e), r(node, root) AS (SELECT mention_id, mention_id FROM f UNION SELECT r.node, s.v FROM r JOIN s ON r.root = s.u) SELECT node, min(root) AS entity_id FROM r GROUP BY node""",
)
def n01(spark, sf_dir):
    """Nine mentions of ten are backfilled, the others come as a batch: identities are those of all at once."""
    whole = frame(spark, sf_dir).select(*N01_COLUMNS)
    docs = whole.select(F.col("mention_id").cast("string").alias("doc_id"), F.lit("note").alias("text"))
    extracted = lambda d: d.select("doc_id").join(whole.withColumn("doc_id", F.col("mention_id").cast("string")), "doc_id")
    store = ingest.Store(spark, scratch(spark, "store"))
    ingest.backfill(store, docs.where("cast(doc_id as long) % 10 <> 0"), extracted, fixed_model(), 0.95)
    ingest.ingest(store, docs.where("cast(doc_id as long) % 10 = 0"), extracted, fixed_model(), 0.95)
    return store.read("entities").select("node", "entity_id")



@query(
    "k06_freeze",
    """WITH r AS (SELECT c_nationkey AS claim, 'r' || CAST(c_custkey % 4 AS VARCHAR) AS reviewer, max(c_custkey) AS m FROM customer GROUP BY 1, 2),
e AS (SELECT DISTINCT c_nationkey AS claim, 'r' || CAST(c_custkey % 4 AS VARCHAR) AS reviewer FROM customer WHERE c_custkey % 40 = 1), d AS (SELECT DISTINCT c_nationkey AS claim, 'r' || CAST(c_custkey % 4 AS VARCHAR) AS reviewer FROM customer WHERE c_custkey % 40 = 2),
x AS (SELECT r.*, e.claim IS NOT NULL AS open, d.claim IS NOT NULL AS drafted FROM r LEFT JOIN e ON r.claim = e.claim AND r.reviewer = e.reviewer LEFT JOIN d ON r.claim = d.claim AND r.reviewer = d.reviewer)
SELECT claim, reviewer, CASE WHEN m % 11 = 0 THEN NULL WHEN m % 7 = 0 THEN 'seen before' WHEN m % 5 = 0 THEN 'notes are open' WHEN open THEN 'entities are not reviewed' WHEN drafted THEN 'drafts are open' WHEN m % 3 = 0 THEN 'not attested' END AS refused FROM x""",
)
def k06(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("claim"), F.concat(F.lit("r"), (F.col("c_custkey") % 4).cast("string")).alias("reviewer"), F.col("c_custkey").alias("k"))
    m = F.col("m")
    reviews = c.groupBy("claim", "reviewer").agg(F.max("k").alias("m")).select("claim", "reviewer", (m % 11 == 0).alias("frozen"), (m % 7 == 0).alias("exposed"), (m % 5 != 0).alias("complete"), (m % 3 != 0).alias("attested"))
    drafts = c.select("claim", "reviewer", F.when(F.col("k") % 40 == 2, "ready").otherwise("accepted").alias("status"))
    return annotate.freeze_refusals(reviews, c.select("claim", "reviewer", (F.col("k") % 40 != 1).alias("reviewed")), drafts)

"""Queries over rows made from texts and spans (C, D3-D8, E1, E15)."""

from __future__ import annotations

from pyspark.sql import functions as F

from notewright.functions import gazetteers
from notewright.operators import generators, intervals
from notewright.plans import query, table
from notewright.plans.scalars import BOILER

# Every third line becomes a quoted one, so that documents have segments of both kinds.
QUOTING = "array_join(transform(split(text, '\\n'), (l, i) -> if(i % 3 = 1, concat('> ', l), l)), '\\n')"


def quoted_docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(QUOTING.replace("\\n", "\n")).alias("text"))


@query(
    "c01_segments",
    f"""WITH q AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda l, i: CASE WHEN (i - 1) % 3 = 1 THEN '> ' || l ELSE l END) AS ls FROM documents),
l AS (SELECT doc_id, n, CASE WHEN n < len(ls) THEN ls[n] || chr(10) ELSE ls[n] END AS line FROM (SELECT doc_id, ls, unnest(generate_series(1, len(ls))) AS n FROM q)),
k AS (SELECT *, CASE WHEN regexp_matches(line, '^[ \\t]*>+') THEN 'quoted' ELSE 'body' END AS kind FROM l WHERE line <> ''),
e AS (SELECT *, sum(length(line)) OVER (PARTITION BY doc_id ORDER BY n) AS hi, CASE WHEN lag(kind) OVER (PARTITION BY doc_id ORDER BY n) = kind THEN 0 ELSE 1 END AS new FROM k),
r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY n) AS run FROM e),
s AS (SELECT doc_id, kind, CAST(min(hi - length(line)) AS BIGINT) AS char_start, CAST(max(hi) AS BIGINT) AS char_end, lower(string_agg(line, '' ORDER BY n)) AS l FROM r GROUP BY doc_id, run, kind)
SELECT doc_id, kind, char_start, char_end, round(CASE WHEN h > 0 AND NOT regexp_matches(l, '[0-9]') THEN least(1.0, least(1.0, h / 3.0) + 0.15) ELSE least(1.0, h / 3.0) END, 3) AS boilerplate_score FROM (SELECT *, {BOILER} AS h FROM s)""",
)
def c01(spark, sf_dir):
    return generators.segments(quoted_docs(spark, sf_dir)).select("doc_id", "kind", F.col("char_start").cast("long"), F.col("char_end").cast("long"), "boilerplate_score")


T = "regexp_extract_all(text, '[ \\t\\n\\r\\f]*[^ \\t\\n\\r\\f]+')"
CHUNK_SQL = f"""SELECT doc_id, k AS index, CAST(CASE WHEN k = 0 THEN 0 ELSE length(array_to_string(t[1:i], '')) + length(regexp_extract(t[i + 1], '^([ \\t\\n\\r\\f]*)', 1)) END AS BIGINT) AS char_start,
  CAST(CASE WHEN i + {generators.WINDOW} >= n THEN length(text) ELSE length(array_to_string(t[1:i + {generators.WINDOW}], '')) END AS BIGINT) AS char_end, CAST(least({generators.WINDOW}, n - i) AS BIGINT) AS n_words
FROM (SELECT doc_id, text, t, n, k, k * {generators.STEP} AS i FROM (SELECT doc_id, text, t, len(t) AS n, unnest(generate_series(0, CASE WHEN len(t) <= {generators.WINDOW} THEN 0 ELSE CAST(ceil((len(t) - {generators.WINDOW}) / {generators.STEP}.0) AS BIGINT) END)) AS k
  FROM (SELECT doc_id, text, {T} AS t FROM documents)))"""


@query("c02_chunks", CHUNK_SQL)
def c02(spark, sf_dir):
    c = generators.chunks(table(spark, sf_dir, "documents"))
    return c.select("doc_id", F.col("index").cast("long"), F.col("char_start").cast("long"), F.col("char_end").cast("long"), F.col("n_words").cast("long"))


SWEEP_SQL = """WITH e AS (SELECT doc_id, pos, sum(d) AS d FROM (SELECT doc_id, lo AS pos, 1 AS d FROM s UNION ALL SELECT doc_id, hi, -1 FROM s) GROUP BY doc_id, pos),
x AS (SELECT doc_id, lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) - pos AS n, sum(d) OVER (PARTITION BY doc_id ORDER BY pos) AS depth FROM e),
c AS (SELECT doc_id, sum(n) FILTER (depth >= 1) AS covered, sum(n) FILTER (depth >= 2) AS twice, max(depth) AS max_depth FROM x GROUP BY doc_id),
k AS (SELECT doc_id, count(*) AS n_spans FROM s GROUP BY doc_id)
SELECT doc_id, n_chars, CAST(coalesce(covered, 0) AS BIGINT) AS covered, CAST(coalesce(twice, 0) AS BIGINT) AS twice, CAST(coalesce(max_depth, 0) AS BIGINT) AS max_depth, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans
FROM docs LEFT JOIN c USING (doc_id) LEFT JOIN k USING (doc_id)"""


@query("c03_coverage", f"WITH s AS (SELECT doc_id, char_start AS lo, char_end AS hi FROM ({CHUNK_SQL})), docs AS (SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars FROM documents), {SWEEP_SQL.removeprefix('WITH ')}")
def c03(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    spans = generators.chunks(docs).select("doc_id", F.col("char_start").alias("start"), F.col("char_end").alias("end"))
    return intervals.coverage(spans, docs.select("doc_id", F.length("text").cast("long").alias("n_chars")))


@query("c04_gazetteer")
def c04(spark, sf_dir):
    return gazetteers.scan(table(spark, sf_dir, "documents")).select("doc_id", "start", "end", "label", "valid", "validation")


@query(
    "c04_gazetteer_counts",
    """SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Za-z0-9._%+\\-]+@[A-Za-z0-9.\\-]+\\.[A-Za-z]{2,}')) AS BIGINT) AS email, CAST(len(regexp_extract_all(text, '\\$\\s?\\d{1,3}(?:,\\d{3})*(?:\\.\\d{2})?\\b')) AS BIGINT) AS monetary_amount FROM documents""",
)
def c04_counts(spark, sf_dir):
    return gazetteers.counts(table(spark, sf_dir, "documents"), ["email", "monetary_amount"])


# Spans of line items: a document is an order, lengths and places follow keys.
SPANS_SQL = "SELECT l_orderkey AS doc_id, l_linenumber AS span_id, CAST(l_partkey % 60 AS INTEGER) AS lo, CAST(l_partkey % 60 + 3 + l_suppkey % 25 AS INTEGER) AS hi, ['person', 'email', 'phone', 'address'][l_partkey % 4 + 1] AS label, CAST([50, 92, 60, 80][l_partkey % 4 + 1] AS INTEGER) AS priority FROM lineitem"


def spans(spark, sf_dir):
    k = F.col("l_partkey") % 4 + 1
    at = F.col("l_partkey") % 60
    pick = lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), k.cast("int"))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"),
        F.col("l_linenumber").alias("span_id"),
        at.cast("int").alias("start"),
        (at + 3 + F.col("l_suppkey") % 25).cast("int").alias("end"),
        pick("person", "email", "phone", "address").alias("label"),
        pick(50, 92, 60, 80).alias("priority"),
    )


@query(
    "c05_conflicts",
    f"""WITH h AS ({SPANS_SQL}), o AS (SELECT * FROM (SELECT DISTINCT doc_id, lo, hi, label, priority FROM h) QUALIFY row_number() OVER (PARTITION BY doc_id, lo, hi ORDER BY priority DESC, label) = 1)
SELECT doc_id, lo AS "start", hi AS "end", label FROM o a WHERE NOT EXISTS (SELECT 1 FROM o b WHERE a.doc_id = b.doc_id AND b.lo <= a.lo AND a.hi <= b.hi AND b.hi - b.lo > a.hi - a.lo AND b.priority >= a.priority)""",
)
def c05(spark, sf_dir):
    return intervals.resolve_conflicts(spans(spark, sf_dir).drop("span_id").distinct()).select("doc_id", "start", "end", "label")


@query("c10_uncovered", f"""WITH h AS ({SPANS_SQL}), c AS (SELECT * FROM h WHERE label = 'phone'), s AS (SELECT * FROM h WHERE label <> 'phone')
SELECT doc_id, span_id FROM c a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE a.doc_id = b.doc_id AND a.lo < b.hi AND b.lo < a.hi)""")
def c10(spark, sf_dir):
    s = spans(spark, sf_dir)
    return intervals.uncovered(s.where("label = 'phone'"), s.where("label <> 'phone'").select("doc_id", "start", "end")).select("doc_id", "span_id")


@query(
    "c12_allegations",
    """SELECT doc_id, CAST(n - 1 AS INTEGER) AS n, c[n] AS clause FROM (SELECT doc_id, c, unnest(generate_series(1, len(c))) AS n FROM (SELECT doc_id, regexp_extract_all(replace(text, ' the ', ' alleged '), '(?i)(suspect[^.;\\n]*|alleg[^.;\\n]*)') AS c FROM documents))""",
)
def c12(spark, sf_dir):
    return generators.allegations(table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit(" the "), F.lit(" alleged ")).alias("text")))


SHINGLES_SQL = """SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(generate_series(1, len(ws) - 4), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS shingle
FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9À-ÿ]+'), lambda w: w <> '') AS ws FROM documents)"""


@query("c14_shingles", f"SELECT doc_id, count(*) AS n_shingles, min(shingle) AS least FROM ({SHINGLES_SQL}) GROUP BY doc_id")
def c14(spark, sf_dir):
    return generators.shingles(table(spark, sf_dir, "documents")).groupBy("doc_id").agg(F.count("*").alias("n_shingles"), F.min("shingle").alias("least"))


@query("c15_parts")
def c15(spark, sf_dir):
    return generators.parts(table(spark, sf_dir, "documents"), 1000)


@query(
    "c17_token_offsets",
    """SELECT doc_id, CAST(len(t) AS BIGINT) AS n, CAST(coalesce(length(regexp_extract(text, '^([ \\t\\n\\r\\f]*)', 1)), 0) AS BIGINT) AS first FROM (SELECT doc_id, text, regexp_extract_all(text, '[^ \\t\\n\\r\\f]+') AS t FROM documents) WHERE len(t) > 0""",
)
def c17(spark, sf_dir):
    t = generators.token_offsets(table(spark, sf_dir, "documents"))
    return t.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("start").cast("long").alias("first"))


@query("d03_overlap", f"""WITH h AS ({SPANS_SQL}) SELECT a.doc_id, a.span_id AS a, b.span_id AS b FROM h a JOIN h b ON a.doc_id = b.doc_id AND a.label = 'person' AND b.label = 'email' AND a.lo < b.hi AND b.lo < a.hi""")
def d03(spark, sf_dir):
    s = spans(spark, sf_dir)
    j = intervals.overlap_join(s.where("label = 'person'"), s.where("label = 'email'"))
    return j.select("doc_id", F.col("span_id").alias("a"), F.col("span_id_r").alias("b"))


@query("d04_contained", f"""WITH h AS ({SPANS_SQL}) SELECT a.doc_id, a.span_id AS a, b.span_id AS b FROM h a JOIN h b ON a.doc_id = b.doc_id AND a.span_id <> b.span_id AND b.lo <= a.lo AND a.hi <= b.hi""")
def d04(spark, sf_dir):
    s = spans(spark, sf_dir)
    return intervals.contained_join(s, s).where("span_id <> span_id_r").select("doc_id", F.col("span_id").alias("a"), F.col("span_id_r").alias("b"))


@query("d05_point_in_span", f"""WITH h AS ({SPANS_SQL}), p AS (SELECT o_orderkey AS doc_id, CAST(o_custkey % 90 AS INTEGER) AS pos FROM orders)
SELECT p.doc_id, p.pos, h.span_id AS span FROM p LEFT JOIN h ON p.doc_id = h.doc_id AND h.label = 'address' AND h.lo <= p.pos AND p.pos < h.hi""")
def d05(spark, sf_dir):
    p = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_custkey") % 90).cast("int").alias("pos"))
    return intervals.point_join(p, spans(spark, sf_dir).where("label = 'address'")).select("doc_id", "pos", F.col("span_id_r").alias("span"))


@query("d06_nearest_preceding", f"""WITH h AS ({SPANS_SQL}), p AS (SELECT o_orderkey AS doc_id, CAST(o_custkey % 150 AS INTEGER) AS pos FROM orders)
SELECT p.doc_id, p.pos, h.span_id AS antecedent FROM p JOIN h ON p.doc_id = h.doc_id AND h.label IN ('person', 'address') AND h.hi <= p.pos AND p.pos - h.hi <= 60
QUALIFY row_number() OVER (PARTITION BY p.doc_id, p.pos ORDER BY h.lo DESC, h.hi DESC, h.span_id DESC) = 1""")
def d06(spark, sf_dir):
    p = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderkey").alias("point_id"), (F.col("o_custkey") % 150).cast("int").alias("pos"))
    m = spans(spark, sf_dir).select("doc_id", F.col("span_id").alias("mention_id"), "start", "end", "label")
    found = intervals.nearest_preceding(p, m, 60, F.col("label_m").isin("person", "address"))
    return found.select("doc_id", "pos", F.col("mention_id_m").alias("antecedent"))


@query("d07_same_line_owner", f"""WITH h AS ({SPANS_SQL}), p AS (SELECT o_orderkey AS doc_id, CAST(o_custkey % 150 AS INTEGER) AS pos FROM orders)
SELECT p.doc_id, p.pos, h.span_id AS owner FROM p JOIN h ON p.doc_id = h.doc_id AND h.hi <= p.pos AND p.pos - h.hi <= 120 AND (h.lo // 20 = p.pos // 20 OR h.lo // 20 = p.pos // 20 - 1)
QUALIFY row_number() OVER (PARTITION BY p.doc_id, p.pos ORDER BY h.lo DESC, h.hi DESC, h.span_id DESC) = 1""")
def d07(spark, sf_dir):
    p = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderkey").alias("point_id"), (F.col("o_custkey") % 150).cast("int").alias("pos"))
    m = spans(spark, sf_dir).select("doc_id", F.col("span_id").alias("mention_id"), "start", "end")
    line = F.floor(F.col("pos") / 20)  # lines of 20 characters
    found = intervals.nearest_preceding(p, m, 120, F.floor(F.col("start_m") / 20).between(line - 1, line))
    return found.select("doc_id", "pos", F.col("mention_id_m").alias("owner"))


@query("d08_nearest_named", f"""WITH h AS ({SPANS_SQL}), p AS (SELECT o_orderkey AS doc_id, CAST(o_custkey % 90 AS INTEGER) AS pos FROM orders)
SELECT p.doc_id, p.pos, h.span_id AS owner FROM p JOIN h ON p.doc_id = h.doc_id AND (contains('personal', h.label) OR contains(h.label, 'email'))
QUALIFY row_number() OVER (PARTITION BY p.doc_id, p.pos ORDER BY abs(h.lo - p.pos), h.lo, h.span_id) = 1""")
def d08(spark, sf_dir):
    p = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderkey").alias("point_id"), (F.col("o_custkey") % 90).cast("int").alias("pos"))
    m = spans(spark, sf_dir).select("doc_id", F.col("span_id").alias("mention_id"), "start", "end", "label")
    named = F.lit("personal").contains(F.col("label_m")) | F.col("label_m").contains("email")
    return intervals.nearest(p, m, named).select("doc_id", "pos", F.col("mention_id_m").alias("owner"))


@query("e01_span_union")
def e01(spark, sf_dir):
    s = spans(spark, sf_dir)
    full = s.select("doc_id", "start", "end", F.concat("label", F.lit(":"), F.col("span_id").cast("string")).alias("text"), "label", F.array(F.concat(F.lit("lane"), (F.col("span_id") % 2).cast("string"))).alias("extractors"), (F.col("priority") / 100).alias("score"), F.lit(None).cast("string").alias("description"))
    return intervals.union_spans(full).select("doc_id", "start", "end", "text", "label", F.array_join("extractors", "+").alias("extractors"), "score")


@query("e01_span_islands", f"""WITH h AS ({SPANS_SQL}), m AS (SELECT *, CASE WHEN max(hi) OVER (PARTITION BY doc_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= lo THEN 0 ELSE 1 END AS new FROM (SELECT DISTINCT doc_id, lo, hi FROM h)),
g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY lo, hi) AS island FROM m)
SELECT doc_id, min(lo) AS "start", max(hi) AS "end" FROM g GROUP BY doc_id, island""")
def e01_islands(spark, sf_dir):
    return intervals.islands(spans(spark, sf_dir).select("doc_id", "start", "end").distinct())


@query("e15_ledger_coverage", f"WITH s AS (SELECT doc_id, lo, hi FROM ({SPANS_SQL})), docs AS (SELECT o_orderkey AS doc_id, CAST(100 AS BIGINT) AS n_chars FROM orders), {SWEEP_SQL.removeprefix('WITH ')}")
def e15(spark, sf_dir):
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(100).cast("long").alias("n_chars"))
    return intervals.coverage(spans(spark, sf_dir), docs)



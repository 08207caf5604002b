"""Queries over scalar functions (B)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewright.functions import contact, names, text
from notewright.plans import query, table

# Names of a kind: the first three words of a text, with what their letters allow of variants.
SQL_NAMES = "regexp_extract(text, '^\\s*(\\S+(?:\\s+\\S+){0,2})', 1)"

def plain_sql(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower(translate({x}, '{names.LATIN}', '{names._plain(names.LATIN)}')), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract("text", r"^\s*(\S+(?:\s+\S+){0,2})", 1).alias("name"), "text")


def addressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with an address, a phone and identifiers made of their columns, the same in SQL."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    street = F.element_at(F.array(*[F.lit(x) for x in STREETS]), (k % len(STREETS) + 1).cast("int"))
    digits9 = F.lpad((k * 7919 % 1000000000).cast("string"), 9, "0")
    return c.select(
        "c_custkey",
        "c_nationkey",
        "c_mktsegment",
        "c_acctbal",
        "c_name",
        F.concat((k % 997 + 1).cast("string"), F.lit(" "), street, F.lit(", Springfield, IL "), F.lpad((k % 100000).cast("string"), 5, "0")).alias("address"),
        F.concat(F.when(k % 3 == 0, F.lit("+1 ")).otherwise(F.lit("")), F.lit("("), F.lpad((k % 900 + 100).cast("string"), 3, "0"), F.lit(") 555-"), F.lpad((k % 10000).cast("string"), 4, "0")).alias("phone"),
        F.concat(F.lit(" Agent."), k.cast("string"), F.lit("@Mail"), (k % 7).cast("string"), F.lit(".Example.com ")).alias("email"),
        F.concat(digits9, (k % 10).cast("string")).alias("npi"),
    )


STREETS = ("Maple Street", "Oak Avenue", "N. Pine Boulevard", "State Road", "Éclair Lane", "Court Place #4", "7 Hills Parkway")
SQL_ADDRESSED = f"""(SELECT c_custkey, c_nationkey, c_mktsegment, c_acctbal, c_name,
  CAST(c_custkey % 997 + 1 AS VARCHAR) || ' ' || [{quoted(STREETS)}][c_custkey % {len(STREETS)} + 1] || ', Springfield, IL ' || lpad(CAST(c_custkey % 100000 AS VARCHAR), 5, '0') AS address,
  CASE WHEN c_custkey % 3 = 0 THEN '+1 ' ELSE '' END || '(' || lpad(CAST(c_custkey % 900 + 100 AS VARCHAR), 3, '0') || ') 555-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS phone,
  ' Agent.' || CAST(c_custkey AS VARCHAR) || '@Mail' || CAST(c_custkey % 7 AS VARCHAR) || '.Example.com ' AS email,
  lpad(CAST(c_custkey * 7919 % 1000000000 AS VARCHAR), 9, '0') || CAST(c_custkey % 10 AS VARCHAR) AS npi FROM customer)"""

SQL_NAMED = f"(SELECT doc_id, {SQL_NAMES} AS name, text FROM documents)"


@query("b02_normalize_name", f"SELECT doc_id, {plain_sql('name')} AS norm FROM {SQL_NAMED}")
def b02(spark, sf_dir):
    return named(spark, sf_dir).select("doc_id", names.normalize_name(F.col("name")).alias("norm"))


@query(
    "b03_name_tokens",
    f"""SELECT doc_id, array_to_string(list_filter(t, lambda x: x NOT IN ({quoted([*names.TITLES, *names.SUFFIXES, ''])})), ' ') AS tokens,
  list_filter(t, lambda x: x IN ({quoted(names.SUFFIXES)}))[1] AS suffix
FROM (SELECT doc_id, string_split({plain_sql("'Dr. ' || name || CASE WHEN doc_id % 3 = 0 THEN ' Jr.' ELSE '' END")}, ' ') AS t FROM {SQL_NAMED})""",
)
def b03(spark, sf_dir):
    full = F.concat(F.lit("Dr. "), F.col("name"), F.when(F.col("doc_id") % 3 == 0, " Jr.").otherwise(""))
    return named(spark, sf_dir).select("doc_id", F.array_join(names.name_tokens(full), " ").alias("tokens"), names.name_suffix(full).alias("suffix"))


@query(
    "b04_jaro_winkler",
    """WITH w AS (SELECT doc_id, source, lower(regexp_extract(text, '[A-Za-z]+', 0)) AS a FROM documents),
p AS (SELECT x.doc_id AS id_a, y.doc_id AS id_b, x.a AS a, y.a AS b FROM w x JOIN w y ON y.doc_id - x.doc_id BETWEEN 1 AND 10)
SELECT id_a, id_b, round(jaro_winkler_similarity(a, b), 6) AS similarity FROM p WHERE length(a) > 0 AND length(b) > 0""",
)
def b04(spark, sf_dir):
    w = table(spark, sf_dir, "documents").select("doc_id", "source", F.lower(F.regexp_extract("text", "[A-Za-z]+", 0)).alias("a")).where("a <> ''")
    # Each document with the ten after it.
    x = w.select(F.col("doc_id").alias("id_a"), "a").withColumn("id_b", F.explode(F.sequence(F.col("id_a") + 1, F.col("id_a") + 10)))
    pairs = x.join(w.select(F.col("doc_id").alias("id_b"), F.col("a").alias("b")), "id_b")
    return pairs.select("id_a", "id_b", F.round(names.jaro_winkler("duckdb")("a", "b"), 6).alias("similarity"))


@query("b05_token_set_jw")
def b05(spark, sf_dir):
    a = named(spark, sf_dir)
    turned = F.array_join(F.reverse(F.split("name", r"\s+")), " ")
    return a.select("doc_id", F.round(names.token_set_jw(F.col("name"), turned), 6).alias("similarity"))


SOUND_SQL = "translate(l, 'abcdefghijklmnopqrstuvwxyz', '01230127022455012623017202')"
COLLAPSED_SQL = f"left({SOUND_SQL}, 1) || replace(substr({SOUND_SQL}, 2), '7', '')"
for _digit in "0123456":
    COLLAPSED_SQL = f"regexp_replace({COLLAPSED_SQL}, '{_digit}+', '{_digit}', 'g')"


@query(
    "b06_soundex_key",
    f"""SELECT doc_id, CASE WHEN l = '' THEN '0000' ELSE upper(left(l, 1)) || left(rpad(replace(substr({COLLAPSED_SQL}, 2), '0', ''), 3, '0'), 3) END AS key
FROM (SELECT doc_id, regexp_replace({plain_sql('name')}, '[^a-z]', '', 'g') AS l FROM {SQL_NAMED})""",
)
def b06(spark, sf_dir):
    return named(spark, sf_dir).select("doc_id", names.soundex_key(F.col("name")).alias("key"))


NICK_ROWS = ", ".join(f"('{n}', {g})" for n, g in names.NICKNAME_GROUP.items())


@query(
    "b07_nicknames",
    f"""WITH n(nick, grp) AS (VALUES {NICK_ROWS})
SELECT x.nick AS a, y.nick AS b FROM n x JOIN n y ON x.grp = y.grp AND x.nick < y.nick JOIN (SELECT count(*) AS k FROM nation) ON true""",
)
def b07(spark, sf_dir):
    n = spark.createDataFrame([*names.NICKNAME_GROUP.items()], "nick string, grp int")
    pairs = n.toDF("a", "grp").join(n.toDF("b", "grp"), "grp").where("a < b")
    return pairs.where(names.are_nickname_variants(F.initcap("a"), F.concat("b", F.lit(" Smith")))).select("a", "b")


DIGITS_SQL = "regexp_replace(phone, '[^0-9]', '', 'g')"


@query(
    "b08_phone",
    f"""SELECT c_custkey, d AS digits, right(d, 7) AS last7 FROM (SELECT c_custkey, CASE WHEN length({DIGITS_SQL}) = 11 AND {DIGITS_SQL} LIKE '1%' THEN substr({DIGITS_SQL}, 2) ELSE {DIGITS_SQL} END AS d FROM {SQL_ADDRESSED})""",
)
def b08(spark, sf_dir):
    return addressed(spark, sf_dir).select("c_custkey", contact.phone_digits(F.col("phone")).alias("digits"), contact.phone_last7(F.col("phone")).alias("last7"))


STREET_MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in contact.STREET_WORDS.items()) + "}"
TOKENS_SQL = f"list_transform(string_split({plain_sql('address')}, ' '), lambda t: coalesce({STREET_MAP}[t], t))"


@query("b09_normalize_address", f"SELECT c_custkey, array_to_string({TOKENS_SQL}, ' ') AS norm FROM {SQL_ADDRESSED}")
def b09(spark, sf_dir):
    return addressed(spark, sf_dir).select("c_custkey", contact.normalize_address(F.col("address")).alias("norm"))


@query(
    "b10_address_key",
    f"""SELECT c_custkey, concat_ws('|', nullif(regexp_extract(array_to_string(t, ' '), '^([0-9]+)', 1), ''),
  list_filter(t[2:], lambda x: NOT regexp_matches(x, '^[0-9]+$'))[1], nullif(regexp_extract(array_to_string(t, ' '), '\\b([0-9]{{5}})\\b', 1), '')) AS key
FROM (SELECT c_custkey, {TOKENS_SQL} AS t FROM {SQL_ADDRESSED})""",
)
def b10(spark, sf_dir):
    return addressed(spark, sf_dir).select("c_custkey", contact.address_key(F.col("address")).alias("key"))


@query(
    "b11_address_parts",
    f"""SELECT c_custkey, array_to_string(t[:len(t) - 3], ' ') AS street, 'springfield' AS city, 'il' AS state, t[len(t)] AS zip
FROM (SELECT c_custkey, list_transform(string_split(trim(regexp_replace(regexp_replace(lower(address), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda t: coalesce({STREET_MAP}[t], t)) AS t FROM {SQL_ADDRESSED})""",
)
def b11(spark, sf_dir):
    return addressed(spark, sf_dir).select("c_custkey", contact.address_parts("address").alias("p")).select("c_custkey", "p.*")


@query("b12_email", f"SELECT c_custkey, lower(trim(email)) AS email, split_part(lower(trim(email)), '@', 2) AS domain FROM {SQL_ADDRESSED}")
def b12(spark, sf_dir):
    return addressed(spark, sf_dir).select("c_custkey", contact.normalize_email(F.col("email")).alias("email"), contact.email_domain(F.col("email")).alias("domain"))


def vin_expr(k):
    """17 characters of a key: two of three keys in ten have the right check digit by chance or not at all; letters among them."""
    return F.concat(F.lit("1HGCM82"), F.lpad((k % 1000).cast("string"), 3, "0"), F.lit("A"), F.lpad((k % 1000000).cast("string"), 6, "0"))


VIN_SQL = "'1HGCM82' || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') || 'A' || lpad(CAST(c_custkey % 1000000 AS VARCHAR), 6, '0')"
VIN_SUM = " + ".join(f"CAST(substr(n, {i + 1}, 1) AS INTEGER) * {w}" for i, w in enumerate(contact.VIN_WEIGHTS))


@query(
    "b13_vin_valid",
    f"""SELECT c_custkey, substr(v, 9, 1) = CASE WHEN ({VIN_SUM}) % 11 = 10 THEN 'X' ELSE CAST(({VIN_SUM}) % 11 AS VARCHAR) END AS valid
FROM (SELECT c_custkey, v, translate(v, '{contact.VIN_LETTERS}', '{contact.VIN_NUMBERS}') AS n FROM (SELECT c_custkey, {VIN_SQL} AS v FROM customer))""",
)
def b13(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", contact.vin_valid(vin_expr(F.col("c_custkey"))).alias("valid"))


def luhn_sql(length: int) -> str:
    parts = []
    for i in range(length):
        d = f"CAST(substr(s, {i + 1}, 1) AS INTEGER)"
        parts.append(f"({d} * 2 - CASE WHEN {d} > 4 THEN 9 ELSE 0 END)" if (length - 1 - i) % 2 else d)
    return " + ".join(parts)


@query("b14_npi_valid", f"SELECT c_custkey, ({luhn_sql(15)}) % 10 = 0 AS valid FROM (SELECT c_custkey, '80840' || npi AS s FROM {SQL_ADDRESSED})")
def b14(spark, sf_dir):
    return addressed(spark, sf_dir).select("c_custkey", contact.npi_valid(F.col("npi")).alias("valid"))


@query(
    "b15_normalize_identifier",
    f"""SELECT c_custkey, kind, CASE WHEN kind IN ({quoted(contact.DIGIT_KINDS)}) THEN regexp_replace(value, '[^0-9]', '', 'g') ELSE lower(trim(value)) END AS norm
FROM (SELECT c_custkey, unnest(['npi', 'phone', 'email', 'policy']) AS kind, unnest([npi, phone, email, c_name]) AS value FROM {SQL_ADDRESSED})""",
)
def b15(spark, sf_dir):
    return long_identifiers(addressed(spark, sf_dir)).select("c_custkey", "kind", contact.normalize_identifier(F.col("kind"), F.col("value")).alias("norm"))


def long_identifiers(df):
    return df.select("c_custkey", F.explode(F.create_map(F.lit("npi"), "npi", F.lit("phone"), "phone", F.lit("email"), "email", F.lit("policy"), "c_name")).alias("kind", "value"))


@query(
    "b16_identifier_shape",
    f"""SELECT c_custkey, kind, CASE kind WHEN 'phone' THEN length(regexp_replace(value, '[^0-9]', '', 'g')) >= 7 WHEN 'email' THEN value LIKE '%@%.%'
  WHEN 'ssn' THEN length(regexp_replace(value, '[^0-9]', '', 'g')) >= 9 WHEN 'dob' THEN length(regexp_replace(value, '[^0-9]', '', 'g')) >= 4
  WHEN 'address' THEN regexp_matches(value, '[0-9]') END AS ok
FROM (SELECT c_custkey, unnest(['phone', 'email', 'ssn', 'dob', 'address']) AS kind, unnest([phone, email, c_name, CAST(c_custkey AS VARCHAR), address]) AS value FROM {SQL_ADDRESSED})""",
)
def b16(spark, sf_dir):
    a = addressed(spark, sf_dir)
    each = a.select("c_custkey", F.explode(F.create_map(F.lit("phone"), "phone", F.lit("email"), "email", F.lit("ssn"), "c_name", F.lit("dob"), F.col("c_custkey").cast("string"), F.lit("address"), "address")).alias("kind", "value"))
    return each.select("c_custkey", "kind", contact.identifier_shape_ok(F.col("kind"), F.col("value")).alias("ok"))


@query(
    "b17_norm_value",
    f"""SELECT c_custkey, field, CASE WHEN field IN ('phone', 'TIN', 'zip_code') THEN regexp_replace(lower(trim(value)), '[\\s.()/,-]', '', 'g')
  ELSE regexp_replace(regexp_replace(lower(trim(value)), '\\s+', ' ', 'g'), '^[ .,;]+|[ .,;]+$', '', 'g') END AS norm
FROM (SELECT c_custkey, unnest(['phone', 'address', 'TIN']) AS field, unnest([phone, '  ' || address || ' ., ', npi]) AS value FROM {SQL_ADDRESSED})""",
)
def b17(spark, sf_dir):
    each = addressed(spark, sf_dir).select("c_custkey", F.explode(F.create_map(F.lit("phone"), F.col("phone"), F.lit("address"), F.concat(F.lit("  "), "address", F.lit(" ., ")), F.lit("TIN"), F.col("npi"))).alias("field", "value"))
    return each.select("c_custkey", "field", contact.norm_value(F.col("field"), F.col("value")).alias("norm"))


@query(
    "b18_cited_notes",
    """SELECT c_custkey, array_to_string(list_distinct_ordered, '|') AS notes, c_custkey % 2 = 0 AS flagged FROM (
  SELECT c_custkey, CASE WHEN c_custkey % 10 = c_custkey % 7 THEN [CAST(c_custkey % 10 AS VARCHAR), 'N2'] ELSE [CAST(c_custkey % 10 AS VARCHAR), 'N2', CAST(c_custkey % 7 AS VARCHAR)] END AS list_distinct_ordered FROM customer)""",
)
def b18(spark, sf_dir):
    k = F.col("c_custkey")
    exact = F.concat((k % 10).cast("string"), F.lit(".0, N2,, N2"))
    genai = F.concat((k % 7).cast("string"), F.lit(" , N2"))
    flag = F.when(k % 2 == 0, F.lit(" Yes")).otherwise("no")
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(contact.cited_notes(exact, genai), "|").alias("notes"), contact.is_flagged(flag).alias("flagged"))


RELATIONS = ("went to", "Retained", "IS", "has-npi", "MENTIONED_IN", "Works  For", "paints")
REL_MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in text.RELATION_FORMS.items()) + "}"
GRAPH_MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in text.GRAPH_FORMS.items()) + "}"
RAW_SQL = f"(SELECT event_id, [{quoted(RELATIONS)}, event_type][event_id % {len(RELATIONS) + 1} + 1] AS raw FROM events)"


def raw_predicates(spark, sf_dir):
    choices = F.array(*[F.lit(r) for r in RELATIONS], F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", F.element_at(choices, (F.col("event_id") % (len(RELATIONS) + 1) + 1).cast("int")).alias("raw"))


@query(
    "b19_relation_predicate",
    f"""SELECT event_id, p AS predicate, CASE WHEN p IN ({quoted(text.RELATION_BANNED)}) THEN 'banned' WHEN regexp_matches(p, '{text.IDENTIFIER_PREDICATE}') THEN 'identifier' WHEN p IN ({quoted(text.DEGENERATE)}) THEN 'degenerate' END AS refused
FROM (SELECT event_id, coalesce({REL_MAP}[r], upper(r)) AS p FROM (SELECT event_id, regexp_replace(regexp_replace(regexp_replace(lower(trim(raw)), '[ -]', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g') AS r FROM {RAW_SQL}))""",
)
def b19(spark, sf_dir):
    p = raw_predicates(spark, sf_dir).select("event_id", text.relation_predicate(F.col("raw")).alias("predicate"))
    return p.withColumn("refused", text.relation_verdict(F.col("predicate")))


@query(
    "b20_graph_predicate",
    f"""SELECT event_id, CASE WHEN p NOT IN ({quoted(text.GRAPH_BANNED)}) THEN coalesce({GRAPH_MAP}[p], p) END AS predicate
FROM (SELECT event_id, upper(regexp_replace(trim(raw), '\\s+', '_', 'g')) AS p FROM {RAW_SQL})""",
)
def b20(spark, sf_dir):
    return raw_predicates(spark, sf_dir).select("event_id", text.graph_predicate(F.col("raw")).alias("predicate"))


def cues_sql(x: str, cues) -> str:
    return "(" + " OR ".join(f"contains({x}, '{c}')" for c in cues) + ")"


POLARITY_SQL = " ".join(f"WHEN {cues_sql('w', cues)} THEN '{k}'" for k, cues in text.POLARITY_CUES)


@query(
    "b21_polarity",
    f"""SELECT doc_id, CASE {POLARITY_SQL} ELSE 'asserted' END AS polarity
FROM (SELECT doc_id, lower(substr(text, greatest(s - 40, 0) + 1, s + 20 - greatest(s - 40, 0))) AS w FROM (SELECT doc_id, text, doc_id % 150 AS s FROM documents))""",
)
def b21(spark, sf_dir):
    s = (F.col("doc_id") % 150).cast("int")
    return table(spark, sf_dir, "documents").select("doc_id", text.polarity(F.col("text"), s, s + 10).alias("polarity"))


# Contexts for classes and roles: pieces of phrases that the cues look for, dealt by key.
PIECES = ("Harbor Collision", "Dr Vance", "Bell LLP", "Pat Doe", "Clinic North", "see a@firm-x.org", "from b@ourinsco.com", "the claim rep said", "Clmt Atty -", "TIN of shop")
PIECE_SQL = f"[{quoted(PIECES)}]"
ROLE_SQL = " ".join(f"WHEN {cues_sql('l', cues)} THEN '{k}'" for k, cues in text.ROLE_CUES)
CLASS_MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in text.LABEL_CLASS.items()) + "}"


@query(
    "b22_entity_class",
    f"""SELECT event_id, CASE WHEN {cues_sql('s', text.SHOP_CUES)} THEN 'repair_shop' WHEN s LIKE 'dr%' OR {cues_sql('s', text.PROVIDER_CUES)} THEN 'medical_provider' WHEN {cues_sql('s', text.FIRM_CUES)} THEN 'attorney'
 WHEN contains(r, '@ourinsco.com') OR contains(l, '@ourinsco.com') THEN 'adjuster' WHEN contains(r, 'claims department') OR contains(l, 'adjuster') OR contains(l, 'claim rep') THEN 'adjuster'
 WHEN regexp_matches(r, '@[a-z0-9.\\-]+\\.[a-z]{{2,}}') AND NOT regexp_matches(r, '@(ourinsco|example)\\.com') THEN 'attorney' WHEN {cues_sql('r', text.FIRM_AFTER_CUES)} THEN 'attorney'
 {ROLE_SQL} ELSE coalesce({CLASS_MAP}[label], 'claimant') END AS class
FROM (SELECT event_id, lower({PIECE_SQL}[event_id % 10 + 1]) AS s, lower({PIECE_SQL}[event_id // 10 % 10 + 1]) AS l, lower({PIECE_SQL}[event_id // 100 % 10 + 1]) AS r, ['person', 'law_firm', 'other'][event_id % 3 + 1] AS label FROM events)""",
)
def b22(spark, sf_dir):
    pick = lambda n: F.element_at(F.array(*[F.lit(p) for p in PIECES]), (F.floor(F.col("event_id") / n) % 10 + 1).cast("int"))
    label = F.element_at(F.array(*[F.lit(x) for x in ("person", "law_firm", "other")]), (F.col("event_id") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", text.entity_class(pick(1), label, pick(10), pick(100)).alias("class"))


@query("b23_role_cue", f"SELECT doc_id, CASE {ROLE_SQL} END AS role FROM (SELECT doc_id, lower(text) AS l FROM documents)")
def b23(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.role_from_context(F.col("text")).alias("role"))


@query(
    "b24_plausible_name",
    f"""SELECT doc_id, length(s) >= 3 AND NOT contains(s, chr(10)) AND NOT regexp_matches(s, '^[A-Z][A-Z\\s&''/.-]{{6,}}$') AND NOT regexp_matches(s, '(?i)^({'|'.join(text.HEADER_LABELS)})\\b')
  AND (len(c) >= 2 OR lower(s) LIKE 'dr%' OR (len(c) = 1 AND doc_id % 2 = 1)) AS plausible
FROM (SELECT doc_id, s, list_filter(regexp_split_to_array(s, '[\\s,]+'), lambda t: regexp_matches(t, '^\\p{{Lu}}') AND regexp_matches(regexp_replace(t, '^\\.+|\\.+$', '', 'g'), '^\\p{{L}}+$')) AS c
  FROM (SELECT doc_id, regexp_replace(name, '^\\s+|\\s+$', '', 'g') AS s FROM {SQL_NAMED}))""",
)
def b24(spark, sf_dir):
    return named(spark, sf_dir).select("doc_id", text.plausible_name(F.col("name"), None, F.when(F.col("doc_id") % 2 == 1, 2).otherwise(1)).alias("plausible"))


@query("b25_span_grounded")
def b25(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("length(text) >= 40")
    value = F.concat(F.substring("text", 11, 12), F.lit("x"))
    return d.select("doc_id", text.span_grounded("text", F.lit(10), F.lit(22), value).alias("grounded"))


@query(
    "b26_casing",
    """SELECT doc_id, CASE WHEN n < 12 THEN 'sparse' WHEN u >= 0.60 THEN 'upper' WHEN c <= 0.02 THEN 'lower' ELSE 'mixed' END AS regime, n >= 12 AND u < 0.60 AND c > 0.02 AS case_informative,
  CAST(n AS BIGINT) AS n_words, round(u, 4) AS upper_frac, round(c, 4) AS capitalized_frac, round(l, 4) AS lower_frac
FROM (SELECT doc_id, n, CASE WHEN n = 0 THEN 0.0 ELSE len(list_filter(w, lambda x: regexp_matches(x, '^[^a-z]+$'))) / n END AS u, CASE WHEN n = 0 THEN 0.0 ELSE len(list_filter(w, lambda x: regexp_matches(x, '^[A-Z]'))) / n END AS c,
  CASE WHEN n = 0 THEN 0.0 ELSE len(list_filter(w, lambda x: regexp_matches(x, '^[^A-Z]+$'))) / n END AS l
 FROM (SELECT doc_id, w, len(w) AS n FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z][A-Za-z''’\\-]+') AS w FROM documents)))""",
)
def b26(spark, sf_dir):
    c = table(spark, sf_dir, "documents").select("doc_id", text.casing(F.col("text")).alias("c"))
    return c.select("doc_id", "c.*").withColumn("n_words", F.col("n_words").cast("long"))


BOILER = " + ".join(f"CAST(contains(l, '{c}') AS INTEGER)" for c in text.BOILERPLATE_CUES)
NOTICE = "This email is privileged and for the sole use of the intended recipient."


@query(
    "b27_boilerplate",
    f"""SELECT doc_id, round(CASE WHEN h > 0 AND NOT regexp_matches(l, '[0-9]') THEN least(1.0, least(1.0, h / 3.0) + 0.15) ELSE least(1.0, h / 3.0) END, 3) AS score
FROM (SELECT doc_id, l, {BOILER} AS h FROM (SELECT doc_id, lower(text || CASE doc_id % 3 WHEN 0 THEN ' {NOTICE}' WHEN 1 THEN ' privileged' ELSE '' END) AS l FROM documents))""",
)
def b27(spark, sf_dir):
    k = F.col("doc_id") % 3
    full = F.concat("text", F.when(k == 0, f" {NOTICE}").when(k == 1, " privileged").otherwise(""))
    return table(spark, sf_dir, "documents").select("doc_id", text.boilerplate_score(full).alias("score"))


@query(
    "b28_template",
    """SELECT doc_id, CASE WHEN len(f) >= 2 THEN substr(sha1(array_to_string(f, '|')), 1, 16) END AS fingerprint
FROM (SELECT doc_id, list_filter(list_transform(string_split('Claim No: ' || doc_id || chr(10) || 'Status - open' || chr(10) || text, chr(10)), lambda x:
  regexp_replace(lower(regexp_extract(x || chr(10), '^\\s*(?:([A-Za-z][A-Za-z0-9 ._#/&-]{0,40})\\s*[:=]\\s|([A-Za-z][A-Za-z0-9 ._#/&]{0,40})\\s+-\\s)', 1) || regexp_extract(x || chr(10), '^\\s*(?:([A-Za-z][A-Za-z0-9 ._#/&-]{0,40})\\s*[:=]\\s|([A-Za-z][A-Za-z0-9 ._#/&]{0,40})\\s+-\\s)', 2)), '[^a-z]', '', 'g')), lambda y: y <> '') AS f FROM documents)""",
)
def b28(spark, sf_dir):
    full = F.concat(F.lit("Claim No: "), F.col("doc_id").cast("string"), F.lit("\nStatus - open\n"), F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", text.template_fingerprint(full).alias("fingerprint"))


def count_sql(w: str) -> str:
    return f"(length(l) - length(replace(l, '{w}', ''))) // {len(w)}"


CATEGORY_N = ", ".join(f"{' + '.join(count_sql(w) for w in words)} AS n{i}" for i, (_, words) in enumerate(text.CATEGORY_WORDS))
CATEGORY_BEST = f"greatest({', '.join(f'n{i}' for i in range(len(text.CATEGORY_WORDS)))})"
CATEGORY_CASE = " ".join(f"WHEN n{i} = {CATEGORY_BEST} THEN '{c}'" for i, (c, _) in enumerate(text.CATEGORY_WORDS))


@query("b29_note_category", f"SELECT doc_id, CASE WHEN {CATEGORY_BEST} = 0 THEN 'general_correspondence' {CATEGORY_CASE} END AS category FROM (SELECT doc_id, {CATEGORY_N} FROM (SELECT doc_id, lower(text) AS l FROM documents))")
def b29(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.note_category(F.col("text")).alias("category"))


@query("b30_weight_probability", "SELECT event_id, round(pow(2.0, v) / (1 + pow(2.0, v)), 9) AS probability FROM (SELECT event_id, value % 20 - 10 AS v FROM events WHERE value IS NOT NULL)")
def b30(spark, sf_dir):
    return table(spark, sf_dir, "events").where("value is not null").select("event_id", F.round(text.weight_to_probability(F.col("value") % 20 - 10), 9).alias("probability"))


@query("b31_relocate_evidence")
def b31(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("length(text) >= 60")
    quote = F.when(F.col("doc_id") % 2 == 0, F.substring("text", 21, 30)).otherwise(F.upper(F.regexp_replace(F.substring("text", 21, 30), " ", "  ")))
    return d.select("doc_id", text.relocate_evidence("text", quote).alias("r")).select("doc_id", "r.*")


@query("b32_locate_surface")
def b32(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("length(text) >= 60").select("doc_id", text.locate("text", F.lower(F.substring("text", 31, 8)), F.lit(30)).alias("at"))


ANAPHORA = quoted([*[p for g in text.PRONOUNS.values() for p in g], *text.DESCRIPTORS])
DESC_MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in text.DESCRIPTORS.items() if v) + "}"
SURFACES = ("He", " the clinic ", "The Shop", "Pat Doe", "ITS", "same as above")


@query(
    "b34_anaphor",
    f"""SELECT event_id, lower(trim(s)) IN ({ANAPHORA}) AS anaphor, {DESC_MAP}[lower(trim(s))] AS class FROM (SELECT event_id, [{quoted(SURFACES)}][event_id % {len(SURFACES)} + 1] AS s FROM events)""",
)
def b34(spark, sf_dir):
    s = F.element_at(F.array(*[F.lit(x) for x in SURFACES]), (F.col("event_id") % len(SURFACES) + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", text.is_anaphor(s).alias("anaphor"), text.descriptor_class(s).alias("class"))


TYPED = ("Dr. Alicia Reyes", "Harbor & Vance", "Bell Injury Group", "Marge Wilson", "Wilson", "Tom Ito Jr.", "Acme Parts LLC", "")


@query(
    "b35_entity_type",
    f"""SELECT event_id, CASE WHEN len(w) = 0 THEN 'unknown' WHEN w[1] IN ({quoted(text.PERSON_TITLES)}) OR w[-1] IN ({quoted(text.PERSON_SUFFIXES)}) THEN 'person'
  WHEN len(list_filter(w, lambda x: x IN ({quoted(text.LEGAL_FORMS)}))) > 0 OR contains(n, '&') THEN 'organization' WHEN len(w) >= 2 AND w[-1] IN ({quoted(text.HEAD_NOUNS)}) THEN 'organization'
  WHEN len(w) IN (2, 3) AND len(list_filter(w, lambda x: regexp_matches(x, '^\\p{{L}}+$'))) = len(w) THEN 'person' ELSE 'unknown' END AS type
FROM (SELECT event_id, n, list_filter(list_transform(regexp_extract_all(n, '[A-Za-z&''’.\\-]+'), lambda x: lower(regexp_replace(x, '^[.,''’]+|[.,''’]+$', '', 'g'))), lambda y: y <> '') AS w
  FROM (SELECT event_id, [{quoted(TYPED)}][event_id % {len(TYPED)} + 1] AS n FROM events))""",
)
def b35(spark, sf_dir):
    n = F.element_at(F.array(*[F.lit(x) for x in TYPED]), (F.col("event_id") % len(TYPED) + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", text.entity_type(n).alias("type"))


TYPES = ("person", "organization", "unknown")


@query(
    "b36_strategy",
    f"""SELECT event_id, CASE WHEN a = b AND a IN ('person', 'organization') THEN a WHEN a = 'unknown' AND b IN ('person', 'organization') THEN b WHEN b = 'unknown' AND a IN ('person', 'organization') THEN a ELSE 'generic' END AS strategy
FROM (SELECT event_id, [{quoted(TYPES)}][event_id % 3 + 1] AS a, [{quoted(TYPES)}][event_id // 3 % 3 + 1] AS b FROM events)""",
)
def b36(spark, sf_dir):
    pick = lambda n: F.element_at(F.array(*[F.lit(x) for x in TYPES]), (F.floor(F.col("event_id") / n) % 3 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", text.comparison_strategy(pick(1), pick(3)).alias("strategy"))

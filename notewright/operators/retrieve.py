"""J1-J13, JD1-JD5, F1, F3, F6: plans over entities, scoped retrieval and checked citations."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notewright.functions import names

# What plans may filter on, and how.
FIELDS = ("name", "entity_class", "role", "claim", "email", "phone", "npi", "tin", "ssn", "vin", "dob", "address", "email_domain", "policy_number", "occurrence", "doc")
OPS = ("eq", "contains", "startswith", "endswith", "fuzzy", "exists")


class UnknownField(ValueError):
    """A plan names a field, operation or link that isn't served."""


@dataclass(frozen=True)
class Filter:
    field: str
    op: str
    value: str = ""


@dataclass(frozen=True)
class Plan:
    """What is asked for: a class, filters that all hold, a value shared with another entity, presence on several claims."""

    entity_class: str | None = None
    filters: tuple[Filter, ...] = ()
    link_via: tuple[str, ...] = ()
    cross_reference: bool = False
    want: str = "entities"
    trace: list[str] = field(default_factory=list, compare=False, hash=False)


def matches(f: Filter) -> Column:
    """A condition over value, of rows of f's field. Equality is equality; contains is the substring test."""
    if f.field not in FIELDS or f.op not in OPS:
        raise UnknownField(f"{f.field} {f.op}")
    v, want = F.lower(F.col("value")), F.lit(f.value.lower())
    if f.op == "exists":
        return F.lit(True)
    if f.op == "fuzzy":
        return (names.jaro_winkler()(v, want) > 0.7) | v.contains(want)
    return {"eq": v == want, "contains": v.contains(want), "startswith": v.startswith(want), "endswith": v.endswith(want)}[f.op]


def sharing(index: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """entity_ids that share a value of one of these kinds with another entity."""
    own = index.where(F.col("field").isin(*kinds)).select("entity_id", "field", "value").distinct()
    shared = own.groupBy("field", "value").agg(F.count_distinct("entity_id").alias("n")).where("n > 1")
    return own.join(shared, ["field", "value"], "left_semi").select("entity_id").distinct()


def execute(plan: Plan, entities: DataFrame, index: DataFrame) -> DataFrame:
    """The entities that a plan asks for, most mentions first, ties by id. Links narrow the result like filters.

    entities: entity_id, entity_class, canonical_name, n_mentions. index (J10): entity_id, field, value.
    """
    out = entities
    if plan.entity_class:
        out = out.where(F.col("entity_class") == plan.entity_class)
        plan.trace.append(f"class = {plan.entity_class}")
    for f in plan.filters:
        rows = index.where(F.col("field") == f.field).where(matches(f))
        out = out.join(rows.select("entity_id").distinct(), "entity_id", "left_semi")
        plan.trace.append(f"{f.field} {f.op} {f.value}".strip())
    for kind in plan.link_via:
        out = out.join(sharing(index, (kind,)), "entity_id", "left_semi")
        plan.trace.append(f"shares {kind}")
    if plan.cross_reference:
        several = index.where("field = 'claim'").groupBy("entity_id").agg(F.count_distinct("value").alias("n")).where("n > 1")
        out = out.join(several, "entity_id", "left_semi")
        plan.trace.append("on several claims")
    return out.orderBy(F.desc("n_mentions"), "entity_id")


def plan_question(question: str) -> Plan:
    """A plan from words of the question, for use without a model."""
    q = question.lower()
    classes = {"attorney": ("attorney", "lawyer", "counsel"), "medical_provider": ("doctor", "provider", "clinic", "physician"), "repair_shop": ("shop", "repair"), "adjuster": ("adjuster",), "claimant": ("claimant", "insured")}
    kind = next((c for c, cues in classes.items() if any(w in q for w in cues)), None)
    filters = []
    if m := re.search(r"[\w.+-]+@[\w.-]+\w", question):
        filters.append(Filter("email", "eq", m[0]))
    elif m := re.search(r"@([\w.-]+\w)", question):
        filters.append(Filter("email_domain", "eq", m[1]))
    if m := re.search(r"(?<!\d)(\d{10})(?!\d)", question):
        filters.append(Filter("npi" if "npi" in q else "phone", "contains", m[1]))
    if m := re.search(r"(?:named|called)\s+[\"']?([A-Z][\w'-]*(?:\s+[A-Z][\w'-]*)*)", question):
        filters.append(Filter("name", "fuzzy", m[1]))
    if m := re.search(r"(?:start\w*|begin\w*)\s+with\s+[\"']?(\w+)", q):
        filters.append(Filter("name", "startswith", m[1]))
    link = tuple(k for k in ("phone", "address", "email", "npi", "tin") if re.search(rf"(?:same|shar\w+)\s+(?:an?\s+|the\s+)?(?:same\s+)?{k}", q))
    return Plan(kind, tuple(filters), link, bool(re.search(r"(multiple|several|more than one|different) claims", q)))


def search_name(entities: DataFrame, query: str, k: int = 10, least: float = 0.4) -> DataFrame:
    """F1: the k entities whose name is most like the query, above a least score."""
    scored = entities.withColumn("score", names.token_set_jw(F.col("canonical_name"), F.lit(query)))
    return scored.where(F.col("score") > least).orderBy(F.desc("score"), "entity_id").limit(k)


CITATION = r"^\s*\[?([A-Za-z0-9_]+)\s*:\s*([0-9]+)\s*-\s*([0-9]+)\]?\s*$"


def verify_citations(citations: DataFrame, docs: DataFrame, evidence: DataFrame) -> DataFrame:
    """citation_id, reason (null: verified): unparseable, unknown doc_id, span out of bounds, span outside retrieved evidence.

    citations: citation_id, citation (doc:start-end). docs: doc_id string, n_chars. evidence: doc_id, start, end.
    """
    part = lambda i: F.regexp_extract("citation", CITATION, i)
    c = citations.select("citation_id", F.nullif(part(1), F.lit("")).alias("doc_id"), part(2).try_cast("long").alias("s"), part(3).try_cast("long").alias("e"))
    known = c.join(docs.groupBy("doc_id").agg(F.max("n_chars").alias("n_chars"), F.lit(True).alias("__known")), "doc_id", "left")  # a document without characters is known, a repeated one is one
    inside = c.join(evidence.withColumnRenamed("start", "a").withColumnRenamed("end", "b"), "doc_id").where("a <= s and e <= b").select("citation_id").distinct().withColumn("__in", F.lit(True))
    j = known.join(inside, "citation_id", "left")
    reason = F.when(F.col("doc_id").isNull(), "unparseable").when(F.col("__known").isNull(), "unknown doc_id").when(~((F.col("s") < F.col("e")) & (F.col("e") <= F.col("n_chars"))), "span out of bounds").when(F.col("__in").isNull(), "span outside retrieved evidence")
    return j.select("citation_id", reason.alias("reason"))


def bm25(docs: DataFrame, terms: list[str], k1: float = 1.2, b: float = 0.75, pattern: str = "[^a-z0-9]+") -> DataFrame:
    """JD2: doc_id, score of the documents that hold a term; ASCII words in lower case."""
    words = F.filter(F.split(F.lower("text"), pattern), lambda w: w != "")
    own = docs.select("doc_id", words.alias("ws")).withColumn("n", F.size("ws"))
    totals = own.agg(F.count("*").alias("docs"), F.avg("n").alias("avg"))
    hits = own.select("doc_id", "n", F.explode(F.filter("ws", lambda w: w.isin(*terms))).alias("term")).groupBy("doc_id", "n", "term").agg(F.count("*").alias("tf"))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    j = hits.join(F.broadcast(df), "term").crossJoin(F.broadcast(totals))  # a row a query term; one row
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n") / F.col("avg")))
    return j.groupBy("doc_id").agg(F.sum(part).alias("score"))


def fuse(ranked: DataFrame, k: int = 60) -> DataFrame:
    """JD2: doc_id, score, lanes: reciprocal ranks of lanes (lane, doc_id, score), summed, with who found what."""
    w = Window.partitionBy("lane").orderBy(F.desc("score"), "doc_id")
    r = ranked.withColumn("rank", F.row_number().over(w))
    return r.groupBy("doc_id").agg(F.sum(1 / (F.lit(k) + F.col("rank"))).alias("score"), F.array_join(F.array_sort(F.collect_set("lane")), "+").alias("lanes"))


def temporal(events: DataFrame, op: str, at: Column, until: Column | None = None) -> DataFrame:
    """JD3: events (ts) before, after, as of (the last of each key up to `at`) or in a range."""
    if op == "before":
        return events.where(F.col("ts") < at)
    if op == "after":
        return events.where(F.col("ts") > at)
    if op == "range":
        return events.where((F.col("ts") >= at) & (F.col("ts") < until))
    if op == "as_of":
        best = events.where(F.col("ts") <= at).groupBy("key").agg(F.max_by(F.struct(*events.columns), F.struct("ts", "event_id")).alias("e"))
        return best.select("e.*")
    raise UnknownField(op)


def enough(evidence: DataFrame, least: int) -> DataFrame:
    """JD4: n_evidence and reason, null where the evidence is enough to answer."""
    return evidence.agg(F.count("*").alias("n_evidence")).withColumn("reason", F.when(F.col("n_evidence") < least, "insufficient evidence"))


def scope_proof(chunks: DataFrame, claim_a: Column, claim_b: Column, probe: Column) -> DataFrame:
    """How many chunks that the probe finds belong to each claim, and how many a search scoped to the first can see of the second."""
    own = chunks.where(probe)
    return own.agg(F.count_if(F.col("claim_id") == claim_a).alias("in_a"), F.count_if(F.col("claim_id") == claim_b).alias("in_b"), F.count_if((F.col("claim_id") == claim_a) & (F.col("claim_id") == claim_b)).alias("leaked"))


def chunk_index(chunks: DataFrame, docs: DataFrame, embed: object = None) -> DataFrame:
    """Chunks with their claim (UNKNOWN without one) and a vector. embed: rows and a text column to rows with vector."""
    from notewright.operators.vectors import embed as hashed

    claims = docs.select("doc_id", "claim_id")
    placed = chunks.join(claims, "doc_id", "left").withColumn("claim_id", F.coalesce("claim_id", F.lit("UNKNOWN")))
    return (embed or hashed)(placed, "text")


def answer(question_vector: list[float], claim_id: str, index: DataFrame, mentions: DataFrame, edges: DataFrame, exact: DataFrame | None = None, k: int = 5, hops: int = 2, most: int = 60) -> dict[str, DataFrame]:
    """Chunks of the claim most like the question, the entities in them and in exact hits, and the edges around those, by distance, at most `most`.

    The claim is a filter before anything is ranked. exact: entity_id of identifier lookups.
    mentions: doc_id, start, end, entity_id. edges: as the graph's, with claim_id.
    """
    from notewright.operators.graph import neighbours
    from notewright.operators.intervals import contained_join
    from notewright.operators.vectors import search

    found = search(index.withColumnRenamed("chunk_id", "vec_id"), question_vector, k, F.col("claim_id") == claim_id)
    spans = found.select("doc_id", F.col("char_start").alias("start"), F.col("char_end").alias("end"))
    seen = contained_join(mentions, spans).select("entity_id")
    entities = (seen if exact is None else seen.union(exact.select("entity_id"))).distinct()
    around = neighbours(edges, entities.select(F.concat(F.lit("ent:"), "entity_id").alias("id")), hops, F.col("claim_id") == claim_id)
    return {"chunks": found, "entities": entities, "triples": around.orderBy("hop", "src", "dst", "predicate").limit(most)}


def enrich(entities: DataFrame, links: DataFrame, most: int = 20) -> DataFrame:
    """For each entity the others it shares values with, at most `most`, by degree."""
    w = Window.partitionBy("entity_id").orderBy("degree", "other")
    return links.join(entities.select("entity_id"), "entity_id", "left_semi").withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).drop("n")


def claim_dossier(claim_id: str, entities: DataFrame, edges: DataFrame, assertions: DataFrame) -> DataFrame:
    """One row: claim_id, parties, n_edges, allegations (from assertions, which hold their evidence)."""
    parties = entities.where(F.array_contains("claims", claim_id)).agg(F.array_sort(F.collect_list(F.struct("entity_id", "canonical_name", "entity_class"))).alias("parties"))
    n = edges.where(F.col("claim_id") == claim_id).agg(F.count("*").alias("n_edges"))
    said = assertions.where((F.col("claim_id") == claim_id) & (F.col("predicate") == "allegation")).agg(F.array_sort(F.collect_list("value")).alias("allegations"))
    return parties.crossJoin(n).crossJoin(said).withColumn("claim_id", F.lit(claim_id))  # one row each

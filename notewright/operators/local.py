"""H24, JD1, JD5, JD6: claim-scoped entities, links between them, and matching of outside records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notewright.operators.components import connected_components
from notewright.operators.linkage import Model, contributions, gammas, paired, score

# Identifiers that carry their own validation, and may link entities of different claims by themselves.
LINKING = ("npi", "vin", "email", "ssn", "tin")
BANDS = ((0.99, "near-certain"), (0.8, "probable"), (0.2, "possible"))


def _pairs(mentions: DataFrame, keys: list[str]) -> DataFrame:
    own = mentions.select("mention_id", *keys)
    for k in keys:
        own = own.where(F.col(k).isNotNull())
    least = own.groupBy(*keys).agg(F.min("mention_id").alias("first"))
    return own.join(least, keys).where("mention_id <> first").select("mention_id", F.col("first").alias("other"))


def local_entities(mentions: DataFrame, identifiers: DataFrame) -> DataFrame:
    """H24, JD6: mention_id, claim_id, local_id: mentions of one claim merged by equal name, by a name whose tokens are part of exactly one other name of the claim, or by a shared validated identifier. Never by likeness.

    mentions: mention_id, claim_id, full_name (null for none). identifiers: mention_id, kind, value, validated.
    """
    exact = _pairs(mentions, ["claim_id", "full_name"])
    names = mentions.where("full_name is not null").groupBy("claim_id", "full_name").agg(F.min("mention_id").alias("rep")).withColumn("tokens", F.array_distinct(F.split("full_name", " ")))
    # A shorter name meets the longer ones that hold its first token: an equi-key within the claim.
    short = names.select("claim_id", F.col("full_name").alias("short"), F.col("rep").alias("mention_id"), F.col("tokens").alias("ts"), F.get("tokens", 0).alias("t"))
    long_ = names.select("claim_id", F.col("full_name").alias("long"), F.col("rep").alias("other"), F.col("tokens").alias("tl"), F.explode("tokens").alias("t"))
    inside = short.join(long_, ["claim_id", "t"]).where((F.size("ts") < F.size("tl")) & (F.size(F.array_except("ts", "tl")) == 0))
    maximal = inside.select("claim_id", F.col("short").alias("long")).distinct()
    only = inside.join(maximal, ["claim_id", "long"], "left_anti").groupBy("claim_id", "mention_id").agg(F.min("other").alias("other"), F.count_distinct("long").alias("n")).where("n = 1").select("mention_id", "other")
    seen = identifiers.where("validated").join(mentions.select("mention_id", "claim_id"), "mention_id")
    shared = _pairs(seen.select("mention_id", "claim_id", "kind", "value"), ["claim_id", "kind", "value"])
    labels = connected_components(exact.unionByName(only).unionByName(shared), mentions.select("mention_id"))
    return mentions.select("mention_id", "claim_id").join(labels.withColumnRenamed("node", "mention_id").withColumnRenamed("component", "local_id"), "mention_id")


def identity_links(locals_: DataFrame, identifiers: DataFrame, scored: DataFrame | None = None) -> DataFrame:
    """local_a < local_b of different claims, status, evidence: auto for a shared validated identifier that links, review for pairs that only a score proposes.

    scored: local_a, local_b, probability; it ranks the review queue and decides nothing.
    """
    own = identifiers.where(F.col("validated") & F.col("kind").isin(*LINKING)).join(locals_, "mention_id").select("local_id", "claim_id", "kind", "value").distinct()
    a = own.withColumnRenamed("local_id", "local_a").withColumnRenamed("claim_id", "claim_a")
    b = own.withColumnRenamed("local_id", "local_b").withColumnRenamed("claim_id", "claim_b")
    key = F.concat("kind", F.lit("="), "value")
    auto = a.join(b, ["kind", "value"]).where("local_a < local_b and claim_a <> claim_b").groupBy("local_a", "local_b").agg(F.array_join(F.array_sort(F.collect_set(key)), ",").alias("evidence")).withColumn("status", F.lit("auto")).withColumn("probability", F.lit(None).cast("double"))
    if scored is None:
        return auto
    rest = scored.join(auto, ["local_a", "local_b"], "left_anti").withColumn("status", F.lit("review")).withColumn("evidence", F.lit("score"))
    return auto.unionByName(rest.select("local_a", "local_b", "evidence", "status", "probability"))


def band(probability: Column) -> Column:
    """JD1: a word for a probability; no bare percentage is shown."""
    out = F
    for least, name in BANDS:
        out = out.when(probability >= least, name)
    return out.otherwise("unlikely")


def match_records(records: DataFrame, frame: DataFrame, model: Model, pairs: DataFrame, identities: DataFrame | None = None) -> DataFrame:
    """JD1, JD5: record_id, mention_id, band, deterministic, name_only, conflicting, evidence, rank: outside records against mentions.

    records: a frame like the corpus's, with record_id for mention_id and negative or otherwise
    distinct ids. pairs: id_l (record), id_r (mention), as blocking proposes. A shared linking
    identifier is a hit by itself; missing fields add nothing; conflicting identifiers rank below
    matches by name alone. identities (mention_id, entity_id) keeps the best mention of an entity.
    """
    both = paired(pairs, records.withColumnRenamed("record_id", "mention_id").unionByName(frame, allowMissingColumns=True))
    levels = gammas(both)
    scored = score(levels, model, threshold=0.0)
    strong = [c for c in LINKING if f"gamma_{c}" in scored.columns]
    full = {"email": 4}
    hit = clash = F.lit(False)
    for c in strong:
        hit = hit | (F.col(f"gamma_{c}") == full.get(c, 1))
        clash = clash | ((F.col(f"gamma_{c}") == 0) & F.lit(c != "email") & F.lit(c != "vin"))
    present = [c.removeprefix("gamma_") for c in scored.columns if c.startswith("gamma_")]
    others = F.lit(True)
    for c in present:
        if c not in ("full_name", "name_sorted"):
            others = others & (F.col(f"gamma_{c}") <= 0)
    bits = contributions(levels, model).where("step > 0 and level >= 0 and bits <> 0")
    said = bits.groupBy("id_l", "id_r").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("bits")).alias("o"), "comparison", "bits"))), lambda x: F.format_string("%s %+.1f", x["comparison"], x["bits"])), ", ").alias("evidence"))
    flagged = scored.withColumn("deterministic", hit).withColumn("conflicting", clash).withColumn("name_only", others)
    out = flagged.join(said, ["id_l", "id_r"], "left").select(F.col("id_l").alias("record_id"), F.col("id_r").alias("mention_id"), F.when(F.col("deterministic"), "deterministic").otherwise(band(F.col("probability"))).alias("band"), "deterministic", "name_only", "conflicting", "evidence", "probability")
    order = [F.desc("deterministic"), F.asc("conflicting"), F.desc("probability"), "mention_id"]
    if identities is not None:
        one = Window.partitionBy("record_id", "entity_id").orderBy(*order)
        out = out.join(identities.select("mention_id", "entity_id"), "mention_id").withColumn("__n", F.row_number().over(one)).where("__n = 1").drop("__n")
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("record_id").orderBy(*order)))

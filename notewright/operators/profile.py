"""Surviving attributes, roles, summaries and dossiers of entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notewright.functions.contact import npi_valid

# Tiers from the strongest, attributes that are identifiers, and roles of classes.
TIERS = {"validated_id": 3, "template_field": 2, "narrative": 1}
IDENTIFIERS = ("has_email", "has_phone", "has_npi", "has_tin", "has_ssn", "has_vin", "has_dob")
ROLES = {"claimant": "claimant", "attorney": "claimant_attorney", "medical_provider": "treating_provider", "repair_shop": "repair_shop", "adjuster": "adjuster"}
SUMMARY = {"emails": "has_email", "phones": "has_phone", "npis": "has_npi", "tins": "has_tin", "ssns": "has_ssn", "vins": "has_vin", "dobs": "has_dob", "email_domains": "email_domain", "addresses": "addr"}
PAD = 45


def tier(attribute: Column, extractor: Column, value: Column) -> Column:
    """How a value is backed: a validated identifier, a template's field, or narrative."""
    identifier = attribute.isin(*IDENTIFIERS) & ((extractor == "template") | ((F.coalesce(value, F.lit("")) != "") & ((attribute != "has_npi") | npi_valid(value))))
    return F.when(identifier, "validated_id").when(extractor == "template", "template_field").otherwise("narrative")


def tier_rank(name: Column) -> Column:
    return F.when(name == "validated_id", 3).when(name == "template_field", 2).otherwise(1)


def survivorship(assertions: DataFrame) -> DataFrame:
    """One row per entity, attribute and value: its best tier (the first of equals by seq), known_to, conflict_flag.

    assertions: entity_id, attribute, value_norm, tier, polarity, seq and more, which the chosen row
    keeps. A value that is retracted or negated anywhere is closed. Values conflict if several
    survive at the attribute's highest surviving tier.
    """
    key = ["entity_id", "attribute"]
    value = Window.partitionBy(*key, "value_norm")
    ranked = assertions.withColumn("__rank", tier_rank(F.col("tier")))
    gone = F.max(F.col("polarity").isin("retracted", "negated")).over(value)
    first = F.row_number().over(value.orderBy(F.desc("__rank"), "seq"))
    kept = ranked.withColumn("__gone", gone).withColumn("__n", first).where("__n = 1")
    of = Window.partitionBy(*key)
    top = F.max(F.when(~F.col("__gone"), F.col("__rank"))).over(of)
    kept = kept.withColumn("__top", top)
    rivals = F.sum((~F.col("__gone") & (F.col("__rank") == F.col("__top"))).cast("int")).over(of)
    out = kept.withColumn("known_to", F.when(F.col("__gone"), "retracted")).withColumn("conflict_flag", F.when((rivals > 1) & (F.col("__rank") == F.col("__top")), 1).otherwise(0))
    return out.drop("__rank", "__gone", "__n", "__top")


def timelines(attributes: DataFrame) -> DataFrame:
    """F8: entity_id, attribute, timeline: values by tier from the strongest, then valid_from, then value."""
    item = F.struct((4 - tier_rank(F.col("tier"))).alias("order"), F.coalesce("valid_from", F.lit("None")).alias("from_"), "value_norm", "tier", "known_to", "conflict_flag")
    return attributes.groupBy("entity_id", "attribute").agg(F.array_sort(F.collect_list(item)).alias("timeline"))


def roles_per_claim(members: DataFrame) -> DataFrame:
    """entity_id, claim_id, role of its first mention there. members: entity_id, claim_id, entity_class, seq."""
    table = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return members.groupBy("entity_id", "claim_id").agg(F.min_by("entity_class", "seq").alias("c")).select("entity_id", "claim_id", F.coalesce(F.try_element_at(table, F.col("c")), F.col("c")).alias("role"))


def identity_summary(identifiers: DataFrame) -> DataFrame:
    """The sorted distinct values of each kind of identifier of an entity. identifiers: entity_id, field, value."""
    each = [F.array_sort(F.collect_set(F.when(F.col("field") == f, F.col("value")))).alias(n) for n, f in SUMMARY.items()]
    return identifiers.groupBy("entity_id").agg(*each)


def evidence(assertions: DataFrame, docs: DataFrame) -> DataFrame:
    """Assertions with snippet (PAD characters on each side), highlight_offset and machine_annotation."""
    low = F.greatest(F.lit(0), F.col("span_start") - PAD)
    high = F.least(F.length("text"), F.col("span_end") + PAD)
    joined = assertions.join(docs, "doc_id")
    return joined.select(
        *assertions.columns,
        F.substring("text", low + 1, high - low).alias("snippet"),
        F.array(F.col("span_start") - low, F.col("span_end") - low).alias("highlight_offset"),
        F.concat_ws(" ", "polarity", "predicate", F.concat(F.lit("= "), "value"), F.format_string("(%s[%d:%d])", F.col("doc_id").cast("string"), "span_start", "span_end")).alias("machine_annotation"),
    )


def dossiers(items: DataFrame, attributes: DataFrame) -> DataFrame:
    """entity_id and dossier_json of its timelines and evidence, each sorted."""
    seen = items.groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("doc_id", "span_start", "span_end", "predicate", "snippet", "highlight_offset", "machine_annotation"))).alias("evidence"))
    lines = timelines(attributes).groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("attribute", "timeline"))).alias("attributes"))
    both = seen.join(lines, "entity_id", "full_outer")
    return both.select("entity_id", F.to_json(F.struct("entity_id", "attributes", "evidence")).alias("dossier_json"))

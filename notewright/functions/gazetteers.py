"""Identifiers in texts by pattern, with the strength of what confirms them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewright.functions import contact
from notewright.operators import intervals

# The patterns of labels, most specific first.
PATTERNS = {
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "tin": r"\b\d{2}-\d{7}\b",
    "npi": r"\b\d{10}\b",
    "vin": r"\b[A-HJ-NPR-Z0-9]{17}\b",
    "icd10": r"\b[A-TV-Z][0-9][0-9A-Z](?:\.[0-9A-Z]{1,4})?\b",
    "cpt": r"\b\d{5}(?:-[A-Z]{2})?\b",
    "policy_number": r"(?i:\b(?:POL|PLC|POLICY)[#\s:-]*((?=[A-Z0-9-]*\d)[A-Z0-9-]{5,})\b)",
    "email": r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}",
    "phone": r"(?:\+?1[\s.\-]?)?\(?\d{3}\)?[\s.\-]?\d{3}[\s.\-]?\d{4}",
    "monetary_amount": r"\$\s?\d{1,3}(?:,\d{3})*(?:\.\d{2})?\b",
    "date": r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b",
    "date_written": r"\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s+\d{1,2},?\s+\d{4}\b",
    "zip": r"\b\d{5}(?:-\d{4})?\b",
    "address": r"\b\d{1,5}\s+[A-Z][A-Za-z]*(?:\s+[A-Z][A-Za-z]*)*\s+(?:St|Ave|Blvd|Rd|Dr|Ln|Ct|Pl|Pkwy)\b\.?(?:,\s*[A-Z][A-Za-z]+,\s*[A-Z]{2}\s*\d{5})?",
}
# Which label a span keeps when several claim it, and what confirms a label.
PRIORITY = {"ssn": 95, "tin": 94, "npi": 93, "vin": 93, "email": 92, "policy_number": 90, "address": 80, "date_written": 72, "date": 70, "monetary_amount": 65, "phone": 60, "icd10": 55, "cpt": 54, "zip": 20}
STRENGTH = {"npi": "checksum", "vin": "checksum", "email": "format", "phone": "format", "icd10": "format", "cpt": "format"}
CUES = {"icd10": "(?i)icd|dx|diagnos", "cpt": "(?i)cpt|procedure code|proc code"}
CONTEXT = 30

_compiled = {k: re.compile(p) for k, p in PATTERNS.items()}


def raw_hits(text: str | None) -> list[tuple[int, int, str, str, str]]:
    """(start, end, text, label, 30 characters before) of every match of every pattern."""
    t = text or ""
    return [(m.start(), m.end(), m[0], label, t[max(0, m.start() - CONTEXT) : m.start()]) for label, p in _compiled.items() for m in p.finditer(t)]


def scan(docs: DataFrame, resolve: bool = True) -> DataFrame:
    """doc_id, start, end, text, label, valid, validation; of conflicting spans the stronger label stays.

    Patterns run in Python, whose offsets are code points; checks are expressions.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(d, *h) for d, t in zip(f["doc_id"], f["text"], strict=True) for h in raw_hits(t)]
            yield pd.DataFrame(rows, columns=["doc_id", "start", "end", "text", "label", "left"])

    found = docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, start int, end int, text string, label string, left string")
    table = lambda values: F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    label, value = F.col("label"), F.col("text")
    valid = (
        F.when(label == "npi", contact.npi_valid(value))
        .when(label == "vin", contact.vin_valid(value))
        .when(label == "phone", F.length(contact.phone_digits(value)) == 10)
        .when(label == "icd10", F.col("left").rlike(CUES["icd10"]))
        .when(label == "cpt", F.col("left").rlike(CUES["cpt"]))
        .otherwise(True)
    )
    hits = found.select("doc_id", "start", "end", "text", "label", valid.alias("valid"), F.coalesce(F.try_element_at(table(STRENGTH), label), F.lit("none")).alias("validation"), F.element_at(table(PRIORITY), label).alias("priority"))
    return (intervals.resolve_conflicts(hits) if resolve else hits).drop("priority")


def scan_valid(docs: DataFrame) -> DataFrame:
    """Hits that pass what their label can be checked by; for most that is the pattern alone."""
    return scan(docs).where("valid")


def scan_checksum_verified(docs: DataFrame) -> DataFrame:
    """Hits that a check digit confirms."""
    return scan(docs).where("valid and validation = 'checksum'")


def counts(docs: DataFrame, labels: list[str]) -> DataFrame:
    """doc_id and the number of matches of each label's pattern, inside the JVM."""
    return docs.select("doc_id", *[F.regexp_count("text", F.lit(PATTERNS[k])).cast("long").alias(k) for k in labels])

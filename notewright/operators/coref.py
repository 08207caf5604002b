"""Coreference by rules, and resolved views of texts."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewright.functions import text as values
from notewright.operators.intervals import nearest_preceding

WITHIN = 600
_words = sorted([p for g in values.PRONOUNS.values() for p in g], key=len, reverse=True)
_phrases = sorted(values.DESCRIPTORS, key=len, reverse=True)
ANAPHOR = re.compile(rf"\b(?:({'|'.join(map(re.escape, _phrases))})|({'|'.join(_words)}))\b", re.I)


def anaphora(docs: DataFrame) -> DataFrame:
    """doc_id, start, end, surface, kind (pronoun or descriptor); whole words only, the longer of nested ones."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(d, m.start(), m.end(), m[0], "descriptor" if m[1] else "pronoun") for d, t in zip(f["doc_id"], f["text"], strict=True) for m in ANAPHOR.finditer(t or "")]
            yield pd.DataFrame(rows, columns=["doc_id", "start", "end", "surface", "kind"])

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, start int, end int, surface string, kind string")


def resolve(docs: DataFrame, mentions: DataFrame, typed: bool = False) -> DataFrame:
    """doc_id, start, end, surface, kind, antecedent_* and confidence: the last agreeing mention within WITHIN characters before.

    mentions: doc_id, mention_id, start, end, label, surface. Pronouns of persons agree with classes
    of persons, it and its with organizations, they with all; descriptors with their class. typed:
    labels are person, organization or unknown, and unknown agrees with all (I2).
    """
    a = anaphora(docs).withColumn("key", F.lower("surface"))
    allowed = lambda group: F.array(*[F.lit(c) for c in group])
    if typed:
        persons, orgs = ("person", "unknown"), ("organization", "unknown")
        described = {d: orgs if c in ("repair_shop", "medical_provider") else persons for d, c in values.DESCRIPTORS.items() if c}
    else:
        persons, orgs = values.PERSON_CLASSES, values.ORG_CLASSES
        described = {d: (c,) for d, c in values.DESCRIPTORS.items() if c}
    classes = F.when(F.col("key").isin(*values.PRONOUNS["person"]), allowed(persons)).when(F.col("key").isin(*values.PRONOUNS["org"]), allowed(orgs))
    for d, c in described.items():
        classes = classes.when(F.col("key") == d, allowed(c))
    points = a.withColumn("allowed", classes).withColumn("pos", F.col("start"))
    label = F.lower(F.coalesce("label_m", F.lit("")))
    agree = F.col("allowed").isNull() | (label == "") | F.array_contains("allowed", label)
    found = nearest_preceding(points, mentions, WITHIN, agree)
    return found.select(
        "doc_id", "start", "end", "surface", "kind",
        F.col("mention_id_m").alias("antecedent"), F.col("surface_m").alias("antecedent_surface"), F.col("start_m").alias("antecedent_start"), F.col("end_m").alias("antecedent_end"), F.col("label_m").alias("antecedent_class"),
        F.when(F.col("kind") == "pronoun", 0.75).otherwise(0.7).alias("confidence"),
    )


Clusters = Callable[[list[str]], list[list[list[tuple[int, int]]]]]


def cluster_links(text: str, clusters: list[list[tuple[int, int]]], mentions: list[tuple[int, int, str]]) -> list[tuple]:
    """(start, end, surface, antecedent's surface, start, end, class, kind) of each later member of a cluster: its first one is the antecedent,
    whose class is that of the first mention around it."""
    pronouns = {p for g in values.PRONOUNS.values() for p in g}
    out = []
    for first, *rest in (sorted(c) for c in clusters if len(c) > 1):
        kind = next((label for s, e, label in mentions if s <= first[0] and first[1] <= e), None)
        out += [(a, b, text[a:b], text[first[0] : first[1]], *first, kind, "pronoun" if text[a:b].lower() in pronouns else "descriptor") for a, b in rest]
    return sorted(out, key=lambda x: x[:2])


def resolve_by_model(docs: DataFrame, mentions: DataFrame, predict: Clusters) -> DataFrame:
    """As resolve(), by a model that answers clusters of spans for a batch of texts; confidence 0.9."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    own = mentions.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "label"))).alias("known"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts = [t or "" for t in f["text"]]
            rows = []
            for d, t, clusters, known in zip(f["doc_id"], texts, predict(texts), f["known"], strict=True):
                around = [(m["start"], m["end"], m["label"]) for m in known] if known is not None else []
                rows += [(d, *link, 0.9) for link in cluster_links(t, clusters, around)]
            yield pd.DataFrame(rows, columns=["doc_id", "start", "end", "surface", "antecedent_surface", "antecedent_start", "antecedent_end", "antecedent_class", "kind", "confidence"])

    schema = f"doc_id {kind}, start int, end int, surface string, antecedent_surface string, antecedent_start int, antecedent_end int, antecedent_class string, kind string, confidence double"
    return docs.select("doc_id", "text").join(own, "doc_id", "left").mapInPandas(run, schema)


def resolver(name: str, load: Callable[[], Clusters] | None = None) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """I3: "rules", "model" (an error if it can't be loaded), or "auto": the model if it loads, else rules."""
    if name not in ("rules", "model", "auto"):
        raise ValueError(f"unknown resolver {name}")
    if name == "rules":
        return resolve
    try:
        if load is None:
            raise LookupError("no model to load")
        predict = load()
    except Exception:
        if name == "model":
            raise
        return resolve
    return lambda docs, mentions: resolve_by_model(docs, mentions, predict)


def view(text: str, links: list[tuple[int, int, str]]) -> tuple[str, list[tuple[int, int]]]:
    """I4: the text with each link (start, end, antecedent) replaced, and checkpoints (offset there, offset here)."""
    out, marks, raw, size = [], [], 0, 0
    for start, end, name in sorted(links):
        if start < raw:
            continue
        marks += [(size, raw), (size + start - raw, start)]
        out += [text[raw:start], name]
        size += start - raw + len(name)
        raw = end
    return "".join([*out, text[raw:]]), [*marks, (size, raw)]


def project(start: int, end: int, marks: list[tuple[int, int]], length: int) -> tuple[int, int]:
    """I4: a span of the resolved view in offsets of the text."""
    def back(at: int) -> int:
        there, here = max((m for m in marks if m[0] <= at), default=(0, 0))
        return min(max(here + at - there, 0), length)

    a = back(start)
    return a, max(a, back(end))


def resolved_views(docs: DataFrame, links: DataFrame) -> DataFrame:
    """I4: doc_id, resolved, checkpoints: one row per document with links; the text itself is never changed."""
    per = links.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", "antecedent_surface")).alias("links"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            done = [view(t, [(x["start"], x["end"], x["antecedent_surface"]) for x in ls]) for t, ls in zip(f["text"], f["links"], strict=True)]
            yield pd.DataFrame({"doc_id": f["doc_id"], "resolved": [r for r, _ in done], "checkpoints": [[{"resolved": a, "raw": b} for a, b in c] for _, c in done]})

    return docs.select("doc_id", "text").join(per, "doc_id").mapInPandas(run, f"doc_id {kind}, resolved string, checkpoints array<struct<resolved:int,raw:int>>")

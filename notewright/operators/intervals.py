"""Joins, unions and coverage of half-open spans [start, end) within a document."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Spans are joined by document and stretches of this many characters, so a long document is many keys.
STRETCH = 4096


def _stretches(start: Column, end: Column) -> Column:
    last = F.greatest(start, end - 1)
    return F.explode(F.sequence(F.floor(start / STRETCH), F.floor(last / STRETCH)))


def overlap_join(left: DataFrame, right: DataFrame, key: str = "doc_id", how: str = "inner") -> DataFrame:
    """D3: pairs of spans of one document that overlap, start1 < end2 and start2 < end1.

    left and right: key, start, end and more; right's columns come with the suffix _r. how: inner,
    left_semi or left_anti. Each pair is made once, in the stretch where the later span starts.
    """
    r = right.select(*[F.col(c).alias(c if c == key else f"{c}_r") for c in right.columns])
    meets = (F.col("start") < F.col("end_r")) & (F.col("start_r") < F.col("end"))
    a, b = left.withColumn("__s", _stretches(F.col("start"), F.col("end"))), r.withColumn("__s", _stretches(F.col("start_r"), F.col("end_r")))
    if how == "inner":
        once = F.floor(F.greatest("start", "start_r") / STRETCH) == F.col("__s")
        return a.join(b, [key, "__s"]).where(meets & once).drop("__s")
    # Whether a row meets depends on its key, start and end alone: by these, rows that repeat stay apart, and no number is given
    # that another reading of left in another order would give to another row.
    at = [key, "start", "end"]
    spans = left.select(*at).distinct()
    hit = spans.withColumn("__s", _stretches(F.col("start"), F.col("end"))).join(b, [key, "__s"]).where(meets).select(*at).distinct()
    return left.join(hit, at, how).select(*left.columns)


def contained_join(inner: DataFrame, outer: DataFrame, key: str = "doc_id") -> DataFrame:
    """Pairs of a span and a span of the same document that holds it whole."""
    return overlap_join(inner, outer, key).where("start_r <= start and end <= end_r")


def point_join(points: DataFrame, spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """Points with the spans that hold their position, start <= pos < end; points outside all spans have nulls."""
    s = spans.select(*[F.col(c).alias(c if c == key else f"{c}_r") for c in spans.columns])
    a = points.withColumn("__s", F.floor(F.col("pos") / STRETCH))
    b = s.withColumn("__s", _stretches(F.col("start_r"), F.col("end_r")))
    b = b.withColumnRenamed(key, "__key").withColumnRenamed("__s", "__t")
    on = (F.col(key) == F.col("__key")) & (F.col("__s") == F.col("__t")) & (F.col("start_r") <= F.col("pos")) & (F.col("pos") < F.col("end_r"))
    return a.join(b, on, "left").drop("__s", "__t", "__key")


def nearest_preceding(points: DataFrame, mentions: DataFrame, within: int, agree: Column | None = None, key: str = "doc_id") -> DataFrame:
    """For each point the mention that ends at or before it, at most `within` characters back, and starts last.

    points: key, point_id, pos. mentions: key, mention_id, start, end. agree: a condition over both
    (columns of mentions carry the suffix _m). Points without such a mention aren't returned. The
    join is by document and stretches of `within` characters: a point meets its own and the one before.
    """
    m = mentions.select(*[F.col(c).alias(c if c == key else f"{c}_m") for c in mentions.columns])
    a = points.withColumn("__s", F.explode(F.array(F.floor(F.col("pos") / within), F.floor(F.col("pos") / within) - 1)))
    b = m.withColumn("__s", F.floor(F.col("end_m") / within))
    near = (F.col("end_m") <= F.col("pos")) & (F.col("pos") - F.col("end_m") <= within)
    found = a.join(b, [key, "__s"]).where(near if agree is None else near & agree)
    best = F.max_by(F.struct(*[c for c in m.columns if c != key]), F.struct("start_m", "end_m", "mention_id_m")).alias("best")
    return found.groupBy(*points.columns).agg(best).select(*points.columns, "best.*")


def nearest(points: DataFrame, mentions: DataFrame, agree: Column, key: str = "doc_id") -> DataFrame:
    """For each point the agreeing mention of its document with the least distance of starts, the earlier of equals."""
    m = mentions.select(*[F.col(c).alias(c if c == key else f"{c}_m") for c in mentions.columns])
    found = points.join(m, key).where(agree)
    best = F.min_by(F.struct(*[c for c in m.columns if c != key]), F.struct(F.abs(F.col("start_m") - F.col("pos")), "start_m", "mention_id_m")).alias("best")
    return found.groupBy(*points.columns).agg(best).select(*points.columns, "best.*")


def islands(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, start, end of the unions of spans that overlap or touch."""
    w = Window.partitionBy(key).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.select(key, "start", "end", F.when(reach >= F.col("start"), 0).otherwise(1).alias("new"))
    return marked.withColumn("island", F.sum("new").over(w)).groupBy(key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def coverage(spans: DataFrame, lengths: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document n_chars, covered and twice (characters in one span, in two or more), max_depth and n_spans.

    lengths: key and n_chars. A sweep over starts and ends: two rows a span, whatever its length.
    """
    ends = spans.select(key, F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("d")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("d")))).alias("e"))
    steps = ends.groupBy(key, F.col("e.at").alias("at")).agg(F.sum("e.d").alias("d"))
    w = Window.partitionBy(key).orderBy("at")
    depth = steps.select(key, (F.lead("at").over(w) - F.col("at")).alias("n"), F.sum("d").over(w).alias("depth"))
    by = depth.groupBy(key).agg(F.sum(F.when(F.col("depth") >= 1, F.col("n"))).alias("covered"), F.sum(F.when(F.col("depth") >= 2, F.col("n"))).alias("twice"), F.max("depth").alias("max_depth"))
    n = spans.groupBy(key).agg(F.count("*").alias("n_spans"))
    out = lengths.join(by, key, "left").join(n, key, "left")
    return out.select(key, "n_chars", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("covered", "twice", "max_depth", "n_spans")])


def resolve_conflicts(hits: DataFrame, key: str = "doc_id") -> DataFrame:
    """Of hits on one span the highest priority stays; then those within a longer hit of no lower priority go.

    hits: key, start, end, label, priority. Equal priorities are decided by the label.
    """
    w = Window.partitionBy(key, "start", "end").orderBy(F.desc("priority"), "label")
    one = hits.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    held = contained_join(one, one.select(key, "start", "end", "priority"), key)
    gone = held.where("end_r - start_r > end - start and priority_r >= priority").select(key, "start", "end").distinct()
    return one.join(gone, [key, "start", "end"], "left_anti")


GENERIC = ("person", "organization")


def union_list(spans: list[tuple]) -> list[list]:
    """Merge (start, end, text, label, extractors, score, description) of one document; see union_spans."""
    out: list[list] = []
    near: list[list] = []  # survivors that end behind the current start: later spans can overlap no others
    for s, e, text, label, extractors, score, about in sorted(spans, key=lambda x: (x[0], x[0] - x[1])):
        near = [m for m in near if s < m[1]]
        own = next((m for m in near if m[0] < e), None)
        if own is None:
            out.append([s, e, text, label, set(extractors), score, about])
            near.append(out[-1])
            continue
        special = label not in GENERIC
        if e - s > own[1] - own[0]:
            own[:3] = [s, e, text]
            own[3] = label if special else own[3]
        elif own[3] in GENERIC and special:
            own[3] = label
        own[4] |= set(extractors)
        own[5] = max(own[5], score)
        own[6] = own[6] or about
    return out


def union_spans(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """Overlapping spans of a document become the longest of them, with all extractors, the best score, the first
    description and a label that is not generic if one has it.

    By start, then longest first, each span joins the first survivor that it overlaps: the order
    decides, so a document's spans go through one task in that order, streamed with those of other
    documents. spans: key, start, end, text, label, extractors (array), score, description.
    """
    kind = spans.schema[key].dataType.simpleString()
    columns = [key, "start", "end", "text", "label", "extractors", "score", "description"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, held = None, []
        for f in frames:
            out = []
            for own, *span in f[columns].itertuples(index=False, name=None):
                if own != last:
                    out += [(last, *m[:4], sorted(m[4]), m[5], m[6]) for m in union_list(held)]
                    last, held = own, []
                held.append(span)
            yield pd.DataFrame(out, columns=columns)
        yield pd.DataFrame([(last, *m[:4], sorted(m[4]), m[5], m[6]) for m in union_list(held)], columns=columns)

    dealt = spans.select(*columns).repartition(key).sortWithinPartitions(key)
    return dealt.mapInPandas(run, f"{key} {kind}, start int, end int, text string, label string, extractors array<string>, score double, description string")


def uncovered(candidates: DataFrame, spans: DataFrame, most: int = 40, key: str = "doc_id") -> DataFrame:
    """Candidates that no span touches, the first `most` of each document."""
    free = overlap_join(candidates, spans, key, "left_anti")
    w = Window.partitionBy(key).orderBy("start", "end")
    return free.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__n")


"""Mixing sources to target weights by Poisson replication, with DataFrame functions alone.

A source's mean repetition rate is its target share of the output over its share of the input,
in bytes. Each document is repeated k times, where k inverts the Poisson distribution of that
mean at a number in [0, 1) taken from a hash of seed and document: a rerun, or a task run anew
after an executor is lost, draws the same k. A source's distribution is tabulated once, in the
table of sources, until the rest of its mass is below what the hash can resolve, so no count is
capped. The copies are dealt to the output by a second hash: a range partitioning over it and a
sort inside each partition is the global shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewright.llm.common import materialize, text_bytes

SEED = 20240917
#: A larger mean is the sum of draws of at most this mean, so that exp(-mean) stays a normal number.
PART = 64.0
#: A row holds at most some 200 numbers, so the table of this many sources is below 32 MB. More sources are joined by a shuffle.
SOURCES_TO_BROADCAST = 20_000


def _hash(*parts: Column) -> Column:
    """52 bits of the MD5 of the parts, joined by colons."""
    text = F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("\\N")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def rates(docs: DataFrame, weights: dict[str, float] | None = None, size: float = 1.0) -> DataFrame:
    """source, bytes long, rate double, parts int, cdf array<double> (of Poisson(rate / parts) at 0, 1, ...).

    weights: target share of each source, in any unit; without them all sources weigh the same;
    a source that weights doesn't name gets none, so its rate is 0. size: bytes of the output over
    bytes of the input. Null is a source like another, named None in weights. A text without bytes
    counts one, so that a source of empty texts has a rate.
    """
    own = F.greatest(text_bytes(F.col("text")), F.lit(1).cast("long"))
    by = docs.groupBy("source").agg(F.sum(own).alias("bytes"))
    if weights is None:
        weight = F.lit(1.0)
    else:
        weight = F.lit(0.0)
        for name, w in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(weight)
    weighed = by.withColumn("w", weight)
    total = weighed.agg(F.sum("w").alias("tw"), F.sum("bytes").alias("tb"))
    rate = F.when(F.col("tw") > 0, F.col("w") / F.col("tw") * F.col("tb") * F.lit(float(size)) / F.col("bytes")).otherwise(0.0)
    out = weighed.crossJoin(F.broadcast(total)).select("source", "bytes", rate.alias("rate"))  # total is one row
    out = out.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART)).cast("int")).withColumn("m", F.col("rate") / F.col("parts"))
    # Beyond m + 12 sqrt(m) + 40 the tail is below 2**-53, less than the hash resolves.
    steps = f"sequence(1, cast(ceil(m + 12 * sqrt(m) + 40) as int))"
    cdf = f"""aggregate({steps}, named_struct('p', exp(-m), 'c', array(exp(-m))),
 (a, k) -> named_struct('p', a.p * m / k, 'c', concat(a.c, array(element_at(a.c, -1) + a.p * m / k))), a -> a.c)"""
    return out.withColumn("cdf", F.expr(cdf)).select("source", "bytes", "rate", "parts", "cdf")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, size: float = 1.0, seed: int = SEED) -> DataFrame:
    """The columns of docs and __rate double, __copy int (from 0), __key long: each document k times, shuffled.

    A document is known by doc_id and text: rows that repeat get the same count. An empty table
    gives an empty result. The result is ordered by __key, then doc_id and __copy.
    """
    table = rates(docs, weights, size).select(F.col("source").alias("__s"), F.col("rate").alias("__rate"), F.col("parts").alias("__parts"), F.col("cdf").alias("__cdf"))
    table = materialize(table, "mixing-rates")
    if table.count() <= SOURCES_TO_BROADCAST:
        table = F.broadcast(table)
    marked = docs.withColumn("__mark", F.md5(F.coalesce("text", F.lit("\\N"))))  # before the join, so that a text nobody wants stays behind
    counted = marked.join(table, marked["source"].eqNullSafe(F.col("__s")), "left")
    unit = F.lit(float(1 << 52))
    draw = lambda j: F.size(F.filter("__cdf", lambda c: c <= _hash(F.lit(seed), F.col("doc_id"), F.col("__mark"), j) / unit))
    one = F.transform(F.array(_hash(F.lit(seed), F.col("doc_id"), F.col("__mark"), F.lit(1)) / unit), lambda u: F.size(F.filter("__cdf", lambda c: c <= u)))[0]
    many = F.aggregate(F.sequence(F.lit(1), F.col("__parts")), F.lit(0), lambda a, j: a + draw(j))
    counted = counted.withColumn("__k", F.when(F.col("__parts") == 1, one).otherwise(many))
    copies = counted.where("__k > 0").withColumn("__copy", F.explode(F.sequence(F.lit(0), F.col("__k") - 1)))
    keyed = copies.withColumn("__key", _hash(F.lit(seed), F.lit("order"), F.col("doc_id"), F.col("__mark"), F.col("__copy")))
    out = keyed.select(*docs.columns, "__rate", "__copy", "__key")
    order = ["__key", "doc_id", "__copy"]
    return out.repartitionByRange(*order).sortWithinPartitions(*order)


def oracle_sql(seed: int = SEED) -> str:
    """DuckDB SQL for doc_id, source, rate, copy and shuffle_key of mix() with equal weights."""
    def h(*parts: str) -> str:
        text = " || ':' || ".join(f"coalesce(CAST({p} AS VARCHAR), '\\N')" for p in parts)
        return f"CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT)"

    return f"""
WITH RECURSIVE d AS (SELECT doc_id, source, md5(coalesce(text, '\\N')) AS mark, greatest(coalesce(strlen(text), 0), 1) AS b FROM documents),
s AS (SELECT source, CAST(sum(b) AS BIGINT) AS bytes FROM d GROUP BY source),
t AS (SELECT CAST(count(*) AS DOUBLE) AS tw, CAST(sum(bytes) AS BIGINT) AS tb FROM s),
r AS (SELECT source, CAST(1.0 AS DOUBLE) / tw * tb * CAST(1.0 AS DOUBLE) / bytes AS rate FROM s, t),
parts AS (SELECT source, rate, greatest(1, CAST(ceil(rate / {PART}) AS INTEGER)) AS parts FROM r),
cdf(source, rate, parts, m, k, p, c) AS (
  SELECT source, rate, parts, rate / parts, 0, exp(-(rate / parts)), exp(-(rate / parts)) FROM parts
  UNION ALL SELECT source, rate, parts, m, k + 1, p * m / (k + 1), c + p * m / (k + 1) FROM cdf WHERE k < CAST(ceil(m + 12 * sqrt(m) + 40) AS INTEGER)),
table_ AS (SELECT source, rate, parts, list(c ORDER BY k) AS cs FROM cdf GROUP BY source, rate, parts),
u AS (SELECT d.*, rate, parts, cs, j, {h(str(seed), 'doc_id', 'mark', 'j')} / CAST({1 << 52} AS DOUBLE) AS u
  FROM (SELECT d.*, rate, parts, cs, unnest(generate_series(1, parts)) AS j FROM d JOIN table_ x ON d.source IS NOT DISTINCT FROM x.source) d),
k AS (SELECT doc_id, source, mark, rate, sum(len(list_filter(cs, lambda c: c <= u))) AS k FROM u GROUP BY doc_id, source, mark, rate),
c AS (SELECT doc_id, source, mark, rate, CAST(unnest(generate_series(0, CAST(k AS BIGINT) - 1)) AS INTEGER) AS copy FROM k WHERE k > 0)
SELECT doc_id, source, rate, copy, {h(str(seed), "'order'", 'doc_id', 'mark', 'copy')} AS shuffle_key FROM c"""

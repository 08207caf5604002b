"""Benchmark decontamination with DataFrame functions alone.

Words are runs of letters, digits and non-ASCII characters after lower-casing A-Z. The windows
of the benchmark (n consecutive words; a shorter item is one window) are turned into 64-bit
hashes. One scan of the documents, whatever the size of the benchmark, steps over the windows of
each text and tests their hashes:

* up to WINDOWS_TO_BROADCAST windows, counted first, the hashes are broadcast as a hash set;
* beyond it, a filter of FILTER_BITS bits is broadcast, so its size is fixed; hashes that pass it
  (some per cent of all) are joined with the benchmark's by a shuffle.

Texts never leave the scan: what does are a row per document, without text, and the hits, as
words. Hits are verified by a join on these words with the benchmark's windows, which names their
items, and are gathered by the key of their document (128 bits over id and text, so rows that repeat
whole have the same hits and need no place of their own).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewright.llm.common import document_key, materialize

WINDOW = 8
#: Of 8 bytes, some 24 in a hash table: 48 MB.
WINDOWS_TO_BROADCAST = 2_000_000
#: Kept as FILTER_BITS / 64 longs: 16 MB.
FILTER_BITS = 1 << 27
#: Spans of 16 bytes that are broadcast to their documents (32 MB); where there are more, texts and spans are joined by a shuffle.
SPANS_TO_BROADCAST = 2_000_000
NOT_WORD = r"[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: The same in a text as it came, where A-Z are still letters.
NOT_WORD_RAW = r"[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def words_sql(text: str) -> str:
    """SQL for the words of a text; none for null."""
    return f"coalesce(array_remove(split({LOWER.format(text)}, '{NOT_WORD}'), ''), array())"


def benchmark_windows(benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """w string (the words, joined by spaces), len int, h long, items array<string>: each distinct window."""
    own = benchmark.select(F.col("item_id").cast("string").alias("item"), F.expr(words_sql("text")).alias("ws")).where("size(ws) > 0")
    each = own.select("item", F.explode(F.expr(f"if(size(ws) <= {n}, array(ws), transform(sequence(1, size(ws) - {n - 1}), p -> slice(ws, p, {n})))")).alias("win"))
    return each.groupBy(F.array_join("win", " ").alias("w"), F.size("win").alias("len"), F.xxhash64("win").alias("h")).agg(F.array_sort(F.collect_set("item")).alias("items"))


def _windows(docs: DataFrame, sizes: list[int], keep: list[str]) -> DataFrame:
    """The columns keep as __k0, ..., __d1, __d2, __n (words), __p, __len, __h, __ws: a row with __p 0 for each document, and one for each of its windows of these sizes."""
    base = docs.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)], *document_key(), F.expr(words_sql("text")).alias("__ws"))
    kept = [f"__k{i}" for i in range(len(keep))] + ["__d1", "__d2", "__ws"]
    least = min(sizes, default=1 << 30)
    placed = base.select(*kept, F.explode(F.expr(f"sequence(0, greatest(0, size(__ws) - {least - 1}))")).alias("__p"))
    if len(sizes) > 1:
        placed = placed.select("*", F.explode(F.expr(f"if(__p = 0, array(0), array({', '.join(map(str, sizes))}))")).alias("__len")).where("__p + __len <= size(__ws) + 1")
    else:
        placed = placed.withColumn("__len", F.lit(sizes[0] if sizes else 0))
    return placed.withColumn("__h", F.expr("if(__p = 0, cast(null as bigint), xxhash64(slice(__ws, __p, __len)))"))


def scan(docs: DataFrame, windows: DataFrame, keep: list[str]) -> DataFrame:
    """What leaves the scan of the documents: a row with __p 0 for each document, and its verified hits, with __items.

    windows: as of benchmark_windows(), in a table that can be read again.
    """
    sizes = [r["len"] for r in windows.select("len").distinct().collect()]  # at most n of them
    known = windows.select(F.col("h").alias("__known")).distinct()
    few = known.count() <= WINDOWS_TO_BROADCAST
    each = _windows(docs, sorted(sizes), keep)
    if few:
        near = each.join(F.broadcast(known), F.col("__h") == F.col("__known"), "left").where("__p = 0 OR __known IS NOT NULL")
    else:
        bit = lambda h: F.pmod(h, F.lit(FILTER_BITS))
        longs = known.select(F.shiftright(bit(F.col("__known")), 6).alias("i"), F.expr(f"shiftleft(1L, cast(pmod(__known, {FILTER_BITS}) & 63 as int))").alias("b"))
        words = longs.groupBy("i").agg(F.bit_or("b").alias("b"))
        # A row for each long of the filter that isn't 0.
        each = each.withColumn("__i", F.when(F.col("__h").isNotNull(), F.shiftright(bit(F.col("__h")), 6)))
        near = each.join(F.broadcast(words), F.col("__i") == F.col("i"), "left").where(f"__p = 0 OR (b >> cast(pmod(__h, {FILTER_BITS}) & 63 as int)) & 1 = 1")
    words_ = F.expr("if(__p = 0, null, array_join(slice(__ws, __p, __len), ' '))")
    return near.select(*[f"__k{i}" for i in range(len(keep))], "__d1", "__d2", F.size("__ws").cast("long").alias("__n"), "__p", "__len", words_.alias("__w"))


def find_hits(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, keep: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, hits): one row per document with the columns keep, __d1, __d2 and n_words long; one row per
    document key with a hit: __d1, __d2, __spans array<struct<p, len>> (sorted, 1-based) and __named array<string>.

    Null or empty texts, and all texts under an empty benchmark, have no hits.
    """
    keep = docs.columns if keep is None else keep
    windows = materialize(benchmark_windows(benchmark, n), "decontam-windows")
    found = materialize(scan(docs, windows, keep), "decontam-found")
    own = found.where("__p = 0").select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)], "__d1", "__d2", F.col("__n").alias("__n_words"))
    hits = found.where("__p > 0").select("__d1", "__d2", "__p", "__len", "__w").distinct()  # rows that repeat whole
    named = hits.join(windows.select(F.col("w").alias("__w"), F.col("items").alias("__items")), "__w")
    gathered = named.groupBy("__d1", "__d2").agg(
        F.array_sort(F.collect_set(F.struct(F.col("__p").alias("p"), F.col("__len").alias("len")))).alias("__spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("__items")))).alias("__named"),
    )
    return own, materialize(gathered, "decontam-hits")


#: Words inside any span: spans are sorted, so each adds what lies beyond the end reached so far.
COVERED = """aggregate(__spans, named_struct('n', 0L, 'to', 0),
 (a, s) -> named_struct('n', a.n + greatest(0, s.p + s.len - greatest(s.p, a.to)), 'to', greatest(a.to, s.p + s.len)), a -> a.n)"""


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, min_items: int = 2) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: one row per document."""
    own, hits = find_hits(docs, benchmark, n, ["doc_id"])
    found = own.join(hits, ["__d1", "__d2"], "left")
    zero = F.lit(0).cast("long")
    items = F.coalesce("__named", F.array().cast("array<string>"))
    return found.select(
        "doc_id",
        F.col("__n_words").alias("n_words"),
        F.coalesce(F.expr(COVERED), zero).alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.size(items) >= min_items).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, min_items: int = 2) -> DataFrame:
    """The documents with the columns they came with, without what the benchmark holds.

    Documents with windows of min_items items or more go. Of others, the hit words go, each with
    what stands between it and the word before; n_chars, if there, follows the text. Documents
    without hits stay as they are, nulls included. Spans go to the texts: texts are shuffled only
    where there are too many spans to broadcast.
    """
    hits = find_hits(docs, benchmark, n, [])[1].select("__d1", "__d2", "__spans", F.size("__named").alias("__items"))
    if (hits.agg(F.sum(F.size("__spans"))).first()[0] or 0) <= SPANS_TO_BROADCAST:
        hits = F.broadcast(hits)
    keyed = docs.select(*docs.columns, *document_key())
    found = keyed.join(hits, ["__d1", "__d2"], "left").where(f"coalesce(__items, 0) < {min_items}")
    # A text is cut into its words, each with what stands before it, and a tail without a word.
    pieces = f"regexp_extract_all(text, '({NOT_WORD_RAW[:-1]}*)([^{NOT_WORD_RAW[1:-2]}]+)', 0)"
    kept = f"array_join(filter({pieces}, (t, i) -> NOT exists(__spans, s -> i + 1 >= s.p AND i + 1 < s.p + s.len)), '')"
    tail = f"regexp_extract(text, '{NOT_WORD_RAW[:-1]}*$', 0)"
    cut = F.col("__items").isNotNull()
    out = found.withColumn("text", F.when(cut, F.expr(f"concat({kept}, {tail})")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(cut, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def oracle_sql(n: int = WINDOW, min_items: int = 2) -> str:
    """DuckDB SQL for contamination()."""
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    found = f"coalesce(regexp_extract_all({lower}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), [])"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {found} AS ws FROM documents),
b AS (SELECT item_id, {found} AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(ws), {n}) AS k, array_to_string(ws[p:p + least(len(ws), {n}) - 1], ' ') AS w
  FROM (SELECT item_id, ws, unnest(generate_series(1, greatest(len(ws) - {n - 1}, 1))) AS p FROM b WHERE len(ws) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT r, p, k, array_to_string(ws[p:p + k - 1], ' ') AS w
  FROM (SELECT r, ws, k, unnest(generate_series(1, len(ws) - k + 1)) AS p FROM d, ks WHERE len(ws) >= k)),
h AS (SELECT DISTINCT r, p, dw.k, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.w = bw.w),
c AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(generate_series(p, p + k - 1)) AS q FROM h) GROUP BY r),
i AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS named FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(named, '')) AS items_sha256, coalesce(n_items, 0) >= {min_items} AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN i USING (r)"""

"""Repeated passages: sparse suffixes at minimisers, sorted, compared with their neighbours, extended both ways.

A passage of LEAST words or more that stands in two documents is found wherever it stands:

1. Of each text's suffixes only those are kept that start at a minimiser: among every SPAN
   consecutive runs of PREFIX words the first with the least hash. SPAN + PREFIX - 1 = LEAST, so
   every window of LEAST words has one owner, a kept suffix chosen by the window's content alone:
   the same one wherever the window stands.
2. Suffixes whose first PREFIX words have a hash that only one text has are left out. The others take
   with them the words of the windows they own: those that follow, and those before.
3. They are sorted by what follows, as words, and each is compared, word by word, with the nearest
   suffixes of other texts on either side: its longest match to the right. Then they are sorted
   by what stands before, read backwards, and compared in the same way: the longest match to the left.
4. A window inside these matches may still lie in one text to its left and in another to its right. So
   the windows that are left are compared as wholes, by 128 bits over their words. Windows that stand in
   two distinct texts are repeats, and what they cover is the exact union of all maximal matches, as
   every maximal match is a chain of such windows.

Sorts are by range over (hash, words, text), so a passage in very many documents spreads over
partitions. A suffix at the edge of a batch has a neighbour that isn't seen and takes the whole of its
words as matched; step 4 decides. The hash of step 2 only groups: what it brings together by chance,
step 3 tells apart. Only neighbours meet, never pairs, so a passage in very many documents costs as
many rows as it has occurrences. Equal texts (128 bits) take part once; their copies repeat the whole text.

The first occurrence, by the least doc_id, stays; others are dropped. A doc_id may be of any type that
can be ordered. A word is a run of characters that are not ASCII white space. Texts of fewer than LEAST
words repeat nothing. Null texts have no words. Rows that agree in doc_id and text are one document. A
null doc_id comes last.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewright.llm.common import bound_batches, document_key, materialize
from notewright.llm.textvec import code_points, slices, utf8, windows, words

LEAST, PREFIX = 50, 25
SPAN = LEAST - PREFIX + 1
LAST = (1 << 63) - 1


def owners(grams: np.ndarray, span: int = SPAN) -> np.ndarray:
    """For every span consecutive grams, the place of the first least one; places never fall."""
    best = np.arange(len(grams))
    wide = 1
    while wide < span:  # best[i] is the place of the least of grams i to i + wide - 1
        step = min(wide, span - wide)
        if len(best) <= step:
            return np.zeros(0, np.int64)
        a, b = best[:-step], best[step:]
        best = np.where(grams[b] < grams[a], b, a)
        wide += step
    return best


def kept(grams: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, nearest, farthest): the kept suffixes, and how many words before them the windows that they own begin."""
    own = owners(grams, span)
    begin = np.flatnonzero(np.diff(own, prepend=-1))
    place = own[begin]
    end = np.append(begin[1:], len(own)) - 1
    return place, place - end, place - begin


ROWS = "doc_id {kind}, __d1 long, __d2 long, n1 long, n2 long, n_words long, first int, last int, starts array<long>"


def prefix_hashes(hashes: np.ndarray) -> np.ndarray:
    """A hash of every PREFIX words, which chooses suffixes and groups them."""
    return windows(hashes, PREFIX)


def suffix_starts(docs: DataFrame) -> DataFrame:
    """A row per document: its key, 128 bits of its text, words, code points before its first word and at its last word's end, and the hashes of its kept suffixes' first words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 19):
            column = batch.column("text")
            buf, off = utf8(column)
            w = words(buf, off)
            chars = code_points(buf)
            n = np.diff(w.off)
            digests, lists = [], []
            first, last = np.zeros(len(column), np.int32), np.zeros(len(column), np.int32)
            raw = buf.tobytes()
            for i in range(len(column)):
                digests.append(xxhash.xxh3_128_digest(raw[off[i] : off[i + 1]]))
                a, b = w.off[i], w.off[i + 1]
                if b > a:
                    first[i] = chars[w.start[a]] - chars[off[i]]
                    last[i] = chars[w.end[b - 1]] - chars[off[i]]
                grams = prefix_hashes(w.hash[a:b])
                lists.append(np.unique(grams[kept(grams)[0]].view(np.int64)))
            at = np.zeros(len(column) + 1, np.int32)
            at[1:] = np.cumsum([len(x) for x in lists])
            starts = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(lists)))
            node = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            out = [*(batch.column(c) for c in ("doc_id", "__d1", "__d2")), pa.array(node[:, 0].copy()), pa.array(node[:, 1].copy()), pa.array(n), pa.array(first), pa.array(last), starts]
            yield pa.record_batch(out, ["doc_id", "__d1", "__d2", "n1", "n2", "n_words", "first", "last", "starts"])

    return docs.select("doc_id", *document_key(), "text").mapInArrow(run, ROWS.format(kind=docs.schema["doc_id"].dataType.simpleString()))


CONTEXT = "h long, n1 long, n2 long, rank {kind}, place int, nearest int, farthest int, after binary, before binary, at int, steps binary"


def contexts(texts: DataFrame) -> DataFrame:
    """A row per kept suffix that another text may have: the words of the windows it owns.

    texts: n1, n2, rank, matched array<long>, text. after: the words from the suffix's place on, each
    with a space behind it; before: those in front of it, read backwards. at: the code point where the first of
    them all begins; steps: the code points of each word and of the white space behind it, in turn.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 19):
            buf, off = utf8(batch.column("text"))
            w = words(buf, off)
            chars = code_points(buf)
            raw = buf.tobytes()
            rows: list[int] = []
            out: list[tuple] = []
            for i, matched in enumerate(batch.column("matched")):
                a, b = w.off[i], w.off[i + 1]
                grams = prefix_hashes(w.hash[a:b])
                place, near, far = kept(grams)
                h = grams[place].view(np.int64)
                edges = np.stack([chars[w.start[a:b]], chars[w.end[a:b]]], axis=1).ravel() - chars[off[i]]
                begin, end = w.start[a:b].tolist(), w.end[a:b].tolist()
                for j in np.flatnonzero(np.isin(h, matched.values.to_numpy())):
                    p, lo, hi = int(place[j]), int(place[j] - far[j]), int(place[j] - near[j]) + LEAST
                    own = raw[begin[lo] : end[hi - 1]].split()  # bytes.split(): \x20 and \x09-\x0D
                    steps = np.diff(edges[2 * lo : 2 * hi])
                    rows.append(i)
                    out.append((int(h[j]), p, int(near[j]), int(far[j]), b" ".join(own[p - lo :]) + b" ", b" ".join(own[p - lo - 1 :: -1]) + b" " if p > lo else b"", int(edges[2 * lo]), steps.astype(np.uint8 if steps.max() < 256 else np.int32).tobytes()))
            if out:
                h, place, near, far, after, before, at, steps = zip(*out, strict=True)
                own = pa.array(rows)
                yield pa.record_batch(
                    [pa.array(h), *(batch.column(c).take(own) for c in ("n1", "n2", "rank")), *(pa.array(x, pa.int32()) for x in (place, near, far)), pa.array(after, pa.binary()), pa.array(before, pa.binary()), pa.array(at, pa.int32()), pa.array(steps, pa.binary())],
                    ["h", "n1", "n2", "rank", "place", "nearest", "farthest", "after", "before", "at", "steps"],
                )

    return texts.select("n1", "n2", "rank", "matched", "text").mapInArrow(run, CONTEXT.format(kind=texts.schema["rank"].dataType.simpleString()))


def shared_words(a: bytes, b: bytes) -> int:
    """How many words two rows of words, each with a space behind it, begin with alike."""
    if a == b:
        return a.count(b" ")
    n = 0
    for x, y in zip(a.split(b" ")[:-1], b.split(b" ")[:-1], strict=False):
        if x != y:
            break
        n += 1
    return n


def longest_matches(group: list[int], text: list[tuple[int, int]], words_: list[bytes]) -> np.ndarray:
    """For sorted rows, the most words that each begins with alike with a row of another text in its group.

    Where the nearest row of another text may lie before the first row or behind the last one, LEAST.
    """
    n = len(group)
    alike = [0] * n  # with the row before
    for i in range(1, n):
        if group[i] == group[i - 1]:
            alike[i] = shared_words(words_[i - 1], words_[i])
    back, ahead = [LEAST] * n, [LEAST] * n
    for i in range(1, n):
        back[i] = alike[i] if text[i] != text[i - 1] else min(alike[i], back[i - 1])
    for i in range(n - 2, -1, -1):
        ahead[i] = alike[i + 1] if text[i] != text[i + 1] else min(alike[i + 1], ahead[i + 1])
    return np.maximum(back, ahead)


def _compared(rows: DataFrame, by: str, result: str) -> DataFrame:
    """rows and result int: the longest match of each in the order of the words `by`."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                text = list(zip(batch.column("n1").to_pylist(), batch.column("n2").to_pylist(), strict=True))
                best = longest_matches(batch.column("h").to_pylist(), text, batch.column(by).to_pylist())
                yield pa.record_batch([*batch.columns, pa.array(best.astype(np.int32))], [*names, result])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    order = ["h", by, "n1", "n2", "place"]
    # A fixed number: by their compressed bytes, partitions of a very common passage would be put together although they hold very many rows.
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(run, f"{kinds}, {result} int")


WINDOWS = "w1 long, w2 long, n1 long, n2 long, rank {kind}, start int, a int, b int"


def matched_windows(rows: DataFrame) -> DataFrame:
    """w1, w2 (128 bits of the words), n1, n2, rank, start (in words), a, b (code points): the windows inside the matches of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests: list[bytes] = []
            counts = np.zeros(batch.num_rows, np.int64)
            parts = []
            columns = [batch.column(c).to_pylist() for c in ("place", "low", "high", "farthest", "after", "before", "at", "steps")]
            for i, (place, low, high, far, after, before, at, steps) in enumerate(zip(*columns, strict=True)):
                own = before.split()[::-1] + after.split()
                line = b" ".join(own) + b" "
                stops = list(accumulate(map(len, own), lambda a, n: a + n + 1, initial=0))
                edges = np.frombuffer(steps, np.uint8 if len(steps) == 2 * len(own) - 1 else np.int32).astype(np.int64)
                edges = at + np.concatenate(([0], np.cumsum(edges)))
                k = far - np.arange(high, low - 1, -1)  # first words, among the row's own
                counts[i] = len(k)
                parts.append(np.stack([place - far + k, edges[2 * k], edges[2 * (k + LEAST) - 1]], axis=1))
                digests += [xxhash.xxh3_128_digest(line[stops[x] : stops[x + LEAST]]) for x in k.tolist()]
            if digests:
                taken = pa.array(np.repeat(np.arange(batch.num_rows), counts))
                w = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                places = np.concatenate(parts).astype(np.int32)
                yield pa.record_batch(
                    [pa.array(w[:, 0].copy()), pa.array(w[:, 1].copy()), *(batch.column(c).take(taken) for c in ("n1", "n2", "rank")), *(pa.array(places[:, c].copy()) for c in range(3))],
                    ["w1", "w2", "n1", "n2", "rank", "start", "a", "b"],
                )

    return rows.mapInArrow(run, WINDOWS.format(kind=rows.schema["rank"].dataType.simpleString()))


def _covered(hits: DataFrame) -> DataFrame:
    """Per text: words in repeats, words in repeats that stand in an earlier document, the spans of the latter, and the first documents.

    hits: n1, n2, start, a, b, later boolean, first (null unless later).
    """

    def union(start: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[int, list[str]]:
        if not len(start):
            return 0, []
        cut = np.flatnonzero(np.concatenate(([True], start[1:] > start[:-1] + LEAST)))
        end = np.append(cut[1:], len(start)) - 1
        return int((start[end] + LEAST - start[cut]).sum()), [f"{x}:{y}" for x, y in zip(a[cut], b[end], strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            repeated, dropped, joined = [], [], []
            for found in batch.column("found"):
                s = found.values
                start, a, b, later = (s.field(x).to_numpy(zero_copy_only=False) for x in ("start", "a", "b", "later"))
                order = np.argsort(start, kind="stable")
                start, a, b, later = start[order], a[order], b[order], later[order]
                repeated.append(union(start, a, b)[0])
                m, spans = union(start[later], a[later], b[later])
                dropped.append(m)
                joined.append(",".join(spans))
            yield pa.record_batch([batch.column("n1"), batch.column("n2"), batch.column("firsts"), pa.array(repeated, pa.int64()), pa.array(dropped, pa.int64()), pa.array(joined, pa.string())], ["n1", "n2", "firsts", "repeated", "dropped", "spans"])

    found = F.collect_set(F.struct("start", "a", "b", "later")).alias("found")
    grouped = hits.groupBy("n1", "n2").agg(found, F.array_sort(F.collect_set("first")).alias("firsts"))
    return grouped.mapInArrow(run, f"n1 long, n2 long, firsts {grouped.schema['firsts'].dataType.simpleString()}, repeated long, dropped long, spans string")


def _rank(docs: DataFrame) -> tuple[Column, Callable[[str], Column]]:
    """(what orders documents, null last; the doc_id in a column that holds it): a long for whole numbers, so that aggregations hash it, else a pair."""
    if docs.schema["doc_id"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint"):
        return F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), F.col
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id")), lambda name: F.col(f"{name}.id")


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, __d1, __d2, n_words, n_repeated, n_dropped, spans, first_docs: one row per document.

    n_repeated: words in passages of LEAST words or more that another document holds. n_dropped:
    those that a document of a lesser doc_id holds; spans: where they stand, as start:end in code
    points, joined by commas; first_docs: the least doc_id of each, sorted.
    """
    own = bound_batches(docs.select("doc_id", "text"))
    rank, id_of = _rank(docs)
    rows = materialize(suffix_starts(own), "suffix-rows")
    node = ["n1", "n2"]
    key = F.struct("__d1", "__d2")
    top = F.min(F.struct(rank.alias("rank"), "__d1", "__d2"))
    nodes = rows.groupBy(*node).agg(top.alias("top"), (F.min(key) != F.max(key)).alias("copied"), F.first("starts").alias("starts"))
    nodes = materialize(nodes, "suffix-nodes")
    several = (F.min("n1") != F.max("n1")) | (F.min("n2") != F.max("n2"))
    starts = nodes.select(*node, F.explode("starts").alias("h"))
    shared = starts.groupBy("h").agg(several.alias("several")).where("several").select("h")
    matched = starts.join(shared, "h").groupBy(*node).agg(F.collect_list("h").alias("matched"))
    wanted = materialize(matched.join(nodes.select(*node, "top"), node).select(*node, F.col("top.rank").alias("rank"), F.col("top.__d1").alias("__d1"), F.col("top.__d2").alias("__d2"), "matched"), "suffix-matched")
    texts = own.select(*document_key(), "text").join(wanted, ["__d1", "__d2"])
    suffixes = materialize(contexts(texts), "suffix-contexts")
    low = F.greatest("nearest", F.lit(LEAST) - F.col("after_words")).alias("low")
    forward = _compared(suffixes, "after", "after_words").select("*", low).drop("after_words").where("low <= farthest")
    high = F.least("farthest", "before_words").alias("high")
    both = _compared(forward, "before", "before_words").select("*", high).drop("before_words").where("low <= high")
    found = materialize(matched_windows(both), "suffix-windows")
    common = found.groupBy("w1", "w2").agg(several.alias("several"), F.min("rank").alias("first")).where("several").drop("several")
    common = materialize(common, "suffix-common")  # the join deals its sides anew, so that Spark can split a very common passage
    later = F.col("first") < F.col("rank")
    hits = found.join(common, ["w1", "w2"]).select(*node, "start", "a", "b", later.alias("later"), F.when(later, id_of("first")).alias("first"))
    table = materialize(nodes.select(*node, "top", "copied").join(_covered(hits), node, "left"), "suffix-covered")
    joined = rows.select("doc_id", "__d1", "__d2", *node, "n_words", "first", "last").join(table, node, "left")
    long_ = F.col("n_words") >= LEAST
    copy = long_ & F.col("copied")
    again = copy & ~((F.col("top.__d1") == F.col("__d1")) & (F.col("top.__d2") == F.col("__d2")))
    zero = F.lit(0).cast("long")
    ids = f"array<{docs.schema['doc_id'].dataType.simpleString()}>"
    return joined.select(
        "doc_id",
        "__d1",
        "__d2",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("repeated", zero)).alias("n_repeated"),
        F.when(again, F.col("n_words")).otherwise(F.coalesce("dropped", zero)).alias("n_dropped"),
        F.when(again, F.concat_ws(":", "first", "last")).otherwise(F.coalesce("spans", F.lit(""))).alias("spans"),
        F.when(again, F.array(id_of("top.rank")).cast(ids)).otherwise(F.coalesce(F.col("firsts").cast(ids), F.array().cast(ids))).alias("first_docs"),
    )


def cut(text: str | None, spans: str | None) -> str | None:
    """The text without the spans."""
    if not text or not spans:
        return text
    out, at = [], 0
    for a, b in (s.split(":") for s in spans.split(",")):
        out.append(text[at : int(a)])
        at = int(b)
    return "".join([*out, text[at:]])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """The documents, with the columns they came with, without what an earlier document holds. n_chars follows the text."""
    found = repeats(docs).where("spans <> ''").select("__d1", "__d2", F.col("spans").alias("__spans")).dropDuplicates(["__d1", "__d2"])
    joined = docs.select(*docs.columns, *document_key()).join(found, ["__d1", "__d2"], "left")

    @F.udf("string", useArrow=True)
    def apply(text, spans):
        return cut(text, spans)

    changed = F.col("__spans").isNotNull()
    out = joined.withColumn("text", F.when(changed, apply("text", "__spans")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_repeated, n_dropped, spans, first_docs: one row per document."""
    return repeats(docs).drop("__d1", "__d2")

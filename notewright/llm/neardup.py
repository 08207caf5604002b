"""Near-duplicates: consistent weighted sampling over TF-IDF shingles, banded, verified, joined to classes.

1. Document frequencies of shingles (five words, lower-cased; a text of fewer words is one
   shingle) are counted over all documents in BUCKETS hashed counters. A counter's load by chance
   grows with the corpus exactly as the corpus does, so the weights behave alike at every size:
   idf tells shingles apart down to about one document in a few hundred and is level below that.
2. Improved consistent weighted sampling (Ioffe, 2010) draws BANDS x ROWS samples of each text's
   weighted shingles, a shingle that stands t times weighing 1 + ln t times its idf; two texts agree in a
   sample with the probability of their weighted Jaccard similarity. Texts that agree in all
   samples of a band share a bucket.
3. Equal texts (128 bits over their words) are one node. Each bucket is a star around its least node; the
   components of these stars are candidate classes. No bucket is expanded into pairs.
4. Candidate classes are dealt into chunks of about CHUNK texts. A task compares the texts of a
   chunk exactly. A link is a weighted Jaccard similarity at or above the threshold, or a plain
   one: in a large group of near copies, TF-IDF makes what the copies share cheaper than their own
   edits, and would cut copies apart that share eight shingles of ten.
5. Classes of several chunks are joined in two more steps: the best-linked texts of each class are
   compared with all its chunks; then, exactly, texts outside the largest component of a bucket with
   all texts of that bucket: in blocks, each of which meets the texts of its buckets once. So a text
   meets what its bands bring it together with, never the whole of a class that buckets chain
   together. Only connectivity is needed: what is already joined is not compared again.

Texts without words are near-duplicates of none. Repeated rows are copies of one another. doc_id
may be null; a class is named by its least doc_id, null if it has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notewright.llm.common import bound_batches, document_key, materialize
from notewright.llm.textvec import inside, mix, slices, utf8, windows, words
from notewright.operators.components import connected_components

SHINGLE = 5
SIMILARITY = 0.8
#: At 0.8 a pair meets in a band with probability 0.9998, at 0.7 with 0.993.
BANDS, ROWS = 12, 3
BUCKETS = 1 << 18
CHUNK, CHUNK_BYTES = 512, 4 << 20
PIVOTS = 8
BLOCK = 256
#: Up to this many texts, a class is compared by walking its postings, beyond by matrix products.
SPARSE = 16
SLICE = 1 << 19
SEED = 0x5851F42D4C957F2D


def shingles(column: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of each shingle of each text, texts in order."""
    buf, off = utf8(column)
    w = words(buf, off, lower=True)
    at = inside(w.off, k)
    doc = w.doc()
    hashes = windows(w.hash, k)[at] if len(at) else np.zeros(0, np.uint64)
    own = doc[at]
    sizes = np.diff(w.off)
    short = np.flatnonzero((sizes > 0) & (sizes < k))
    if len(short):
        extra = [windows(w.hash[w.off[i] : w.off[i + 1]], int(sizes[i]))[0] for i in short]
        own = np.concatenate([own, short])
        hashes = np.concatenate([hashes, np.array(extra, np.uint64)])
        order = np.argsort(own, kind="stable")
        own, hashes = own[order], hashes[order]
    return hashes, own


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """(documents with a shingle in each bucket, documents). BUCKETS numbers reach the driver, whatever the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS + 1, np.int64)
        for batch in slices(batches, "text", SLICE):
            hashes, own = shingles(batch.column("text"))
            pairs = np.unique(own * np.int64(BUCKETS) + (hashes % np.uint64(BUCKETS)).astype(np.int64))
            counts[:BUCKETS] += np.bincount(pairs % BUCKETS, minlength=BUCKETS)
            counts[BUCKETS] += batch.num_rows
        used = np.flatnonzero(counts)
        for i in range(0, len(used), 10_000):
            part = used[i : i + 10_000]
            yield pa.record_batch([pa.array(part.astype(np.int32)), pa.array(counts[part])], ["bucket", "n"])

    table = docs.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS + 1, np.int64)
    out[table.column("bucket").to_numpy()] = table.column("n").to_numpy()
    return out[:BUCKETS], int(out[BUCKETS])


def weights_of(frequencies: np.ndarray, n: int) -> np.ndarray:
    """Augmented idf of each bucket: from a half, for shingles of every document, to 1, for the rarest.

    An idf that is not bounded below makes the shingles of a group with a third of all documents
    cost a quarter of its members' own edits, and bands no longer bring its members together.
    """
    idf = np.log1p(max(n, 1) / np.maximum(frequencies, 1))
    used = frequencies > 0
    return (0.5 + 0.5 * np.minimum(1, idf / (idf[used].max() if used.any() else 1))).astype(np.float32)


def weighted(column: pa.Array, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, times, idf) of each distinct shingle of each text, by text, then hash."""
    hashes, own = shingles(column)
    if len(column) < 1 << 16:
        order = np.argsort(hashes)
        order = order[np.argsort(own[order].astype(np.uint16), kind="stable")]  # a radix sort
    else:
        order = np.lexsort((hashes, own))
    hashes, own = hashes[order], own[order]
    first = np.ones(len(hashes), bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (own[1:] != own[:-1])
    at = np.flatnonzero(first)
    times = np.diff(np.append(at, len(hashes)))
    hashes = hashes[at]
    return hashes, own[at], times, idf[(hashes % np.uint64(BUCKETS)).astype(np.int64)]


def damped(times: np.ndarray) -> np.ndarray:
    """What a shingle's times in a text multiply its idf by."""
    return (1 + np.log(times)).astype(np.float32)


def samples(hashes: np.ndarray, starts: np.ndarray, log_weight: np.ndarray, n: int) -> np.ndarray:
    """n consistent weighted samples of each text: an array of texts x n hashes.

    starts: where each text begins in hashes; every text has a shingle.
    """
    out = np.empty((len(starts), n), np.uint64)
    sizes = np.diff(np.append(starts, len(hashes)))
    unit, half = np.float32(2.0**-24), np.float32(2.0**-25)
    low, wide = np.uint64(0xFFFFFF), np.uint64(24)
    for k in range(n):
        a = mix(hashes ^ np.uint64((SEED * (2 * k + 1)) & 0xFFFFFFFFFFFFFFFF))
        b = mix(a + np.uint64(0x632BE59BD9B4E019))
        u = lambda x: (x & low).astype(np.float32) * unit + half
        r = -np.log(u(a) * u(a >> wide))  # Gamma(2, 1)
        c = -np.log(u(b) * u(b >> wide))
        beta = (a >> np.uint64(48)).astype(np.float32) * np.float32(2.0**-16)
        t = np.floor(log_weight / r + beta)
        rank = np.log(c) - r * (t - beta) - r
        least = np.minimum.reduceat(rank, starts)
        hits = np.flatnonzero(rank == np.repeat(least, sizes))
        own = np.searchsorted(starts, hits, "right") - 1
        firsts = hits[np.unique(own, return_index=True)[1]]
        out[:, k] = mix(hashes[firsts] ^ mix(t[firsts].astype(np.int64).astype(np.uint64) + np.uint64(k + 1)))
    return out


SIGNED = "doc_id {kind}, __d1 long, __d2 long, n1 long, n2 long, bytes long, bands array<long>"


def signatures(docs: DataFrame, idf: np.ndarray) -> DataFrame:
    """doc_id, document key, n1 and n2 (128 bits of the words; null without words), bytes, bands."""
    shared = docs.sparkSession.sparkContext.broadcast(idf)  # BUCKETS numbers: 1 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            column = batch.column("text")
            hashes, own, times, idf_ = weighted(column, shared.value)
            starts = np.flatnonzero(np.diff(own, prepend=-1))
            bands = np.zeros((len(starts), BANDS), np.int64)
            if len(starts):
                got = samples(hashes, starts, np.log(damped(times) * idf_), BANDS * ROWS)
                acc = np.zeros((len(starts), BANDS), np.uint64)
                for j in range(ROWS):
                    acc = mix(acc * np.uint64(31) + got[:, j::ROWS])
                bands = acc.view(np.int64)
            with_words = own[starts]
            digests = np.zeros((len(column), 2), np.int64)
            for i in with_words:
                key = b" ".join(column[int(i)].as_py().encode().lower().split())  # bytes: ASCII case and white space alone
                digests[i] = np.frombuffer(xxhash.xxh3_128_digest(key), "<i8")
            none = np.ones(len(column), bool)
            none[with_words] = False
            at = np.zeros(len(column) + 1, np.int32)
            at[1:] = np.cumsum(~none) * BANDS
            lists = pa.ListArray.from_arrays(pa.array(at), pa.array(bands.ravel()), mask=pa.array(none))
            _, off = utf8(column)
            yield pa.record_batch([batch.column("doc_id"), batch.column("__d1"), batch.column("__d2"), *(pa.array(digests[:, k].copy(), mask=none) for k in (0, 1)), pa.array(np.diff(off)), lists], ["doc_id", "__d1", "__d2", "n1", "n2", "bytes", "bands"])

    own = docs.select("doc_id", *document_key(), "text")
    return own.mapInArrow(run, SIGNED.format(kind=docs.schema["doc_id"].dataType.simpleString()))


def _links(members: list[tuple[int, str]], groups: np.ndarray, idf: np.ndarray, limit: float) -> list[tuple[int, int]]:
    """Pairs of positions in members, of one group, whose similarity reaches the limit."""
    m = len(members)
    hashes, own, times, weight = weighted(pa.array([t for _, t in members], pa.large_string()), idf)
    # A shingle that stands t times is t units that weigh 1 + ln t times its idf together, so weighted sums are sums over units.
    unit = np.repeat(np.arange(len(hashes)), times)
    level = np.arange(len(unit)) - np.repeat(np.cumsum(times) - times, times)
    key = mix(hashes[unit] + level.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ mix(groups[own[unit]].astype(np.uint64))
    doc, plain = own[unit], level == 0
    w = weight[unit].astype(np.float64) * np.where(plain, 1.0, np.log1p(1 / np.maximum(level, 1)))
    total_w = np.bincount(doc, weights=w, minlength=m)
    total_n = np.bincount(doc[plain], minlength=m)
    order = np.lexsort((doc, key))
    key, doc, w, plain = key[order], doc[order], w[order], plain[order]
    same = np.zeros((m, m))
    count = np.zeros((m, m))
    _, size = np.unique(groups, return_counts=True)
    if size.max() <= SPARSE:
        for o in range(1, int(size.max())):
            i = np.flatnonzero(key[o:] == key[:-o])
            if not len(i):
                break
            pair = doc[i] * m + doc[i + o]
            same += np.bincount(pair, weights=w[i], minlength=m * m).reshape(m, m)
            count += np.bincount(pair, weights=plain[i], minlength=m * m).reshape(m, m)
    else:
        edges = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
        shared = np.flatnonzero(np.diff(edges) > 1)
        for s in range(0, len(shared), 4096):
            own_ = shared[s : s + 4096]
            n = np.diff(edges)[own_]
            rows = np.repeat(edges[own_] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            column = np.repeat(np.arange(len(own_)), n)
            hit = np.zeros((m, len(own_)), np.float32)
            hit[doc[rows], column] = 1
            same += (hit * w[edges[own_]].astype(np.float32)) @ hit.T
            hit *= plain[edges[own_]]
            count += hit @ hit.T
        same, count = np.triu(same, 1), np.triu(count, 1)
    i, j = np.nonzero(count + same)
    a, b = same[i, j], count[i, j]
    good = (a >= limit * (total_w[i] + total_w[j] - a) - 1e-4) | (b >= limit * (total_n[i] + total_n[j] - b) - 1e-9)
    good &= groups[i] == groups[j]
    return list(zip(i[good].tolist(), j[good].tolist(), strict=True))


def _forest(m: int, links: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """(root of each position, number of links of each); a root has most links of its tree."""
    parent, degree = list(range(m)), [0] * m

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for i, j in links:
        degree[i] += 1
        degree[j] += 1
        parent[root(i)] = root(j)
    best: dict[int, int] = {}
    for x in range(m):
        r = root(x)
        if r not in best or degree[x] > degree[best[r]]:
            best[r] = x
    return [best[root(x)] for x in range(m)], degree


EDGES = "class long, u long, v long, degree int"


def compare(texts: DataFrame, keys: list[str], idf: np.ndarray, limit: float) -> DataFrame:
    """class, u, v, degree: each text of each group, tied to the best-linked text of its tree (itself if it has no link).

    texts: class, keys, node, text. Groups stream through the tasks, a few small ones at a time.
    """
    shared = texts.sparkSession.sparkContext.broadcast(idf)

    def solve(members: list[tuple[int, str]], groups: list[int], classes: list[int]) -> pa.RecordBatch:
        root, degree = _forest(len(members), _links(members, np.array(groups), shared.value, limit))
        node = [n for n, _ in members]
        return pa.record_batch([pa.array(classes, pa.int64()), pa.array(node, pa.int64()), pa.array([node[r] for r in root], pa.int64()), pa.array([degree[r] for r in root], pa.int32())], ["class", "u", "v", "degree"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: tuple[list, list, list] = ([], [], [])
        bytes_ = number = 0
        group: list[tuple[int, str]] = []
        last = None

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal ready, bytes_, number
            if not group:
                return
            if len(group) > SPARSE:
                yield solve(group, [0] * len(group), [last[0]] * len(group))
                return
            ready[0].extend(group)
            ready[1].extend([number] * len(group))
            ready[2].extend([last[0]] * len(group))
            number += 1
            bytes_ += sum(len(t) for _, t in group)
            if len(ready[0]) >= 200 or bytes_ > SLICE * 2:
                yield solve(*ready)
                ready, bytes_ = ([], [], []), 0

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in keys]
            for *key, node, text in zip(*columns, batch.column("node").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if key != last:
                    yield from close()
                    group, last = [], key
                if not group or group[-1][0] != node:
                    group.append((node, text))
        yield from close()
        if ready[0]:
            yield solve(*ready)

    dealt = texts.select(*keys, "node", "text").repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, "node")
    return dealt.mapInArrow(run, EDGES)


def near_duplicates(docs: DataFrame, limit: float = SIMILARITY) -> DataFrame:
    """doc_id, __d1, __d2, class_id, best boolean: one row per document; best marks the document (by key) that its class keeps."""
    own = bound_batches(docs.select("doc_id", "text"))
    frequencies, n = document_frequencies(own)
    idf = weights_of(frequencies, n)
    rows = materialize(signatures(own, idf), "neardup-signatures")
    nodes = rows.where("n1 is not null").groupBy("n1", "n2").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__d1", "__d2")).alias("own"), F.max("bytes").alias("bytes"), F.first("bands").alias("bands"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "neardup-nodes")
    # Stars of buckets: their members and least node.
    placed = nodes.select("node", F.posexplode("bands").alias("band", "h"))
    centres = placed.groupBy("band", "h").agg(F.min("node").alias("centre"), F.count("*").alias("n")).where("n > 1")
    stars = placed.join(centres, ["band", "h"]).where("node <> centre").select("node", "centre").distinct()
    coarse = connected_components(materialize(stars, "neardup-stars")).toDF("node", "class")
    sized = materialize(coarse.join(nodes.select("node", "own", "bytes"), "node"), "neardup-classes")
    chunks = sized.groupBy("class").agg(F.greatest(F.ceil(F.count("*") / F.lit(CHUNK)), F.ceil(F.sum("bytes") / F.lit(CHUNK_BYTES))).alias("chunks"))
    dealt = sized.join(chunks, "class").select("class", "chunks", F.pmod(F.xxhash64("node"), "chunks").alias("chunk"), "node", F.col("own.__d1").alias("__d1"), F.col("own.__d2").alias("__d2"))
    dealt = materialize(dealt, "neardup-dealt")
    # A merge join whatever the sizes: few candidates would be broadcast, many not, and what runs on
    # a sample would not be what runs on a corpus.
    found = own.select(*document_key(), "text").join(dealt.hint("merge"), ["__d1", "__d2"]).select("class", "chunks", "chunk", "node", "text")
    texts = materialize(found, "neardup-texts")
    if texts.count() > dealt.count():  # rows that repeat whole: one of each is enough
        texts = materialize(texts.groupBy("node").agg(*[F.first(c).alias(c) for c in ("class", "chunks", "chunk", "text")]).select("class", "chunks", "chunk", "node", "text"), "neardup-texts")
    edges = materialize(compare(texts, ["class", "chunk"], idf, limit), "neardup-edges")
    wide = texts.where("chunks > 1")
    joined = _across(wide, edges, placed, idf, limit) if not wide.isEmpty() else connected_components(edges.where("u <> v").select("u", "v"))
    joined = joined.toDF("node", "component")
    named = nodes.join(joined, "node", "left").select("n1", "n2", "own", F.coalesce("component", "node").alias("component"))
    firsts = named.groupBy("component").agg(F.min("own").alias("first"))
    firsts = materialize(firsts, "neardup-firsts")  # the join deals its sides anew, so that Spark can split a very large class
    table = materialize(named.join(firsts, "component").select("n1", "n2", F.col("first.doc_id").alias("class_id"), F.struct("first.__d1", "first.__d2").alias("kept")), "neardup-named")
    out = rows.select("doc_id", "__d1", "__d2", "n1", "n2").join(table, ["n1", "n2"], "left")
    return out.select(
        "doc_id",
        "__d1",
        "__d2",
        F.when(F.col("n1").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce(F.col("kept") == F.struct("__d1", "__d2"), F.lit(True)).alias("best"),
    )


def _across(wide: DataFrame, edges: DataFrame, placed: DataFrame, idf: np.ndarray, limit: float) -> DataFrame:
    """node, component: by the edges, and by those that join the chunks of classes with several.

    wide: the texts of these classes; placed: node, band, h of every node.
    """
    classes = wide.select("class", "chunk").distinct()
    roots = edges.join(classes.select("class").distinct(), "class", "left_semi").where("degree > 0").select("class", F.col("v").alias("node"), "degree").distinct()
    best = roots.withColumn("rank", F.row_number().over(Window.partitionBy("class").orderBy(F.desc("degree"), "node"))).where(F.col("rank") <= PIVOTS)
    pivots = wide.join(best.select("class", "node"), ["class", "node"]).select("class", "node", "text")
    again = wide.select("class", "chunk", "node", "text").union(pivots.join(classes, "class").select("class", "chunk", "node", "text"))
    edges = materialize(edges.union(compare(again, ["class", "chunk"], idf, limit)), "neardup-edges")
    joined = materialize(connected_components(edges.where("u <> v").select("u", "v"), wide.select("node")), "neardup-joined").toDF("node", "component")
    # Buckets that hold several components, and their texts outside the largest one of each, dealt into blocks by class.
    size = F.octet_length("text").cast("long").alias("bytes")
    own = materialize(placed.select("node", F.xxhash64("band", "h").alias("bucket")).join(wide.select("class", "node", size), "node").join(joined, "node"), "neardup-buckets")
    counts = own.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    mixed = counts.groupBy("bucket").agg(F.count("*").alias("components"), F.max(F.struct("n", "component")).alias("top")).where("components > 1").select("bucket", F.col("top.component").alias("largest"))
    apart = own.join(materialize(mixed, "neardup-mixed"), "bucket").where(F.col("component") != F.col("largest"))
    apart = materialize(apart.select("class", "node", "bytes", "bucket"), "neardup-apart")
    if apart.isEmpty():
        return joined
    parts = lambda n, most, bytes_: F.greatest(F.ceil(n / F.lit(most)), F.ceil(bytes_ / F.lit(CHUNK_BYTES)))
    blocks = apart.select("class", "node", "bytes").distinct().groupBy("class").agg(parts(F.count("*"), BLOCK, F.sum("bytes")).alias("blocks"))
    block = F.pmod(F.xxhash64(F.lit(7), "node"), "blocks").alias("block")
    left = apart.join(blocks, "class").select("class", block, "node", "bucket")
    # What a block meets: all texts of its texts' buckets, each once, in chunks.
    reached = left.select("block", "bucket").distinct().join(own.select("class", "node", "bytes", "bucket"), "bucket").select("class", "block", "node", "bytes").distinct()
    reached = materialize(reached, "neardup-reached")
    chunks = reached.groupBy("class", "block").agg(parts(F.count("*"), CHUNK, F.sum("bytes")).alias("chunks"))
    right = reached.join(chunks, ["class", "block"]).select("class", "block", F.pmod(F.xxhash64("node"), "chunks").alias("chunk"), "node")
    upto = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk")
    again = left.select("class", "block", "node").distinct().join(chunks, ["class", "block"]).select("class", "block", upto, "node")
    met = materialize(again.union(right).distinct(), "neardup-met")  # the join deals its sides anew, so that Spark can split a text of many blocks
    texts = wide.select("node", "text").join(met, "node")
    late = materialize(compare(texts, ["class", "chunk", "block"], idf, limit).where("u <> v").select("u", "v"), "neardup-late")
    # The late links join components that are known, so only their ends are walked again.
    ends = late.join(joined.toDF("u", "a"), "u").join(joined.toDF("v", "b"), "v").where("a <> b").select("a", "b").distinct()
    if ends.isEmpty():
        return joined
    merged = connected_components(ends).toDF("component", "root")
    return joined.join(merged, "component", "left").select("node", F.coalesce("root", "component").alias("component"))


def classes(docs: DataFrame, limit: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id: one row per document."""
    return near_duplicates(docs, limit).select("doc_id", "class_id")


def keep_one(docs: DataFrame, limit: float = SIMILARITY) -> DataFrame:
    """One document of each class, with the columns it came with: one that has the least doc_id."""
    found = near_duplicates(docs, limit)
    best = materialize(found.where("best").select("__d1", "__d2").groupBy("__d1", "__d2").count(), "neardup-kept")
    keyed = docs.select(*docs.columns, *document_key())
    kept = keyed.join(best.select("__d1", "__d2"), ["__d1", "__d2"], "left_semi")
    if not best.where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["__d1", "__d2"])
    return kept.select(*docs.columns)

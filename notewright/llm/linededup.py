"""Line dedup over whole corpora: range-partitioned line hashes, decided in sorted streams.

1. One scan turns every line into (128-bit hash of its key, 128-bit document key, position, rows).
   Rows that repeat whole within a batch are one entry that counts them.
2. The narrow rows are range-partitioned by (hash, document) and sorted by position within. Equal
   (hash, document) pairs share a partition, but a hot line spreads over as many partitions as
   its documents need, so no line's rows have to fit one task.
3. Each partition is one stream of runs of equal hashes. A run is decided as soon as it has shown
   enough documents; a run that touches an edge of its partition also leaves its count behind,
   and rows of such a run that are still open (fewer documents than the limit, so few rows
   before the next edge) are decided from the sum of the counts.
4. What is dropped returns to its documents as a compressed bitmap of the lines to keep. Texts
   are read once more to apply it, and never pass through the line stages.

Every row is a document: rows with the same doc_id and text count one by one, and share a bitmap.
A null or empty text is one empty line. Line keys are the line without ASCII white space at its
ends, A-Z in lower case; keys shorter than min_chars are never dropped.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewright.llm.common import bound_batches, document_key, materialize
from notewright.llm.textvec import slices

SPACE = b" \t\n\x0b\x0c\r"
LINES = "__d1 long, __d2 long, pos long, h1 long, h2 long, n long"
DECIDED = "kind int, __d1 long, __d2 long, pos long, h1 long, h2 long, n long"
DROP, OPEN, EDGE = 0, 1, 2


def line_hashes(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """A row per line whose key has min_chars code points or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            hashes, rows, places = [], [], []
            own_keys = np.stack([batch.column(n).to_numpy() for n in ("__d1", "__d2")], axis=1)
            _, firsts, copies = np.unique(own_keys, axis=0, return_index=True, return_counts=True)
            for row in firsts.tolist():
                text = batch.column("text")[row]
                for pos, line in enumerate((text.as_py() or "").encode().split(b"\n")):
                    key = line.strip(SPACE).lower()  # bytes.lower() changes A-Z alone
                    if len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode()) >= min_chars):
                        hashes.append(xxhash.xxh3_128_digest(key))
                        rows.append(row)
                        places.append(pos)
            h = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
            own = np.array(rows, np.int64)
            weight = np.zeros(batch.num_rows, np.int64)
            weight[firsts] = copies
            columns = [own_keys[own, 0], own_keys[own, 1], np.array(places, np.int64), h[:, 0], h[:, 1], weight[own]]
            yield pa.record_batch([pa.array(np.ascontiguousarray(c), pa.int64()) for c in columns], ["__d1", "__d2", "pos", "h1", "h2", "n"])

    return bound_batches(docs.select(*document_key(), "text")).mapInArrow(run, LINES)


def _runs(min_docs: int):
    """The streaming pass over one sorted partition; see the module's text."""

    def rows(kind: int, part: np.ndarray, n: int = 0) -> pa.RecordBatch:
        columns = [pa.array(np.full(len(part), kind, np.int32)), *(pa.array(np.ascontiguousarray(part[:, i])) for i in range(5)), pa.array(np.full(len(part), n, np.int64))]
        return pa.record_batch(columns, ["kind", "__d1", "__d2", "pos", "h1", "h2", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # rows of the current run that are still open
        hash_: tuple[int, int] | None = None
        doc: tuple[int, int, int] | None = None  # the last document and the place of its first line in the run
        n_docs, edge = 0, True

        def close(last: bool) -> Iterator[pa.RecordBatch]:
            if hash_ is None:
                return
            if edge or last:
                yield rows(EDGE, np.array([[0, 0, 0, *hash_, 0]], np.int64), n_docs)
                if held:
                    yield rows(OPEN, np.concatenate(held))

        for batch in batches:
            if not batch.num_rows:
                continue
            a = np.stack([batch.column(n).to_numpy() for n in ("__d1", "__d2", "pos", "h1", "h2", "n")], axis=1)
            new_hash = np.ones(len(a), bool)
            new_hash[1:] = (a[1:, 3:5] != a[:-1, 3:5]).any(axis=1)
            new_doc = new_hash.copy()
            new_doc[1:] |= (a[1:, :2] != a[:-1, :2]).any(axis=1)
            starts = np.flatnonzero(new_hash)
            # A row of the table puts each of its lines here once, so the entries at a document's first place count its rows.
            at_first = a[np.flatnonzero(new_doc), 2][np.cumsum(new_doc) - 1]
            here = (int(a[0, 3]), int(a[0, 4]))
            if here == hash_ and doc is not None and (int(a[0, 0]), int(a[0, 1])) == doc[:2]:  # goes on with the document of the batch before
                stop = int(np.append(np.flatnonzero(new_doc)[1:], len(a))[0])
                at_first[:stop] = doc[2]
            counts = np.add.reduceat(np.where(a[:, 2] == at_first, a[:, 5], 0), starts)
            ends = np.append(starts[1:], len(a))
            # Runs that begin and end in this batch, but not with it, are decided at once.
            whole = np.flatnonzero(counts[1:-1] >= min_docs) + 1
            if len(whole):
                yield rows(DROP, np.concatenate([a[starts[i] : ends[i]] for i in whole]))
            for i in dict.fromkeys((0, len(starts) - 1)):
                part = a[starts[i] : ends[i]]
                here = (int(part[0, 3]), int(part[0, 4]))
                if here != hash_:
                    yield from close(False)
                    edge = hash_ is None
                    held, n_docs, doc, hash_ = [], 0, None, here
                n_docs += int(counts[i])
                doc = (int(part[-1, 0]), int(part[-1, 1]), int(at_first[ends[i] - 1]))
                held.append(part)
                if n_docs >= min_docs:
                    yield rows(DROP, np.concatenate(held))
                    held = []
        yield from close(True)

    return run


def dropped_lines(lines: DataFrame, min_docs: int) -> DataFrame:
    """__d1, __d2, pos of the lines whose hash is in min_docs documents or more."""
    lines = materialize(lines, "line-hashes")  # the range bounds are sampled from this, not from the texts
    order = ["h1", "h2", "__d1", "__d2"]
    sorted_ = lines.repartitionByRange(*order).sortWithinPartitions(*order, "pos")
    seen = materialize(sorted_.mapInArrow(_runs(min_docs), DECIDED), "line-runs")
    totals = seen.where(F.col("kind") == EDGE).groupBy("h1", "h2").agg(F.sum("n").alias("total"))
    late = seen.where(F.col("kind") == OPEN).join(totals.where(F.col("total") >= min_docs), ["h1", "h2"], "left_semi")
    columns = ["__d1", "__d2", "pos"]
    return seen.where(F.col("kind") == DROP).select(*columns).union(late.select(*columns))


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """__d1, __d2, keep binary: for each document that loses lines, a deflated bitmap, bit i of byte i // 8 (high bit first) set where line i stays. Lines beyond its end stay."""
    dropped = dropped_lines(line_hashes(docs, min_chars), min_docs)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = []
            for places in batch.column("places"):
                pos = places.values.to_numpy()
                bits = np.ones(int(pos.max()) + 1, np.uint8)
                bits[pos] = 0
                bits = np.concatenate([bits, np.ones(-len(bits) % 8, np.uint8)])
                maps.append(zlib.compress(np.packbits(bits).tobytes(), 6))
            yield pa.record_batch([batch.column("__d1"), batch.column("__d2"), pa.array(maps, pa.binary())], ["__d1", "__d2", "keep"])

    return dropped.groupBy("__d1", "__d2").agg(F.collect_set("pos").alias("places")).mapInArrow(pack, "__d1 long, __d2 long, keep binary")


def kept_lines(text: str | None, keep: bytes | None) -> tuple[list[bytes], int]:
    """The lines of a text that its bitmap keeps, and how many it had."""
    lines = (text or "").encode().split(b"\n")
    if keep is None:
        return lines, len(lines)
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8))
    return [x for i, x in enumerate(lines) if i >= len(bits) or bits[i]], len(lines)


def with_bitmaps(docs: DataFrame, maps: DataFrame) -> DataFrame:
    """The columns of docs, and __keep: the document's bitmap or null."""
    keyed = docs.select(*docs.columns, *document_key())
    return keyed.join(maps.withColumnRenamed("keep", "__keep"), ["__d1", "__d2"], "left").select(*docs.columns, "__keep")


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """The documents, with the columns they came with, without lines that are in min_docs documents or more. n_chars follows the text."""
    joined = with_bitmaps(docs, keep_bitmaps(docs, min_docs, min_chars)).withColumn("__changed", F.col("__keep").isNotNull())

    @F.pandas_udf("string")
    def apply(text: pd.Series, keep: pd.Series) -> pd.Series:
        return pd.Series([t if k is None else b"\n".join(kept_lines(t, k)[0]).decode() for t, k in zip(text, keep, strict=True)])

    out = joined.withColumn("text", F.when(F.col("__changed"), apply("text", "__keep")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__changed"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def line_report(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256: one row per document."""
    joined = with_bitmaps(docs.select("doc_id", "text"), keep_bitmaps(docs, min_docs, min_chars))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            lines, dropped, shas = [], [], []
            for text, keep in zip(batch.column("text"), batch.column("__keep"), strict=True):
                kept, n = kept_lines(text.as_py(), keep.as_py())
                lines.append(n)
                dropped.append(n - len(kept))
                shas.append(hashlib.sha256(b"\n".join(kept)).hexdigest())
            yield pa.record_batch([batch.column("doc_id"), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(shas)], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"doc_id {kind}, n_lines long, n_dropped long, kept_sha256 string")


def oracle_sql(min_docs: int = 10, min_chars: int = 1) -> str:
    """DuckDB SQL for line_report()."""
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, p, ls[p] AS line, translate(regexp_replace(ls[p], '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT r, ls, unnest(generate_series(1, len(ls))) AS p FROM d)),
f AS (SELECT key FROM l WHERE length(key) >= {min_chars} GROUP BY key HAVING count(DISTINCT r) >= {min_docs}),
k AS (SELECT r, count(*) AS n_dropped FROM l WHERE key IN (SELECT key FROM f) GROUP BY r),
t AS (SELECT r, string_agg(line, chr(10) ORDER BY p) AS kept FROM l WHERE key NOT IN (SELECT key FROM f) GROUP BY r)
SELECT doc_id, CAST(len(ls) AS BIGINT) AS n_lines, CAST(coalesce(n_dropped, 0) AS BIGINT) AS n_dropped, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (r) LEFT JOIN t USING (r)"""

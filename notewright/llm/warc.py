"""WARC archives: written by Spark's text writer, read back by boundary-chain verification.

Writing. A record is a header, an empty line, the payload and two line ends. Spark's text writer
with CR LF CR LF between rows makes exactly that, so archives are committed like any Spark output
and a lost executor costs a task's rerun. Of records with equal payloads of REVISIT_BYTES or more
the one with the smallest page_id is a response and holds the payload; others are revisits that
name it and repeat its digest and length.

Reading. Archives are cut into blocks of BLOCK bytes, whatever they hold.

1. Each task scans its blocks for the magic of a record and parses what follows it: a candidate
   record, with its successor's offset from Content-Length. Magic inside payloads yields
   candidates too; lines that several of them would read are read once, so a block of nothing but
   magic takes linear time. The task follows successors inside its block and emits, for every
   candidate, where its chain leaves the block.
2. Pointer jumping from the start of each file over these edges: each round doubles the blocks
   that a jump passes, and what is reachable from offset 0 is, for each block, the one offset at
   which true records enter it.
3. A second scan walks each block from its entry; only records on the chain are read. The digest
   of each payload is computed and compared with its header.

A record longer than a block belongs to the block where it starts; a header that leaves its block
is read on to its end, however long. A record whose header can't be parsed ends its file's chain:
what follows can't be trusted. A chain that ends before its file does is an error, unless the reader
asks for what such files hold before the damage (strict=False).

page_id may be of any type: in the archive it is percent-encoded text. A page without one has a
record without one. A url's control characters are written as spaces.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import unquote_plus

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notewright.llm.common import materialize, read_range, scratch

REVISIT_BYTES = 100
BLOCK = 8 << 20
#: Bytes of the first step beyond a block; each further step doubles what was read.
STEP = 1 << 16
#: Payloads on several pages, a row of some 100 bytes each: up to so many are broadcast (20 MB), more are joined by a shuffle of the pages.
SHARED_TO_BROADCAST = 200_000
SEPARATOR = "\r\n\r\n"
VERSION = "WARC/1.1\r\n"
MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
# Fixed value: the profile of revisits by digest, from the WARC 1.1 standard.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def _line(name: str, value: Column) -> Column:
    """A header line; nothing for null. Line ends and other controls in the value become spaces."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), F.regexp_replace(value.cast("string"), r"[\x00-\x1F\x7F]", " "), F.lit("\r\n")), F.lit(""))


def plan_records(pages: DataFrame) -> DataFrame:
    """page_id, url, html, bytes, digest, record_type, refers_to of each page.

    A null html is an empty payload. A page without page_id is always a response, and never one
    that others refer to. Pages that share the smallest page_id of their payload are all responses.
    """
    html = F.coalesce("html", F.lit(""))
    facts = pages.select("page_id", "url", html.alias("html"), F.octet_length(html).cast("long").alias("bytes"), F.sha2(html, 256).alias("digest"))
    shared = facts.where((F.col("bytes") >= REVISIT_BYTES) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    shared = materialize(shared, "warc-shared")
    if shared.count() <= SHARED_TO_BROADCAST:
        shared = F.broadcast(shared)
    joined = facts.join(shared, "digest", "left")
    revisit = F.col("first").isNotNull() & (F.col("page_id") != F.col("first"))
    revisit = F.coalesce(revisit & (F.col("bytes") >= REVISIT_BYTES), F.lit(False))
    return joined.select("page_id", "url", "html", "bytes", "digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str) -> None:
    """Write a record for each page to archives under path, one or more for each task."""
    planned = plan_records(pages)
    name = lambda c: F.concat(F.lit("<urn:page:"), F.url_encode(c.cast("string")), F.lit(">"))
    revisit = F.col("record_type") == "revisit"
    payload = F.when(revisit, "").otherwise(F.col("html"))
    record = F.concat(
        F.lit(VERSION),
        _line("WARC-Type", F.col("record_type")),
        _line("WARC-Record-ID", F.coalesce(name(F.col("page_id")), F.lit("<urn:no-page>"))),
        _line("WARC-Date", F.lit(DATE)),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        _line("WARC-Refers-To", F.when(revisit, name(F.col("refers_to")))),
        _line("WARC-Profile", F.when(revisit, PROFILE)),
        _line("X-Payload-Length", F.col("bytes")),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.octet_length(payload)),
        F.lit("\r\n"),
        payload,
    )
    planned.select(record.alias("value")).write.option("lineSep", SEPARATOR).text(path)


def blocks_of(spark: SparkSession, path: str, size: int = BLOCK) -> DataFrame:
    """file, length, start: the blocks of the archives under path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select(F.col("path").alias("file"), "length")  # contents aren't read
    parts = files.where("length > 0").select("file", "length", F.explode(F.expr(f"sequence(0L, length - 1, {size}L)")).alias("start"))
    return parts.repartition("file", "start")


Header = tuple[int, int, bool]


class Headers:
    """Headers of one file around a block: raw holds what follows base, and is read on where a header leaves it.

    What is left of a header from each of its lines on is remembered, so a line is read once
    although many candidates lead to it.
    """

    def __init__(self, file: str, base: int, raw: bytes):
        self.file, self.base, self.raw = file, base, raw
        self.done = False  # whether raw reaches the end of the file
        self.after: dict[int, Header | None] = {}

    def _more(self) -> bool:
        if self.done:
            return False
        step = max(STEP, len(self.raw))
        got = read_range(self.file, self.base + len(self.raw), step)
        self.raw += got
        self.done = len(got) < step
        return bool(got)

    def _line_end(self, at: int) -> int:
        """Where the line from `at` ends, in raw; -1 if the file ends before."""
        begin = at
        while (end := self.raw.find(b"\r\n", begin)) < 0:
            begin = max(at, len(self.raw) - 1)
            if not self._more():
                return -1
        return end

    def find(self, offset: int) -> Header | None:
        """(offset of the content, its length, whether a record type is given) of the header at an offset of the file; None if it isn't one."""
        at = offset - self.base
        end = self._line_end(at)
        if end < 0 or not MAGIC.match(self.raw, at):
            return None
        at = end + 2
        passed: list[tuple[int, int | None, bool, bool]] = []
        while at not in self.after:
            end = self._line_end(at)
            if end < 0:
                self.after[at] = None
            elif end == at:
                self.after[at] = (self.base + end + 2, -1, False)
            elif (colon := self.raw.find(b":", at, end)) < 0:
                self.after[at] = None
            else:
                key = self.raw[at:colon].strip().lower() if colon - at < 64 else b""
                length = self.raw[colon + 1 : end].strip() if key == b"content-length" else None
                passed.append((at, int(length) if length and len(length) < 19 and length.isdigit() else -1, length is not None, key == b"warc-type"))
                at = end + 2
        left = self.after[at]
        for at, length, sized, typed in reversed(passed):
            if left is not None:  # of fields that repeat the last one counts
                left = (left[0], length if sized and left[1] == -1 else left[1], left[2] or typed)
            self.after[at] = left
        return left if left is not None and left[1] >= 0 and left[2] else None

    def fields(self, offset: int, content: int) -> dict[bytes, bytes]:
        """The fields of a header that find() has found, in lower case."""
        lines = self.raw[offset - self.base : content - self.base].split(b"\r\n")[1:-2]
        return {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in lines)}


def candidate_exits(blocks: DataFrame, size: int = BLOCK) -> DataFrame:
    """file, node, exit: for each candidate record of each block, where its chain leaves the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                file, start = row["file"], row["start"]
                raw = read_range(file, start, size + len(VERSION))
                headers = Headers(file, start, raw)
                end = start + size
                after: dict[int, int] = {}
                for m in MAGIC.finditer(raw):
                    at = start + m.start()
                    if at < end and (found := headers.find(at)):
                        after[at] = found[0] + found[1] + len(SEPARATOR)
                for at in sorted(after, reverse=True):  # successors lie behind, so they are done
                    after[at] = after.get(after[at], after[at])
                yield pa.record_batch([pa.array([file] * len(after), pa.string()), pa.array(list(after), pa.int64()), pa.array(list(after.values()), pa.int64())], ["file", "node", "exit"])

    return blocks.mapInArrow(run, "file string, node long, exit long")


def entries(exits: DataFrame) -> DataFrame:
    """file, node: the offsets at which the chain from each file's start enters a block."""
    jump = materialize(exits, "warc-jump")
    seen = materialize(jump.where("node = 0").select("file", "node"), "warc-seen")
    known = seen.count()
    while known:
        step = seen.join(jump, ["file", "node"]).select("file", F.col("exit").alias("node"))
        seen = materialize(seen.union(step).distinct(), "warc-seen")
        if (now := seen.count()) == known:
            break
        known = now
        far = jump.select("file", F.col("node").alias("exit"), F.col("exit").alias("far"))
        jump = materialize(jump.join(far, ["file", "exit"], "left").select("file", "node", F.coalesce("far", "exit").alias("exit")), "warc-jump")
    return seen


RECORD = "file string, offset long, page_id string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string, intact boolean"


def page_of(name: bytes | None) -> str | None:
    """The page_id that a record's name holds; None for a record without one."""
    if name is None or not name.startswith(b"<urn:page:"):
        return None
    return unquote_plus(name.decode()[len("<urn:page:") : -1])


def read_records(spark: SparkSession, path: str, size: int = BLOCK, with_payload: bool = False, strict: bool = True) -> DataFrame:
    """The records on the chains of the archives under path.

    A file whose chain ends before the file does is an error; with strict=False its records up to there are returned.

    payload_bytes and payload_digest are those of the full payload: of what was read for a
    response, as the header repeats them for a revisit. intact: what was read has the length and
    digest that its header gives. with_payload adds payload, binary (null for revisits).
    """
    blocks = blocks_of(spark, path, size)
    reached = entries(candidate_exits(blocks, size))
    if strict:
        broken = blocks.select("file", "length").distinct().join(reached.select("file", F.col("node").alias("length")), ["file", "length"], "left_anti").first()
        if broken:
            raise ValueError(f"the chain of records of {broken['file']} ends before the file does")
    enter = reached.select("file", (F.col("node") - F.col("node") % size).alias("start"), F.col("node").alias("enter"))
    starts = blocks.join(enter, ["file", "start"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                file, at, end = row["file"], row["enter"], min(row["start"] + size, row["length"])
                base, raw = at, read_range(file, at, end - at + len(VERSION))
                headers = Headers(file, base, raw)
                out = []
                while at < end and (found := headers.find(at)):
                    content, n, _ = found
                    head = headers.fields(at, content)
                    if content + n <= base + len(raw):
                        payload = raw[content - base : content - base + n]
                    else:
                        payload = read_range(file, content, n)
                    sha = hashlib.sha256(payload).hexdigest()
                    kind = head[b"warc-type"].decode()
                    told = head.get(b"warc-payload-digest", b"").decode().removeprefix("sha256:")
                    url = head[b"warc-target-uri"].decode() if b"warc-target-uri" in head else None
                    own = kind != "revisit"
                    size_ = len(payload) if own else int(head[b"x-payload-length"])
                    intact = len(payload) == n and (not own or sha == told)
                    out.append((file, at, page_of(head.get(b"warc-record-id")), url, kind, size_, sha if own else told, page_of(head.get(b"warc-refers-to")), intact) + ((payload if own else None,) if with_payload else ()))
                    at = content + n + len(SEPARATOR)
                if out:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), KINDS, strict=False)], NAMES[: len(out[0])])

    return starts.mapInArrow(run, RECORD + (", payload binary" if with_payload else ""))


NAMES = [x.split()[0] for x in RECORD.split(", ")] + ["payload"]
KINDS = [{"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}[x.split()[1]] for x in RECORD.split(", ")] + [pa.binary()]


def read_pages(spark: SparkSession, path: str, size: int = BLOCK) -> DataFrame:
    """page_id string, url, html binary of every record; revisits get the payload of the response they refer to."""
    records = read_records(spark, path, size, with_payload=True)
    full = records.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), F.col("payload").alias("full")).dropDuplicates(["refers_to"])
    return records.join(full, "refers_to", "left").select("page_id", "url", F.coalesce("payload", "full").alias("html"))


def archive_report(pages: DataFrame, path: str | None = None) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to: written to archives, then read back from them."""
    spark = pages.sparkSession
    path = path or scratch(spark, "warc")
    write_archives(pages, path)
    kind = pages.schema["page_id"].dataType
    found = read_records(spark, path)
    return found.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


def oracle_sql() -> str:
    """DuckDB SQL for archive_report()."""
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages),
s AS (SELECT h, min(page_id) AS first FROM p WHERE payload_bytes >= {REVISIT_BYTES} GROUP BY h)
SELECT page_id, payload_bytes, sha256(p.h) AS payload_digest,
  CASE WHEN first IS NOT NULL AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN s USING (h)"""

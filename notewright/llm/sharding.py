"""Sharding: contiguous minimax partition of ordered atomic groups.

Equal texts form a group that no cut divides. Groups stand in the order of a 64-bit hash of
their text, except that groups larger than an even share of what is left come first and take a
shard each (there are fewer of them than shards). The smallest capacity at which a greedy walk
needs no more than the given number of shards is found by binary search, and the cuts are made
there.

The walk needs prefix sums of sizes, which would be as many as the texts. The driver holds them
for ranges of the hash only: 4,096 ranges first; the search is run once with ranges taken as
divisible (a lower bound of the capacity) and once as atomic (an upper bound). While the bounds
differ, the ranges in which a cut can fall are split in 64 by one small aggregation over the
groups. When they agree, the capacity is the exact optimum. The number of ranges held depends on
the number of shards alone. Groups are cut at that capacity, so that each shard but the last is as full as
it allows; where the last would be left with less than the smallest of cuts as near to even shares as the
ranges' edges and the capacity allow, these are taken instead. No shard exceeds the capacity either way.

Null and empty texts are one group of empty text; rows that repeat stay rows of their own. Two
different texts whose hashes agree would share a group, which keeps the law intact.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewright.llm.common import materialize, text_bytes

OVERHEAD = 16
FIRST_SHIFT, STEP = 52, 6


@dataclass(frozen=True)
class Span:
    """Groups whose hash >> shift is key: bytes, number and largest."""

    key: int
    shift: int
    bytes: int
    groups: int
    most: int

    @property
    def low(self) -> int:
        return self.key << self.shift


class Walk:
    """Greedy walks over ordered spans."""

    def __init__(self, spans: list[Span]):
        self.spans = sorted(spans, key=lambda s: s.low)
        self.ends, total = [], 0
        for s in self.spans:
            total += s.bytes
            self.ends.append(total)
        self.total = total
        self.most = max((s.most for s in self.spans), default=0)

    def cuts(self, capacity: int, shards: int, atomic: bool) -> tuple[list[int], bool]:
        """Where each shard but the last ends, in bytes; and whether all is placed.

        atomic: a span is never divided. Otherwise a span of several groups is cut anywhere.
        """
        at, out = 0, []
        for _ in range(shards):
            to = at + capacity
            if to >= self.total:
                out.append(self.total)
                at = self.total
                continue
            i = bisect_right(self.ends, to)  # the span that `to` falls into
            begin = self.ends[i - 1] if i else 0
            if atomic or self.spans[i].groups == 1:
                to = max(at, begin)
            at = to
            out.append(at)
        return out[:-1], at >= self.total

    def smallest(self, shards: int, atomic: bool) -> int:
        low = max(self.most, -(-self.total // shards))
        if atomic:
            low = max([low, *(s.bytes for s in self.spans)])
        high = max(low, self.total)
        while low < high:
            mid = (low + high) // 2
            if self.cuts(mid, shards, atomic)[1]:
                high = mid
            else:
                low = mid + 1
        return low

    def even_cuts(self, capacity: int, shards: int) -> list[int]:
        """Where each shard but the last ends, at edges of spans: as near to an even share of what is left as the capacity allows.

        latest[i] is the least end of shard i from which the rest still fits, walking back from the end.
        """
        edges = [0, *self.ends]
        latest = [self.total]
        for _ in range(shards - 1):
            latest.append(edges[bisect_left(edges, latest[-1] - capacity)])
        latest = latest[-1:0:-1]
        at, out = 0, []
        for i in range(shards - 1):
            even = at + (self.total - at) / (shards - i)
            k = min(bisect_left(edges, even), len(edges) - 1)
            best = edges[k] if k == 0 or edges[k] - even <= even - edges[k - 1] else edges[k - 1]
            most = edges[bisect_right(edges, at + capacity) - 1]
            at = max(at, min(max(best, latest[i]), most))
            out.append(at)
        return out

    def near(self, low: list[int], high: list[int]) -> list[Span]:
        """Spans of several groups that meet one of the ranges of bytes."""
        found: dict[int, Span] = {}
        for a, b in zip(low, high, strict=True):
            i = bisect_right(self.ends, a)
            while i < len(self.spans) and (self.ends[i - 1] if i else 0) <= b:
                if self.spans[i].groups > 1:
                    found[i] = self.spans[i]
                i += 1
        return list(found.values())


def _spans(groups: DataFrame, shift: int) -> list[Span]:
    key = F.shiftright("h", shift).alias("key")
    rows = groups.groupBy(key).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"), F.max("bytes").alias("most")).collect()
    return [Span(r["key"], shift, r["bytes"], r["n"], r["most"]) for r in rows]


def minimax(groups: DataFrame, shards: int) -> tuple[list[int], list[int], int]:
    """(hashes of groups with a shard of their own, first hash of each further shard but the first, capacity).

    groups: h long (unique), bytes long.
    """
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    alone: list[int] = []
    left = total
    for r in groups.orderBy(F.desc("bytes"), "h").limit(shards - 1).collect() if total else []:
        if r["bytes"] * (shards - len(alone)) <= left:
            break
        alone.append(r["h"])
        left -= r["bytes"]
    rest = groups.where(~F.col("h").isin(alone)) if alone else groups
    n = shards - len(alone)
    spans = _spans(rest, FIRST_SHIFT)
    if not spans:
        return alone, [], 0
    while True:
        walk = Walk(spans)
        low, high = walk.smallest(n, False), walk.smallest(n, True)
        if low == high:
            break
        fine = walk.near(walk.cuts(low, n, True)[0], walk.cuts(high, n, False)[0])
        shift = min(s.shift for s in spans)
        widest = [s for s in fine if s.shift == max(x.shift for x in fine)]
        shift = widest[0].shift
        finer = max(0, shift - STEP)
        keys = groups.sparkSession.createDataFrame([(s.key,) for s in widest], "k long")
        parts = _spans(rest.join(F.broadcast(keys), F.shiftright("h", shift) == F.col("k"), "left_semi"), finer)
        gone = set(widest)
        spans = [s for s in spans if s not in gone] + parts
    starts = []
    least = lambda cuts: min(b - a for a, b in zip([0, *cuts], [*cuts, walk.total], strict=True))
    for cut in max(walk.cuts(high, n, True)[0], walk.even_cuts(high, n), key=least):
        i = bisect_right(walk.ends, cut)
        if cut < walk.total:
            starts.append(walk.spans[i].low)
    return alone, starts, high


def _shard_number(groups: DataFrame, shards: int) -> Column:
    """The shard of a row, by the hash h of its text."""
    alone, starts, _ = minimax(groups, shards)
    number = F.lit(len(alone))
    for s in starts:
        number = number + (F.col("h") >= F.lit(s)).cast("int")
    for i, h in enumerate(alone):
        number = F.when(F.col("h") == F.lit(h), F.lit(i)).otherwise(number)
    return number.cast("int")


def _with_slots(placed: DataFrame, order: list[str]) -> DataFrame:
    """placed (with shard) and slot long: its place in its shard, in the given order, whose first column is shard."""
    dealt = materialize(placed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "shard-order")
    # How many rows stand before each task's first and each shard's first: a row a task and a shard.
    task = F.shiftright("at", 33)
    parts = sorted(dealt.groupBy(task.alias("task"), "shard").count().collect())
    before_task: dict[int, int] = {}
    before_shard: dict[int, int] = {}
    seen = 0
    for r in parts:
        before_task.setdefault(r["task"], seen)
        before_shard.setdefault(r["shard"], seen)
        seen += r["count"]
    spark = placed.sparkSession
    tasks = spark.createDataFrame([*before_task.items()], "task long, before_task long")
    firsts = spark.createDataFrame([*before_shard.items()], "shard int, before_shard long")
    slot = F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("before_task") - F.col("before_shard")
    return dealt.withColumn("task", task).join(F.broadcast(tasks), "task").join(F.broadcast(firsts), "shard").withColumn("slot", slot).select(*placed.columns, "slot")


def shard(docs: DataFrame, shards: int = 40, overhead: int = OVERHEAD) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, string, shard, slot, grown_shard.

    A document's size is the UTF-8 bytes of its text plus overhead. Slots count from 0 in each
    shard without gaps, in the order of the text's hash, then doc_id; a null doc_id comes first.
    An empty table gives an empty result; fewer groups than shards leave shards empty.
    """
    text = F.coalesce("text", F.lit(""))
    facts = materialize(
        docs.select("doc_id", (text_bytes(text) + F.lit(overhead)).alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("row")),
        "shard-facts",
    )
    groups = materialize(facts.groupBy("h").agg(F.sum("size").alias("bytes")), "shard-groups")
    placed = facts.withColumn("shard", _shard_number(groups, shards))
    return _with_slots(placed, ["shard", "h", "doc_id", "row"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def shard_documents(docs: DataFrame, shards: int = 40, overhead: int = OVERHEAD) -> DataFrame:
    """The documents with the columns they came with, in the order of shards and slots, and after these size, text_crc32, shard and slot.

    docs has none of these four names. Shards and slots are those of shard(); of rows that agree in text and
    doc_id, any may come first.
    """
    text = F.coalesce("text", F.lit(""))
    size = text_bytes(text) + F.lit(overhead)
    groups = materialize(docs.select(F.xxhash64(text).alias("h"), size.alias("bytes")).groupBy("h").agg(F.sum("bytes").alias("bytes")), "shard-groups")
    number = _shard_number(groups, shards)
    whole = docs.select(F.struct(*docs.columns).alias("doc"), "doc_id", size.alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("h"))
    placed = _with_slots(whole.withColumn("shard", number), ["shard", "h", "doc_id"])
    return placed.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns], "size", "text_crc32", "shard", "slot")

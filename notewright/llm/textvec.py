"""Words and word windows of Arrow text batches as numpy arrays.

A batch's texts lie back to back in one UTF-8 buffer, so words, their hashes and window hashes
come from a handful of vector operations over that buffer; no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes hashed at once; a longer word makes its piece longer.
PIECE = 1 << 19
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)

#: Bytes of the words [^\x20\x09-\x0D]+.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(which: str, n: int) -> np.ndarray:
    """BASE (up) or its inverse (down) to the powers 0 to n-1, modulo 2**64."""
    if len(_powers[which]) < n:
        steps = np.full(max(n, PIECE + 64), BASE if which == "up" else INVERSE, np.uint64)
        steps[0] = 1
        _powers[which] = np.multiply.accumulate(steps)
    return _powers[which][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a bijection on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offset of each text in them; null texts are empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


@dataclass
class Words:
    """Words of n texts in order. hash, start and end (bytes in the buffer) have one entry a word; off has n+1."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    off: np.ndarray

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.off) - 1), np.diff(self.off))


def words(buf: np.ndarray, off: np.ndarray, lower: bool = False, table: np.ndarray = NOT_SPACE) -> Words:
    """Maximal runs of bytes in table within each text. Equal words have equal 64-bit hashes."""
    hashes, starts, ends = [], [], []
    at, n = 0, len(buf)
    bounds = off[1:-1]
    while at < n:
        to = min(n, at + PIECE)
        while to < n and table[buf[to]] and table[buf[to - 1]]:  # don't cut a word
            step = np.flatnonzero(~table[buf[to : to + PIECE]])
            to = to + int(step[0]) if len(step) else min(n, to + PIECE)
        piece = buf[at:to]
        inside = table[piece]
        before = np.empty_like(inside)
        before[0], before[1:] = False, inside[:-1]
        cuts = bounds[np.searchsorted(bounds, at) : np.searchsorted(bounds, to)] - at
        before[cuts] = False
        first = np.flatnonzero(inside & ~before)
        after = np.empty_like(inside)
        after[-1], after[:-1] = False, inside[1:]
        after[cuts[cuts > 0] - 1] = False
        last = np.flatnonzero(inside & ~after) + 1
        if len(first):
            value = (LOWER[piece] if lower else piece).astype(np.uint64)
            value += np.uint64(1)
            value *= _power("up", len(piece))
            total = np.empty(len(piece) + 1, np.uint64)
            total[0] = 0
            np.cumsum(value, out=total[1:])
            h = (total[last] - total[first]) * _power("down", len(piece))[first]
            hashes.append(mix(h ^ (last - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
            starts.append(first + at)
            ends.append(last + at)
        at = to
    if not hashes:
        return Words(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64))
    start = np.concatenate(starts)
    return Words(np.concatenate(hashes), start, np.concatenate(ends), np.searchsorted(start, off))


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k words, by its first word; the caller masks runs that leave their text."""
    n = max(0, len(hashes) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out *= np.uint64(0x9FB21C651E98DF25)
        out += hashes[j : j + n]
    return mix(out)


def inside(off: np.ndarray, k: int) -> np.ndarray:
    """First words of the runs of k words that stay in their text."""
    sizes = np.maximum(np.diff(off) - k + 1, 0)
    if not sizes.sum():
        return np.zeros(0, np.int64)
    return np.repeat(off[:-1] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())


def code_points(buf: np.ndarray) -> np.ndarray:
    """Code points before each byte of buf, and at its end."""
    out = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=out[1:])
    return out


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that each holds at most `most` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        _, off = utf8(column)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to

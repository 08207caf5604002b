"""Quality rules: fixed word and line rules, then bands of tokeniser fertility.

Two public vocabularies measure each whole text:

* characters per token of a byte-level BPE for many languages: junk, shouting and symbol noise
  break into more tokens than the prose of its language, glued or encoded matter into fewer;
* entropy in bits of the text's own token distribution: looped and templated text is far below
  prose of its length, which limits the entropy of n tokens to log2(n);
* byte-fallback share: of the text's UTF-8 bytes, those in characters that a piece vocabulary
  with byte fallback has no piece for (it falls back character by character, so a text's distinct
  characters decide).

Bands belong to the language that the row names, else to the script most of its letters have.
One rule holds at every length: a band is wider by DOUBT tokens' worth, which a few odd words can make
of a short text and which vanishes in a long one. The whole text is measured. The bands of the four
languages and of LATIN are fitted to labelled texts; those of other scripts are estimates with no
labelled text behind them, wide on purpose.
"""

from __future__ import annotations

import base64
import importlib.util
import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewright.llm.common import bound_batches, tokenizer_dir
from notewright.llm.textvec import NOT_SPACE, inside, mix, slices, utf8, windows, words

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
PIECES = "piece_bpe_32k.model"
DOUBT = 20
SYMBOLS = b"#*$%&|<>"
REPEAT_WINDOW = 5


@dataclass(frozen=True)
class Band:
    """A text is rejected below min_chars or above max_chars characters per token, above max_fallback, each widened
    by the factor 1 + DOUBT / tokens, or below min(entropy, entropy_slope * log2(tokens)) bits."""

    min_chars: float
    max_chars: float = 8.0
    max_fallback: float = 0.10
    entropy: float = 6.0
    entropy_slope: float = 0.72


# The lower ends lie below every document labelled good, the entropy below all of them, in the labelled tables.
BANDS: dict[str, Band] = {
    "en": Band(2.25),
    "de": Band(2.30),
    "es": Band(2.10),
    "fr": Band(2.05),
    "LATIN": Band(1.90),
    "CYRILLIC": Band(1.20),
    "GREEK": Band(0.90),
    "ARABIC": Band(0.90),
    "HEBREW": Band(0.70),
    "CJK": Band(0.40, max_fallback=0.60),
    "HIRAGANA": Band(0.40, max_fallback=0.60),
    "HANGUL": Band(0.40, max_fallback=0.60),
    "DEVANAGARI": Band(0.60, max_fallback=0.60),
    "OTHER": Band(0.25, max_fallback=1.0, entropy=4.0),
}


@lru_cache(maxsize=4)
def encoder(folder: str):
    """The byte-level BPE of a folder of vocabularies."""
    import tiktoken

    spec = importlib.util.spec_from_file_location("notewright_vocabularies", f"{folder}/__init__.py")
    own = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(own)
    with open(f"{folder}/{VOCABULARY}", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("notewright", pat_str=own.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Fallback(dict):
    """Character to its UTF-8 bytes if the piece vocabulary spells it in bytes, else 0; filled as characters appear."""

    def __init__(self, folder: str):
        import sentencepiece

        self.pieces = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{PIECES}")
        super().__init__()

    def __missing__(self, char: str) -> int:
        ids = self.pieces.encode(char, num_threads=1)
        self[char] = len(char.encode()) if any(self.pieces.is_byte(i) for i in ids) else 0
        return self[char]


@lru_cache(maxsize=4)
def fallback(folder: str) -> Fallback:
    return Fallback(folder)


@lru_cache(maxsize=1 << 16)
def _script(char: str) -> str:
    name = unicodedata.name(char, "").split(" ")[0]
    return name if name in BANDS else "OTHER"


def script(text: str) -> str:
    """The script that most letters have; LATIN if there are none."""
    letters = Counter(text) if not text.isascii() else {}
    by: Counter[str] = Counter()
    for char, n in letters.items():
        if char.isalpha():
            by["LATIN" if char.isascii() else _script(char)] += n
    return by.most_common(1)[0][0] if by else "LATIN"


def fertility(text: str, folder: str) -> tuple[int, float, float, float]:
    """(tokens, characters per token, byte-fallback share, token entropy in bits) of a text."""
    ids = np.asarray(encoder(folder).encode_ordinary(text), np.int64)
    if not len(ids):
        return 0, 0.0, 0.0, 0.0
    ids.sort()
    edges = np.flatnonzero(np.diff(ids)) + 1
    counts = np.diff(np.concatenate(([0], edges, [len(ids)])))
    share = counts / len(ids)
    entropy = float(-(share * np.log2(share)).sum())
    lost = 0
    if not text.isascii():
        own = fallback(folder)
        odd = [c for c in set(text) if own[c]]
        lost = sum(text.count(c) * own[c] for c in odd)
    return len(ids), len(text) / len(ids), lost / len(text.encode()), entropy


def verdict(lang: str | None, text: str, measured: tuple[int, float, float, float], bands: dict[str, Band]) -> str:
    """"" for a text inside its band, else the measures outside it, joined by commas."""
    n, chars, lost, entropy = measured
    if not n:
        return ""
    wider = 1 + DOUBT / n
    band = bands.get(lang or "") or bands.get(script(text)) or bands["OTHER"]
    found = [
        ("chars_per_token", not band.min_chars / wider <= chars <= band.max_chars * wider),
        ("byte_fallback", lost > band.max_fallback * wider),
        ("entropy", entropy < min(band.entropy, band.entropy_slope * math.log2(n))),
    ]
    return ",".join(name for name, out in found if out)


def _sums(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


IS_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))


def base_measures(column: pa.Array) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text of a column."""
    buf, off = utf8(column)
    w = words(buf, off)
    n_words = np.diff(w.off)
    dup = np.zeros(len(column), np.int64)
    raw = buf.tobytes()
    for i in np.flatnonzero(n_words > 1):
        lines = raw[off[i] : off[i + 1]].split(b"\n")
        if len(lines) > 1:
            own = [x for x in lines if x and not x.isspace()]  # bytes.isspace(): \x20 and \x09-\x0D
            dup[i] = len(own) - len(set(own))
    repeat = np.zeros(len(column), np.int64)
    at = inside(w.off, REPEAT_WINDOW)
    if len(at):
        doc = w.doc()
        key = windows(w.hash, REPEAT_WINDOW)[at] ^ mix(doc[at].astype(np.uint64) + np.uint64(1))
        order = np.argsort(key)
        same = key[order[1:]] == key[order[:-1]]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        edges = np.zeros(len(w.hash) + 1, np.int64)
        hit = at[twice]
        np.add.at(edges, hit, 1)
        np.add.at(edges, hit + REPEAT_WINDOW, -1)
        repeat = np.bincount(doc, weights=np.cumsum(edges)[:-1] > 0, minlength=len(column)).astype(np.int64)
    return {
        "n_words": n_words,
        "word_chars": _sums(NOT_SPACE[buf] & ((buf & 0xC0) != 0x80), off),
        "n_symbols": _sums(IS_SYMBOL[buf], off),
        "n_dup_lines": dup,
        "n_repeat_words": repeat,
    }


COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_tokens long, chars_per_token double, byte_fallback double, token_entropy double, reasons string"


def measure(docs: DataFrame, keep: list[str] | None = None, bands: dict[str, Band] | None = None, folder: str | None = None) -> DataFrame:
    """The columns keep and, prefixed with __q_, those of COLUMNS; one row per document.

    docs needs text; lang, if there, picks the band. A null text has no words and fails the base
    rules, as an empty one does. Texts that fail the base rules aren't tokenised: their token
    measures are null.
    """
    keep = docs.columns if keep is None else keep
    bands, folder = bands or BANDS, folder or tokenizer_dir()
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    given = docs.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)], F.col("text").alias("__text"), lang.alias("__lang"))
    names = [x.split()[0] for x in COLUMNS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            base = base_measures(batch.column("__text"))
            failed = (base["n_words"] < 10) | (100 * base["n_repeat_words"] > 20 * base["n_words"])
            measured: list = []
            for bad, text, language in zip(failed, batch.column("__text"), batch.column("__lang"), strict=True):
                if bad:
                    measured.append((None, None, None, None, "base"))
                else:
                    t = text.as_py()
                    m = fertility(t, folder)
                    measured.append((*m, verdict(language.as_py(), t, m, bands)))
            reasons = [m[4] for m in measured]
            out = [*(pa.array(v, pa.int64()) for v in base.values()), pa.array(failed), pa.array([not r for r in reasons])]
            out += [pa.array([m[i] for m in measured], kind) for i, kind in enumerate((pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.string()))]
            yield pa.record_batch([*(batch.column(i) for i in range(len(keep))), *out], [*(f"__k{i}" for i in range(len(keep))), *(f"__q_{n}" for n in names)])

    kinds = [f"__k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)] + [f"__q_{x}" for x in COLUMNS.split(", ")]
    found = bound_batches(given).mapInArrow(run, ", ".join(kinds))
    return found.select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)], *[f"__q_{n}" for n in names])


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The documents that pass, with the columns they came with."""
    return measure(docs, **options).where("__q_kept").select(*docs.columns)


def report(docs: DataFrame, **options) -> DataFrame:
    """doc_id and the measures, without prefix."""
    found = measure(docs, ["doc_id"], **options)
    return found.select("doc_id", *[F.col(c).alias(c.removeprefix("__q_")) for c in found.columns[1:]])

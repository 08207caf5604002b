"""Rows made from texts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notewright.functions import text as text_functions

TOKENS_PER_WORD = 1.3
CHUNK_TOKENS, OVERLAP = 300, 0.5
WINDOW = int(CHUNK_TOKENS / TOKENS_PER_WORD)
STEP = max(1, int(WINDOW * (1 - OVERLAP)))


def segments(docs: DataFrame) -> DataFrame:
    """doc_id, kind (quoted or body), char_start, char_end, text, boilerplate_score, casing_regime, case_informative.

    Lines that open with > are quoted; runs of lines of one kind are segments, which tile the text.
    """
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"), F.size(F.split("text", "\n")).alias("lines"))
    lines = lines.withColumn("line", F.when(F.col("n") < F.col("lines") - 1, F.concat("line", F.lit("\n"))).otherwise(F.col("line"))).where("line <> ''")
    w = Window.partitionBy("doc_id").orderBy("n")
    kind = F.when(F.col("line").rlike(r"^[ \t]*>+"), "quoted").otherwise("body")
    marked = lines.withColumn("kind", kind).withColumn("end", F.sum(F.length("line")).over(w)).withColumn("new", F.when(F.lag("kind").over(w) == F.col("kind"), 0).otherwise(1))
    runs = marked.withColumn("run", F.sum("new").over(w)).groupBy("doc_id", "run", "kind").agg(F.min(F.col("end") - F.length("line")).alias("char_start"), F.max("end").alias("char_end"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "").alias("text"))
    cased = runs.withColumn("c", text_functions.casing(F.col("text")))
    return cased.select("doc_id", "kind", "char_start", "char_end", "text", text_functions.boilerplate_score(F.col("text")).alias("boilerplate_score"), F.col("c.regime").alias("casing_regime"), F.col("c.case_informative").cast("int").alias("case_informative"))


def chunks(docs: DataFrame, window: int = WINDOW, step: int = STEP) -> DataFrame:
    """doc_id, index, chunk_id, char_start, char_end, n_words, est_tokens, text: windows of words, each step words on.

    Chunks cover the text: the first starts at 0 and the last ends with it. A text without words is one chunk.
    """
    # Every token is a word with the white space before it, so a prefix of tokens is a prefix of the text.
    tokens = r"regexp_extract_all(text, '[ \\t\\n\\r\\f]*[^ \\t\\n\\r\\f]+', 0)"
    base = docs.select("doc_id", "text", F.expr(f"transform(array({tokens}), t -> named_struct('t', t, 'n', size(t)))[0]").alias("w"))
    n = F.col("w.n")
    count = F.when(n <= window, 1).otherwise(1 + F.ceil((n - window) / step))
    each = base.withColumn("index", F.explode(F.sequence(F.lit(0), (count - 1).cast("int")))).withColumn("i", F.col("index") * step).withColumn("j", F.least(F.col("i") + window, n))
    prefix = lambda k: F.length(F.array_join(F.slice("w.t", F.lit(1), k), ""))
    lead = F.length(F.regexp_extract(F.coalesce(F.get("w.t", F.col("i")), F.lit("")), r"^([ \t\n\r\f]*)", 1))
    placed = each.withColumn("char_start", F.when(F.col("index") == 0, 0).otherwise(prefix(F.col("i")) + lead)).withColumn("char_end", F.when(F.col("j") >= n, F.length("text")).otherwise(prefix(F.col("j"))))
    return placed.select(
        "doc_id",
        "index",
        F.format_string("%s_c%03d", F.col("doc_id").cast("string"), "index").alias("chunk_id"),
        "char_start",
        "char_end",
        (F.col("j") - F.col("i")).alias("n_words"),
        F.round((F.col("j") - F.col("i")) * TOKENS_PER_WORD, 1).alias("est_tokens"),
        F.substring("text", F.col("char_start") + 1, F.col("char_end") - F.col("char_start")).alias("text"),
    )


def shingles(docs: DataFrame, k: int = 5, pattern: str = "[^a-z0-9À-ÿ]+") -> DataFrame:
    """C14: doc_id and each distinct shingle of k lower-case words; a text of fewer words is one shingle."""
    words = docs.select("doc_id", F.filter(F.split(F.lower("text"), pattern), lambda w: w != "").alias("ws"))
    whole = f"""if(size(ws) = 0, array(), if(size(ws) < {k}, array(array_join(ws, ' ')),
      transform(sequence(1, size(ws) - {k - 1}), i -> array_join(slice(ws, i, {k}), ' '))))"""
    return words.select("doc_id", F.explode(F.array_distinct(F.expr(whole))).alias("shingle"))


ALLEGATION = r"(?i)(suspect[^.;\n]*|alleg[^.;\n]*)"


def allegations(docs: DataFrame) -> DataFrame:
    """doc_id, n (from 0), clause: what follows "suspect" or "alleg" up to the clause's end."""
    return docs.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(ALLEGATION), F.lit(1))).alias("n", "clause"))


def split_text(text: str, size: int) -> list[tuple[int, int]]:
    """Spans of parts of about size characters, cut behind a paragraph's end, else a sentence's, else anywhere."""
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + size)
        if end < len(text):
            for mark in ("\n\n", "\n", ". ", " "):
                cut = text.rfind(mark, at + size // 2, end)
                if cut >= 0:
                    end = cut + len(mark)
                    break
        out.append((at, end))
        at = end
    return out


def parts(docs: DataFrame, size: int = 4000) -> DataFrame:
    """doc_id, part, char_start, char_end."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(d, i, a, b) for d, t in zip(f["doc_id"], f["text"], strict=True) for i, (a, b) in enumerate(split_text(t or "", size))]
            yield pd.DataFrame(rows, columns=["doc_id", "part", "char_start", "char_end"])

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, part int, char_start int, char_end int")


def token_offsets(docs: DataFrame) -> DataFrame:
    """C17: doc_id, n, start, end of each run of characters that are not white space."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(d, i, *m.span()) for d, t in zip(f["doc_id"], f["text"], strict=True) for i, m in enumerate(re.finditer(r"\S+", t or ""))]
            yield pd.DataFrame(rows, columns=["doc_id", "n", "start", "end"])

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, n int, start int, end int")

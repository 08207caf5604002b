"""Helpers that several training-data operators share: shared storage, sizes, row keys."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewright.storage import drop_scratch, materialize, scratch, shared_dir

__all__ = ["bound_batches", "document_key", "drop_scratch", "lower_ascii", "materialize", "read_range", "scratch", "shared_dir", "text_bytes", "tokenizer_dir"]


#: Bytes of an Arrow batch on its way to a Python worker; Spark's own 64 MB, twice in the JVM and twice in Python, is too much for texts.
BATCH = "4m"
BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(df: DataFrame) -> DataFrame:
    """df, in a session whose Arrow batches are bounded by BATCH, unless the session has set a bound of its own."""
    conf = df.sparkSession.conf
    if BATCH_KEY not in conf.getAll:
        conf.set(BATCH_KEY, BATCH)
    return df


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text; null counts none."""
    return F.coalesce(F.octet_length(text).cast("long"), F.lit(0).cast("long"))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only, as contracts ask; other letters stay."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def document_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Two longs that name a document row by its content: 128 bits over id and text."""
    return [F.xxhash64(F.lit(s), F.col(doc_id), F.col(text)).alias(n) for s, n in ((11, "__d1"), (23, "__d2"))]


def local_path(uri: str) -> str | None:
    """The path of a file: URI or plain path; None for stores that only Spark or pyarrow reach."""
    if uri.startswith("file:"):
        return "/" + uri.removeprefix("file:").lstrip("/")
    return uri if uri.startswith("/") else None


def read_range(uri: str, start: int, length: int) -> bytes:
    """length bytes of a file from start; short at the end of the file."""
    if path := local_path(uri):
        with open(path, "rb", buffering=0) as f:
            f.seek(start)
            return f.read(length)
    import pyarrow.fs as pafs

    fs, path = pafs.FileSystem.from_uri(uri)
    with fs.open_input_file(path) as f:
        return f.read_at(max(0, min(length, f.size() - start)), start)


def tokenizer_dir() -> str:
    """Where the public vocabulary files lie; NOTEWRIGHT_TOKENIZERS overrides it."""
    return os.environ.get("NOTEWRIGHT_TOKENIZERS", "/opt/tokenizers")

from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, node long, n_words string, kind string"


@pytest.fixture(scope="session")
def documents(spark):
    """Documents with columns whose names clash with those that operators use."""

    def make(rows):
        full = [(i, t, "en", s, None if t is None else len(t), "own", 7, "many", "odd") for i, t, s in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(3)

    return make


@pytest.fixture(scope="session")
def rows():
    return lambda df, *names: sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)

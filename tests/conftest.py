from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    """Run SQL over the tables of a folder, as the driver does."""
    import duckdb

    def run(sf_dir: str, sql: str):
        con = duckdb.connect()
        for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
            con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
        done = con.execute(sql)
        return [d[0] for d in done.description], done.fetchall()

    return run

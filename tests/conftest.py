"""One local session for all tests, and a DuckDB harness like the driver's."""

from __future__ import annotations

import os
import sys
from decimal import Decimal

import pandas as pd
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
from table_paths import MIDDLE  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    def at(sf_dir: str):
        c = duckdb.connect()
        for t in TABLES:
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        return c

    return at


def plain(df: pd.DataFrame) -> list[tuple]:
    """Rows with columns by name, in an order of their own, nulls as None and decimals as numbers."""

    def one(v):
        if isinstance(v, Decimal):
            return float(v)
        if v is None or (not isinstance(v, (str, list, tuple, dict, bytes)) and not hasattr(v, "__len__") and pd.isna(v)):
            return None
        return v.item() if hasattr(v, "item") and not hasattr(v, "__len__") else v

    return sorted([tuple(one(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False)], key=repr)


@pytest.fixture(scope="session")
def same(spark, duck):
    """Checks a query against its SQL at one size and returns the number of rows."""

    def run(query, sql: str, sf_dir: str = MIDDLE) -> int:
        got, want = query(spark, sf_dir).toPandas(), duck(sf_dir).execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert plain(got) == plain(want)
        return len(got)

    return run

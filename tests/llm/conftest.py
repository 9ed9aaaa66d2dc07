"""Small documents with every edge case that the operators define."""

from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, fp long, row string"


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in any column, empty and white-space texts, repeated rows, ties, and columns whose names clash."""
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))
    rows = [
        (1, None, None, None, None, 9, 9, "r"),
        (2, "", "en", "s", 0, None, None, None),
        (3, " \t\n ", "en", "s", 4, 1, 1, "x"),
        (4, "a b c", "en", "t", 5, 1, 1, "x"),
        (4, "a b c", "en", "t", 5, 1, 1, "x"),
        (None, "a b c", "en", "t", 5, 1, 1, "x"),
        (None, None, None, None, None, None, None, None),
        (7, long, "en", "s", len(long), 0, 0, ""),
        (8, "É\x00 <|endoftext|>   ΑΣ ½ 🙂 mail a.b1@x.org +1 (415) 555-0123", "fr", "u", 1, 1, 1, "x"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def texts():
    import pandas as pd
    from table_paths import SMALL

    return pd.read_parquet(f"{SMALL}/documents.parquet")

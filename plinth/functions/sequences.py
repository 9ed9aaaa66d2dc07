"""Longest common subsequences of token arrays (C17-C19), as Arrow-batched functions.

No built-in expresses them; each call handles one pair, and memory is that of the pair.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F


def _rows(a: list, b: list):
    """For each prefix of ``a``, a number whose zero bits mark where the length grows along ``b``."""
    where: dict = {}
    for j, t in enumerate(b):
        where[t] = where.get(t, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    yield row
    for t in a:
        hit = row & where.get(t, 0)
        row = (row + hit | row - hit) & full
        yield row


def lcs_length(a: list, b: list) -> int:
    """Length by a row of bits for each token of ``a``: len(a) times len(b) / 64 steps, and two rows of memory."""
    for row in _rows(a, b):  # noqa: B007
        pass
    return len(b) - row.bit_count()


def lcs_pairs(a: list, b: list) -> list[tuple[int, int]]:
    """Index pairs of one alignment; where two are as long, the first sequence is shortened first.

    All rows are kept, at a bit a cell: 20,000 tokens on either side take 50 MB.
    """
    rows = list(_rows(a, b))
    out, i, j = [], len(a), len(b)
    while i and j:
        if a[i - 1] == b[j - 1]:
            out.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        else:
            low = (1 << j) - 1
            if (rows[i - 1] & low).bit_count() == (rows[i] & low).bit_count():  # as long without a's last
                i -= 1
            else:
                j -= 1
    return out[::-1]


def lcs_len(a, b):
    """Column of LCS lengths of two array columns; null counts as empty."""

    @F.pandas_udf("long")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([lcs_length(list(p) if p is not None else [], list(q) if q is not None else []) for p, q in zip(x, y, strict=True)])

    return run(a, b)


def dice_lcs(a, b):
    """Twice the LCS length over the sum of lengths; 0 if both are empty."""
    count = lambda c: F.when(c.isNull(), 0).otherwise(F.size(c))
    total = count(a) + count(b)
    return F.when(total == 0, F.lit(0.0)).otherwise(2.0 * lcs_len(a, b) / total)


def lcs_align(a, b):
    """Column of aligned index pairs."""

    @F.pandas_udf("array<struct<a:int,b:int>>")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([[{"a": i, "b": j} for i, j in lcs_pairs(list(p) if p is not None else [], list(q) if q is not None else [])] for p, q in zip(x, y, strict=True)])

    return run(a, b)

"""Metric operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def halstead(df: DataFrame, keys: list[str], tokens: str, is_operator) -> DataFrame:
    """``keys, n1, n2, total1, total2, volume, difficulty`` of each row's array of tokens (A6); both figures with two decimals.

    ``is_operator`` maps a token to a condition. Rows without a token are left out. A
    row's tokens are told apart within the row, so nothing is shuffled.
    """
    split = df.where(F.size(tokens) > 0).select(*keys, F.filter(tokens, is_operator).alias("ops"), F.filter(tokens, lambda t: ~is_operator(t)).alias("rest"))
    n = lambda c: F.size(c).cast("long")
    agg = split.select(*keys, n(F.array_distinct("ops")).alias("n1"), n(F.array_distinct("rest")).alias("n2"), n("ops").alias("total1"), n("rest").alias("total2"))
    words, size = F.col("n1") + F.col("n2"), F.col("total1") + F.col("total2")
    volume = F.when(words > 0, size * F.log2(words.cast("double"))).otherwise(0.0)
    # n1 / 2 * total2 / n2 in hundredths, half up, in whole numbers: ties do not hang on a quotient's last bit.
    hundredths = F.expr("(100 * n1 * total2 + n2) div (2 * greatest(n2, 1))")
    difficulty = F.when(F.col("n2") > 0, hundredths.cast("decimal(20,0)") / 100).otherwise(0)
    two = lambda c: F.round(c, 2).cast("decimal(18,2)")
    return agg.withColumn("volume", two(volume)).withColumn("difficulty", two(difficulty))


def nesting(marks: DataFrame, keys: list[str], order: str, opens: Column, closes: Column) -> DataFrame:
    """Greatest running sum of opens less closes of each key."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(opens, 1).when(closes, -1).otherwise(0)
    return marks.withColumn("__d", F.sum(step).over(w)).groupBy(*keys).agg(F.max("__d").cast("long").alias("max_depth"), F.count("*").alias("n_marks"))


def line_count(text: Column) -> Column:
    """Lines by any of CRLF, LF, CR, U+2028 and U+2029, one more if the last is not ended; empty text has none (X11)."""
    ends = F.regexp_count(text, F.lit("\r\n|[\n\r\u2028\u2029]"))
    open_end = ~text.rlike("[\n\r\u2028\u2029]\\z")
    return F.when(F.length(text) == 0, 0).otherwise(ends + open_end.cast("int")).cast("long")


def oversized(df: DataFrame, text: str, most: int, path: str | None = None, exclude: list[str] = ()) -> DataFrame:
    """Rows of more than ``most`` lines, but for those whose ``path`` fits an excluded pattern."""
    out = df.withColumn("n_lines", line_count(F.col(text))).where(F.col("n_lines") > most)
    for pattern in exclude:
        out = out.where(~F.col(path).rlike(pattern))
    return out


def reduction_score(df: DataFrame, key: str, depth: Column, size: Column, kind: str, order: list[str]) -> DataFrame:
    """Sum of depth times size of each key and the kind of its best part, the first of equals."""
    scored = df.withColumn("__s", depth * size)
    return scored.groupBy(key).agg(F.sum("__s").alias("score"), F.min_by(kind, F.struct((-F.col("__s")).alias("s"), *order)).alias("primary_kind"))

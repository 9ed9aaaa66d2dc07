"""Operator 5: token counts by an exact length histogram.

Documents are reduced to their encoded lengths and aggregated by length, which
is the only shuffle and moves one row a task and length. Prefix and suffix sums
over the histogram then answer totals, quantiles and truncated totals for every
context limit. The sums are built in two levels (blocks of lengths, then lengths
of a block), so no task has to hold all lengths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plinth.llm.common import documents, map_texts, written
from plinth.llm.wordbpe import default_vocabulary, library

BLOCK = 2048


def token_lengths(docs: DataFrame, vocabulary: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``n_tokens`` of each row; null and empty texts count 0."""

    def kernel(texts: list) -> dict[str, list]:
        return {"n_tokens": [len(x) // 4 for x in library(vocabulary).encode_all(texts)]}

    return map_texts(docs, kernel, "n_tokens long", text, keep)


def length_histogram(lengths: DataFrame, length: str = "n_tokens") -> DataFrame:
    """One row for each length that occurs, with exact running sums on both sides.

    Columns: ``n_tokens``, ``n_docs`` (documents of that length), ``docs_up_to`` and
    ``tokens_up_to`` (of that length or shorter), ``docs_from`` and ``tokens_from``
    (that length or longer), ``truncated_total`` (tokens left when each document is
    cut to that length), ``total_docs`` and ``total_tokens``. Null lengths are not
    counted; an empty table gives no rows; ties share a row.
    """
    n = F.col("n_tokens")
    counts = lengths.select(F.col(length).cast("long").alias("n_tokens")).where(n.isNotNull()).groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))
    counts = written(counts, "lengths")  # read twice below; without it the texts would be encoded twice
    counts = counts.withColumn("block", F.floor(n / BLOCK).cast("long")).withColumn("tokens", n * F.col("n_docs"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    zero = lambda c: F.coalesce(c, F.lit(0))
    blocks = (
        counts.groupBy("block")
        .agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
        .select("block", zero(F.sum("d").over(before)).alias("docs_before"), zero(F.sum("t").over(before)).alias("tokens_before"), F.sum("d").over(whole).alias("total_docs"), F.sum("t").over(whole).alias("total_tokens"))
    )
    inside = Window.partitionBy("block").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    summed = (
        counts.join(blocks, "block")
        .withColumn("docs_up_to", F.col("docs_before") + F.sum("n_docs").over(inside))
        .withColumn("tokens_up_to", F.col("tokens_before") + F.sum("tokens").over(inside))
        .withColumn("docs_from", F.col("total_docs") - F.col("docs_up_to") + F.col("n_docs"))
        .withColumn("tokens_from", F.col("total_tokens") - F.col("tokens_up_to") + F.col("tokens"))
    )
    return summed.select(
        "n_tokens", "n_docs", "docs_up_to", "tokens_up_to", "docs_from", "tokens_from",
        (F.col("total_tokens") - F.col("tokens_from") + n * F.col("docs_from")).alias("truncated_total"), "total_docs", "total_tokens",
    )


def truncated_total(histogram: DataFrame, limit: int) -> Column | int:
    """Tokens left over all documents when each is cut to ``limit``, for any limit, from the histogram alone."""
    row = histogram.where(F.col("n_tokens") < limit).agg(F.sum(F.col("n_tokens") * F.col("n_docs")).alias("t"), F.sum("n_docs").alias("d")).first()
    total = histogram.agg(F.max("total_docs")).first()[0] or 0
    return (row["t"] or 0) + limit * (total - (row["d"] or 0))


def quantile(histogram: DataFrame, q: float) -> int | None:
    """Smallest length that at least the share ``q`` of the documents do not exceed; null for no documents."""
    return histogram.where(F.col("docs_up_to") >= F.ceil(F.lit(q) * F.col("total_docs"))).agg(F.min("n_tokens")).first()[0]


def op5_token_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact histogram of the encoded lengths of all documents, with sums for every context limit."""
    return length_histogram(token_lengths(documents(spark, sf_dir, "doc_id", "text"), default_vocabulary()))

"""Queries over token sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plinth.functions.sequences import dice_lcs, lcs_len
from plinth.plans.helpers import table
from plinth.plans.registry import query


@query()
def lcs_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LCS length and similarity of consecutive turns' words (C17, C18); SQL does not express it, tests hold it to brute force."""
    conv = table(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    w = Window.partitionBy("conv_id").orderBy("turn")
    pairs = conv.withColumn("next", F.lead("text").over(w)).where("next is not null")
    words = pairs.select("conv_id", "turn", F.split(F.lower("text"), r"\s+").alias("a"), F.split(F.lower("next"), r"\s+").alias("b"))
    return words.select("conv_id", "turn", lcs_len(F.col("a"), F.col("b")).alias("lcs"), F.round(dice_lcs(F.col("a"), F.col("b")), 6).alias("similarity"))

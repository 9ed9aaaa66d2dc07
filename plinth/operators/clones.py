"""Clone operators: grouping by fingerprint, tiers, common runs, representatives."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def clone_groups(df: DataFrame, fp: str, member: str, least: int = 2) -> DataFrame:
    """``fp, n_members, first_member`` of fingerprints with ``least`` members or more; null fingerprints group nothing (A1)."""
    return df.where(F.col(fp).isNotNull()).groupBy(fp).agg(F.count(F.lit(1)).alias("n_members"), F.min(member).alias("first_member")).where(F.col("n_members") >= least)


def tier_exclusion(df: DataFrame, exact: str, loose: str, member: str) -> DataFrame:
    """Groups by ``loose`` to which no group by ``exact`` gives its representative."""
    reps = df.groupBy(exact).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col(member), F.col(loose))).alias("r")).where("n > 1").select(F.col(f"r.{loose}").alias(loose)).distinct()
    return clone_groups(df, loose, member).join(reps, loose, "left_anti")


def _grams(df: DataFrame, seq: str, pos: str, fp: str, least: int) -> DataFrame:
    """``seq, pos, fp``: every stretch of ``least`` consecutive fingerprints, none of them null, by where it starts."""
    own = Window.partitionBy(seq).orderBy(pos)
    whole = [F.lead(pos, k).over(own) == F.col(pos) + k for k in range(1, least)]
    gram = F.array(F.col(fp), *(F.lead(fp, k).over(own) for k in range(1, least)))
    grams = df.select(F.col(seq).alias("seq"), F.col(pos).alias("pos"), gram.alias("fp"), reduce(and_, whole, F.lit(True)).alias("whole"))
    return grams.where("whole").drop("whole").where(F.forall("fp", lambda x: x.isNotNull()))


def common_runs(df: DataFrame, seq: str, pos: str, fp: str, least: int) -> DataFrame:
    """Maximal runs of equal fingerprints at consecutive positions of two sequences.

    All common runs of ``least`` or more are found, for all pairs of sequences: rows
    grow with the square of the sequences that share a run, so this is for tables
    where few do; :func:`runs_from_first` has no such growth. Seeds are ``least``
    consecutive fingerprints. Positions are distinct in a sequence. Runs are islands
    on the diagonals of the position grid.
    """
    seeds = _grams(df, seq, pos, fp, least)
    a, b = (seeds.select("fp", F.col("seq").alias(f"seq_{x}"), F.col("pos").alias(f"pos_{x}")) for x in "ab")
    met = a.join(b, "fp").where("seq_a < seq_b").withColumn("diagonal", F.col("pos_a") - F.col("pos_b"))
    island = F.col("pos_a") - F.row_number().over(Window.partitionBy("seq_a", "seq_b", "diagonal").orderBy("pos_a"))
    runs = met.withColumn("island", island).groupBy("seq_a", "seq_b", "diagonal", "island")
    return runs.agg(F.min("pos_a").alias("start_a"), F.min("pos_b").alias("start_b"), (F.count(F.lit(1)) + least - 1).alias("n")).drop("diagonal", "island")


def runs_from_first(df: DataFrame, seq: str, pos: str, fp: str, least: int) -> DataFrame:
    """``seq, start, first_seq, first_start, n``: common runs, each against the first place that has it.

    A stretch of ``least`` fingerprints belongs to the smallest sequence that has it, at
    its smallest position there; stretches that follow one another in both are one
    run. Every stretch that two sequences share lies in a run of all of them but the
    first, so sequences share it exactly if their runs meet there: what is shared is
    known in full, in rows that grow with the stretches and not with their pairs.
    A stretch's first place is one row a stretch, so Spark can split a hot one.
    """
    grams = _grams(df, seq, pos, fp, least)
    first = grams.groupBy("fp").agg(F.min(F.struct("seq", "pos")).alias("o"), F.max("seq").alias("last")).where("o.seq <> last").select("fp", F.col("o.seq").alias("first_seq"), F.col("o.pos").alias("first_pos"))
    met = grams.join(first, "fp").where("seq <> first_seq").withColumn("diagonal", F.col("first_pos") - F.col("pos"))
    island = F.col("pos") - F.row_number().over(Window.partitionBy("seq", "first_seq", "diagonal").orderBy("pos"))
    runs = met.withColumn("island", island).groupBy("seq", "first_seq", "diagonal", "island")
    return runs.agg(F.min("pos").alias("start"), F.min("first_pos").alias("first_start"), (F.count(F.lit(1)) + least - 1).alias("n")).drop("diagonal", "island")


def representative(df: DataFrame, key: str, member: str, size: str) -> DataFrame:
    """For each key the member whose size is nearest the upper median, the first of equals.

    Sizes are counted before they are ranked, so a key is not gathered row by row.
    """
    sizes = df.groupBy(key, size).agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(key).orderBy(size).rowsBetween(Window.unboundedPreceding, 0)
    upto = sizes.withColumn("upto", F.sum("__n").over(w)).withColumn("total", F.sum("__n").over(Window.partitionBy(key)))
    median = upto.where(F.col("upto") > F.floor(F.col("total") / 2)).groupBy(key).agg(F.min(size).cast("long").alias("median_size"))
    near = df.join(median, key).groupBy(key, "median_size").agg(F.min(F.struct(F.abs(F.col(size) - F.col("median_size")).alias("off"), F.col(member), F.col(size))).alias("m"))
    return near.select(key, F.col(f"m.{member}").alias(member), F.col(f"m.{size}").alias(size), "median_size")

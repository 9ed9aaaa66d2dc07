"""Operators over ordered rows: neighbours, runs, definitions and uses, live ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.operators.tables import written


def global_lead(df: DataFrame, order: list[str], value: str, out: str, partitions: int | None = None) -> DataFrame:
    """``value`` of the next row in one order over the whole table, without bringing it to one task.

    Rows are ranged over partitions; the last row of each takes its neighbour from a
    table with one row a partition. ``order`` must be a total order; nulls come first.
    """
    n = partitions or df.sparkSession.sparkContext.defaultParallelism
    ranged = written(df.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()), "ranged")
    inside = Window.partitionBy("__part").orderBy(*order)
    firsts = ranged.groupBy("__part").agg(F.min_by(value, F.struct(*order)).alias("__first"))
    nexts = firsts.select("__part", F.lead("__first").over(Window.orderBy("__part")).alias("__next"))
    led = ranged.withColumn("__last", F.lead(F.lit(1)).over(inside).isNull()).withColumn("__lead", F.lead(value).over(inside))
    joined = led.join(F.broadcast(nexts), "__part")
    return joined.withColumn(out, F.when(F.col("__last"), F.col("__next")).otherwise(F.col("__lead"))).drop("__part", "__last", "__lead", "__next")


def reaching_definition(df: DataFrame, keys: list[str], order: list[str], is_def: Column, def_id: str, out: str) -> DataFrame:
    """The last definition before each row of its key on a straight line."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.last(F.when(is_def, F.col(def_id)), ignorenulls=True).over(w))


def definition_uses(df: DataFrame, keys: list[str], order: list[str], is_def: Column, is_use: Column, def_id: str) -> DataFrame:
    """Each definition with its uses before the next one: ``n_uses``, ``overwritten``."""
    reached = reaching_definition(df, keys, order, is_def, def_id, "__def")
    uses = reached.where(is_use & F.col("__def").isNotNull()).groupBy(*keys, "__def").agg(F.count(F.lit(1)).alias("n_uses"))
    w = Window.partitionBy(*keys).orderBy(*order)
    defs = df.where(is_def).withColumn("overwritten", F.lead(F.lit(True)).over(w).isNotNull()).select(*keys, F.col(def_id).alias("__def"), "overwritten")
    joined = defs.join(uses, [*keys, "__def"], "left")
    return joined.select(*keys, F.col("__def").alias(def_id), F.coalesce("n_uses", F.lit(0)).cast("long").alias("n_uses"), "overwritten")


def run_lengths(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Maximal runs of equal ``value`` in each key's order: ``run``, ``value``, ``n``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    change = (~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)).cast("long")
    marked = df.withColumn("__change", change).withColumn("run", F.sum("__change").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "run").agg(F.first(value).alias(value), F.count(F.lit(1)).alias("n"))


def trailing_run(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Length of the run that ends each key's rows."""
    back = [F.col(c).desc() for c in order]
    w = Window.partitionBy(*keys).orderBy(*back)
    last = F.first(value).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    broken = F.sum((~F.col(value).eqNullSafe(last)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    marked = df.withColumn("__value", last).withColumn("__broken", broken)
    return marked.where("__broken = 0").groupBy(*keys, F.col("__value").alias(value)).agg(F.count(F.lit(1)).alias("n"))


def live_pressure(spans: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Most spans that are live at once for each key, and the first position where (A9, F12); ends are inclusive."""
    moves = spans.select(*keys, F.explode(F.array(F.struct(F.col(start).alias("at"), F.lit(0).alias("kind"), F.lit(1).alias("d")), F.struct(F.col(end).alias("at"), F.lit(1).alias("kind"), F.lit(-1).alias("d")))).alias("m")).select(*keys, "m.*")
    w = Window.partitionBy(*keys).orderBy("at", "kind").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    w = Window.partitionBy(*keys).orderBy(F.struct("at", "kind")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    live = moves.withColumn("live", F.sum("d").over(w)).where("kind = 0")
    best = F.max_by("at", F.struct("live", "at"))
    return live.groupBy(*keys).agg(F.max("live").cast("long").alias("max_live"), F.min(F.struct((-F.col("live")).alias("n"), F.col("at"))).alias("__m"), best.alias("__last")).select(*keys, "max_live", F.col("__m.at").alias("first_at"))


def ordered_violations(df: DataFrame, keys: list[str], order: list[str], rank: Column) -> DataFrame:
    """Rows whose rank is below the greatest before them."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("__rank", rank).withColumn("before", F.max("__rank").over(w)).where(F.col("__rank") < F.col("before")).withColumnRenamed("__rank", "rank")


def neighbour_rules(df: DataFrame, keys: list[str], order: list[str], kind: str, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rows whose (previous, this) kinds meet the first rule that fits and whose verdict is ``always`` (L3); ``*`` fits any."""
    w = Window.partitionBy(*keys).orderBy(*order)
    prev = F.lag(kind).over(w)
    verdict = F.lit(None).cast("string")
    for a, b, v in reversed(rules):
        verdict = F.when((F.lit(a == "*") | (F.col("prev") == a)) & (F.lit(b == "*") | (F.col(kind) == b)), F.lit(v)).otherwise(verdict)
    return df.withColumn("prev", prev).where("prev is not null").withColumn("verdict", verdict).where("verdict = 'always'")

"""Operator 8: mixing sources to target weights, with DataFrame and SQL functions only.

Method: multivariate-hypergeometric splitting tree.

1. Documents of a source fall into blocks by a hash, which is a random permutation
   of the source cut into parts; no block holds more than its share, however large
   its source is.
2. Targets are shares of all words by weight, stopped at a multiple of the source's
   words, the excess reshared. A source is taken whole as often as it fits into its
   target, then block by block; inside the last block, documents in hash order as far
   as they fit, and one document whose size is nearest to what is missing. The quota of a source is thus an exact number of block draws.
3. The tree halves the set of output shards again and again. At each node the quotas
   are split by drawing without replacement: the node's draws are put in a random
   order and the left half of the shards gets the first of them, which is a
   multivariate-hypergeometric draw with exact totals.
4. Each source deals its draws, in permuted order, to shards by their quotas, so
   shards get disjoint draws. Within a shard, documents follow a hash.

Only sizes are shuffled (by source and block), never texts; the tables of sources,
blocks and draws are bounded by sources times ``MOST_BLOCKS``. All orders come from
hashes with fixed seeds, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plinth.llm.common import WORD, documents, row_count, written

WEIGHTS, MOST_REPEATS = (5, 2, 1), 3
#: Documents a block holds on average over all sources, bounds for the blocks of a source, and output shards.
BLOCK_DOCS, LEAST_BLOCKS, MOST_BLOCKS, SHARDS = 2000, 16, 16384, 16
#: Pieces of a shard that separate tasks write.
PIECES = 256
#: Sources that one task ranks.
RANKED = 1 << 16
SEED = 42


def size_of(text: Column) -> Column:
    """Words of a text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """The source with a mark that null lacks, so that joins and groups need no null handling."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def order_hash(doc_id: Column, source: Column, size: Column) -> Column:
    """A document's place in the permutation of its source; equal rows share it."""
    return F.xxhash64(F.lit(SEED), doc_id, source, size)


def running(df: DataFrame, order: list, sums: dict[str, Column]) -> DataFrame:
    """``df`` with, for each name, the sum over all rows before its own in one order over the whole table.

    Rows are ranged over partitions of bounded size; a partition's rows add up after
    what the partitions before it hold, which is one row a partition on the driver.
    ``order`` must be a total order.
    """
    parts = -(-row_count(df) // RANKED)
    if parts < 2:
        placed = df.withColumn("__part", F.lit(0))
    else:
        placed = written(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()), "mix-ranged")
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    held, before = [], {c: 0 for c in sums}
    if parts > 1:
        for r in sorted(placed.groupBy("__part").agg(*(F.sum(v).alias(c) for c, v in sums.items())).collect(), key=lambda r: r["__part"]):
            held.append((r["__part"], dict(before)))
            before = {c: before[c] + r[c] for c in sums}
    start = {c: F.element_at(F.create_map(*(F.lit(x) for p, v in held for x in (p, v[c]))), F.col("__part")) if held else F.lit(0) for c in sums}
    return placed.withColumns({c: start[c] + F.coalesce(F.sum(v).over(inside), F.lit(0)) for c, v in sums.items()}).drop("__part")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """``sources(skey, source_size)`` with ``target``: shares of all words by weight, none above ``most`` times its size.

    Sources rank by code point, null last. With sources in order of ``most`` times
    size over weight, those that stop are a first stretch, so running sums give the
    level at which all other shares stand. Sources may be as many as hosts are; only
    sums reach the driver.
    """
    cap = most * F.col("source_size")
    ranked = running(sources, [(F.col("skey") == "").cast("int"), F.col("skey")], {"rank": F.lit(1).cast("long")})
    weighed = ranked.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), F.pmod("rank", F.lit(len(weights))).cast("int") + 1)).withColumn("level", cap / F.col("weight"))
    weighed = written(weighed, "mix-ranked")
    all_size, all_weight = weighed.agg(F.sum("source_size"), F.sum("weight")).first()
    levelled = running(weighed, [F.col("level"), F.col("skey")], {"cap_before": cap, "weight_before": F.col("weight")})
    rest = (F.lit(all_size or 0) - F.col("cap_before")) / (F.lit(all_weight or 0.0) - F.col("weight_before"))
    first = levelled.withColumn("rest", rest).agg(F.min(F.when(F.col("rest") <= F.col("level"), F.struct("level", "skey", "rest"))).alias("m")).first()["m"]
    stand = float("inf") if first is None else first["rest"]
    return weighed.select("skey", "source_size", F.least(cap.cast("double"), F.col("weight") * F.lit(stand)).alias("target"))


def _size_table(docs: DataFrame, name: str) -> DataFrame:
    frame = docs.select("doc_id", source_key(F.col("source")).alias("skey"), size_of(F.col("text")).alias("size"))
    return written(frame.withColumn("h", order_hash(F.col("doc_id"), F.col("skey"), F.col("size"))), name)


def block_of(h: Column, blocks: int) -> Column:
    return F.pmod(F.shiftright(h, 17), F.lit(blocks)).cast("int")


def plan_mix(sized: DataFrame, shards: int = SHARDS, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> tuple[DataFrame, int]:
    """What each block of ``sized(doc_id, skey, size, h)`` gives, and the number of blocks of a source.

    Columns: ``skey, block, source_size, target, copies`` (times that the whole block
    is taken), ``cut`` and ``bonus`` (documents whose ``h`` is at most the one or equals
    the other are taken once more) and ``shards`` (the shard of each draw, the last being that of the cut).
    """
    blocks = max(LEAST_BLOCKS, min(MOST_BLOCKS, row_count(sized) // BLOCK_DOCS))
    placed = sized.withColumn("block", block_of(F.col("h"), blocks))
    totals = written(placed.groupBy("skey", "block").agg(F.sum("size").alias("words")), "mix-blocks")
    aims = written(targets(totals.groupBy("skey").agg(F.sum("words").alias("source_size")), weights, most), "mix-targets")
    size = F.col("source_size")
    passes = F.when(size == 0, F.lit(0)).otherwise(F.least(F.floor(F.col("target") / size), F.lit(most))).cast("int")
    rest = F.when(F.col("passes") >= most, F.lit(0.0)).otherwise(F.col("target") - F.col("passes") * size)
    order = Window.partitionBy("skey").orderBy(F.xxhash64(F.lit(SEED + 1), "block"), "block").rowsBetween(Window.unboundedPreceding, -1)
    filled = (
        totals.join(aims, "skey")
        .withColumn("passes", passes)
        .withColumn("left", rest - F.coalesce(F.sum("words").over(order), F.lit(0)))
        .withColumn("copies", F.col("passes") + (F.col("left") >= F.col("words")).cast("int") * (F.col("words") > 0).cast("int"))
        .withColumn("part", (F.col("left") > 0) & (F.col("left") < F.col("words")))
    )
    filled = written(filled.select("skey", "block", "source_size", "target", "passes", "copies", "part", "left"), "mix-filled")
    # The one block of each source that is taken in part: documents in hash order as far as they fit.
    last = filled.where("part").select("skey", "block", "left")
    inside = Window.partitionBy("skey", "block").orderBy("h").rowsBetween(Window.unboundedPreceding, 0)
    run = placed.join(last, ["skey", "block"]).groupBy("skey", "block", "left", "h").agg(F.sum("size").alias("size")).withColumn("sum", F.sum("size").over(inside))
    fit = F.col("sum") <= F.col("left")
    cuts = run.groupBy("skey", "block").agg(F.max(F.when(fit, F.col("h"))).alias("cut"), (F.first("left") - F.coalesce(F.max(F.when(fit, F.col("sum"))), F.lit(0))).alias("gap"))
    cuts = written(cuts, "mix-cuts")
    cut = filled.join(cuts.select("skey", "block", "cut"), ["skey", "block"], "left")
    # What is then missing: the one document not taken so far whose size comes nearest to it.
    free = placed.join(cut.where(F.col("copies") == F.col("passes")), ["skey", "block"]).join(cuts.select("skey", "gap"), "skey")
    near = free.where((F.col("size") > 0) & (F.col("size") < 2 * F.col("gap")) & (F.col("cut").isNull() | (F.col("h") > F.col("cut")))).groupBy("skey").agg(F.min(F.struct(F.abs(F.col("size") - F.col("gap")).alias("off"), "h")).alias("m"))
    bonus = near.select("skey", block_of(F.col("m.h"), blocks).alias("block"), F.col("m.h").alias("bonus"))
    draws = cut.join(bonus, ["skey", "block"], "left").withColumn("draws", F.col("copies") + (F.col("cut").isNotNull() | F.col("bonus").isNotNull()).cast("int"))
    draws = written(draws.select("skey", "block", "source_size", "target", "copies", "cut", "bonus", "draws"), "mix-draws")
    dealt = deal(draws, shards)
    return draws.join(dealt, ["skey", "block"], "left").select("skey", "block", "source_size", "target", "copies", "cut", "bonus", F.coalesce("shards", F.array().cast("array<int>")).alias("shards")), blocks


def split_quotas(quotas: DataFrame, shards: int) -> DataFrame:
    """``quotas(skey, n)`` to ``skey, shard, n`` by the splitting tree; all totals are kept.

    A node over ``k`` shards holds its sources' draws in a random order; the left
    ``k // 2`` shards get as many of the first as their share of the node's draws.
    """
    level = quotas.select("skey", F.lit(0).alias("first"), F.lit(shards).alias("many"), F.col("n").cast("long").alias("n")).where("n > 0")
    depth = (shards - 1).bit_length()
    for d in range(depth):
        half = F.floor(F.col("many") / 2).cast("int")
        node = Window.partitionBy("first")
        units = level.withColumn("unit", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
        place = F.row_number().over(node.orderBy(F.xxhash64(F.lit(SEED + 2 + d), "first", "skey", "unit"), "skey", "unit"))
        goes = units.withColumn("place", place).withColumn("all", F.count(F.lit(1)).over(node)).withColumn("goes_left", F.col("place") <= F.floor(F.col("all") * half / F.col("many")))
        level = goes.groupBy("skey", F.when(F.col("goes_left"), F.col("first")).otherwise(F.col("first") + half).alias("first"), F.when(F.col("goes_left"), half).otherwise(F.col("many") - half).alias("many")).agg(F.count(F.lit(1)).alias("n"))
    return level.select("skey", F.col("first").alias("shard"), "n")


def deal(draws: DataFrame, shards: int) -> DataFrame:
    """``skey, block, shards``: the shard of each of a block's draws."""
    quotas = split_quotas(draws.groupBy("skey").agg(F.sum("draws").alias("n")), shards)
    places = quotas.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).withColumn("place", F.row_number().over(Window.partitionBy("skey").orderBy("shard", "copy"))).select("skey", "place", "shard")
    units = draws.where("draws > 0").select("skey", "block", F.explode(F.sequence(F.lit(1), F.col("draws"))).alias("unit"))
    numbered = units.withColumn("place", F.row_number().over(Window.partitionBy("skey").orderBy(F.xxhash64(F.lit(SEED + 99), "skey", "block", "unit"), "block", "unit")))
    met = numbered.join(places, ["skey", "place"])
    return met.groupBy("skey", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("unit", "shard"))), lambda x: x["shard"]).alias("shards"))


def taken_copies(h: Column) -> Column:
    """Times that a document is taken, beside its block's ``copies``, ``cut`` and ``bonus``."""
    more = F.coalesce(h <= F.col("cut"), F.lit(False)) | F.coalesce(h == F.col("bonus"), F.lit(False))
    return F.col("copies") + more.cast("int")


def mix_sizes(docs: DataFrame, shards: int = SHARDS, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """``doc_id, size, source_size, target, taken, shards`` for every row of ``docs(doc_id, text, source)``.

    ``taken`` is 0 for documents that the mix leaves out; ``shards`` has one entry a
    copy, none for documents without words. Null texts and texts without words have size 0, a null source is a source
    of its own. Rows equal in ``doc_id``, source and size are taken alike. Texts are
    counted whole, however long; other columns are not read. An empty table gives no
    rows; if no document has words, all targets are 0.
    """
    sized = _size_table(docs, "mix-sizes")
    plan, blocks = plan_mix(sized, shards, weights, most)
    met = sized.withColumn("block", block_of(F.col("h"), blocks)).join(plan, ["skey", "block"])
    copies = F.when(F.col("size") > 0, taken_copies(F.col("h"))).otherwise(0)
    # A document is taken as often as the tree deals it to a shard.
    dealt = met.select("doc_id", "size", "source_size", "target", F.slice("shards", F.lit(1), copies).alias("shards"))
    return dealt.select("doc_id", "size", "source_size", "target", (F.size("shards") * F.col("size")).cast("long").alias("taken"), "shards")


def mix(docs: DataFrame, shards: int = SHARDS, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """The mixed documents themselves, each as often as it is taken, with the columns of ``docs``.

    Null texts and documents without words are never drawn; a null source is a source
    of its own; texts of any length move whole; other columns pass through, whatever
    their names; an empty table gives no rows. Rows go to a piece of their shard and
    follow a hash there.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    plan, blocks = plan_mix(_size_table(docs, "mix-sizes"), shards, weights, most)
    # A written table has a known size: Spark broadcasts it while it is small, else joins by source and block.
    plan = written(plan.where(F.size("shards") > 0).select("skey", "block", "copies", "cut", "bonus", "shards"), "mix-plan")
    whole = docs.select(F.struct(*columns).alias("row"), source_key(F.col("source")).alias("skey"), size_of(F.col("text")).alias("size"), F.col("doc_id").alias("id"))
    hashed = whole.withColumn("h", order_hash(F.col("id"), F.col("skey"), F.col("size"))).withColumn("block", block_of(F.col("h"), blocks))
    met = hashed.where("size > 0").join(plan, ["skey", "block"])
    each = met.select("row", "h", F.posexplode(F.slice("shards", F.lit(1), taken_copies(F.col("h")))).alias("copy", "shard"))
    placed = each.select("row", "shard", F.xxhash64(F.lit(SEED + 3), "h", "copy").alias("order"))
    # A shard is dealt over pieces by the same hash that orders it, so its size is no task's.
    return placed.repartition("shard", F.pmod("order", F.lit(PIECES))).sortWithinPartitions("shard", "order").select("row.*")


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document, and the shard that each copy goes to."""
    return mix_sizes(documents(spark, sf_dir, "doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken", "shards")

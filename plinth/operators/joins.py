"""Join operators: absence, universality, intervals, containment, ranked and prefix resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def anti_report(left: DataFrame, right: DataFrame, on: list[str], holds: list[DataFrame] = ()) -> DataFrame:
    """Rows of ``left`` without a partner in ``right`` nor in any of ``holds`` (J1-J3); null keys have no partner."""
    out = left.join(right.select(*on).distinct(), on, "left_anti")
    for hold in holds:
        out = out.join(hold.select(*on).distinct(), on, "left_anti")
    return out


def all_satisfy(df: DataFrame, key: list[str], holds: Column) -> DataFrame:
    """Keys all of whose rows satisfy ``holds``; unknown counts as not."""
    return df.groupBy(*key).agg(F.bool_and(F.coalesce(holds, F.lit(False))).alias("__all")).where("__all").drop("__all")


def innermost_interval(points: DataFrame, at: str, intervals: DataFrame, start: str, end: str, interval_id: str, width: int, keys: list[str] = ()) -> DataFrame:
    """For each point the narrowest interval that holds it, the first of equals.

    Intervals are cut into cells of ``width``, so that the join is one of equality on
    cells; ``start`` is inclusive, ``end`` exclusive, both integers.
    """
    cell = lambda c: F.floor(F.col(c) / width).cast("long")
    cells = intervals.select(*keys, start, end, interval_id, F.explode(F.sequence(cell(start), F.floor((F.col(end) - 1) / width).cast("long"))).alias("__cell"))
    met = points.withColumn("__cell", cell(at)).join(cells, [*keys, "__cell"]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end)))
    return met.drop("__cell")


def narrowest(met: DataFrame, point_id: list[str], start: str, end: str, interval_id: str) -> DataFrame:
    """Of the intervals that meet each point, the narrowest; ties go to the smaller id."""
    return met.groupBy(*point_id).agg(F.min(F.struct((F.col(end) - F.col(start)).alias("size"), F.col(interval_id))).alias("__m")).select(*point_id, F.col(f"__m.{interval_id}").alias(interval_id))


def dyadic_cells(start: Column, end: Column, levels: int) -> Column:
    """Array of ``level, cell`` whose cells of ``2 ** level`` numbers make up ``start .. end`` (inclusive) without overlap; at most two a level."""
    first = F.struct(start.cast("long").alias("l"), (end + 1).cast("long").alias("r"), F.array().cast("array<struct<level:int,cell:bigint>>").alias("out"))

    def step(a: Column, k: Column) -> Column:
        one = lambda c: F.struct(k.cast("int").alias("level"), c.alias("cell"))
        odd_l, odd_r = (a["l"] < a["r"]) & (F.pmod(a["l"], F.lit(2)) == 1), (a["l"] < a["r"]) & (F.pmod(a["r"], F.lit(2)) == 1)
        more = F.concat(a["out"], F.when(odd_l, F.array(one(a["l"]))).otherwise(F.array().cast("array<struct<level:int,cell:bigint>>")), F.when(odd_r, F.array(one(a["r"] - 1))).otherwise(F.array().cast("array<struct<level:int,cell:bigint>>")))
        return F.struct(F.shiftright(a["l"] + odd_l.cast("long"), 1).alias("l"), F.shiftright(a["r"] - odd_r.cast("long"), 1).alias("r"), more.alias("out"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(levels)), first, step, lambda a: a["out"])


def contained(children: DataFrame, parents: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of a child span and a parent span of one key that contains it; spans have ``id, s, e``, ends inclusive.

    A parent is listed in the dyadic cells that make it up, a child in those of each
    size that hold its start: both in the logarithm of the longest span, and a pair
    meets once.
    """
    longest = parents.agg(F.max(F.col("e") - F.col("s") + 1)).first()[0] or 1
    levels = int(longest).bit_length()
    p = parents.select(*keys, F.col("id").alias("parent"), F.col("s").alias("ps"), F.col("e").alias("pe"), F.explode(dyadic_cells(F.col("s"), F.col("e"), levels)).alias("__at"))
    cells = F.array(*(F.struct(F.lit(k).cast("int").alias("level"), F.shiftright(F.col("s").cast("long"), k).alias("cell")) for k in range(levels + 1)))
    c = children.select(*keys, F.col("id").alias("child"), F.col("s").alias("cs"), F.col("e").alias("ce"), F.explode(cells).alias("__at"))
    return c.join(p, [*keys, "__at"]).where(F.col("pe") >= F.col("ce")).drop("__at")


def resolve_ranked(specs: DataFrame, spec: str, files: DataFrame, path: str, rules: list[Column]) -> DataFrame:
    """For each specifier the first candidate path that exists, with its rank (J9, J10); candidates come from ``rules`` in order."""
    tries = specs.select(spec, F.posexplode(F.array(*rules)).alias("rank", path))
    found = tries.join(files.select(path).distinct(), path)
    return found.groupBy(spec).agg(F.min_by(path, "rank").alias(path), F.min("rank").cast("long").alias("rank"))


def ancestors(path: Column) -> Column:
    """All prefixes of a path that end before a slash, and the path itself."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def longest_prefix(paths: DataFrame, path: str, roots: DataFrame, root: str) -> DataFrame:
    """The longest root that is an ancestor of each path (J11, J12); paths without one give no row."""
    met = paths.select(path, F.explode(ancestors(F.col(path))).alias(root)).join(roots.select(root).distinct(), root)
    return met.groupBy(path).agg(F.max_by(root, F.length(root)).alias(root))


def first_rule(value: Column, rules: list[tuple[str, str]]) -> Column:
    """Name of the first rule whose pattern matches, else null."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(rules):
        out = F.when(value.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def subsumed(groups: DataFrame, items: DataFrame) -> DataFrame:
    """Groups all of whose items lie within items of one other group.

    ``items(group, key, id, s, e)``, ``groups(group, tier, n)``: a parent's tier must
    not be less specific; on the same tier it needs at least as many items, and of
    two groups that would subsume each other the smaller id stays.
    """
    child = items.select("key", F.col("id"), "s", "e")
    pairs = contained(child, child, ["key"])
    owner = items.select(F.col("id"), "group")
    met = pairs.join(owner.select(F.col("id").alias("child"), F.col("group").alias("cg")), "child").join(owner.select(F.col("id").alias("parent"), F.col("group").alias("pg")), "parent").where("cg <> pg")
    held = met.groupBy("cg", "pg").agg(F.countDistinct("child").alias("held"))
    c = groups.select(F.col("group").alias("cg"), F.col("tier").alias("ct"), F.col("n").alias("cn"))
    p = groups.select(F.col("group").alias("pg"), F.col("tier").alias("pt"), F.col("n").alias("pn"))
    whole = held.join(c, "cg").join(p, "pg").where("held = cn and (pt < ct or (pt = ct and pn >= cn))")
    mutual = whole.join(whole.select(F.col("cg").alias("pg"), F.col("pg").alias("cg"), F.lit(True).alias("back")), ["cg", "pg"], "left")
    return mutual.where("back is null or cg > pg").select(F.col("cg").alias("group")).distinct()


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")

"""Graph operators as loops of joins; each round's rows are a written table, so plans stay short and survive lost executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plinth.operators.tables import written


def reachable(edges: DataFrame, roots: DataFrame, avoid: DataFrame | None = None, max_rounds: int = 10_000) -> DataFrame:
    """``node, depth`` of all nodes reached from ``roots(node)`` over ``edges(u, v)``, not entering ``avoid(node)``."""
    blocked = avoid.select("node").distinct() if avoid is not None else None
    links = edges.select("u", "v").where("u is not null and v is not null").distinct()
    if blocked is not None:
        links = links.join(blocked.withColumnRenamed("node", "v"), "v", "left_anti").join(blocked.withColumnRenamed("node", "u"), "u", "left_anti")
        roots = roots.join(blocked, "node", "left_anti")
    links = written(links.select("u", "v"), "links")
    seen = written(roots.select("node").where("node is not null").distinct().withColumn("depth", F.lit(0).cast("long")), "seen")
    frontier = seen
    for depth in range(1, max_rounds):
        step = frontier.join(links, frontier["node"] == links["u"]).select(F.col("v").alias("node")).distinct()
        frontier = written(step.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth).cast("long")), "frontier")
        if frontier.isEmpty():
            return seen
        seen = written(seen.unionByName(frontier), "seen")
    raise RuntimeError("reachability did not end")


def dominates(edges: DataFrame, entry, nodes: DataFrame, target) -> bool:
    """Whether every path from ``entry`` to ``target`` meets one of ``nodes(node)`` (G12); an entry among them does."""
    roots = nodes.sparkSession.createDataFrame([(entry,)], nodes.select("node").schema)
    return reachable(edges, roots, avoid=nodes).where(F.col("node") == target).isEmpty()


def bypasses(edges: DataFrame, entry, nodes: DataFrame, exceptional: DataFrame, target) -> bool:
    """Whether ``target`` is reached when ``nodes`` may be left only over ``exceptional(u, v)`` edges."""
    kept = edges.select("u", "v").join(nodes.select(F.col("node").alias("u")), "u", "left_anti").select("u", "v")
    more = exceptional.select("u", "v").join(nodes.select(F.col("node").alias("u")), "u", "left_semi").select("u", "v")
    roots = nodes.sparkSession.createDataFrame([(entry,)], nodes.select("node").schema)
    return not reachable(kept.union(more), roots).where(F.col("node") == target).isEmpty()


def _propagate_max(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, colour``: the greatest node that reaches each node."""
    colours = written(nodes.select("node", F.col("node").alias("colour")), "colours")
    while True:
        sent = links.join(colours, links["u"] == colours["node"]).groupBy(F.col("v").alias("node")).agg(F.max("colour").alias("sent"))
        new = written(colours.join(sent, "node", "left").select("node", F.greatest("colour", "sent").alias("colour"), (F.coalesce("sent", "colour") > F.col("colour")).alias("moved")), "colours")
        changed = not new.where("moved").isEmpty()
        colours = new.drop("moved")
        if not changed:
            return colours


def strongly_connected(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges(u, v)``; a component is named by its smallest node.

    By colouring: the greatest node that reaches a node is its colour; what reaches
    that node back within the colour is its component. Nodes without an edge in or
    out among those left are components of their own and leave early.
    """
    links = written(edges.select("u", "v").where("u <> v").distinct(), "links")
    nodes = written(edges.select(F.col("u").alias("node")).union(edges.select("v")).where("node is not null").distinct(), "nodes")
    parts = []
    while not nodes.isEmpty():
        inner = nodes.join(links.select(F.col("u").alias("node")).distinct(), "node", "left_semi").join(links.select(F.col("v").alias("node")).distinct(), "node", "left_semi")
        core = written(inner, "core")
        alone = nodes.join(core, "node", "left_anti")
        parts.append(written(alone.select("node", F.col("node").alias("root")), "alone"))
        links = written(links.join(core.select(F.col("node").alias("u")), "u", "left_semi").join(core.select(F.col("node").alias("v")), "v", "left_semi").select("u", "v"), "links")
        if core.count() < nodes.count():
            nodes = core
            continue
        colours = _propagate_max(links, core)
        same = links.join(colours.select(F.col("node").alias("u"), F.col("colour").alias("cu")), "u").join(colours.select(F.col("node").alias("v"), F.col("colour").alias("cv")), "v").where("cu = cv")
        back = written(same.select(F.col("v").alias("u"), F.col("u").alias("v")), "back")
        found = reachable(back, colours.where("node = colour").select("node")).select("node").join(colours, "node").select("node", F.col("colour").alias("root"))
        found = written(found, "found")
        parts.append(found)
        nodes = written(core.join(found.select("node"), "node", "left_anti"), "nodes")
        links = written(links.join(nodes.select(F.col("node").alias("u")), "u", "left_semi").join(nodes.select(F.col("node").alias("v")), "v", "left_semi").select("u", "v"), "links")
    if not parts:
        return nodes.select("node", F.col("node").alias("component"))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    named = whole.groupBy("root").agg(F.min("node").alias("component"))
    return whole.join(named, "root").select("node", "component")


def greedy_cycles(edges: DataFrame, components: DataFrame) -> DataFrame:
    """``component, ix, node``: from each component's smallest node along smallest neighbours in the component until one repeats; the cycle is what lies between."""
    size = components.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("component")
    c = components.join(size, "component", "left_semi")
    inner = edges.where("u <> v").join(c.select(F.col("node").alias("u"), "component"), "u").join(c.select(F.col("node").alias("v"), F.col("component").alias("cv")), "v").where("component = cv")
    step = written(inner.groupBy("component", "u").agg(F.min("v").alias("v")), "steps")
    # Places along the walk by doubling: each round knows twice as many, so rounds grow with the logarithm of its length.
    walk = written(size.select("component", F.col("component").alias("node"), F.lit(0).cast("long").alias("ix")), "walk")
    jump, reach, known = step, 1, -1
    while (n := walk.count()) != known:
        known = n
        ahead = walk.join(jump.withColumnRenamed("u", "node"), ["component", "node"]).select("component", F.col("v").alias("node"), (F.col("ix") + reach).alias("ix"))
        walk = written(walk.unionByName(ahead).groupBy("component", "node").agg(F.min("ix").alias("ix")), "walk")
        twice = jump.select("component", "u", F.col("v").alias("m")).join(jump.select("component", F.col("u").alias("m"), "v"), ["component", "m"]).select("component", "u", "v")
        jump, reach = written(twice, "jump"), 2 * reach
    last = walk.groupBy("component").agg(F.max_by("node", "ix").alias("u")).join(step, ["component", "u"]).select("component", F.col("v").alias("node"))
    entry = last.join(walk, ["component", "node"]).select("component", F.col("ix").alias("first"))
    return walk.join(entry, "component").where("ix >= first").select("component", (F.col("ix") - F.col("first")).cast("int").alias("ix"), "node")


def edge_cuts(cycles: DataFrame, degrees: DataFrame) -> DataFrame:
    """For each cycle the listed edge whose source has most targets, the first of equals; the closing edge is never one."""
    w = Window.partitionBy("component").orderBy("ix")
    pairs = cycles.withColumn("next", F.lead("node").over(w)).where("next is not null").join(degrees, "node", "left").withColumn("score", F.greatest(F.coalesce("degree", F.lit(0)), F.lit(1)).cast("long"))
    return pairs.groupBy("component").agg(F.min_by(F.struct("node", "next", "score"), F.struct((-F.col("score")).alias("s"), F.col("ix"))).alias("m")).select("component", F.col("m.node").alias("cut_from"), F.col("m.next").alias("cut_to"), F.col("m.score").alias("score"))


def chain_depths(edges: DataFrame, cycle_depth: int = -1) -> DataFrame:
    """``node, depth`` over a functional graph: steps until a node without a target, ``cycle_depth`` for all that never end.

    By pointer jumping: each round doubles the steps, so rounds grow with the
    logarithm of the longest chain.
    """
    jump = written(edges.select(F.col("u").alias("node"), F.col("v").alias("to"), F.lit(1).cast("long").alias("steps"), F.lit(False).alias("open")), "jump")
    n = jump.count()
    rounds = 0
    while (1 << rounds) <= 2 * n:
        ahead = jump.select(F.col("node").alias("to"), F.col("to").alias("to2"), F.col("steps").alias("steps2"))
        jump = written(jump.join(ahead, "to", "left").select("node", F.coalesce("to2", "to").alias("to"), (F.col("steps") + F.coalesce("steps2", F.lit(0))).alias("steps"), F.col("to2").isNotNull().alias("open")), "jump")
        rounds += 1
        if jump.where("open").isEmpty():
            break
    return jump.select("node", F.when(F.col("open"), F.lit(cycle_depth)).otherwise(F.col("steps")).cast("long").alias("depth"))


def propagate_dead(edges: DataFrame, nodes: DataFrame, seeds: DataFrame) -> DataFrame:
    """``node``: the seeds and, until nothing changes, all nodes that have consumers of which none is alive (G6); ``edges(u, v)``: v consumes u."""
    dead = written(seeds.select("node").distinct(), "dead")
    consumed = edges.select("u", "v").distinct()
    while True:
        alive = consumed.join(dead.select(F.col("node").alias("v")), "v", "left_anti").select(F.col("u").alias("node")).distinct()
        new = nodes.select("node").join(consumed.select(F.col("u").alias("node")).distinct(), "node", "left_semi").join(alive, "node", "left_anti").join(dead, "node", "left_anti")
        new = written(new, "dead-new")
        if new.isEmpty():
            return dead
        dead = written(dead.unionByName(new), "dead")

"""Dataflow over control-flow graphs given as fact tables (F6-F12, F7 default form).

Facts are per function (``keys``): ``edges(src, dst)``, ``defs(node, def_id, var, ix)``
and ``uses(node, var)``. A function's graph is small, so one function is one group of
a vectorised kernel with bit masks; functions are spread over the cluster by key.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reaching_fixpoint(edges: list[tuple[int, int]], gen: dict[int, int], kill: dict[int, int], entry: int, seed: int = 0) -> dict[int, int]:
    """Definitions, as bits, that may reach each node's start; ``seed`` holds at the entry."""
    succ, pred, nodes = defaultdict(set), defaultdict(set), {entry}
    for s, d in edges:
        succ[s].add(d)
        pred[d].add(s)
        nodes |= {s, d}
    into = dict.fromkeys(nodes, 0)
    into[entry] = seed
    work = sorted(nodes)
    while work:
        again = set()
        for n in work:
            got = seed if n == entry else 0
            for p in pred[n]:
                got |= gen.get(p, 0) | (into[p] & ~kill.get(p, 0))
            if got != into[n] or n not in into:
                into[n] = got
                again |= succ[n]
        work = sorted(again)
    return into


def live_fixpoint(edges: list[tuple[int, int]], use: dict[int, int], define: dict[int, int]) -> dict[int, int]:
    """Variables, as bits, live at each node's start."""
    succ, pred, nodes = defaultdict(set), defaultdict(set), set(use) | set(define)
    for s, d in edges:
        succ[s].add(d)
        pred[d].add(s)
        nodes |= {s, d}
    live = dict.fromkeys(nodes, 0)
    work = sorted(nodes, reverse=True)
    while work:
        again = set()
        for n in work:
            out = 0
            for s in succ[n]:
                out |= live[s]
            got = use.get(n, 0) | (out & ~define.get(n, 0))
            if got != live[n]:
                live[n] = got
                again |= pred[n]
        work = sorted(again, reverse=True)
    return live


FACTS = "kind string, a long, b long, name string, ix long"


def facts(keys: list[str], edges: DataFrame, defs: DataFrame, uses: DataFrame) -> DataFrame:
    """The three tables as one, so that a function's facts meet in one shuffle."""
    e = edges.select(*keys, F.lit("edge").alias("kind"), F.col("src").cast("long").alias("a"), F.col("dst").cast("long").alias("b"), F.lit(None).cast("string").alias("name"), F.lit(0).cast("long").alias("ix"))
    d = defs.select(*keys, F.lit("def"), F.col("node").cast("long"), F.col("def_id").cast("long"), "var", F.col("ix").cast("long"))
    u = uses.select(*keys, F.lit("use"), F.col("node").cast("long"), F.lit(None).cast("long"), "var", F.lit(0).cast("long"))
    return e.union(d).union(u)


def _tables(pdf: pd.DataFrame):
    edges = list(pdf.loc[pdf.kind == "edge", ["a", "b"]].itertuples(index=False, name=None))
    defs = [tuple(x) for x in pdf.loc[pdf.kind == "def", ["a", "b", "name", "ix"]].sort_values(["a", "ix", "b"]).itertuples(index=False, name=None)]
    uses = [tuple(x) for x in pdf.loc[pdf.kind == "use", ["a", "name"]].itertuples(index=False, name=None)]
    return edges, defs, uses


def definition_verdicts(keys: list[str], edges: DataFrame, defs: DataFrame, uses: DataFrame, entry: int = 0) -> DataFrame:
    """``keys, def_id, var, n_uses, overwritten``: uses that each definition reaches, and whether a later one may displace it.

    Within a node uses come before definitions and the last definition of a variable
    leaves the node. A definition at ``entry`` seeds it, as a parameter does. A
    function without edges or uses has its definitions unused.
    """
    key_schema = ", ".join(f"{k} {edges.schema[k].dataType.simpleString()}" for k in keys)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        links, defs_, uses_ = _tables(pdf)
        bit = {int(d): 1 << i for i, (_, d, _, _) in enumerate(defs_)}
        of_var: dict = defaultdict(int)
        for _, d, v, _ in defs_:
            of_var[v] |= bit[int(d)]
        gen: dict = defaultdict(int)
        kill: dict = defaultdict(int)
        lost = 0
        last: dict = {}
        for n, d, v, _ in defs_:
            if (n, v) in last:
                lost |= last[n, v]
            last[n, v] = bit[int(d)]
        for (n, v), b in last.items():
            gen[n] |= b
            kill[n] |= of_var[v] & ~b
        into = reaching_fixpoint([(int(s), int(d)) for s, d in links], gen, kill, entry)
        count: dict = defaultdict(int)
        for n, v in uses_:
            reached = into.get(n, 0) & of_var[v]
            for d, b in bit.items():
                if reached & b:
                    count[d] += 1
        for (n, v), b in last.items():
            lost |= into.get(n, 0) & of_var[v] & ~b
        rows = [(*key, int(d), v, count[int(d)], bool(lost & bit[int(d)])) for _, d, v, _ in defs_]
        return pd.DataFrame(rows, columns=[*keys, "def_id", "var", "n_uses", "overwritten"])

    table = facts(keys, edges, defs, uses)
    return table.groupBy(*keys).applyInPandas(run, f"{key_schema}, def_id long, var string, n_uses long, overwritten boolean")


def def_use_pairs(keys: list[str], edges: DataFrame, defs: DataFrame, uses: DataFrame, entry: int = 0) -> DataFrame:
    """``keys, def_id, var, use_id``: every use that a definition reaches; ``uses`` also has ``use_id``."""
    key_schema = ", ".join(f"{k} {edges.schema[k].dataType.simpleString()}" for k in keys)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        links, defs_, _ = _tables(pdf)
        uses_ = [tuple(x) for x in pdf.loc[pdf.kind == "use", ["a", "name", "ix"]].itertuples(index=False, name=None)]
        bit = {int(d): 1 << i for i, (_, d, _, _) in enumerate(defs_)}
        of_var: dict = defaultdict(int)
        last: dict = {}
        for n, d, v, _ in defs_:
            of_var[v] |= bit[int(d)]
            last[n, v] = bit[int(d)]
        gen: dict = defaultdict(int)
        kill: dict = defaultdict(int)
        for (n, v), b in last.items():
            gen[n] |= b
            kill[n] |= of_var[v] & ~b
        into = reaching_fixpoint([(int(s), int(d)) for s, d in links], gen, kill, entry)
        rows = [(*key, int(d), v, int(u)) for n, v, u in uses_ for _, d, w, _ in defs_ if w == v and into.get(n, 0) & bit[int(d)]]
        return pd.DataFrame(rows, columns=[*keys, "def_id", "var", "use_id"])

    with_ids = facts(keys, edges, defs, uses.limit(0)).union(uses.select(*keys, F.lit("use"), F.col("node").cast("long"), F.lit(None).cast("long"), "var", F.col("use_id").cast("long")))
    return with_ids.groupBy(*keys).applyInPandas(run, f"{key_schema}, def_id long, var string, use_id long").distinct()


def liveness(keys: list[str], edges: DataFrame, defs: DataFrame, uses: DataFrame) -> DataFrame:
    """``keys, max_live, at_node``: most variables live at a node's start and the first node where."""
    key_schema = ", ".join(f"{k} {edges.schema[k].dataType.simpleString()}" for k in keys)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        links, defs_, uses_ = _tables(pdf)
        names = {v: 1 << i for i, v in enumerate(sorted({x[2] for x in defs_} | {x[1] for x in uses_}))}
        use: dict = defaultdict(int)
        define: dict = defaultdict(int)
        for n, v in uses_:
            use[n] |= names[v]
        for n, _, v, _ in defs_:
            define[n] |= names[v]
        live = live_fixpoint([(int(s), int(d)) for s, d in links], use, define)
        best = max(sorted(live), key=lambda n: live[n].bit_count(), default=None)
        return pd.DataFrame([(*key, live[best].bit_count() if best is not None else 0, best)], columns=[*keys, "max_live", "at_node"])

    return facts(keys, edges, defs, uses).groupBy(*keys).applyInPandas(run, f"{key_schema}, max_live long, at_node long")


def dead_stores(keys: list[str], edges: DataFrame, defs: DataFrame, uses: DataFrame, captured: DataFrame | None = None, entry: int = 0) -> DataFrame:
    """Definitions that no use meets and no closure captures, with the kind of the finding.

    ``defs`` also has ``write_kind`` and ``is_parameter``. Parameters and variables
    without any use are left out; a definition that is a declaration is never called
    overwritten. ``captured(keys, def_id)`` holds definitions back.
    """
    verdicts = definition_verdicts(keys, edges, defs, uses, entry).where("n_uses = 0").drop("var", "n_uses")
    read = uses.select(*keys, "var").distinct()
    facts_ = defs.where(~F.coalesce("is_parameter", F.lit(False))).join(read, [*keys, "var"], "left_semi")
    out = facts_.join(verdicts, [*keys, "def_id"])
    if captured is not None:
        out = out.join(captured.select(*keys, "def_id").distinct(), [*keys, "def_id"], "left_anti")
    kind = F.when(F.col("overwritten") & (F.col("write_kind") != "declaration"), "dead-store-overwrite").otherwise("dead-store")
    return out.select(*keys, "def_id", "var", kind.alias("kind"))

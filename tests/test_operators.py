"""Operators against brute force and at their edges."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from plinth.operators import clones, graph, joins, metrics, report, sequences
from plinth.operators.components import connected_components


def edges_of(spark, pairs):
    return spark.createDataFrame(pairs, "u long, v long")


def closure(pairs):
    nodes = {x for p in pairs for x in p}
    reach = {n: {n} for n in nodes}
    while True:
        grown = {n: set().union(*(reach[v] for u, v in pairs if u in r), r) for n, r in reach.items()}
        if grown == reach:
            return reach
        reach = grown


def test_components_equal_brute_force(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(15)] + [(7, 7), (None, 3)]
    both = [(u, v) for u, v in pairs if u is not None] + [(v, u) for u, v in pairs if u is not None]
    want = {n: min(r) for n, r in closure(both).items() if min(r) != n}
    got = {r["node"]: r["component"] for r in connected_components(edges_of(spark, pairs)).collect()}
    assert got == want
    assert connected_components(edges_of(spark, [])).count() == 0


def test_strongly_connected_equals_brute_force(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(12), rng.randrange(12)) for _ in range(20)]
    reach = closure(pairs)
    want = {n: min(m for m in reach[n] if n in reach[m]) for n in reach}
    got = {r["node"]: r["component"] for r in graph.strongly_connected(edges_of(spark, pairs)).collect()}
    assert got == want
    assert graph.strongly_connected(edges_of(spark, [])).count() == 0


def test_domination_and_bypass(spark):
    e = edges_of(spark, [(0, 1), (1, 2), (0, 3), (3, 2)])
    node = lambda *x: spark.createDataFrame([(i,) for i in x], "node long")
    assert not graph.dominates(e, 0, node(1), 2)
    assert graph.dominates(e, 0, node(1, 3), 2)
    assert graph.dominates(e, 0, node(0), 2)
    assert not graph.bypasses(e, 0, node(1, 3), edges_of(spark, []), 2)
    assert graph.bypasses(e, 0, node(1, 3), edges_of(spark, [(3, 2)]), 2)


def test_chain_depths_mark_cycles(spark):
    got = {r["node"]: r["depth"] for r in graph.chain_depths(edges_of(spark, [(1, 2), (2, 3), (5, 6), (6, 5), (4, 5)])).collect()}
    assert got == {1: 2, 2: 1, 5: -1, 6: -1, 4: -1}


def test_edge_cut_never_takes_the_closing_edge(spark):
    cycles = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 2, 3)], "component long, ix int, node long")
    degrees = spark.createDataFrame([(3, 9), (2, 4)], "node long, degree long")
    assert [tuple(r) for r in graph.edge_cuts(cycles, degrees).collect()] == [(1, 2, 3, 4)]


def test_dead_propagation_keeps_what_something_alive_uses(spark):
    e = edges_of(spark, [(1, 2), (2, 3), (4, 3), (4, 5)])
    nodes = spark.createDataFrame([(i,) for i in range(1, 7)], "node long")
    seeds = spark.createDataFrame([(3,)], "node long")
    assert {r[0] for r in graph.propagate_dead(e, nodes, seeds).collect()} == {1, 2, 3}


def test_anti_report_with_nulls_and_empty_sides(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "k long")
    assert {r[0] for r in joins.anti_report(left, spark.createDataFrame([(1,), (None,)], "k long"), ["k"]).collect()} == {2, None}
    assert joins.anti_report(left, left.limit(0), ["k"]).count() == 3


def test_unknown_does_not_satisfy(spark):
    df = spark.createDataFrame([(1, True), (1, None), (2, True)], "k long, ok boolean")
    assert [r[0] for r in joins.all_satisfy(df, ["k"], F.col("ok")).collect()] == [2]


def test_mutual_subsumption_keeps_the_smaller(spark):
    items = spark.createDataFrame([("a", "f", "a1", 0, 9), ("b", "f", "b1", 0, 9), ("c", "f", "c1", 2, 3), ("d", "g", "d1", 2, 3)], "group string, key string, id string, s long, e long")
    groups = items.select("group", F.lit(0).alias("tier"), F.lit(1).cast("long").alias("n"))
    assert {r[0] for r in joins.subsumed(groups, items).collect()} == {"b", "c"}


def test_ancestors_and_longest_prefix(spark):
    p = spark.createDataFrame([("/a/b/c",), ("/x",)], "path string")
    r = spark.createDataFrame([("/a",), ("/a/b",), ("/a/bb",)], "root string")
    assert [tuple(x) for x in joins.longest_prefix(p, "path", r, "root").collect()] == [("/a/b/c", "/a/b")]


@pytest.mark.parametrize(("text", "lines"), [("", 0), ("a", 1), ("a\n", 1), ("a\r\nb", 2), ("a\rb ", 2), ("\n\n", 2), ("a\u2028b\u2029", 2)])
def test_line_count(spark, text, lines):
    assert spark.createDataFrame([(text,)], "t string").select(metrics.line_count(F.col("t"))).first()[0] == lines


def test_oversized_bound(spark):
    df = spark.createDataFrame([(1, "a\nb"), (2, "a\nb\nc")], "i long, t string")
    assert [r["i"] for r in metrics.oversized(df, "t", 2).collect()] == [2]


def test_global_lead_equals_a_plain_window(spark):
    rows = [(i * 7 % 101, i) for i in range(101)]
    df = spark.createDataFrame(rows, "o long, v long").repartition(3)
    got = {r["o"]: r["n"] for r in sequences.global_lead(df, ["o"], "v", "n", 5).collect()}
    by = dict(rows)
    assert got == {o: by.get(o + 1) for o in by}


def test_definitions_and_uses(spark):
    rows = [(1, i, k) for i, k in enumerate("uddudu")] + [(2, 9, "d")]
    df = spark.createDataFrame(rows, "k long, i long, e string")
    got = {(r["k"], r["i"]): (r["n_uses"], r["overwritten"]) for r in sequences.definition_uses(df, ["k"], ["i"], F.col("e") == "d", F.col("e") == "u", "i").collect()}
    assert got == {(1, 1): (0, True), (1, 2): (1, True), (1, 4): (1, False), (2, 9): (0, False)}


def test_representative_takes_the_upper_median(spark):
    df = spark.createDataFrame([("s", 1, 10), ("s", 2, 20), ("s", 3, 20), ("s", 4, 5)], "k string, m long, n long")
    assert [tuple(r) for r in clones.representative(df, "k", "m", "n").collect()] == [("s", 2, 20, 20)]


def test_common_runs(spark):
    rows = [(1, i, f) for i, f in enumerate("abcxyz")] + [(2, i, f) for i, f in enumerate("qabcyz")]
    df = spark.createDataFrame(rows, "s long, p long, f string")
    got = {tuple(r) for r in clones.common_runs(df, "s", "p", "f", 2).collect()}
    assert got == {(1, 2, 0, 1, 3), (1, 2, 4, 4, 2)}


@pytest.mark.parametrize("least", [1, 2, 3])
def test_common_runs_keep_frequent_lines(spark, least):
    rng = random.Random(least)
    texts = [[rng.choice("hhhhabc") for _ in range(rng.randint(0, 9))] for _ in range(25)] + [["only"], list("xhhhy"), list("zhhhy")]
    at = {(s, p): f for s, t in enumerate(texts) for p, f in enumerate(t) if rng.random() < 0.9}
    assert sum(f == "h" for f in at.values()) > 40
    want = set()
    for (s, p), f in at.items():
        for t in range(s + 1, len(texts)):
            for q in range(len(texts[t])):
                if at.get((t, q)) == f and (at.get((s, p - 1)) is None or at.get((s, p - 1)) != at.get((t, q - 1))):
                    n = next(k for k in range(1, 99) if at.get((s, p + k)) is None or at.get((s, p + k)) != at.get((t, q + k)))
                    want |= {(s, t, p, q, n)} if n >= least else set()
    df = spark.createDataFrame([(*k, f) for k, f in at.items()], "s long, p long, f string")
    rows = clones.common_runs(df, "s", "p", "f", least).collect()
    assert {tuple(r) for r in rows} == want and len(rows) == len(want) > 0


def test_equal_findings_collapse(spark):
    df = spark.createDataFrame([(1,), (1,), (2,)], "f long")
    part = report.finding(df, "waste", "W", F.col("f"), F.lit(1), F.lit("k"), F.lit("l"))
    assert report.flatten(part, part).count() == 2


def test_runs_from_first_cover_all_that_is_shared(spark):
    rng = random.Random(9)
    texts = [[rng.choice("hhabcd") for _ in range(rng.randint(0, 12))] for _ in range(30)]
    rows = [(s, p, f) for s, t in enumerate(texts) for p, f in enumerate(t)]
    runs = clones.runs_from_first(spark.createDataFrame(rows, "s long, p long, f string"), "s", "p", "f", 2).collect()
    places: dict = {}
    for s, t in enumerate(texts):
        for p in range(len(t) - 1):
            places.setdefault((t[p], t[p + 1]), []).append((s, p))
    covered: dict = {}
    for r in runs:
        assert r["first_seq"] < r["seq"] and texts[r["seq"]][r["start"] : r["start"] + r["n"]] == texts[r["first_seq"]][r["first_start"] : r["first_start"] + r["n"]]
        for k in range(r["n"] - 1):
            key = (r["seq"], r["start"] + k)
            assert key not in covered
            covered[key] = (r["first_seq"], r["first_start"] + k)
    want = {o: min(at) for at in places.values() for o in at if o[0] != min(at)[0]}
    assert covered == want


def test_runs_from_first_with_a_line_in_a_thousand_documents(spark):
    rows = [(s, p, f) for s in range(1000) for p, f in enumerate(["head", "license", "all rights", f"own {s}"])]
    runs = clones.runs_from_first(spark.createDataFrame(rows, "s long, p long, f string"), "s", "p", "f", 2).collect()
    assert len(runs) == 999 and {(r["first_seq"], r["start"], r["first_start"], r["n"]) for r in runs} == {(0, 0, 0, 3)}


def test_dyadic_cells_are_few_and_make_up_the_span(spark):
    from plinth.operators.joins import contained, dyadic_cells

    rng = random.Random(2)
    rows = [(i, a := rng.randint(0, 10**9), a + rng.randint(0, 10**9)) for i in range(200)] + [(900, 0, 0), (901, 7, 7), (902, 0, (1 << 30) - 1)]
    df = spark.createDataFrame(rows, "id long, s long, e long")
    for r in df.withColumn("cells", dyadic_cells(F.col("s"), F.col("e"), 31)).collect():
        spans = sorted((c["cell"] << c["level"], (c["cell"] + 1 << c["level"]) - 1) for c in r["cells"])
        assert len(spans) <= 62 and spans[0][0] == r["s"] and spans[-1][1] == r["e"] and all(a[1] + 1 == b[0] for a, b in zip(spans, spans[1:], strict=False))
    keyed = df.withColumn("k", F.lit(1))
    got = {(r["child"], r["parent"]) for r in contained(keyed, keyed, ["k"]).collect()}
    assert got == {(a[0], b[0]) for a in rows for b in rows if b[1] <= a[1] and a[2] <= b[2]}


def test_greedy_cycles_take_rounds_in_the_logarithm(spark, monkeypatch):
    from plinth.operators import graph

    n, rounds = 300, []
    edges = spark.createDataFrame([(i, i + 1) for i in range(n - 1)] + [(n - 1, 40), (40, 0), (7, 3)], "u long, v long")
    parts = spark.createDataFrame([(i, 0) for i in range(n)], "node long, component long")
    whole = graph.written
    monkeypatch.setattr(graph, "written", lambda df, name: rounds.append(name) or whole(df, name))
    rows = sorted((r["ix"], r["node"]) for r in graph.greedy_cycles(edges, parts).collect())
    # From 0 along smallest neighbours: 7 turns back to 3.
    assert rows == [(k, 3 + k) for k in range(5)] and rounds.count("walk") <= 8
    ring = spark.createDataFrame([(i, (i + 1) % 257) for i in range(257)], "u long, v long")
    parts = spark.createDataFrame([(i, 0) for i in range(257)], "node long, component long")
    rounds.clear()
    assert sorted((r["ix"], r["node"]) for r in graph.greedy_cycles(ring, parts).collect()) == [(i, i) for i in range(257)] and rounds.count("walk") <= 12


def test_lcs_rows_equal_the_table():
    from plinth.functions.sequences import lcs_length, lcs_pairs

    def table(a, b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                best[i][j] = best[i - 1][j - 1] + 1 if x == y else max(best[i - 1][j], best[i][j - 1])
        out, i, j = [], len(a), len(b)
        while i and j:
            if a[i - 1] == b[j - 1]:
                out.append((i - 1, j - 1))
                i, j = i - 1, j - 1
            elif best[i - 1][j] >= best[i][j - 1]:
                i -= 1
            else:
                j -= 1
        return out[::-1]

    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 14))] for _ in range(2))
        assert lcs_pairs(a, b) == table(a, b) and lcs_length(a, b) == len(table(a, b))

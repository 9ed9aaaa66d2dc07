"""Dataflow, sequence functions and path functions."""

from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plinth.functions import paths, sequences
from plinth.operators import dataflow as D


def frames(spark, edges, defs, uses):
    e = spark.createDataFrame([(1, *x) for x in edges], "fn long, src long, dst long")
    d = spark.createDataFrame([(1, *x) for x in defs], "fn long, node long, def_id long, var string, ix long, write_kind string, is_parameter boolean")
    u = spark.createDataFrame([(1, *x) for x in uses], "fn long, node long, var string")
    return ["fn"], e, d, u


def brute_uses(edges, defs, uses):
    """Uses that a path from the definition meets without another definition of the variable on the way."""
    succ = {}
    for s, d in edges:
        succ.setdefault(s, set()).add(d)
    last = {}
    for n, d, v, ix, *_ in sorted(defs, key=lambda x: x[3]):
        last[n, v] = d
    out = {}
    for n, d, v, *_ in defs:
        out[d] = 0
        if last[n, v] != d:
            continue
        seen, work = set(), list(succ.get(n, ()))
        while work:
            x = work.pop()
            if x in seen:
                continue
            seen.add(x)
            if (x, v) not in last:
                work += succ.get(x, ())
        out[d] = sum(1 for un, uv in uses if uv == v and un in seen)
    return out


def test_definitions_equal_path_search(spark):
    rng = random.Random(4)
    for _ in range(4):
        edges = [(i, i + 1) for i in range(7)] + [(rng.randrange(8), rng.randrange(1, 8)) for _ in range(4)]
        defs = [(rng.randrange(8), i, rng.choice("xyz"), i, "assignment", False) for i in range(7)]
        uses = [(rng.randrange(8), rng.choice("xyz")) for _ in range(6)]
        got = {r["def_id"]: r["n_uses"] for r in D.definition_verdicts(*frames(spark, edges, defs, uses)).collect()}
        assert got == brute_uses(edges, defs, uses)


def test_dead_stores(spark):
    # x = 1; if (..) x = 2; use x; x = 3 at the end
    edges = [(0, 1), (1, 2), (0, 2), (2, 3)]
    defs = [(0, 10, "x", 0, "declaration", False), (1, 11, "x", 1, "assignment", False), (3, 12, "x", 2, "assignment", False), (0, 13, "p", 3, "declaration", True), (0, 14, "never", 4, "declaration", False)]
    uses = [(2, "x"), (1, "p")]
    keys, e, d, u = frames(spark, edges, defs, uses)
    got = {(r["def_id"], r["kind"]) for r in D.dead_stores(keys, e, d, u).collect()}
    assert got == {(12, "dead-store")}
    held = spark.createDataFrame([(1, 12)], "fn long, def_id long")
    assert D.dead_stores(keys, e, d, u, held).count() == 0


def test_overwritten_before_use(spark):
    keys, e, d, u = frames(spark, [(0, 1), (1, 2)], [(0, 1, "x", 0, "assignment", False), (1, 2, "x", 1, "assignment", False)], [(2, "x")])
    assert {(r["def_id"], r["kind"]) for r in D.dead_stores(keys, e, d, u).collect()} == {(1, "dead-store-overwrite")}


def test_liveness_in_a_loop(spark):
    keys, e, d, u = frames(spark, [(0, 1), (1, 2), (2, 1), (1, 3)], [(0, 1, "a", 0, "d", False), (0, 2, "b", 1, "d", False), (2, 3, "a", 2, "d", False)], [(2, "a"), (3, "b")])
    assert [tuple(r) for r in D.liveness(keys, e, d, u).collect()] == [(1, 2, 1)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=12), st.lists(st.integers(0, 4), max_size=12))
def test_lcs_length_equals_alignment(a, b):
    pairs = sequences.lcs_pairs(a, b)
    assert sequences.lcs_length(a, b) == len(pairs)
    assert all(a[i] == b[j] for i, j in pairs) and pairs == sorted(pairs) and len({j for _, j in pairs}) == len(pairs)


def test_lcs_columns(spark):
    df = spark.createDataFrame([(["a", "b", "c"], ["b", "c"]), ([], []), (None, ["x"])], "a array<string>, b array<string>")
    rows = df.select(sequences.lcs_len(F.col("a"), F.col("b")).alias("n"), sequences.dice_lcs(F.col("a"), F.col("b")).alias("d"), sequences.lcs_align(F.col("a"), F.col("b")).alias("p")).collect()
    assert [(r["n"], round(r["d"], 3), len(r["p"])) for r in rows] == [(2, 0.8, 2), (0, 0.0, 0), (0, 0.0, 0)]


@pytest.mark.parametrize(("glob", "path", "fits"), [("**/*.ts", "a/b/c.ts", True), ("**/*.ts", "c.ts", True), ("src/*.ts", "src/a/b.ts", False), ("src/**", "src/a/b.ts", True), ("a?.ts", "ab.ts", True), ("a?.ts", "a/.ts", False), ("a.ts", "axts", False)])
def test_globs(spark, glob, path, fits):
    assert spark.createDataFrame([(path,)], "p string").select(paths.matches_any(F.col("p"), [glob])).first()[0] is fits


def test_specifiers(spark):
    rows = [("lodash/fp", "lodash"), ("@a/b/c", "@a/b"), ("./x", None), ("/x", None), ("@a", None)]
    got = spark.createDataFrame([(r[0],) for r in rows], "s string").select("s", paths.package_name(F.col("s")).alias("p")).collect()
    assert [tuple(r) for r in got] == rows
    one = lambda v, c: spark.createDataFrame([(v,)], "s string").select(c(F.col("s"))).first()[0]
    assert one("@a/b", paths.mangled_types_package) == "@types/a__b"
    assert one("x/src/a/src/b.ts", paths.normalize_file) == "src/b.ts" and one("q\\w.ts", paths.normalize_file) == "w.ts"
    assert one("@/a/b", lambda c: paths.star_apply(c, "@/*", "src/*")) == "src/a/b" and one("ab", lambda c: paths.star_apply(c, "ab*ba", "x*")) is None
    assert one("/r/a.ts", lambda c: paths.project_relative(c, "/r")) == "a.ts" and one("/q/a.ts", lambda c: paths.project_relative(c, "/r")) == "/q/a.ts"
    assert one("ab\n  cd ef\ngh", lambda c: paths.evidence_line(c, F.lit(6))) == "cd ef"
    assert one("a/node_modules/b.ts", paths.is_source) is False and one("a/b.d.ts", paths.is_source) is False and one("a/b.ts", paths.is_source) is True

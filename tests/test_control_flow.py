"""Dead stores from source text: each case must report or keep silent."""

from __future__ import annotations

import pytest

from plinth.sources.control_flow import Flow, dead_store_findings, lifetime_findings, mutation_findings, pressure_findings
from plinth.sources.ts_parser import parse

CASES = {
    "overwrite chain": ("let x = f(); x = g(); x = h(); use(x);", {(1, "x", "dead-store"), (1, "x", "dead-store-overwrite")}),
    "all branches overwrite": ("let x = 1; if (c) { x = 2; } else { x = 3; } use(x);", {(1, "x", "dead-store")}),
    "one branch overwrites": ("let x = 1; if (c) { x = 2; } use(x);", set()),
    "both arms of try write": ("let x = 1; try { x = f(); } catch { x = 2; } use(x);", {(1, "x", "dead-store")}),
    "catch reads the first": ("let x = 1; try { f(); x = 2; g(); } catch { use(x); } use(x);", set()),
    "fallthrough": ("let x = 0; switch (c) { case 1: x = 1; case 2: use(x); } x = 3; use(x);", set()),
    "closure keeps": ("let x = 1; const g = () => x; x = 2; g();", set()),
    "loop carries": ("let x = 0; while (c()) { use(x); x = f(); }", set()),
    "last write is lost": ("let x = 1; use(x); x = 2;", {(1, "x", "dead-store")}),
    "dead arm is not walked": ("let x = 1; if (false) { use(x); } x = 2; use(x);", {(1, "x", "dead-store")}),
    "shadowing is another variable": ("let x = 1; { let x = 2; use(x); } use(x);", set()),
    "var is hoisted": ("if (c) { var x = 1; } use(x);", set()),
    "never read is not ours": ("let x = 1;", set()),
    "continue and labels": ("let x = 1; outer: for (const a of b) { for (;;) { x = a; continue outer; } } use(x);", set()),
    "destructuring": ("let { a, b } = f(); a = 1; use(a, b);", {(1, "a", "dead-store")}),
}


def test_dead_stores(spark):
    names = list(CASES)
    files = spark.createDataFrame([(n, "function t(c, b) { " + CASES[n][0] + " }") for n in names], "path string, source_text string")
    got: dict = {n: set() for n in names}
    for r in dead_store_findings(files).collect():
        got[r["path"]].add((r["line"], r["var"], r["kind"]))
    want = {n: w for n, (_, w) in CASES.items()}
    assert got == want


@pytest.mark.parametrize("src", ["for (;;) { if (a) break; }", "do { if (a) continue; } while (b)", "x: { break x; }", "try { return 1; } finally { f(); }", "switch (a) { default: break; }"])
def test_every_node_but_handlers_is_reached(src):
    flow = Flow(parse(f"function f(a, b) {{ {src} g(); }}").children[0][1])
    reached, work = {0}, [0]
    while work:
        n = work.pop()
        for s, d, _ in flow.edges:
            if s == n and d not in reached:
                reached.add(d)
                work.append(d)
    assert {d for _, d, _ in flow.edges} <= reached


def test_lifetimes_at_the_bound(spark):
    body = "function f() {{ const a = g();{} use(a); }}"
    files = spark.createDataFrame([("at.ts", body.format("\n" * 30)), ("over.ts", body.format("\n" * 31)), ("two.ts", body.format("\n" * 40 + " const b = 1;" + "\n" * 40 + " use(b);"))], "path string, source_text string")
    got = sorted((r["path"], r["var"], r["lines"], r["burden"]) for r in lifetime_findings(files).collect())
    assert got == [("over.ts", "a", 31, 1), ("two.ts", "a", 80, 2), ("two.ts", "b", 40, 2)]


def test_pressure_and_mutations(spark):
    names = [f"v{i}" for i in range(7)]
    source = "function f() { " + " ".join(f"let {n} = g();\n" for n in names) + "\n" * 40 + f" use({', '.join(names)}); v0 = 1; v0++; v0 += 2; for (const q of v0) use(q); }}"
    files = spark.createDataFrame([("a.ts", source)], "path string, source_text string")
    assert [r["max_live"] for r in pressure_findings(files).collect()] == [7]
    assert pressure_findings(files, max_live=8).count() == 0
    assert [(r["var"], r["writes"]) for r in mutation_findings(files, 2).collect()] == [("v0", 3)]
    assert mutation_findings(files, 3).count() == 0

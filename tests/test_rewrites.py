"""Each rewrite brings two forms of one code together and keeps unlike code apart."""

from __future__ import annotations

import pytest

from plinth.operators import detectors as D
from plinth.sources import facts
from plinth.sources.facts import bound_names, canonical
from plinth.sources.rewrites import normalised
from plinth.sources.ts_parser import parse


def form(body: str) -> str:
    n = normalised(parse(f"function f(a, b, c) {{ {body} }}").children[0][1])
    return canonical(n, bound_names(n))


@pytest.mark.parametrize(
    ("one", "two"),
    [
        ("g(a); return;", "g(a);"),
        ("return !a ? b : c;", "return a ? c : b;"),
        ("return !(a && b);", "return !a || !b;"),
        ("return !(a || !b);", "return !a && b;"),
        ("if (a) { return b; } else return c;", "return a ? b : c;"),
        ("if (!a) { b = 1; } else { b = 2; }", "b = a ? 2 : 1;"),
        ("if (a) g(b); else h(c);", "a ? g(b) : h(c);"),
        ("return a?.x;", "return a != null ? a.x : undefined;"),
        ("return `p${a}q${b}`;", "return 'p' + a + 'q' + b;"),
        ("for (let i = 0; i < a; i++) { g(i); }", "let i = 0; while (i < a) { g(i); i++; }"),
        ("for (;;) g();", "while (true) { g(); }"),
        ("for (b = 0; b < 9; b++) g(b);", "b = 0; while (b < 9) { g(b); b++; }"),
    ],
)
def test_equivalent_forms_meet(one, two):
    assert form(one) == form(two)


@pytest.mark.parametrize(
    ("one", "two"),
    [
        ("g(a); return b;", "g(a);"),
        ("if (a) { return; } g();", "if (a) { } g();"),
        ("return !a ? b : c;", "return a ? b : c;"),
        ("return !(a ?? b);", "return !a ?? !b;"),
        ("if (a) { b = 1; } else { c = 1; }", "b = a ? 1 : 1;"),
        ("if (a) { b += 1; } else { b += 2; }", "b += a ? 1 : 2;"),
        ("if (a) { return b; }", "return a ? b : undefined;"),
        ("return a?.();", "return a != null ? a() : undefined;"),
        ("for (let i = 0; i < a; i++) { if (b) continue; g(i); }", "let i = 0; while (i < a) { if (b) continue; g(i); i++; }"),
        ("return () => { g(); return; };", "return () => { g(); };"),
        ("return `${a}`;", "return a;"),
    ],
)
def test_unlike_forms_stay_apart(one, two):
    assert form(one) != form(two)


def test_inner_continue_does_not_stop_the_loop_rule():
    assert form("for (let i = 0; i < a; i++) { for (const x of b) { if (x) continue; } }") == form("let i = 0; while (i < a) { for (const x of b) { if (x) continue; } i++; }")


def test_normalised_tier(spark):
    long = "const s = {0} + 1; const t = s * 2; g(s, t, {0}); "
    src = {
        "a.ts": "function one(p, q) { " + long.format("p") + "if (q) { return s; } else { return t; } }",
        "b.ts": "function two(x, y) { " + long.format("x") + "return y ? s : t; }",
        "c.ts": "interface I { a: string; b(): void; c: number; d: number; e: number } type T = { a: string; b(): void; c: number; d: number; e: number };",
    }
    files = spark.createDataFrame(list(src.items()), "path string, source_text string")
    rows = D.clone_tiers(facts.fingerprints(files, min_size=1)).collect()
    assert sorted((r["tier"], r["name"]) for r in rows) == [("normalized", "I"), ("normalized", "T"), ("normalized", "one"), ("normalized", "two")]
    unlike = spark.createDataFrame([("a.ts", "interface I { a: string } interface J { a: number } interface K { a:  string }")], "path string, source_text string")
    assert sorted((r["tier"], r["name"]) for r in D.clone_tiers(facts.fingerprints(unlike, min_size=1)).collect()) == [("exact", "I"), ("exact", "K")]
    both = dict(src, **{"d.ts": src["a.ts"].replace("one", "three")})
    rows = D.clone_tiers(facts.fingerprints(spark.createDataFrame(list(both.items()), "path string, source_text string"), min_size=1)).collect()
    assert {r["name"] for r in rows if r["tier"] == "exact"} >= {"one", "three"} and not [r for r in rows if r["tier"] == "normalized" and r["name"] == "two"]

"""Anti-unification on small sources."""

from __future__ import annotations

import pytest

from plinth.operators.unify import anti_unify, classify, file_pairs, suggested_params
from plinth.sources.ts_parser import parse

BASE = "function f(a) { const s = a + 1; if (s > 3) { return g(s); } return s; }"


@pytest.mark.parametrize(
    ("other", "kind"),
    [
        (BASE, "rename-only"),
        (BASE.replace("f(a)", "h(b)").replace("a +", "b +"), "rename-only"),
        (BASE.replace("> 3", "> 5"), "literal-variant"),
        (BASE.replace("> 3", "> 5").replace("g(s)", "k(s)"), "mixed"),
        (BASE.replace("return g(s);", "return g(s) + 1;"), "structural-diff"),
        (BASE.replace("return s; }", "use(s); return s; }"), "structural-diff"),
    ],
)
def test_classes(other, kind):
    g = anti_unify(parse(BASE), parse(other))
    assert classify(g) == kind
    assert 0 < g.similarity <= 1 and g.shared <= min(g.left_size, g.right_size)


def test_equal_trees_share_all():
    g = anti_unify(parse(BASE), parse(BASE))
    assert g.similarity == 1 and not g.variables


def test_alignment_of_unlike_lists():
    g = anti_unify(parse("a(); b = 1; c();"), parse("a(); c();"))
    assert {k for k, _, _ in g.variables} == {"structural"} and ("structural", "ExpressionStatement", "") in g.variables


def test_params_only_if_all_agree():
    one = anti_unify(parse(BASE), parse(BASE.replace("> 3", "> 5")))
    two = anti_unify(parse(BASE), parse(BASE.replace("> 3", "> 7")))
    odd = anti_unify(parse(BASE), parse(BASE.replace("return s;", "return s + s;")))
    assert suggested_params([one, two]) == [("literal", "3", "5")]
    assert suggested_params([one, odd]) is None


def test_pairs_of_a_file(spark):
    files = spark.createDataFrame([("a.ts", BASE + BASE.replace("> 3", "> 5") + " function z() { while (q()) { r(); s(); t(u, v, w); } }")], "path string, source_text string")
    assert [(r["diff"], r["n_variables"]) for r in file_pairs(files).collect()] == [("literal-variant", 1)]

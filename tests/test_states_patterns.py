"""Coupled states and pattern search over sources of our own."""

from __future__ import annotations

import json

import pytest

from plinth.sources.patterns import find_pattern
from plinth.sources.states import temporal_couplings
from plinth.sources.ts_parser import ParseError


def made(spark, **sources):
    return spark.createDataFrame([(k + ".ts", v) for k, v in sources.items()], "path string, source_text string")


def test_temporal_couplings(spark):
    files = made(
        spark,
        open="let db = null;\nlet count = 0;\nexport function init() { db = 1; }\nexport function get() { return db; }\nexport function add() { count += 1; }",
        guarded="let c;\nexport function set(v) { c = v; }\nexport function read() { if (!c) { throw new Error('x'); } return c; }",
        held="let h;\nexport function start() { h = 1; }\nexport function use() { return h; }",
        caller="import { start, use } from './held'; import { get } from './open'; function main() { start(); return use(); } function other() { return get(); }",
        own="let s;\nexport function put() { s = 1; }\nexport function local(s) { return s; }",
        cls="export class Box { value = 0; constructor() { this.value = 1; } fill(v) { this.value = v; } peek() { return this.value; } }",
        never="const k = 1;\nexport function f() { return k; }",
    )
    got = {(r["path"], r["line"], r["state"], r["writers"], r["readers"]) for r in temporal_couplings(files).collect()}
    assert got == {("open.ts", 1, "db", 1, 1), ("cls.ts", 1, "Box.value", 1, 1)}


def test_patterns(spark):
    files = made(spark, a="if (x) { y = f(1, 2); }\nz = g(a.b, a.b); z = g(a.b, a.c);", b="f(); f(1); h(() => { return 1; });", bad="const = 1")
    found = lambda p: sorted(((r["path"], r["line"], json.loads(r["bindings"])) for r in find_pattern(files, p).collect()), key=repr)
    assert found("f($$args)") == [("a.ts", 1, {"$$args": "1, 2"}), ("b.ts", 1, {"$$args": ""}), ("b.ts", 1, {"$$args": "1"})]
    assert found("g($x, $x)") == [("a.ts", 2, {"$x": "a.b"})]
    assert found("if ($t) { $$body }") == [("a.ts", 1, {"$$body": "y = f(1, 2);", "$t": "x"})]
    assert found("nothing($x)") == []
    with pytest.raises(ParseError):
        find_pattern(files, "f(")

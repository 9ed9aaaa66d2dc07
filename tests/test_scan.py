"""A whole scan."""

from __future__ import annotations

from plinth.scan import Options, scan


def test_scan(spark):
    clone = "export function add(a, b) { const s = a + b; if (s > 3) { return s * 2; } return s; }"
    src = {
        "a.ts": clone + " function f(x) { let y = 1; y = x; if (y) { if (x) { g(); h(); k(); } } }",
        "b.ts": clone + " import { add } from './a'; import './gone'; try { add(1, 2); } catch {}",
        "big.ts": "x();\n" * 30,
        "bad.ts": "const = 1",
    }
    files = spark.createDataFrame(list(src.items()), "path string, source_text string")
    r = scan(spark, files, Options(max_lines=20))
    got = {(x["category"], x["kind"], x["file"]) for x in r.findings.collect()}
    assert {("waste", "dead-store-overwrite", "a.ts"), ("waste", "dead-store", "a.ts")} & got
    assert {("duplicates", "exact", "a.ts"), ("duplicates", "exact", "b.ts"), ("collapsible-if", "collapsible-if", "a.ts"), ("dependencies", "unresolved-import", "b.ts"), ("error-flow", "empty-catch", "b.ts"), ("giant-file", "giant-file", "big.ts")} <= got
    assert not [x for x in got if x[2] == "bad.ts"] and [e["path"] for e in r.errors.collect()] == ["bad.ts"]
    assert "barrel" not in r.detectors and {c["code"] for c in r.catalog.collect()} >= {"CLONE", "GIANT_FILE"}


def test_scan_of_one_detector_and_no_files(spark):
    none = spark.createDataFrame([], "path string, source_text string")
    r = scan(spark, none, Options(only=("giant-file",)))
    assert r.detectors == ["giant-file"] and r.findings.count() == 0
    assert scan(spark, none).findings.count() == 0


def test_lint_gathers_all_rules(spark):
    from plinth.scan import lint

    src = {"a.ts": "import { b, c } from './b'; globalThis.x = b; export class A {} export class B {}", "b.ts": "export {}", "c.spec.ts": "describe('other', () => {}); let o: object;"}
    got = {(r["file"], r["kind"]) for r in lint(spark, spark.createDataFrame(list(src.items()), "path string, source_text string")).collect()}
    assert got == {
        ("a.ts", "unused-imports"), ("a.ts", "no-globalthis-mutation"), ("a.ts", "single-exported-class"), ("a.ts", "test-unit-file-mapping"), ("b.ts", "no-tombstone"),
        ("c.spec.ts", "test-unit-file-mapping"), ("c.spec.ts", "test-describe-sut-name"), ("c.spec.ts", "no-umbrella-types"),
    }


def test_scan_tells_states_and_mutations(spark):
    src = {"a.ts": "let db; export function init() { db = 1; } export function get() { return db; } export function many(x) { let y = 0; y = x; y += 1; y++; return y; }"}
    r = scan(spark, spark.createDataFrame(list(src.items()), "path string, source_text string"), Options(only=("temporal-coupling", "variable-lifetime"), max_mutations=2))
    assert {(x["kind"], x["label"]) for x in r.findings.collect()} == {("temporal-coupling", "db"), ("mutation-density", "y is written 3 times")}


def test_command_line(spark, tmp_path, capsys):
    import json

    from plinth.__main__ import main

    code = tmp_path / "code"
    code.mkdir()
    (code / "a.ts").write_text("f(1); try { f(2); } catch {}")
    out = str(tmp_path / "out")
    assert main(["scan", str(code), "--only", "error-flow", "--out", out], spark) == 1
    told = json.loads(capsys.readouterr().out)
    assert told["total"] == 1 and told["findings"][0]["kind"] == "empty-catch" and spark.read.json(out).count() == 1
    assert main(["find", "f($x)", str(code)], spark) == 0 and len(capsys.readouterr().out.splitlines()) == 2
    assert main(["scan", str(code), "--only", "none-such"], spark) == 2
    assert main(["scan", str(code), "--root", str(tmp_path / "else")], spark) == 2


def test_shared_folder_must_be_named_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    import pytest

    from plinth.operators.tables import shared_dir

    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None))
    with pytest.raises(RuntimeError, match="checkpoint"):
        shared_dir(cluster)

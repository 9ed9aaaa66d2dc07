"""Projects and module resolution on small sources of our own."""

from __future__ import annotations

import json

import pytest

from plinth.operators import detectors as D
from plinth.operators import modules as M
from plinth.sources import facts, projects


@pytest.fixture(scope="module")
def project(spark):
    """A workspace of two packages with path mappings, re-export chains and installed packages."""
    sources = {
        "package.json": json.dumps({"name": "root", "workspaces": ["packages/*"]}),
        "tsconfig.json": '{ "extends": "./base", "compilerOptions": { "paths": { "@lib/*": ["packages/lib/src/*"], "@exact": ["packages/lib/src/one.ts"], }, "types": ["@scope/amb/x"] } } // end',
        "base.json": json.dumps({"compilerOptions": {"baseUrl": ".", "paths": {"@lib/*": ["nowhere/*"], "@l*": ["no/*"]}}}),
        "packages/app/package.json": json.dumps({"name": "app", "main": "./src/main.ts", "dependencies": {"left": "1", "idle": "1", "tool": "1", "hidden": "1"}, "devDependencies": {"@types/left": "1", "@scope/amb": "1"}, "peerDependencies": {"peer": "1"}}),
        "packages/lib/package.json": json.dumps({"name": "@w/lib"}),
        "node_modules/idle/package.json": json.dumps({"name": "idle"}),
        "node_modules/tool/package.json": json.dumps({"name": "tool", "bin": {"t": "t.js"}}),
        "node_modules/@scope/amb/package.json": json.dumps({"name": "@scope/amb"}),
        "packages/app/src/main.ts": "import { one } from '@exact'; import { two } from '@lib/two.js'; import left from 'left/x'; import peer from 'peer'; import gone from 'gone'; import fs from 'node:fs'; import { deep } from '@w/lib'; import './missing'; import '@lib/nothing'; one(two, left, peer, gone, fs, deep);",
        "packages/lib/src/one.ts": "export function one() {} export function unusedOne() {}",
        "packages/lib/src/two.ts": "export const two = 2;",
        "packages/lib/src/index.ts": "export * from './far'; export { low as high } from './far'; export { one } from './one';",
        "packages/lib/src/far.ts": "export const deep = 1; export const low = 2; export const never = 3;",
        "packages/lib/src/again.ts": "import { two } from './two'; export { two };",
        "packages/lib/src/ring.ts": "export { a } from './ring2';",
        "packages/lib/src/ring2.ts": "export { a } from './ring';",
    }
    texts = spark.createDataFrame(list(sources.items()), "path string, text string")
    code = texts.where("path like '%.ts'").withColumnRenamed("text", "source_text")
    manifest = projects.manifests(texts.where("path like '%package.json'")).cache()
    own = manifest.where("dir not like 'node_modules%'")
    configs = projects.tsconfigs(texts.where("path like '%.json' and path not like '%package.json'"))
    resolved = M.resolve(facts.relations(code), code, configs, projects.workspaces(spark, own)).cache()
    return {"texts": texts, "code": code, "manifest": manifest, "own": own, "resolved": resolved, "configs": configs}


def pairs(df):
    return {tuple(r) for r in df.collect()}


def test_manifests_and_workspaces(spark, project):
    rows = pairs(project["manifest"].select("dir", "field", "key", "value"))
    assert {("packages/app", "dependencies", "left", "1"), ("packages/app", "entry", None, "packages/app/src/main.ts"), ("", "workspace", None, "packages/*"), ("node_modules/tool", "bin", None, "t.js")} <= rows
    assert pairs(projects.workspaces(spark, project["own"])) == {("app", "packages/app"), ("@w/lib", "packages/lib")}
    pnpm = spark.createDataFrame([("pnpm-workspace.yaml", "packages:\n  - 'packages/l*'\n# c\n  - \"x\"\nother:\n  - y")], "path string, text string")
    assert pairs(projects.workspaces(spark, project["own"].where("field <> 'workspace'"), pnpm)) == {("@w/lib", "packages/lib")}
    assert projects.project_root(project["manifest"], "packages/app/src", "left") == "packages/app"


def test_configs_inherit_and_rank(project):
    rows = {(r["pattern"], r["rank"], tuple(r["targets"])) for r in project["configs"].collect()}
    assert rows == {("@exact", 1, ("packages/lib/src/one.ts",)), ("@lib/*", 2, ("packages/lib/src/*",)), ("@l*", 3, ("no/*",))}
    assert {(r["dir"], r["base"]) for r in project["configs"].collect()} == {("", "")}
    assert pairs(projects.ambient_types(project["texts"].where("path = 'tsconfig.json'"))) == {("", "@scope/amb/x"), ("", "@scope/amb"), ("", "@types/scope__amb")}


def test_specifiers_resolve_in_order(project):
    got = {r["specifier"]: (r["target"], r["how"]) for r in project["resolved"].where("path like '%main.ts'").collect()}
    assert got == {
        "@exact": ("packages/lib/src/one.ts", "alias"), "@lib/two.js": ("packages/lib/src/two.ts", "alias"), "left/x": (None, "package"), "peer": (None, "package"), "gone": (None, "package"),
        "node:fs": (None, "package"), "@w/lib": ("packages/lib/src/index.ts", "workspace"), "./missing": (None, "relative"), "@lib/nothing": (None, "alias"),
    }
    assert pairs(M.unresolved(project["resolved"]).select("specifier")) == {("./missing",), ("@lib/nothing",)}


def test_origins_follow_reexports(project):
    got = {(r["path"].split("/")[-1], r["name"]): (r["origin_path"].split("/")[-1], r["origin_name"]) for r in M.origins(project["resolved"]).collect()}
    assert got["index.ts", "deep"] == ("far.ts", "deep") and got["index.ts", "high"] == ("far.ts", "low") and got["index.ts", "one"] == ("one.ts", "one") and got["again.ts", "two"] == ("two.ts", "two")
    assert not [k for k in got if k[0].startswith("ring")]


def test_dead_exports_know_aliases_and_chains(spark, project):
    none = spark.createDataFrame([], "path string")
    assert {(p.split("/")[-1], n) for p, n in pairs(M.dead_exports(project["resolved"], none))} == {("one.ts", "unusedOne")}
    entry = spark.createDataFrame([("packages/lib/src/index.ts",)], "path string")
    assert {(p.split("/")[-1], n) for p, n in pairs(M.dead_exports(project["resolved"], entry))} == {("one.ts", "unusedOne")}
    main = spark.createDataFrame([("packages/app/src/main.ts",)], "path string")
    unused = {r["path"].split("/")[-1] for r in D.unused_files(project["resolved"], project["code"], main).collect()}
    assert unused == {"again.ts", "ring.ts", "ring2.ts"}


def test_reexports_that_nobody_uses_are_no_use(spark):
    code = {"main.ts": "import { kept } from './barrel'; kept();", "barrel.ts": "export { a as kept, b, c } from './more';", "more.ts": "export { a, b } from './own'; export const c = 1;", "own.ts": "export const a = 1; export const b = 2;"}
    files = spark.createDataFrame(list(code.items()), "path string, source_text string")
    resolved = M.resolve(facts.relations(files), files)
    entry = spark.createDataFrame([("main.ts",)], "path string")
    assert pairs(M.dead_exports(resolved, entry)) == {("own.ts", "b"), ("more.ts", "c")}
    assert pairs(M.dead_exports(resolved, entry, entry.selectExpr("'own.ts' AS path"))) == {("more.ts", "c")}


def test_packages(project):
    assert {p for _, p in pairs(M.unlisted_dependencies(project["resolved"], project["own"]))} == {"gone"}
    installed = M.installed_packages(project["manifest"])
    assert pairs(installed) == {("", "idle", False), ("", "tool", True), ("", "@scope/amb", False)}
    assert pairs(M.unused_dependencies(project["resolved"], project["own"], installed)) == {("packages/app", "idle"), ("packages/app", "@scope/amb")}


def test_duplicate_exports_and_layers(project):
    assert pairs(M.duplicate_exports(project["resolved"])) == {("two", "packages/lib/src/two.ts", 2, "packages/lib/src/again.ts")}
    layers = [("app", "packages/app/**"), ("lib", "packages/lib/**")]
    found = M.layer_violations(project["resolved"], layers, {"lib": ["app"]})
    assert {r["from_layer"] for r in found.collect()} == {"app"} and found.count() == 3
    assert M.layer_violations(project["resolved"], layers, {"app": ["lib"]}).count() == 0


def test_trace(project):
    nodes, edges = M.trace(project["resolved"], "packages/lib/src/far.ts", "deep")
    assert {(r["path"].split("/")[-1], r["kind"], r["depth"]) for r in nodes.collect()} == {("far.ts", "symbol", 0), ("index.ts", "symbol", 1), ("main.ts", "file", 2)}
    assert edges.count() == 2
    assert M.trace(project["resolved"], "none.ts", "x")[1].count() == 0


def test_cross_module_reexports_and_cuts(spark):
    code = {"a/index.ts": "export { x } from '../b/x'; export { y } from './y';", "a/y.ts": "export const y = 1; import '../b/x';", "b/x.ts": "export const x = 1; import { y } from '../a/y'; import '../c'; x(y);", "c.ts": ""}
    files = spark.createDataFrame(list(code.items()), "path string, source_text string")
    resolved = M.resolve(facts.relations(files), files)
    assert pairs(M.cross_module_reexports(resolved)) == {("a/index.ts", "../b/x", "b/x.ts")}
    cuts = M.cycle_cuts(resolved, D.circular_dependencies(resolved)).collect()
    assert [(r["cut_from"], r["cut_to"]) for r in cuts] == [("a/y.ts", "b/x.ts")]


def test_scan_of_a_project(spark, tmp_path):
    from plinth.scan import Options, read_project, scan
    from plinth.sources.files import read_sources

    tree = {
        "package.json": json.dumps({"name": "top", "main": "./src/main.js", "dependencies": {"idle": "1", "used": "1"}}),
        "tsconfig.json": json.dumps({"compilerOptions": {"baseUrl": "src", "paths": {"~/*": ["./*"]}}}),
        "node_modules/idle/package.json": json.dumps({"name": "idle"}), "node_modules/used/package.json": json.dumps({"name": "used"}),
        "src/main.ts": "import { a } from '~/a'; import { b } from 'b'; import u from 'used'; import x from 'unlisted'; a(b, u, x);",
        "src/a.ts": "export function a(p) { return p; } export function dead(p) { return p + 1; }", "src/b.ts": "import { ui } from './ui/w'; export const b = ui;", "src/ui/w.ts": "import { b } from '../b'; export const ui = () => b;", "src/lone.ts": "export const z = 1;",
    }
    for name, text in tree.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    root = str(tmp_path)
    report = scan(spark, read_sources(spark, [root]), Options(only=("dependencies",), layers=(("ui", "**/ui/**"), ("core", "**/src/*"))), read_project(spark, [root]))
    got = {(r["kind"], r["file"].removeprefix(root + "/"), r["label"].replace(root + "/", "")) for r in report.findings.collect()}
    assert got == {
        ("circular-dependency", "src/b.ts", "src/b.ts -> src/ui/w.ts"), ("unlisted-dependency", "src/main.ts", "unlisted"), ("unused-dependency", "package.json", "idle"), ("dead-export", "src/a.ts", "dead"),
        ("unused-file", "src/lone.ts", "no entry reaches it"), ("layer-violation", "src/b.ts", "core -> ui"), ("layer-violation", "src/ui/w.ts", "ui -> core"),
    }


def test_no_project_facts(spark):
    none = spark.createDataFrame([], "path string, text string")
    assert projects.manifests(none).count() == projects.tsconfigs(none).count() == 0

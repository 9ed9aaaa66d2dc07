"""Sources, stores and configuration."""

from __future__ import annotations

import json

import pytest

from plinth.operators.tables import scratch
from plinth.plans import queries
from plinth.sources import files, stores
from table_paths import SMALL


def test_sources_are_listed_and_filtered(spark, tmp_path):
    for name in ("a.ts", "b.d.ts", "c.js", "node_modules/x.ts", "sub/d.ts", "gen/e.ts"):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_text(f"// {name}")
    got = files.read_sources(spark, [str(tmp_path)], exclude=["**/gen/**"])
    assert sorted(r["path"].removeprefix(f"{tmp_path}/") for r in got.collect()) == ["a.ts", "sub/d.ts"]
    assert files.outside_root(got, str(tmp_path / "sub")) == [f"{tmp_path}/a.ts"]


def test_jsonc():
    assert files.parse_jsonc('{"a": "//x", /* c */ "b": [1, 2,], // end\n}') == {"a": "//x", "b": [1, 2]}


def test_detector_selection():
    assert "barrel" not in files.select_detectors() and len(files.select_detectors()) == 11
    assert "barrel" in files.select_detectors({"barrel": {}}) and "waste" not in files.select_detectors({"waste": False})
    assert files.select_detectors({"barrel": False, "waste": False}, only=["barrel", "waste"]) == ["waste"]
    with pytest.raises(ValueError, match="nope"):
        files.select_detectors(only=["nope"])


def test_kv_store(spark):
    kv = stores.KvStore(spark, scratch(spark, "kv"))
    assert kv.keys() == [] and kv.read("a") is None
    kv.write("a", {"x": 1})
    kv.write("b", 2)
    kv.write("a", {"x": 3})
    assert kv.keys() == ["a", "b"] and kv.read("a") == {"x": 3}
    made = {r["store_key"]: r for r in kv.latest().collect()}
    assert made["a"]["created_at"] < made["b"]["created_at"] < made["a"]["updated_at"]
    kv.delete("b")
    assert kv.compact(scratch(spark, "kv")).keys() == ["a"]
    assert kv.clear() and not kv.clear()


def test_artifacts_are_made_once(spark):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    store = stores.ArtifactStore(spark, scratch(spark, "artifacts"))
    assert store.get("k", "d") is None
    assert store.get_or_make("k", "d", make).count() == store.get_or_make("k", "d", make).count() == 3 and made == [1]


def test_report_and_exit_codes(spark):
    assert [stores.exit_code(*x) for x in ((0, 0), (0, 3), (1, 3))] == [0, 1, 2]
    f = spark.createDataFrame([("w-1", "W", "a.ts", 1)], "id string, code string, file string, line long")
    out = json.loads(stores.report_json(f, spark.createDataFrame([("W", "why")], "code string, cause string"), ["waste"]))
    assert out["total"] == 1 and out["catalog"]["W"]["cause"] == "why"


def test_lcs_query_equals_brute_force(spark):
    from plinth.functions.sequences import lcs_pairs

    rows = {(r["conv_id"], r["turn"]): r["lcs"] for r in queries()["lcs_similarity"](spark, SMALL).collect()}
    conv = {(r["conv_id"], r["turn"]): r["text"].lower().split() for r in spark.read.parquet(f"{SMALL}/conversations.parquet").collect()}
    some = sorted(rows)[:40]
    assert some and all(rows[c, t] == len(lcs_pairs(conv[c, t], conv[c, t + 1])) for c, t in some)


def test_scratch_tables_can_be_cleared(spark):
    from plinth.operators import tables

    df = tables.written(spark.range(3).toDF("id"), "some")
    assert df.count() == 3
    assert tables.scratch(spark, "x").rsplit("/", 1)[0].endswith(spark.sparkContext.applicationId)
    assert tables.clear_scratch(spark) and not tables.clear_scratch(spark)

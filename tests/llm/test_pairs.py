"""Operators 2 and 3 and the pipeline against brute force."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from table_paths import MIDDLE, SMALL
from pyspark.sql import functions as F

from plinth.llm import search, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_print(text):
    import xxhash

    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass"), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints, radius=4):
    keys, a = sorted(prints), None
    a = np.array([prints[k] for k in keys], np.uint64)
    up = list(range(len(keys)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(keys)):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= radius) + i + 1:
            x, y = root(i), root(int(j))
            up[max(x, y)] = min(x, y)
    return {k: keys[root(i)] for i, k in enumerate(keys)}


def brute_similar(texts, words=5, radius=11, most=19):
    """Groups of texts by fingerprint and check word, all pairs compared."""
    import xxhash

    def prints(text):
        found = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        shingles = [" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))] if found else []
        hashes = [xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass"), 42) for s in shingles]
        other = []
        for h in hashes:
            h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 % 2**64
            h = (h ^ h >> 27) * 0x94D049BB133111EB % 2**64
            other.append(h ^ h >> 31)
        return [sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) for hs in (hashes, other)]

    keys = sorted(texts)
    a, b = np.array([prints(texts[k]) for k in keys], np.uint64).reshape(-1, 2).T
    up = {k: k for k in keys}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, k in enumerate(keys):
        near = np.bitwise_count(a[i + 1 :] ^ a[i])
        for j in np.flatnonzero((near <= radius) & (near + np.bitwise_count(b[i + 1 :] ^ b[i]) <= most)) + i + 1:
            x, y = root(k), root(keys[j])
            up[max(x, y)] = min(x, y)
    return {k: root(k) for k in keys}


def test_near_dedup_finds_similar_texts(spark):
    """Of pairs of different texts whose five-word shingles are 0.8 alike or more, nine in ten are grouped; unlike ones are not."""
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "text")
    prints = simhash.fingerprints(docs, 5, checked=True)
    assert simhash.bits_apart(0.8, 128) == 19
    groups = {r["doc_id"]: r["component_id"] for r in simhash.near_components(prints, 11, most=19).collect()}
    texts = {r["doc_id"]: WORD.findall(r["text"].lower()) for r in docs.collect()}
    sets = {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for d, w in texts.items() if len(w) >= 20}
    where: dict = {}
    for d, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(d)
    shared: Counter = Counter()
    for at in where.values():
        if len(at) < 200:
            shared.update((x, y) for i, x in enumerate(at) for y in at[i + 1 :])
    alike = {p: n / (len(sets[p[0]]) + len(sets[p[1]]) - n) for p, n in shared.items()}
    near = [p for p, j in alike.items() if 0.8 <= j < 1]
    found = sum(groups[x] == groups[y] for x, y in near)
    assert len(near) >= 10 and found >= 0.9 * len(near), (found, len(near))
    wrong = [p for p, j in alike.items() if j < 0.5 and groups[p[0]] == groups[p[1]]]
    lone = sum(len({d for d in sets if groups[d] == g}) > 1 for g in set(groups.values()))
    assert not wrong and lone > 0


def test_op3_equals_brute_force(spark, texts):
    prints = {d: brute_print(t) for d, t in zip(texts.doc_id, texts.text, strict=True)}
    groups = brute_groups(prints)
    rows = simhash.op3_simhash_groups(spark, SMALL).collect()
    assert {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in rows} == {d: (prints[d], groups[d]) for d in prints}


@pytest.mark.parametrize("parts", [2, 3, 4, 5])
def test_op3_any_partitioning_finds_all_links(spark, parts, monkeypatch):
    rng = np.random.default_rng(parts)
    prints = [0, 0, 1, 7]
    for base in rng.integers(0, 2**63, 25):
        x = int(base) & 0xFFFF0000FFFF00FF
        for _ in range(int(rng.integers(1, 30))):
            y = x
            for bit in rng.integers(0, 64, int(rng.integers(1, 7))):
                y ^= 1 << int(bit)
            prints.append(y)
            x = y if rng.random() < 0.5 else x
    df = spark.createDataFrame(pd.DataFrame({"doc_id": np.arange(len(prints)), "fp": np.array(prints, np.uint64).view(np.int64)})).selectExpr("*", "0L AS check", "fp AS node")
    monkeypatch.setattr(simhash, "count_parts", lambda n, r: parts)
    monkeypatch.setattr(simhash, "BLOCK", 16)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_components(df).collect()}
    assert got == brute_groups(dict(enumerate(prints)))


def test_op3_allotment_is_optimal():
    import itertools

    rng = np.random.default_rng(0)
    costs = rng.random((4, 4, 6)) * 10
    costs[:, 0] = 0
    got = simhash.allot(costs, 1)
    for n in range(6):
        best = min((sum(costs[i, t + 1, n] for i, t in enumerate(ts)) for ts in itertools.product((-1, 0, 1, 2), repeat=4) if sum(ts) == 1))
        assert sum(got[:, n]) == 1 and sum(costs[i, got[i, n] + 1, n] for i in range(4)) == pytest.approx(best)


def test_op3_neighbour_counts():
    hist = np.random.default_rng(1).integers(0, 9, 64).astype(float)
    near = simhash.within(hist, 3)
    for v in (0, 13, 63):
        for d in range(4):
            assert near[d, v] == pytest.approx(sum(hist[w] for w in range(64) if (v ^ w).bit_count() == d))


def test_op3_edges(edge_docs, empty_docs):
    rows = simhash.simhash_components(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    zero = {r["component_id"] for r in rows if r["fp"] == 0}
    assert zero == {1} and {r["component_id"] for r in rows if r["doc_id"] == 4} == {4}
    assert simhash.simhash_components(empty_docs).count() == 0
    one = simhash.keep_one_each(edge_docs)
    assert one.columns == edge_docs.columns and one.count() == len({r["component_id"] for r in rows})
    assert simhash.keep_one_each(empty_docs).count() == 0


def test_op2_equals_sql(same):
    assert same(search.op2_bm25_search, search.OP2_SQL, SMALL) > 0


def test_op2_shards_and_blocks_change_nothing(same, monkeypatch):
    monkeypatch.setattr(search, "SHARD_DOCS", 150)
    monkeypatch.setattr(search, "QUERY_BLOCK", 7)
    assert same(search.op2_bm25_search, search.OP2_SQL, MIDDLE) > 0


def test_op2_prunes_blocks(spark):
    docs = spark.createDataFrame([(i, f"common word{i % 40} rare{i}") for i in range(2000)], "doc_id long, text string")
    rows = search.search(docs, F.col("doc_id") == 0, k=3).collect()
    assert [(r["rank"], r["doc_id"]) for r in sorted(rows)] == [(1, 0), (2, 40), (3, 80)]


def test_op2_edges(edge_docs, empty_docs):
    rows = search.search(edge_docs, F.lit(True), k=2).collect()
    assert {r["query_id"] for r in rows} == {4, 7, 8}
    # Three rows have the text of 4: the one without a key sorts first, then the two that repeat.
    assert sorted((r["rank"], r["doc_id"]) for r in rows if r["query_id"] == 4) == [(1, None), (2, 4)]
    assert search.search(empty_docs, F.lit(True)).count() == 0


def test_pipeline_equals_brute_force(spark):
    """Each stage is judged on its own input; the last rows equal what brute force makes of them."""
    import corpus_pipeline as C
    from plinth.llm import mixing, quality, secrets
    from plinth.llm.spans import replaced
    from plinth.llm.wordbpe import bpe, default_vocabulary
    from plinth.operators.tables import written

    docs, seen = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for name, stage in C.STAGES:
        docs = written(stage(spark, docs, SMALL), "test-stage")
        seen.append((name, docs.toPandas()))
    good = {r["doc_id"] for r in quality.op1_quality_rules(spark, SMALL).where("kept").collect()}
    one, two, three, four, five = (df for _, df in seen)
    assert set(one.doc_id) == good and list(one.columns) == ["doc_id", "text", "lang", "source", "n_chars"]
    groups = brute_similar(dict(zip(one.doc_id, one.text, strict=True)))
    assert sorted(two.doc_id) == sorted(set(groups.values()))
    want = {d: replaced(t, secrets.find_secrets(t)[1], "[secret]") for d, t in zip(two.doc_id, two.text, strict=True)}
    assert dict(zip(three.doc_id, three.text, strict=True)) == want
    assert (three.n_chars == three.text.str.len()).all() or three.n_chars.notna().all()
    copies = {r["doc_id"]: len(r["shards"]) for r in mixing.mix_sizes(spark.createDataFrame(three)).collect()}
    assert four.groupby("doc_id").size().to_dict() == {d: n for d, n in copies.items() if n}
    coder = bpe(default_vocabulary())
    texts = dict(zip(four.doc_id, four.text, strict=True))
    assert len(five) == len(four) and all(list(i) == coder.encode(texts[d]) for d, i in zip(five.doc_id, five.ids, strict=True))
    run = C.run(spark, SMALL).select("doc_id", "n_tokens").toPandas()
    assert sorted(zip(run.doc_id, run.n_tokens, strict=True)) == sorted(zip(five.doc_id, five.n_tokens, strict=True))


def test_pipeline_stages_at_their_edges(spark, edge_docs, empty_docs):
    import corpus_pipeline as C

    clash = edge_docs.selectExpr("*", "1 AS words", "2 AS kid", "3 AS h", "'a' AS skey", "4 AS block", "5 AS shard", "6 AS `order`", "7 AS id", "8 AS size", "9 AS `a.b`", "'t' AS n_tokens")
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, clash, SMALL)
        assert out.columns == clash.columns, name
        assert out.count() <= 3 * clash.count()
        assert stage(spark, empty_docs, SMALL).count() == 0
    assert C.STAGES[-1][1](spark, clash, SMALL).count() == clash.count()
    assert C.STAGES[-1][1](spark, empty_docs, SMALL).count() == 0
    kept = C.quality_rules(spark, clash, SMALL).collect()
    assert kept == []  # the long text repeats itself, the others are short
    assert sorted(r["doc_id"] is None for r in C.near_dedup(spark, clash, SMALL).collect()) == [False] * 4
    assert C.secret_scan(spark, clash, SMALL).count() == clash.count()


def test_op2_sends_texts_once(spark, monkeypatch):
    seen = []
    whole = search.dealt
    monkeypatch.setattr(search, "dealt", lambda frame, blocks, lots: seen.append((frame.count(), blocks.count(), lots, whole(frame, blocks, lots))) or seen[-1][3])
    monkeypatch.setattr(search, "QUERY_BLOCK", 5)
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    search.search(docs, F.col("doc_id") % 50 == 0)
    n, blocks, lots, stream = seen[0]
    rows = stream.groupBy("kind").count().collect()
    assert blocks >= 3 and {r["kind"]: r["count"] for r in rows} == {0: n, 1: blocks * lots}
    monkeypatch.setattr(search, "LOT_POSTS", 1000)
    search.search(docs, F.col("doc_id") % 50 == 0)
    assert seen[1][2] > 10 * lots  # lots grow with the postings


def test_op2_word_hashes_do_not_depend_on_pieces(monkeypatch):
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abAB é "), rng.integers(1, 9))) for _ in range(3000)]
    text = " ".join(words) + "\n" + "x" * 5000 + "\t\x0b"
    want = Counter(w.decode() for w in text.encode().lower().split())
    sizes = set()
    for piece in (7, 100, 1 << 18):
        monkeypatch.setattr(search, "PIECE", piece)
        hashes, counts, n = search.vectors([None, text, "", "a b a"])
        assert n.tolist() == [0, len(want), 0, 2] and sorted(counts[: len(want)].tolist()) == sorted(want.values())
        sizes.add(hashes.tobytes())
    assert len(sizes) == 1


def test_op2_many_equal_documents(spark):
    rows = [(i, "one and the same text of some words") for i in range(400)] + [(1000 + i, f"one other text {i}") for i in range(50)]
    found = search.search(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id").isin(3, 1007), k=5).collect()
    got = {(r["query_id"], r["rank"]): r["doc_id"] for r in found}
    assert [got[3, k] for k in range(1, 6)] == [0, 1, 2, 3, 4] and got[1007, 1] == 1007


def test_op2_rows_of_queries_stay_small(spark, monkeypatch):
    seen, plans, whole = [], [], search.dealt

    def dealt(frame, blocks, lots):
        seen.append(blocks.selectExpr("length(ids) div 8 AS queries", "length(places) div 4 AS terms").collect())
        out = whole(frame, blocks, lots)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(search, "dealt", dealt)
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(0, 20 + id % 50), i -> concat('w', (id * 7 + i * i) % 997))) AS text")
    want = sorted(search.search(docs, F.lit(True), k=3).collect())
    assert sum(r["queries"] for r in seen[0]) == 3000 and max(r["queries"] for r in seen[0]) <= 2048
    monkeypatch.setattr(search, "BLOCK_TERMS", 60)
    assert sorted(search.search(docs, F.lit(True), k=3).collect()) == want and len(want) == 9000
    assert sum(r["queries"] for r in seen[1]) == 3000 and all(r["terms"] <= 60 or r["queries"] == 1 for r in seen[1])
    assert not any("Generate" in plan for plan in plans)  # it holds a row's copies for all lots at once


def lot_of(texts, k=10):
    import pyarrow as pa

    lot = search.Lot(sum(len(t.split()) for t in texts) / len(texts), k)
    for i in range(0, len(texts), 700):
        lot.add(pa.array(range(i, min(i + 700, len(texts))), pa.int64()), pa.array(texts[i : i + 700]))
    return lot


def test_op2_lot_holds_postings_once(monkeypatch):
    import tracemalloc

    monkeypatch.setattr(search, "SHARD_POSTS", 1 << 20)
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 50_000, 200)) for _ in range(4000)]
    tracemalloc.start()
    lot = lot_of(texts)
    (shard,) = lot.shards()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # 800,000 postings; 40 bytes each would be 32 MB.
    assert shard.n == 4000 and most < 32e6


def test_op2_shards_are_built_once_for_many_blocks(monkeypatch):
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 300, rng.integers(1, 40))) for _ in range(3000)] + ["w1 " * 70_000]

    def blocks(n):
        for at in range(0, 60, 20):
            hashes, counts, sizes = search.vectors(texts[at : at + 20])
            known, places = np.unique(hashes, return_inverse=True)
            cuts = np.append(0, np.cumsum(sizes))
            blobs = [np.arange(at, at + 20).tobytes(), cuts.tobytes(), search.halves(places), search.packed(counts), known.tobytes(), search.packed(np.full(len(known), 200))]
            yield search.Asked(dict(zip(search.BLOBS, blobs, strict=True)), n)

    def answers(lot):
        out = [b for asked in blocks(len(texts)) for b in lot.answer(asked)] + list(lot.answers())
        return sorted(tuple(r.values()) for b in out for r in b.to_pylist())

    want = answers(lot_of(texts))
    made, whole = [], search.Shard
    monkeypatch.setattr(search, "Shard", lambda *a: made.append(1) or whole(*a))
    monkeypatch.setattr(search, "SHARD_DOCS", 500)
    lot = lot_of(texts)
    assert answers(lot) == want and len(want) == 600
    assert len(made) == len(lot.parts) > 3

"""Operators 5, 7 and 10 against the tokenizers library."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest
from table_paths import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st

from plinth.llm import token_codec, token_counts, token_store
from plinth.llm.wordbpe import bpe, default_vocabulary, library
from plinth.operators.tables import scratch


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_vocabulary())
    t.no_truncation()
    t.no_padding()
    return t


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="abeitnorsthd'é .,́Σσ<|>0½\x1c ", max_size=60))
def test_both_encoders_equal_the_library(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_vocabulary())
    want = ids_of(t, text)
    assert bpe(default_vocabulary()).encode(text) == want
    assert np.frombuffer(library(default_vocabulary()).encode_one(text), "<u4").tolist() == want
    assert bpe(default_vocabulary()).decode(want) == t.decode(want, skip_special_tokens=False)


def test_op7_digests(spark, texts, tokenizer):
    got = {r["doc_id"]: r for r in token_codec.op7_bpe_roundtrip(spark, SMALL).collect()}
    assert len(got) == len(texts)
    for doc, text in zip(texts.doc_id, texts.text, strict=True):
        ids = ids_of(tokenizer, text)
        r = got[doc]
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_op7_edges(edge_docs, empty_docs, tokenizer):
    rows = token_codec.encode_decode(edge_docs, default_vocabulary()).collect()
    texts = [r["text"] for r in edge_docs.collect()]
    assert sorted(map(repr, (r["ids"] for r in rows))) == sorted(repr(ids_of(tokenizer, t)) for t in texts)
    assert token_codec.encode_decode(empty_docs, default_vocabulary()).count() == 0


def test_op5_histogram_answers_every_limit(spark, texts, tokenizer):
    n = np.array([len(ids_of(tokenizer, t)) for t in texts.text])
    h = token_counts.op5_token_histogram(spark, SMALL).cache()
    for r in h.collect():
        assert r["n_docs"] == (n == r["n_tokens"]).sum()
        assert r["docs_from"] == (n >= r["n_tokens"]).sum() and r["tokens_from"] == n[n >= r["n_tokens"]].sum()
        assert r["truncated_total"] == np.minimum(n, r["n_tokens"]).sum()
        assert r["total_docs"] == len(n) and r["total_tokens"] == n.sum()
    for limit in (0, 1, 77, 1000, 10**6):
        assert token_counts.truncated_total(h, limit) == np.minimum(n, limit).sum()
    assert token_counts.quantile(h, 0.5) == np.sort(n)[int(np.ceil(0.5 * len(n))) - 1]


def test_op5_edges(edge_docs, empty_docs):
    h = token_counts.length_histogram(token_counts.token_lengths(edge_docs, default_vocabulary()))
    assert sum(r["n_docs"] for r in h.collect()) == edge_docs.count()
    assert token_counts.length_histogram(token_counts.token_lengths(empty_docs, default_vocabulary())).count() == 0


def test_op10_round_trip(spark, texts, tokenizer):
    got = {r["doc_id"]: r for r in token_store.op10_token_store(spark, SMALL).collect()}
    start = 0
    for doc, text in sorted(zip(texts.doc_id, texts.text, strict=True)):
        raw = np.array([*ids_of(tokenizer, text), 2], "<u4")
        r = got.pop(doc)
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(raw), zlib.crc32(raw.tobytes()))
        start += len(raw)
    assert not got


def test_op10_edges_and_reconstruction(spark, edge_docs, empty_docs, tokenizer):
    path = scratch(spark, "test-store")
    token_store.write_store(edge_docs, path, default_vocabulary())
    whole = sorted(token_store.read_documents(spark, path).collect(), key=lambda r: r["start"])
    assert sorted(map(repr, (r["ids"] for r in whole))) == sorted(repr([*ids_of(tokenizer, r["text"]), 2]) for r in edge_docs.collect())
    keys = [r["doc_id"] for r in whole]
    assert keys == [None, None, 1, 2, 3, 4, 4, 7, 8]
    summary = {(r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_store.read_summary(spark, path).collect()}
    assert summary == {(r["start"], len(r["ids"]), zlib.crc32(np.array(r["ids"], "<u4").tobytes())) for r in whole}
    none = scratch(spark, "test-store")
    token_store.write_store(empty_docs, none, default_vocabulary())
    assert token_store.read_summary(spark, none).count() == 0


def test_op10_detects_damage(spark, edge_docs):
    from pyspark.sql import functions as F

    path, bad = scratch(spark, "test-store"), scratch(spark, "test-store")
    token_store.write_store(edge_docs, path, default_vocabulary())
    spark.read.parquet(f"{path}/ordered").write.parquet(f"{bad}/ordered")
    spark.read.parquet(f"{path}/manifest").write.parquet(f"{bad}/manifest")
    data = spark.read.parquet(f"{path}/data")
    swapped = data.withColumn("key", F.when(F.col("kind") == "chunk", F.lead("key", 1).over(__import__("pyspark").sql.Window.partitionBy("kind").orderBy("key"))).otherwise(F.col("key"))).where("key is not null")
    swapped.write.partitionBy("kind").parquet(f"{bad}/data")
    with pytest.raises(Exception, match="does not match its digest|lacks"):
        token_store.read_summary(spark, bad).collect()


def test_op10_detects_lost_and_changed_recipes(spark, texts):
    from pyspark.sql import functions as F

    path = scratch(spark, "test-store")
    token_store.write_store(spark.createDataFrame(texts[["doc_id", "text"]].head(60)), path, default_vocabulary())
    ordered, data = spark.read.parquet(f"{path}/ordered"), spark.read.parquet(f"{path}/data")
    assert token_store.read_summary(spark, path).count() == token_store.read_documents(spark, path).count() == 60
    one = ordered.orderBy("doc_id").first()
    mine = F.col("doc_id") == one["doc_id"]
    other = ordered.where(F.size("chunks") > 0).where(F.col("root") != F.lit(bytes(one["root"]))).first()
    swap = lambda c: F.when(mine, F.lit(other[c] if c != "root" else bytes(other[c]))).otherwise(F.col(c))
    names = F.array(*(F.lit(bytes(x)) for x in other["chunks"]))
    changed = ordered.withColumns({"chunks": F.when(mine, names).otherwise(F.col("chunks")), "sizes": F.when(mine, F.array(*map(F.lit, other["sizes"]))).otherwise(F.col("sizes")), "root": swap("root"), "n_tokens": swap("n_tokens")})
    renamed = ordered.withColumn("doc_id", F.when(mine, F.lit(-5).cast("long")).otherwise(F.col("doc_id")))
    for damaged in (ordered.where(~mine), ordered.where(F.col("file") != one["file"]), changed, renamed):
        bad = scratch(spark, "test-store")
        damaged.write.parquet(f"{bad}/ordered")
        spark.read.parquet(f"{path}/manifest").write.parquet(f"{bad}/manifest")
        data.write.partitionBy("kind").parquet(f"{bad}/data")
        for read in (token_store.read_summary, token_store.read_documents):
            with pytest.raises(Exception, match="manifest"):
                read(spark, bad).collect()
    bad = scratch(spark, "test-store")
    ordered.write.parquet(f"{bad}/ordered")
    spark.read.parquet(f"{path}/manifest").write.parquet(f"{bad}/manifest")
    data.where((F.col("kind") != "chunk") | (F.col("key") != F.lit(bytes(one["chunks"][0])))).write.partitionBy("kind").parquet(f"{bad}/data")
    with pytest.raises(Exception, match="lacks"):
        token_store.read_documents(spark, bad).collect()


def test_equal_passages_are_stored_once(spark, texts):
    docs = spark.createDataFrame([(i, texts.text[texts.n_chars.idxmax()]) for i in range(5)], "doc_id long, text string")
    path = scratch(spark, "test-store")
    token_store.write_store(docs, path, default_vocabulary())
    assert token_store.read_chunks(spark, path).count() == len(token_store.read_recipes(spark, path).first()["chunks"])


@pytest.mark.parametrize("after", [0, 1, 4, 1000, 123456])
def test_crc_shift(after):
    a, b = b"abc" * 7, bytes(range(256)) * (after // 256) + bytes(after % 256)
    moved = token_store.crc_shift(np.array([zlib.crc32(a)]), np.array([len(b)]))
    assert int(moved[0]) ^ zlib.crc32(b) == zlib.crc32(a + b)

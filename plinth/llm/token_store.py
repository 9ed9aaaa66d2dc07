"""Operator 10: token ids in a content-addressed store.

Method: a rolling hash over the last ids cuts each document's id stream into
chunks; each distinct chunk is stored once under its digest; a recipe lists a
document's chunks, and Merkle roots over chunks, recipes and files verify what is
read back.

Layout under the store's path (Parquet as container, so any file system of Spark's):

- ``data``: rows of kind ``chunk`` with ``key`` (BLAKE2b-128 of the ids) and ``payload``
  (ids, zstd over 16- or 32-bit little-endian integers; the first byte tells the
  width), and rows of kind ``recipe``, written beside the chunks in the same pass.
- ``ordered``: ``doc_id, before, n_tokens, chunks, sizes, root`` in ascending order of
  ``doc_id``, file after file.
- ``manifest``: per recipe file its rows, ids and Merkle root.

Shuffles: chunks once, by digest; an encoding task sends a chunk that many of its
documents share once, and what still repeats between tasks is dropped after the
shuffle, where rows are sorted by digest. Then recipes, which hold 16 bytes a
chunk. Reading checks every chunk against its digest and takes its crc32; a
document's crc32 is the exclusive or of its chunks' values, each shifted by the ids
that follow, so payloads are not shuffled again.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.llm.common import SLICE_ROWS, bounded_batches, documents, row_count, scratch
from plinth.llm.wordbpe import default_vocabulary, library

#: Chunk sizes in ids: least, expected beyond the least, most; and the ids that the rolling hash sees.
MIN_IDS, MEAN_IDS, MAX_IDS, WINDOW = 256, 1024, 4096, 4
DIGEST = 16
#: Recipes of a file under one subtree of its Merkle tree, and recipes that a file holds about.
STRETCH, FILE_ROWS = 1024, 1 << 16
#: Digests that an encoding task remembers as sent; later ones may be sent again and are dropped after the shuffle.
SENT = 1 << 18


class StoreError(RuntimeError):
    """A chunk, recipe or manifest does not match its digest."""


def digest(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=DIGEST).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root of a binary Merkle tree; an odd node moves up as it is. No leaves: the digest of nothing."""
    level = leaves or [digest(b"")]
    while len(level) > 1:
        level = [digest(b"\x01" + b"".join(level[i : i + 2])) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def cut_points(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> list[list[int]]:
    """Chunk ends within each document, from a rolling hash over all documents of a slice at once.

    A hash spans ``WINDOW`` ids and counts only from ``MIN_IDS`` on, so it never sees another document.
    """
    mixed = ids.astype(np.uint32) * np.uint32(2654435761)
    mixed ^= mixed >> np.uint32(15)
    roll = np.zeros(len(ids), np.uint32)
    for k in range(WINDOW):
        roll[k:] += mixed[: len(ids) - k] * np.uint32(pow(31, k, 1 << 32))
    hits = np.flatnonzero(roll < np.uint32((1 << 32) // MEAN_IDS)) + 1
    lo, hi = np.searchsorted(hits, starts, "right"), np.searchsorted(hits, starts + sizes, "left")
    out = []
    for at, size, i, j in zip(starts.tolist(), sizes.tolist(), lo.tolist(), hi.tolist(), strict=True):
        ends, last = [], 0
        for h in hits[i:j].tolist():
            e = h - at
            while e - last > MAX_IDS:
                last += MAX_IDS
                ends.append(last)
            if e - last >= MIN_IDS:
                ends.append(e)
                last = e
        while size - last > MAX_IDS:
            last += MAX_IDS
            ends.append(last)
        if size > last:
            ends.append(size)
        out.append(ends)
    return out


def pack(raw: bytes, press) -> bytes:
    """Ids from 32-bit bytes to the stored form."""
    ids = np.frombuffer(raw, "<u4")
    return b"\x02" + press.compress(ids.astype("<u2").tobytes()) if int(ids.max(initial=0)) < 1 << 16 else b"\x04" + press.compress(raw)


def unpack(payload: bytes, press) -> bytes:
    """Ids as 32-bit little-endian bytes from the stored form."""
    raw = press.decompress(payload[1:])
    return np.frombuffer(raw, "<u2").astype("<u4").tobytes() if payload[0] == 2 else raw


PART = "kind string, key binary, doc_id long, n_tokens long, payload binary, chunks array<binary>, sizes array<int>"


def encode_chunks(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """Chunk rows and one recipe row a document, from one encoding pass."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press, coder, end = zstandard.ZstdCompressor(level=1), library(vocabulary), np.array([end_id], "<u4").tobytes()
        task, row, sent = TaskContext.get().partitionId(), 0, set()
        kinds = pa.DictionaryArray.from_arrays
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(i, SLICE_ROWS)
                streams = [x + end for x in coder.encode_all(part.column(1).to_pylist())]
                sizes = np.array([len(x) // 4 for x in streams], np.int64)
                whole = b"".join(streams)
                ids = np.frombuffer(whole, "<u4")
                starts = np.cumsum(sizes) - sizes
                own: dict[bytes, bytes] = {}
                recipes, lengths, keys = [], [], []
                for at, ends in zip(starts.tolist(), cut_points(ids, starts, sizes), strict=True):
                    names, prior = [], 0
                    for e in ends:
                        raw = whole[4 * (at + prior) : 4 * (at + e)]
                        names.append(name := digest(raw))
                        if name not in sent and name not in own:
                            own[name] = raw
                        prior = e
                    recipes.append(names)
                    lengths.append(np.diff([0, *ends]).astype(np.int32))
                    keys.append(task.to_bytes(8, "big") + row.to_bytes(8, "big"))
                    row += 1
                if len(sent) < SENT:
                    sent.update(own)
                n, m = len(own), len(recipes)
                kind = kinds(pa.array([0] * n + [1] * m, pa.int32()), pa.array(["chunk", "recipe"])).cast(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [
                        kind,
                        pa.array([*own, *keys], pa.binary()),
                        pa.concat_arrays([pa.nulls(n, pa.int64()), part.column(0).cast(pa.int64())]),
                        pa.array([None] * n + sizes.tolist(), pa.int64()),
                        pa.array([pack(x, press) for x in own.values()] + [None] * m, pa.binary()),
                        pa.array([None] * n + recipes, pa.list_(pa.binary())),
                        pa.array([None] * n + lengths, pa.list_(pa.int32())),
                    ],
                    names=fields(PART),
                )

    return docs.select("doc_id", "text").mapInArrow(run, PART)


def write_store(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2) -> None:
    """Write the ids of ``docs(doc_id, text)`` under ``path``.

    Null and empty texts have the end id alone; very long texts are cut into more
    chunks; equal ``doc_id`` each keep a recipe, ordered by a hash of their chunks, with
    nulls first; an empty table gives an empty store; other columns, whatever their
    names, are not read.
    """
    spark = docs.sparkSession
    parts = encode_chunks(docs, vocabulary, end_id)
    rest = F.first(F.struct(*(c for c in fields(PART) if c != "key"))).alias("x")
    once = parts.repartition("key").groupBy("key").agg(rest).select("key", *(f"x.{c}" for c in fields(PART) if c != "key"))
    once.write.option("compression", "zstd").parquet(f"{path}/data")
    order_recipes(_data(spark, path, "recipe").select("key", "doc_id", "n_tokens", "chunks", "sizes"), path)


def fields(schema: str) -> list[str]:
    """Names of the columns of a schema in text form."""
    return [part.split()[0] for part in schema.split(", ")]


def _data(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.schema(PART).parquet(f"{path}/data").where(F.col("kind") == kind)


RECIPE = "file int, place long, doc_id long, before long, n_tokens long, chunks array<binary>, sizes array<int>, root binary"


def order_recipes(recipes: DataFrame, path: str) -> None:
    """Recipes in ascending ``doc_id``, each file with its sums and Merkle root in the manifest."""
    spark = recipes.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, place, before = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            n = np.asarray(b.column("n_tokens"))
            ends = before + np.cumsum(n)
            roots = [merkle_root(x) for x in b.column("chunks").to_pylist()]
            size = b.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(size, task, np.int32)), pa.array(np.arange(place, place + size)), b.column("doc_id"), pa.array(ends - n), *(b.column(c) for c in ("n_tokens", "chunks", "sizes")), pa.array(roots, pa.binary())],
                names=fields(RECIPE),
            )
            place, before = place + size, int(ends[-1]) if size else before

    # The key, which no two recipes share, lets ranges cut through rows with one doc_id.
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("chunks"), F.col("key")]
    files = max(spark.sparkContext.defaultParallelism, -(-row_count(recipes) // FILE_ROWS))
    ranged = recipes.repartitionByRange(files, *order).sortWithinPartitions(*order).drop("key")
    ranged.mapInArrow(run, RECIPE).write.parquet(f"{path}/ordered")
    ordered = spark.read.schema(RECIPE).parquet(f"{path}/ordered")
    files = file_roots(ordered)
    rows, start = [], 0
    for r in sorted(files.collect(), key=lambda r: r["file"]):
        rows.append((r["file"], start, r["rows"], r["ids"], r["root"]))
        start += r["ids"]
    spark.createDataFrame(rows, "file int, start long, rows long, ids long, root string").coalesce(1).write.parquet(f"{path}/manifest")


def _fold(rows: DataFrame, key: tuple[str, ...], at: str) -> DataFrame:
    """``key, rows, ids, root``: sums and the Merkle root of the roots of each group, in order of ``at``."""
    held = rows.groupBy(*key).agg(F.sum("rows").alias("rows"), F.sum("ids").alias("ids"), F.transform(F.array_sort(F.collect_list(F.struct(at, "root"))), lambda x: x["root"]).alias("leaves"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            roots = [merkle_root(x) for x in b.column("leaves").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in (*key, "rows", "ids")), pa.array(roots, pa.binary())], names=[*key, "rows", "ids", "root"])

    return held.mapInArrow(run, "".join(f"{c} {rows.schema[c].dataType.simpleString()}, " for c in key) + "rows long, ids long, root binary")


def file_roots(ordered: DataFrame) -> DataFrame:
    """``file, rows, ids, root`` of each recipe file: a Merkle tree over stretches of ``STRETCH`` recipes.

    A leaf is the digest of a recipe's id, place in the file's stream, ids and root.
    The rows are bounded by the number of files.
    """
    leaf = F.unhex(F.sha2(F.concat_ws(",", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("before").cast("string"), F.col("n_tokens").cast("string"), F.hex("root")), 256))
    leaves = ordered.select("file", "place", F.floor(F.col("place") / STRETCH).alias("stretch"), F.lit(1).cast("long").alias("rows"), F.col("n_tokens").alias("ids"), leaf.alias("root"))
    return _fold(_fold(leaves, ("file", "stretch"), "place"), ("file",), "stretch").withColumn("root", F.lower(F.hex("root")))


def read_recipes(spark: SparkSession, path: str) -> DataFrame:
    """``row, doc_id, start, n_tokens, chunks, sizes, root``; ``row`` is a document's place in the stream of all.

    Every recipe file's rows, ids and Merkle root are computed anew and held against the manifest first.
    """
    ordered = spark.read.schema(RECIPE).parquet(f"{path}/ordered")
    manifest = spark.read.schema("file int, start long, rows long, ids long, root string").parquet(f"{path}/manifest")
    found, start = {r["file"]: (r["rows"], r["ids"], r["root"]) for r in file_roots(ordered).collect()}, 0
    told = sorted(manifest.collect(), key=lambda r: r["file"])
    for r in told:
        if found.get(r["file"]) != (r["rows"], r["ids"], r["root"]) or r["start"] != start:
            raise StoreError(f"recipe file {r['file']} does not match the manifest")
        start += r["ids"]
    if len(told) != len(found):
        raise StoreError("the manifest does not list all recipe files once")
    return ordered.join(F.broadcast(manifest.select("file", "start")), "file").select(
        F.struct("file", "place").alias("row"), "doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "chunks", "sizes", "root"
    )


def read_chunks(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Every stored chunk, checked against its digest: ``key, crc, n`` and, if asked for, ``ids`` as 32-bit bytes."""
    stored = _data(spark, path, "chunk").select("key", "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdDecompressor()
        for b in batches:
            keys = b.column(0).to_pylist()
            raws = [unpack(x, press) for x in b.column(1).to_pylist()]
            for k, raw in zip(keys, raws, strict=True):
                if digest(raw) != k:
                    raise StoreError(f"chunk {k.hex()} does not match its digest")
            made = [b.column(0), pa.array([zlib.crc32(x) for x in raws], pa.int64()), pa.array([len(x) // 4 for x in raws], pa.int64())]
            yield pa.RecordBatch.from_arrays([*made, pa.array(raws, pa.binary())] if with_ids else made, names=["key", "crc", "n", "ids"][: 3 + with_ids])

    return stored.mapInArrow(run, "key binary, crc long, n long" + ", ids binary" * with_ids)


def _crc_tables() -> np.ndarray:
    """For each k: how a crc32 changes when 2**k bytes follow, as four tables by byte of the value."""
    def table(columns: list[int]) -> np.ndarray:
        out = np.zeros((4, 256), np.uint32)
        for b in range(4):
            for v in range(256):
                out[b, v] = np.bitwise_xor.reduce([columns[8 * b + i] for i in range(8) if v >> i & 1] or [0])
        return out

    def apply(t: np.ndarray, x: int) -> int:
        return int(t[0, x & 255] ^ t[1, x >> 8 & 255] ^ t[2, x >> 16 & 255] ^ t[3, x >> 24])

    # crc(a + zero byte) = shift(crc(a)) ^ crc(zero byte), and shift is linear over bits.
    columns = [zlib.crc32(b"\x00", 1 << i) ^ zlib.crc32(b"\x00", 0) for i in range(32)]
    tables = []
    for _ in range(40):
        t = table(columns)
        tables.append(t)
        columns = [apply(t, c) for c in columns]
    return np.array(tables)


_TABLES: list[np.ndarray] = []


def crc_shift(crc: np.ndarray, following: np.ndarray) -> np.ndarray:
    """The part of a crc32 that a piece contributes when ``following`` bytes come after it."""
    if not _TABLES:
        _TABLES.append(_crc_tables())
    out, left, k = crc.astype(np.uint32), following.astype(np.int64), 0
    while left.any():
        odd = left & 1 == 1
        x, t = out[odd], _TABLES[0][k]
        out[odd] = t[0][x & 255] ^ t[1][x >> 8 & 255] ^ t[2][x >> 16 & 255] ^ t[3][x >> 24]
        left, k = left >> 1, k + 1
    return out


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files, with all digests checked."""
    recipes = read_recipes(spark, path)

    def refs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            chunks, sizes = b.column("chunks").to_pylist(), b.column("sizes").to_pylist()
            for names, root in zip(chunks, b.column("root").to_pylist(), strict=True):
                if merkle_root(names) != root:
                    raise StoreError("a recipe does not match its Merkle root")
            counts = np.array([len(x) for x in chunks])
            after = [4 * (np.sum(s, dtype=np.int64) - np.cumsum(s, dtype=np.int64)) for s in sizes]
            pick = pa.array(np.repeat(np.arange(b.num_rows), counts))
            if not len(pick):
                continue
            yield pa.RecordBatch.from_arrays(
                [b.column("row").take(pick), b.column("doc_id").take(pick), b.column("start").take(pick), b.column("n_tokens").take(pick), pa.array([c for x in chunks for c in x], pa.binary()), pa.array(np.concatenate(after)), pa.array(np.concatenate([np.asarray(s, np.int64) for s in sizes]))],
                names=["row", "doc_id", "start", "n_tokens", "key", "after", "size"],
            )

    used = recipes.mapInArrow(refs, "row struct<file:int,place:long>, doc_id long, start long, n_tokens long, key binary, after long, size long")
    joined = used.join(read_chunks(spark, path), "key", "left")

    def shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.column("crc").null_count or not np.array_equal(np.asarray(b.column("n")), np.asarray(b.column("size"))):
                raise StoreError("a recipe names a chunk that the store lacks or that has another size")
            part = crc_shift(np.asarray(b.column("crc")), np.asarray(b.column("after"))).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("row", "doc_id", "start", "n_tokens")), pa.array(part), b.column("size")], names=["row", "doc_id", "start", "n_tokens", "part", "size"])

    parts = joined.mapInArrow(shift, "row struct<file:int,place:long>, doc_id long, start long, n_tokens long, part long, size long")
    merged = parts.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("start").alias("start"), F.first("n_tokens").alias("n_tokens"), F.bit_xor("part").alias("ids_crc32"), F.sum("size").alias("read"))
    return merged.select("doc_id", "start", F.when(F.col("read") == F.col("n_tokens"), F.col("n_tokens")).otherwise(F.raise_error(F.lit("a document is not complete"))).alias("n_tokens"), "ids_crc32")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, ids`` of every document, put together from its chunks."""
    own = ("doc_id", "start", "n_tokens", "root")
    used = read_recipes(spark, path).select("row", *own, F.posexplode_outer("chunks").alias("k", "key"))
    met = used.join(read_chunks(spark, path, with_ids=True), "key", "left")
    whole = met.groupBy("row").agg(*(F.first(c).alias(c) for c in own), F.array_sort(F.collect_list(F.struct("k", "key", "ids"))).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for parts, n, root in zip(b.column("parts").to_pylist(), b.column("n_tokens").to_pylist(), b.column("root").to_pylist(), strict=True):
                if any(p["ids"] is None for p in parts):
                    raise StoreError("a recipe names a chunk that the store lacks")
                if merkle_root([p["key"] for p in parts]) != root:
                    raise StoreError("a recipe does not match its Merkle root")
                made.append(np.frombuffer(b"".join(p["ids"] for p in parts), "<u4").astype(np.int64))
                if len(made[-1]) != n:
                    raise StoreError("a document is not complete")
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), pa.array(made, pa.list_(pa.int64()))], names=["doc_id", "start", "ids"])

    return whole.select(*own, "parts").mapInArrow(run, "doc_id long, start long, ids array<long>")


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids written to a store in the shared folder, and what is read back from it."""
    path = scratch(spark, "token-store")
    write_store(documents(spark, sf_dir, "doc_id", "text"), path, default_vocabulary())
    return read_summary(spark, path)

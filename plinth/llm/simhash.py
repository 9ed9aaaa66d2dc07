"""Operator 3: SimHash near-duplicates by the generalised pigeonhole principle.

1. Fingerprints come from one pass over the texts. Only 16 bytes a document go on.
2. Distinct fingerprints are nodes; equal ones are never compared with each other.
3. Bits are grouped into partitions so that correlated bits share one. The counts
   of all pairs of bits over all fingerprints decide, a 64 x 64 table.
4. For each fingerprint, dynamic programming gives each partition its own threshold
   (-1: skip), so that they sum to ``radius - partitions + 1`` and the estimated
   probes and candidates are fewest. By the pigeonhole principle every fingerprint
   within the radius agrees in some partition within that partition's threshold.
5. Each fingerprint is indexed under its value in every partition and probes the
   values within its thresholds. A bucket's members are verified against each
   other, from one member to the next, and what is already linked is not compared
   again, so a bucket of near copies costs about its size. Buckets over a size are
   cut into blocks, and each pair of blocks is a task's work: no bucket is held whole.
6. Links are joined to components by :func:`plinth.operators.components.connected_components`.

The query links by the 64 bits alone, as its contract fixes. :func:`keep_one_each` is
told a similarity of shingles instead. Texts of similarity ``s`` differ in a share
``acos(2s / (1 + s)) / pi`` of the bits, so candidates come from a wider radius, and a
check word, 64 more bits of the same hashes, decides with the fingerprint whether
the share over all 128 bits is small enough.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import acos, comb, floor, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.llm.common import documents, map_texts, written
from plinth.operators.components import connected_components

SEED, BITS = 42, 64
#: Members of a bucket that one task holds at a time, and the widest histogram in bits.
BLOCK, HISTOGRAM_BITS = 8192, 16
#: Cost of sending one probe, which is written and sorted, against comparing one candidate; bits that a probe flips at least, if need be.
PROBE_COST, MOST_FLIPS = 1000.0, 2
#: Smaller tables are planned as if they had so many fingerprints, so that probes grow with the fingerprints up to here.
PLANNED = 1 << 20


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of each shingle of ``words`` words, repeats included; of the whole if there are fewer."""
    import xxhash

    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(tokens)
    if not n:
        return np.zeros(0, np.uint64)
    line = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, n) + 1) - 1
    if n <= words:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    starts = [0, *(ends[: n - words] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.fromiter([digest(line[s:e], SEED) for s, e in zip(starts, ends[words - 1 :].tolist(), strict=True)], np.uint64, n - words + 1)


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have; 0 without a hash."""
    total = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        some = hashes[i : i + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(some, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, words: int = 4) -> int:
    """SimHash of the shingles of ``words`` words; 0 without a word."""
    return majority(shingle_hashes(text, words))


def mixed(hashes: np.ndarray) -> np.ndarray:
    """Other 64 bits for each hash."""
    h = (hashes ^ hashes >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def check_word(hashes: np.ndarray) -> int:
    """SimHash over the other bits of the same hashes; 0 without a hash."""
    return majority(mixed(hashes))


def named(fps: np.ndarray, checks: np.ndarray) -> np.ndarray:
    """One number for a fingerprint and its check word; the fingerprint itself without one."""
    return fps ^ checks * np.uint64(0x9E3779B97F4A7C15)


def fingerprints(docs: DataFrame, words: int = 4, text: str = "text", keep: tuple[str, ...] = ("doc_id",), checked: bool = False) -> DataFrame:
    """``keep``, ``fp``, the fingerprint as a signed 64-bit integer, ``check``, its check word or 0, and ``node``, which names both."""

    def kernel(texts: list) -> dict[str, list]:
        hashes = [shingle_hashes(t, words) for t in texts]
        fp = np.array([majority(h) for h in hashes], np.uint64)
        check = np.array([check_word(h) if checked else 0 for h in hashes], np.uint64)
        return {"fp": fp.view(np.int64), "check": check.view(np.int64), "node": named(fp, check).view(np.int64)}

    return map_texts(docs, kernel, "fp long, check long, node long", text, keep)


def bits_apart(similarity: float, bits: int) -> int:
    """Bits of ``bits`` that texts whose shingles have this Jaccard similarity are expected to differ in."""
    return floor(bits * acos(2 * similarity / (1 + similarity)) / pi)


def bit_counts(nodes: DataFrame) -> np.ndarray:
    """How many fingerprints have both bits of each pair, over all fingerprints."""
    names = [f"c{j}" for j in range(BITS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS))
        for b in batches:
            bits = np.unpackbits(np.ascontiguousarray(b.column(0)).astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            for i in range(0, len(bits), 4096):
                some = bits[i : i + 4096].astype(np.float32)
                total += some.T @ some
        whole = total.astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(range(BITS), pa.int32()), *(pa.array(whole[:, j]) for j in range(BITS))], names=["i", *names])

    rows = nodes.select("fp").mapInArrow(run, "i int, " + ", ".join(f"{n} long" for n in names)).groupBy("i").agg(*(F.sum(n).alias(n) for n in names)).collect()
    out = np.zeros((BITS, BITS), np.int64)
    for r in rows:
        out[r["i"]] = r[1:]
    return out


def group_bits(counts: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Partitions of almost equal width in which the bits are as correlated as can be had greedily."""
    p = np.diag(counts) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    tie = np.abs((counts / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(tie, 0)
    left, out = list(range(BITS)), []
    for k in range(parts):
        width = BITS // parts + (k < BITS % parts)
        first = max(left, key=lambda b: (tie[b, left].sum(), -b))
        group = [first]
        left.remove(first)
        while len(group) < width:
            best = max(left, key=lambda b: (tie[b, group].sum(), -b))
            group.append(best)
            left.remove(best)
        out.append(sorted(group))
    return out


def count_parts(n: int, radius: int) -> int:
    """How many partitions cost least for ``n`` evenly spread fingerprints; any number finds all pairs."""

    def cost(m: int) -> float:
        extra = radius - m + 1
        widths = [BITS // m + (k < BITS % m) for k in range(m)]
        total = 0.0
        for k, w in enumerate(widths):
            t = extra // m + (k >= m - extra % m)
            total += sum(comb(w, d) for d in range(t + 1)) * (PROBE_COST + n / 2**w)
        return total

    return min(range(2, radius + 2), key=cost) if radius else 1


def project(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    """Values of the given bits, packed."""
    out = np.zeros(len(fps), np.int64)
    for k, b in enumerate(bits):
        out |= ((fps >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << k
    return out


def blocks_of(groups: list[list[int]]) -> list[tuple[int, list[int]]]:
    """Stretches of at most ``HISTOGRAM_BITS`` bits of each partition."""
    return [(g, bits[i : i + HISTOGRAM_BITS]) for g, bits in enumerate(groups) for i in range(0, len(bits), HISTOGRAM_BITS)]


def histograms(nodes: DataFrame, groups: list[list[int]]) -> list[np.ndarray]:
    """Counts of each value of each stretch, over all fingerprints; at most ``2**HISTOGRAM_BITS`` values a stretch."""
    blocks = blocks_of(groups)
    value = lambda bits: sum((F.shiftright("fp", b).bitwiseAND(1) * (1 << k) for k, b in enumerate(bits)), F.lit(0)).cast("int")
    pairs = nodes.select(F.explode(F.array(*(F.struct(F.lit(k).alias("k"), value(bits).alias("v")) for k, (_, bits) in enumerate(blocks)))).alias("x")).groupBy("x.k", "x.v").count()
    out = [np.zeros(1 << len(bits)) for _, bits in blocks]
    found = pairs.toPandas()
    for k, v, c in zip(found["k"], found["v"], found["count"], strict=True):
        out[k][v] = c
    return out


def within(hist: np.ndarray, most: int) -> np.ndarray:
    """For each value, the count of what differs from it in exactly 0, 1, ... ``most`` bits."""
    width = len(hist).bit_length() - 1
    index, rows = np.arange(len(hist)), [hist]
    flips = lambda x: sum((x[index ^ (1 << b)] for b in range(width)), np.zeros(len(x)))
    for d in range(1, most + 1):
        before = rows[d - 2] * (width - d + 2) if d > 1 else 0
        rows.append((flips(rows[d - 1]) - before) / d)
    return np.array(rows, np.float32)


def allot(costs: np.ndarray, total: int) -> np.ndarray:
    """Thresholds of least cost that sum to ``total``, by dynamic programming for all fingerprints at once.

    ``costs[i, t + 1]`` has the costs of threshold ``t`` (from -1) in partition ``i``, one a fingerprint.
    """
    parts, options, n = costs.shape
    low = -parts
    span = parts * options + 1
    best = np.full((span, n), np.inf)
    best[-low] = 0
    choice = np.zeros((parts, span, n), np.int8)
    for i in range(parts):
        new = np.full((span, n), np.inf)
        for t in range(-1, options - 1):
            moved = np.full((span, n), np.inf)
            lo, hi = max(0, t), span + min(0, t)
            moved[lo:hi] = best[lo - t : hi - t] + costs[i, t + 1]
            better = moved < new
            new[better] = moved[better]
            choice[i][better] = t
        best = new
    out = np.zeros((parts, n), np.int64)
    at = np.full(n, total - low)
    cols = np.arange(n)
    for i in reversed(range(parts)):
        out[i] = choice[i][at, cols]
        at = at - out[i]
    return out


def bucket_links(fps: np.ndarray, probing: np.ndarray, radius: int, checks: np.ndarray | None = None, most: int = 2 * BITS) -> list[tuple[int, int]]:
    """Pairs that connect all of a bucket's members within the radius of one another.

    A pair counts only if one of the two probes here and, with ``checks``, if both
    words together differ in at most ``most`` bits. From each member reached, only what
    is not yet reached is compared.
    """
    links = []
    left = np.arange(len(fps))
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            x = queue.pop()
            apart = np.bitwise_count(fps[left] ^ fps[x])
            near = apart <= radius
            if checks is not None:
                near &= apart + np.bitwise_count(checks[left] ^ checks[x]) <= most
            if not probing[x]:
                near &= probing[left]
            if near.any():
                found = left[near].tolist()
                links += [(x, y) for y in found]
                queue += found
                left = left[~near]
    return links


class Forest:
    """Union-find over the links that one task has seen."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (p := up.get(x, x)) != x:
            up[x] = up.get(p, p)
            x = p
        return x

    def join(self, x: int, y: int) -> None:
        a, b = self.root(x), self.root(y)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def edges(self) -> list[tuple[int, int]]:
        return [(x, self.root(x)) for x in list(self.up)]


#: A bucket is a partition's number and a value of its bits.
PROBE = "bucket long, fp long, check long, probing boolean"


def probes(nodes: DataFrame, groups: list[list[int]], hists: list[np.ndarray], n: int, radius: int) -> DataFrame:
    """Index rows of every fingerprint in every partition, and rows for the other values that it probes."""
    parts, total = len(groups), radius - len(groups) + 1
    most = max(MOST_FLIPS, -(-total // parts))
    scale = max(1.0, PLANNED / max(n, 1))
    blocks = blocks_of(groups)
    near = [within(h, most) for h in hists]

    def estimate(values: list[np.ndarray], g: int) -> np.ndarray:
        """Fingerprints within 0 ... most bits of a value; stretches of one partition count as independent."""
        out = None
        for (own, _), table, v in zip(blocks, near, values, strict=True):
            if own != g:
                continue
            at = table[:, v].astype(np.float64)
            if out is None:
                out = at
            else:
                out = np.array([sum(out[j] * at[d - j] for j in range(d + 1)) for d in range(most + 1)]) / max(n, 1)
        return np.cumsum(out, 0)

    flips = [[[sum(1 << b for b in c) for c in combinations(range(len(bits)), d)] for d in range(most + 1)] for bits in groups]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                fps, checks = (np.ascontiguousarray(batch.column(c).slice(i, 4096)).astype(np.int64).view(np.uint64) for c in range(2))
                values = [project(fps, bits) for _, bits in blocks]
                costs = np.zeros((parts, most + 2, len(fps)))
                for g, bits in enumerate(groups):
                    count = estimate(values, g)
                    for t in range(most + 1):
                        costs[g, t + 1] = PROBE_COST * (sum(comb(len(bits), d) for d in range(t + 1)) - 1) + scale * count[t]
                limits = allot(costs, total)
                out_v, out_i, out_q = [], [], []
                every = np.arange(len(fps))
                for g, bits in enumerate(groups):
                    own = project(fps, bits) | g << 32  # a partition has at most half of the bits, or is the only one
                    out_v.append(own)
                    out_i.append(every)
                    out_q.append(limits[g] >= 0)
                    for d in range(1, most + 1):
                        far = limits[g] >= d
                        if far.any():
                            masks = np.array(flips[g][d], np.int64)
                            out_v.append((own[far][:, None] ^ masks).ravel())
                            out_i.append(np.repeat(every[far], len(masks)))
                            out_q.append(np.ones(len(out_i[-1]), bool))
                which = np.concatenate(out_i)
                own = [x[which].view(np.int64) for x in (fps, checks)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.concatenate(out_v), *own, np.concatenate(out_q))], names=["bucket", "fp", "check", "probing"])

    return nodes.select("fp", "check").mapInArrow(run, PROBE)


def links(probe_rows: DataFrame, radius: int, most: int | None = None) -> DataFrame:
    """``u, v``: nodes within the radius and, if given, with ``most`` bits apart over both words, enough of them to connect each component."""
    # Written, so that its size is known before the join is planned: few buckets are hot, and mostly none.
    hot = written(probe_rows.groupBy("bucket").count().where(F.col("count") > BLOCK).select("bucket", F.ceil(F.col("count") / BLOCK).cast("long").alias("cuts")), "hot-buckets")
    if hot.isEmpty():
        keyed = probe_rows.withColumn("pair", F.lit(0).cast("long"))
    else:
        cut = probe_rows.join(hot, "bucket", "left").withColumn("cuts", F.coalesce("cuts", F.lit(1).cast("long")))
        # A member of a cut bucket goes to each pair of blocks that has its own.
        spread = cut.withColumn("mine", F.pmod(F.xxhash64("fp", "check"), F.col("cuts"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)))
        keyed = spread.withColumn("pair", F.shiftleft(F.least("mine", "other"), 32).bitwiseOR(F.greatest("mine", "other")))
    keys = ["bucket", "pair"]
    dealt = keyed.select(*keys, "fp", "check", "probing").repartition(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, key, held = Forest(), None, []

        def close() -> None:
            fps, checks, probing = (np.concatenate([h[c] for h in held]) for c in range(3))
            if len(fps) > 1 and probing.any():
                names = named(fps, checks)
                for a, b in bucket_links(fps, probing, radius, None if most is None else checks, most or 0):
                    forest.join(int(names[a]), int(names[b]))

        for batch in batches:
            columns = [np.asarray(batch.column(k)) for k in range(2)]
            fps, checks = (np.ascontiguousarray(batch.column(c)).astype(np.int64).view(np.uint64) for c in (2, 3))
            probing = np.array(batch.column(4).to_numpy(zero_copy_only=False), bool)
            if not len(fps):
                continue
            change = np.zeros(len(fps), bool)
            for c in columns:
                change[1:] |= c[1:] != c[:-1]
            cuts = [0, *np.flatnonzero(change).tolist(), len(fps)]
            for s, e in zip(cuts, cuts[1:], strict=False):
                new = tuple(int(c[s]) for c in columns)
                if held and new != key:
                    close()
                    held = []
                key = new
                held.append((fps[s:e], checks[s:e], probing[s:e]))
        if held:
            close()
        edges = np.array(forest.edges(), np.uint64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(edges[:, k]).view(np.int64)) for k in (0, 1)], names=["u", "v"])

    return dealt.mapInArrow(run, "u long, v long")


def near_components(prints: DataFrame, radius: int = 4, key: str = "doc_id", most: int | None = None) -> DataFrame:
    """``prints(key, fp, check, node)`` with ``component_id``, the smallest key that links lead to, and ``root``, its node.

    Null keys are linked like others but never name a component, unless it has no
    other. Repeated rows each stay. An empty table gives no rows.
    """
    nodes = written(prints.groupBy("node", "fp", "check").agg(F.min(key).alias("least")), "nodes")
    n = nodes.count()
    groups = group_bits(bit_counts(nodes), n, count_parts(max(n, PLANNED), radius))
    rows = written(probes(nodes, groups, histograms(nodes, groups), n, radius), "probes")
    joined = connected_components(links(rows, radius, most)).withColumnRenamed("node", "name")
    placed = nodes.join(joined, nodes["node"] == joined["name"], "left").select("node", "least", F.coalesce("component", "node").alias("root"))
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    owner = placed.select("node", "root").join(named, "root").select("node", "component_id", "root")
    return prints.join(owner, "node")


def simhash_components(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """``doc_id, fp, component_id`` of every row of ``docs(doc_id, text)``.

    Null and empty texts have fingerprint 0 and are linked like any other; texts are
    read whole, however long; repeated rows each give a row; an empty table gives no
    rows; other columns, whatever their names, are not read.
    """
    return near_components(written(fingerprints(docs, words), "prints"), radius).select("doc_id", "fp", "component_id")


def keep_one_each(docs: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = 11) -> DataFrame:
    """One row of ``docs`` for each group of near-duplicates, with all its columns.

    Texts are linked if their fingerprints are within ``radius`` bits and if, over
    fingerprint and check word, they differ in no more bits than texts whose
    shingles of ``words`` words have the given Jaccard similarity are expected to. The
    row with the smallest ``doc_id`` stays, nulls last; of repeated rows, one. Null
    texts and texts without a word are one group; texts are read whole, however long;
    an empty table gives no rows. Only fingerprints and keys are compared; the texts
    move once, to meet the keys that stay.
    """
    kid, kh = F.coalesce(F.col("doc_id").cast("long"), F.lit(-1).cast("long")), F.xxhash64(F.col("doc_id").isNull(), "text")
    keyed = docs.select(kid.alias("kid"), kh.alias("kh"), F.col("doc_id").isNull().alias("last"), "text")
    prints = written(fingerprints(keyed, words, keep=("kid", "kh", "last"), checked=True), "prints")
    groups = near_components(prints, radius, "kid", bits_apart(similarity, 2 * BITS))
    stay = groups.groupBy("root").agg(F.min(F.struct("last", "kid", "kh")).alias("w")).select(F.col("w.kid").alias("kid"), F.col("w.kh").alias("kh"))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    met = docs.select(kid.alias("kid"), kh.alias("kh"), row.alias("row")).join(stay, ["kid", "kh"], "left_semi")
    return met.dropDuplicates(["kid", "kh"]).select("row.*")


def op3_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of every document."""
    found = simhash_components(documents(spark, sf_dir, "doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

"""Operator 2: exact BM25 top-k search over an inverted index with block-max WAND pruning.

Statistics (document frequencies, number of documents, mean length) are global and
come from one pass over all texts, so a score does not depend on a shard and
merging the shards' top k is exact.

Documents are dealt in turn to lots, whose number grows with the postings; a task
holds a lot, as a rule as one shard, and lets blocks of queries pass, so texts move
once and each block of queries once for each lot. A lot of several shards (short
texts) holds its documents as term vectors and indexes a shard at a time for as many
blocks of queries as fit. A block has few queries, so that no row is large.

Block-max WAND, over arrays and for a batch of queries at a time:

1. Documents of a shard are ordered by their commonest word, so that a block of
   ``BLOCK`` neighbours holds like documents. Each term has the greatest weight that
   it has in a block.
2. The shard's common terms are never walked for a query: their block maxima, times
   the query's weights, bound what they can give in a block. The postings of the
   other terms are walked and added up.
3. Both together bound a block. Blocks whose bound stays below the query's k-th best
   score so far are passed over; in the others (the pivots) the common terms' exact
   weights are added. The k-th best starts from what rare terms alone give, rises
   with each shard, and carries over to the next.
4. Sums are in single precision up to here and are compared with a slack above their
   rounding; what may enter the top k is scored again in double precision.

No document that could enter the top k is passed over.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plinth.llm.common import bounded_batches, documents, row_count, written

K1, B = 1.2, 0.75
#: Documents and postings of a shard, documents of a block, blocks whose common terms are added at a time.
SHARD_DOCS, SHARD_POSTS, BLOCK, TILE = 32768, 10 << 20, 32, 16
#: Queries that travel together and that are scored together; decimals of a score.
QUERY_BLOCK, BATCH, DECIMALS = 2048, 256, 6
#: Terms of the queries that travel together (a query that has more goes alone), and of a partition in which they are put together.
BLOCK_TERMS, PART_TERMS = 1 << 20, 1 << 20
#: Queries, and their terms, that wait for the shards of a lot of several.
HELD_QUERIES, HELD_TERMS = 8192, 1 << 23
#: Postings that a lot holds about; lots for each core at least.
LOT_POSTS, LOTS_A_CORE = 8 << 20, 4
#: A term is common in a shard if this share of its documents has it, as far as the table of common terms reaches.
COMMON, MOST_COMMON = 1 / 20, 1024
#: Share of a score that single precision may lose: 1024 products and sums of numbers rounded to 24 bits.
SLACK = 1e-4
#: Stands for a null key inside a shard.
NO_KEY = -1 << 62


#: White space in every contract of this subpackage, and bytes of text that are hashed at a time.
SPACES, PIECE = b"\t\n\v\f\r ", 1 << 18
SPACE = re.compile(rb"[\t-\r ]")


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    """A 64-bit number for each byte of a word; 0 for white space."""
    import xxhash

    return np.array([0 if b in SPACES else xxhash.xxh64_intdigest(bytes([b]), 7) | 1 for b in range(256)], np.uint64)


@lru_cache(maxsize=1)
def _powers(least: int) -> np.ndarray:
    """Powers of an odd number modulo 2**64, at least so many."""
    return np.multiply.accumulate(np.full(least, 0x9E3779B97F4A7C15, np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Signed 64-bit hashes of all words, A-Z lowered, of a text in UTF-8, and where they start.

    A word's hash is the sum of its bytes' numbers, each times a power for its place,
    then mixed; all words of a piece of text are hashed at once.
    """
    out, places, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    while at < len(raw):
        to = at + PIECE
        to = m.start() if to < len(raw) and (m := SPACE.search(raw, to)) else len(raw)
        values = _byte_values()[np.frombuffer(raw[at:to].lower(), np.uint8)]
        solid = values != 0
        first = solid.copy()
        first[1:] &= ~solid[:-1]
        starts = np.flatnonzero(first)
        places.append(starts + at)
        at = to
        if len(starts):
            sizes = np.diff(np.append(starts, len(values)))
            powers = _powers(1 << max(16, int(sizes.max()).bit_length()))
            h = np.add.reduceat(values[starts[0] :] * powers[spans(np.zeros(len(starts), np.int64), sizes)], starts - starts[0])
            h = (h ^ h >> np.uint64(30)) * np.uint64(0x94D049BB133111EB)
            out.append((h ^ h >> np.uint64(31)).view(np.int64))
    return np.concatenate(out), np.concatenate(places)


def vectors(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct term hashes of each text in order, how often each occurs, and the number of terms of each text."""
    hashes, counts, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], np.zeros(len(texts), np.int64)
    raws = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    held: list[int] = []
    room = 0
    for i, raw in enumerate(raws):
        held.append(i)
        room += len(raw)
        if room < PIECE and i + 1 < len(raws):
            continue
        # Short texts are hashed together; each text's words are a stretch of the result.
        words, places = word_hashes(b"\n".join([raws[k] for k in held]))
        cut = np.searchsorted(places, np.cumsum([0, *(len(raws[k]) + 1 for k in held)]))
        for k, s, e in zip(held, cut.tolist(), cut[1:].tolist(), strict=False):
            if s < e:
                own = np.sort(words[s:e])
                new = np.flatnonzero(own[1:] != own[:-1]) + 1
                ends = np.concatenate(([0], new, [e - s]))
                hashes.append(own[ends[:-1]])
                counts.append((ends[1:] - ends[:-1]).astype(np.int32))
                sizes[k] = len(ends) - 1
        held, room = [], 0
    return np.concatenate(hashes), np.concatenate(counts), sizes


def term_statistics(docs: DataFrame) -> DataFrame:
    """``term, df`` over all texts; the row whose term is null has the number of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                hashes, counts, _ = vectors(b.column(0).slice(i, 1024).to_pylist())
                terms, df = np.unique(hashes, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([int(counts.sum())], pa.int64())], names=["term", "df"])
                yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(df.astype(np.int64))], names=["term", "df"])

    return docs.select("text").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


QUERIES = "ids binary, cuts binary, places binary, counts binary, terms binary, df binary"
BLOBS = [p.split()[0] for p in QUERIES.split(", ")]


def packed(x: np.ndarray) -> bytes:
    """Numbers as wide as the greatest of them."""
    most = int(x.max(initial=0))
    return x.astype("<u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4" if most < 1 << 32 else "<u8").tobytes()


def unpacked(blob: bytes, size: int) -> np.ndarray:
    return np.frombuffer(blob, f"<u{len(blob) // max(size, 1)}")


def halves(x: np.ndarray) -> bytes:
    """All low halves of 32-bit numbers, then all high ones, which are alike and are compressed on their way."""
    return np.concatenate([x & 0xFFFF, x >> 16]).astype("<u2").tobytes()


def query_blocks(parts: DataFrame, terms: int) -> DataFrame:
    """Rows ``lead, query_id, term, n, df``, ``terms`` of them, to rows of some queries with like leads: a dictionary of their terms, and each query's places in it.

    A row has ``QUERY_BLOCK`` queries and ``BLOCK_TERMS`` terms at most, or one query.
    """
    queries, room = QUERY_BLOCK, BLOCK_TERMS

    def row(ids: np.ndarray, terms: np.ndarray, n: np.ndarray, df: np.ndarray) -> pa.RecordBatch:
        known, first, places = np.unique(terms, return_index=True, return_inverse=True)
        cuts = np.append(np.flatnonzero(np.append(True, ids[1:] != ids[:-1])), len(ids)).astype(np.int64)
        blobs = [ids[cuts[:-1]].tobytes(), cuts.tobytes(), halves(places), packed(n), known.tobytes(), packed(df[first])]
        return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in blobs], names=BLOBS)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size, enough = 0, room
        for b in batches:
            held.append([b.column(c).to_numpy() for c in ("query_id", "term", "n", "df")])
            size += b.num_rows
            if size >= enough:
                # The last query may go on; a block that may still grow waits too.
                columns = [np.concatenate(c) for c in zip(*held, strict=True)]
                cuts = blocks_of(columns[0], queries, room)[:-1]
                for i, j in zip(cuts, cuts[1:], strict=False):
                    yield row(*(c[i:j] for c in columns))
                held = [[c[cuts[-1] :].copy() for c in columns]]
                size = len(held[0][0])
                enough = max(room, 2 * size)
        if size:
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            cuts = blocks_of(columns[0], queries, room)
            for i, j in zip(cuts, cuts[1:], strict=False):
                yield row(*(c[i:j] for c in columns))

    count = max(1, -(-terms // PART_TERMS))
    dealt_out = parts.select("lead", "query_id", "term", "n", "df").repartitionByRange(count, "lead", "query_id").sortWithinPartitions("lead", "query_id", "term")
    return dealt_out.coalesce(count).mapInArrow(build, QUERIES)


def blocks_of(ids: np.ndarray, queries: int, room: int) -> list[int]:
    """Where blocks of whole queries begin, and the end: as many as fit, by their number and their rows, one at least."""
    starts = np.append(np.flatnonzero(np.append(True, ids[1:] != ids[:-1])), len(ids))
    cuts, at = [0], 0
    while at + 1 < len(starts):
        at = min(at + queries, max(at + 1, int(np.searchsorted(starts, starts[at] + room, "right")) - 1), len(starts) - 1)
        cuts.append(int(starts[at]))
    return cuts


class Asked:
    """One block of queries, with term weights under the global statistics, like queries side by side."""

    def __init__(self, blobs: dict, n: int):
        get = lambda name, kind: np.frombuffer(blobs[name], kind)
        self.ids, self.cuts, self.terms = get("ids", "<i8"), get("cuts", "<i8"), get("terms", "<i8")
        self.size = int(self.cuts[-1])
        low, high = get("places", "<u2").reshape(2, self.size)
        self.places, self.counts = low | high.astype(np.int32) << 16, unpacked(blobs["counts"], self.size)
        df = unpacked(blobs["df"], len(self.terms)).astype(np.int64)
        self.rarity = np.log1p((n - df + 0.5) / (df + 0.5))
        self.order = np.arange(len(self.ids))
        self.best: list[list[tuple[float, int]]] = [[] for _ in self.ids]

    def query(self, q: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of a query's terms in the dictionary, and their weights."""
        some = slice(self.cuts[q], self.cuts[q + 1])
        return self.places[some], self.counts[some] * self.rarity[self.places[some]]

    def results(self) -> pa.RecordBatch:
        rows = [(q, None if d == NO_KEY else d, s) for q, best in zip(self.ids.tolist(), self.best, strict=True) for s, d in best]
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "doc_id", "score"])


def commonest(hashes: np.ndarray, counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Each row's commonest term, the first of equals; 0 for rows without a term."""
    out = np.zeros(len(sizes), np.int64)
    if len(hashes):
        starts = np.minimum(np.cumsum(sizes) - sizes, len(hashes) - 1)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        most = np.flatnonzero(counts == np.maximum.reduceat(counts, starts)[owner])
        out[owner[most][::-1]] = hashes[most][::-1]
    return out


def marks_of(hashes: np.ndarray, counts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each row's commonest term, number of words, and two sums that tell its terms and counts apart from others."""
    starts = np.cumsum(sizes) - sizes
    total = lambda x: np.add.reduceat(np.append(x, np.zeros(1, x.dtype)), starts) * (sizes > 0).astype(x.dtype)
    mixed = hashes.view(np.uint64) * (2 * counts.astype(np.uint64) + np.uint64(1))
    return commonest(hashes, counts, sizes), total(counts.astype(np.int64)), total(mixed), total((mixed ^ mixed >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15))


def order_of(keys: np.ndarray, sizes: np.ndarray, lead: np.ndarray, words: np.ndarray, one: np.ndarray, two: np.ndarray, k: int) -> np.ndarray:
    """Documents by their commonest term, without those that have no term or ``k`` equal ones with smaller keys."""
    order = np.lexsort((keys, one, two, lead))
    alike = np.zeros(len(order), bool)
    alike[1:] = np.logical_and.reduce([m[order][1:] == m[order][:-1] for m in (one, two, words, sizes)])
    run = np.arange(len(order)) - np.maximum.accumulate(np.where(alike, 0, np.arange(len(order))))
    return order[(run < k) & (sizes[order] > 0)]


class Part:
    """Documents of one shard as they came: a row each, and postings as numbers of terms and counts."""

    def __init__(self):
        self.rows: list[tuple[np.ndarray, ...]] = []
        self.docs = self.posts = 0
        # Room that takes memory only as it fills.
        self.place, self.times = np.empty(SHARD_POSTS, np.int32), np.empty(SHARD_POSTS, np.uint16)

    def add(self, rows: tuple[np.ndarray, ...], place: np.ndarray, times: np.ndarray) -> None:
        to = self.posts + len(place)
        if times.max(initial=0) >= 1 << 16 and self.times.itemsize < 4:
            self.times = self.times.astype(np.int32)
        if to > len(self.place):
            self.place, self.times = (np.concatenate([x[: self.posts], np.empty(2 * to - self.posts, x.dtype)]) for x in (self.place, self.times))
        self.place[self.posts : to], self.times[self.posts : to] = place, times
        self.rows.append(rows)
        self.docs, self.posts = self.docs + len(rows[0]), to


class Shard:
    """The inverted index of one shard, with term weights under the global statistics.

    Of documents with the same terms and counts, which score alike, only the ``k`` with
    the smallest keys can be among the k best; the others are left out. Terms are those
    of the lot, in order, with their numbers. Postings by document stay where they came;
    those by term hold the terms that are not common, and are put in place some
    documents at a time, so that a shard is never held twice.
    """

    def __init__(self, part: Part, terms: np.ndarray, numbers: np.ndarray, mean: float, k: int):
        keys, sizes, lead, words, one, two = (np.concatenate(c) for c in zip(*part.rows, strict=True))
        order = order_of(keys, sizes, lead, words, one, two, k)
        self.keys, self.size, self.k, self.n = keys[order], sizes[order], k, len(order)
        self.terms, self.numbers, self.place, self.times = terms, numbers, part.place, part.times
        ends = np.cumsum(sizes)
        self.start = (ends - sizes)[order]
        norm = K1 * (1 - B + B * words / mean) if mean else np.full(len(keys), K1)
        self.norm = norm[order]
        rank = np.full(len(keys), -1, np.int32)
        rank[order] = np.arange(self.n, dtype=np.int32)
        docs = np.cumsum([0, *(len(r[0]) for r in part.rows)])
        cuts = [(i, j, int(ends[i - 1]) if i else 0, int(ends[j - 1]) if j else 0) for i, j in zip(docs.tolist(), docs[1:].tolist(), strict=False)]
        count = np.zeros(len(terms), np.int32)
        for i, j, a, b in cuts:
            np.add(count, np.bincount(self.place[a:b][np.repeat(rank[i:j] >= 0, sizes[i:j])], minlength=len(count)), out=count, casting="unsafe")
        # The table of common terms, documents padded to whole tiles, and its block maxima.
        self.blocks = -(-max(self.n, 1) // (BLOCK * TILE)) * TILE
        common = np.flatnonzero(count > self.n * COMMON)
        common = common[np.argsort(-count[common], kind="stable")[:MOST_COMMON]]
        self.column = np.full(len(terms), -1, np.int32)
        self.column[common] = np.arange(len(common), dtype=np.int32)
        self.table = np.zeros((len(common), self.blocks * BLOCK), np.float32)
        count[common] = 0
        self.count = count
        self.first = np.cumsum(count, dtype=np.int64) - count
        free = self.first.copy()
        posts = int(count.sum(dtype=np.int64))
        self.post_doc, self.post_weight = np.empty(posts, np.uint16 if self.n <= 1 << 16 else np.int32), np.empty(posts, np.float32)
        for i, j, a, b in cuts:
            owner, times, place = np.repeat(rank[i:j], sizes[i:j]), self.times[a:b], self.place[a:b]
            weight = (times * (K1 + 1) / (times + np.repeat(norm[i:j], sizes[i:j]))).astype(np.float32)
            column = self.column[place]
            here = (column >= 0) & (owner >= 0)
            self.table[column[here], owner[here]] = weight[here]
            here = np.flatnonzero((column < 0) & (owner >= 0))
            here = here[np.argsort(place[here], kind="stable")]
            place = place[here]
            # Where a posting goes: the term's next free place, and one further for each of its term before it here.
            new = np.flatnonzero(np.append(True, place[1:] != place[:-1])) if len(place) else here
            many = np.diff(np.append(new, len(place)))
            to = spans(free[place[new]], many)
            self.post_doc[to], self.post_weight[to] = owner[here], weight[here]
            free[place[new]] += many
        self.most = self.table.reshape(len(common), self.blocks, BLOCK).max(2)

    def search(self, asked: Asked) -> tuple[int, int]:
        """Bring this shard's best into ``asked.best``; returns how many tiles were scored and how many there are."""
        if not self.n or not len(asked.ids):
            return 0, 0
        at = np.searchsorted(self.terms, asked.terms)
        at[at == len(self.terms)] = 0
        where = np.where(self.terms[at] == asked.terms, self.numbers[at], -1)
        weight_of, scored = np.zeros(len(self.terms)), 0
        for i in range(0, len(asked.order), BATCH):
            scored += self._batch(asked, asked.order[i : i + BATCH], where, weight_of)
        return scored, len(asked.order) * (self.blocks // TILE)

    def _batch(self, asked: Asked, rows: np.ndarray, where: np.ndarray, weight_of: np.ndarray) -> int:
        m, own = len(rows), []
        score = np.zeros((m, self.blocks * BLOCK), np.float32)
        wide = np.zeros((m, len(self.table)), np.float32)
        for r, q in enumerate(rows.tolist()):
            t, w = asked.query(q)
            t = where[t]
            t, w = t[t >= 0], w[t >= 0]
            own.append((t, w))
            column = self.column[t]
            wide[r, column[column >= 0]] = w[column >= 0]
            t, w = t[column < 0], w[column < 0].astype(np.float32)
            count = self.count[t]
            post = spans(self.first[t], count)
            if len(post):
                score[r, : self.n] = np.bincount(self.post_doc[post], self.post_weight[post] * np.repeat(w, count), self.n)
        least = np.array([asked.best[q][self.k - 1][0] if len(asked.best[q]) >= self.k else 0.0 for q in rows])
        rare = score.reshape(m, self.blocks, BLOCK).max(2)
        least = np.maximum(least, self._kth(rare))
        pivots = rare + wide @ self.most >= (least * (1 - SLACK) - 10.0**-DECIMALS)[:, None]
        tiles = pivots.reshape(m, -1, TILE).any(2)
        for tile in np.flatnonzero(tiles.any(0)).tolist():
            hit, stretch = np.flatnonzero(tiles[:, tile]), slice(tile * TILE * BLOCK, (tile + 1) * TILE * BLOCK)
            score[hit, stretch] += wide[hit] @ self.table[:, stretch]
        least = np.maximum(least, self._kth(score.reshape(m, self.blocks, BLOCK).max(2)))
        enter = score >= np.maximum(least * (1 - 2 * SLACK) - 10.0**-DECIMALS, 1e-30)[:, None]
        at, docs = np.nonzero(enter)
        cuts = np.searchsorted(at, np.arange(m + 1))
        for r, q in enumerate(rows.tolist()):
            found = docs[cuts[r] : cuts[r + 1]]
            if len(found) > self.k:
                near = score[r, found]
                found = found[near >= np.partition(near, len(near) - self.k)[len(near) - self.k] * (1 - 2 * SLACK) - 10.0**-DECIMALS]
            if len(found):
                t, w = own[r]
                weight_of[t] = w
                sizes = self.size[found]
                post = spans(self.start[found], sizes)
                times = self.times[post]
                weight = times * (K1 + 1) / (times + np.repeat(self.norm[found], sizes))
                exact = np.bincount(np.repeat(np.arange(len(found)), sizes), weight * weight_of[self.place[post]], len(found))
                weight_of[t] = 0
                best = asked.best[q] + [x for x in zip(np.round(exact, DECIMALS).tolist(), self.keys[found].tolist(), strict=True) if x[0] > 0]
                asked.best[q] = sorted(best, key=lambda x: (-x[0], x[1]))[: self.k]
        return int(tiles.sum())

    def _kth(self, most: np.ndarray) -> np.ndarray:
        """At most the k-th best of each row: the k-th greatest of what different blocks have."""
        if most.shape[1] < self.k:
            return np.zeros(len(most))
        return np.partition(most, most.shape[1] - self.k, axis=1)[:, most.shape[1] - self.k].astype(float) * (1 - SLACK)


class Lot:
    """The documents of one lot, in shards of bounded size: one that stays, or several that are indexed one at a time."""

    def __init__(self, mean: float, k: int):
        self.mean, self.k = mean, k
        self.parts = [Part()]
        # The terms so far, in order, and their numbers in the order they came.
        self.terms, self.numbers = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.waiting = 0
        self.built: Shard | None = None
        self.held: list[Asked] = []

    def add(self, keys: pa.Array, texts: pa.Array) -> None:
        for i in range(0, len(keys), 512):
            hashes, counts, sizes = vectors(texts.slice(i, 512).to_pylist())
            if self.parts[-1].docs >= SHARD_DOCS or self.parts[-1].posts >= SHARD_POSTS:
                self.parts.append(Part())
            rows = keys.slice(i, 512).fill_null(NO_KEY).to_numpy().copy(), sizes, *marks_of(hashes, counts, sizes)
            self.parts[-1].add(rows, self._numbered(hashes), counts)

    def _numbered(self, hashes: np.ndarray) -> np.ndarray:
        """The numbers of these terms; new terms get the next ones."""
        own, place = np.unique(hashes, return_inverse=True)
        at = np.searchsorted(self.terms, own)
        known = np.append(self.terms, 0)[at] == own
        known[at == len(self.terms)] = False
        number = np.empty(len(own), np.int32)
        number[known] = self.numbers[at[known]]
        number[~known] = np.arange(len(self.terms), len(self.terms) + np.count_nonzero(~known))
        self.terms, self.numbers = np.insert(self.terms, at[~known], own[~known]), np.insert(self.numbers, at[~known], number[~known])
        return number[place]

    def shards(self) -> Iterator[Shard]:
        """One shard after another; a lot of one shard keeps it."""
        if self.built:
            yield self.built
        elif len(self.parts) > 1:
            for part in self.parts:
                yield Shard(part, self.terms, self.numbers, self.mean, self.k)
        elif self.parts[0].docs:
            self.built = Shard(self.parts[0], self.terms, self.numbers, self.mean, self.k)
            yield self.built

    def answer(self, asked: Asked) -> Iterator[pa.RecordBatch]:
        """What the lot has for these queries; a lot of several shards lets them wait until there are enough."""
        self.held.append(asked)
        self.waiting += asked.size
        if len(self.parts) == 1 or self.waiting >= HELD_TERMS or sum(len(a.ids) for a in self.held) >= HELD_QUERIES:
            yield from self.answers()

    def answers(self) -> Iterator[pa.RecordBatch]:
        """What the lot has for the queries that wait."""
        if self.held:
            for shard in self.shards():
                for asked in self.held:
                    shard.search(asked)
                shard = None
            yield from (asked.results() for asked in self.held)
            self.held, self.waiting = [], 0


def spans(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The stretches from ``first`` of ``count`` numbers, end to end."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + count, count)


def dealt(frame: DataFrame, asked_blocks: DataFrame, lots: int) -> DataFrame:
    """Every text once, in its lot, and every block of queries once a lot; a lot is a partition, its texts come first.

    Copies of a block are made one after another. Spark's ``explode`` would hold all of a row's at once.
    """

    def copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                columns = b.slice(i, 1).columns
                for lot in range(lots):
                    yield pa.RecordBatch.from_arrays([pa.array([lot], pa.int32()), pa.array([1], pa.int32()), *columns], names=["lot", "kind", *BLOBS])

    sent = asked_blocks.select(*BLOBS).mapInArrow(copies, f"lot int, kind int, {QUERIES}")
    held = frame.withColumn("lot", F.pmod(F.monotonically_increasing_id(), F.lit(lots)).cast("int")).withColumn("kind", F.lit(0))
    return sent.unionByName(held, allowMissingColumns=True).repartitionById(lots, "lot").sortWithinPartitions("kind")


def search(docs: DataFrame, is_query, k: int = 10) -> DataFrame:
    """``query_id, rank, doc_id, score``: the k best rows of ``docs(doc_id, text)`` for each row where ``is_query`` holds.

    The texts of the query rows are the queries, whole, against all rows, their own
    included. Scores are rounded to 6 decimals; ties go to the smaller key. Queries
    without a word, null texts among them, and rows without a word of the query give
    no row. Repeated rows are found each for itself and ask once, with the first of
    their texts. Rows whose key is null can be found (their ``doc_id`` is null) but
    are no queries. An empty table gives no rows; other columns, whatever their names,
    are not read.

    Each block of queries goes to each lot, and lots grow with the postings: what is
    sent is all texts once, and all queries for each ``LOT_POSTS`` postings.
    """
    bounded_batches(docs.sparkSession)
    n = row_count(docs)
    frame = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = written(term_statistics(frame), "terms")
    words = known.where("term is null").agg(F.sum("df")).first()[0] or 0
    mean = words / n if n else 0.0
    asked = frame.where(is_query & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("text").alias("text"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 512):
                hashes, counts, sizes = vectors(b.column(1).slice(i, 512).to_pylist())
                ids = b.column(0).slice(i, 512).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
                lead = np.repeat(commonest(hashes, counts, sizes), sizes)
                yield pa.RecordBatch.from_arrays([pa.array(lead), ids, pa.array(hashes), pa.array(counts)], names=["lead", "query_id", "term", "n"])

    parts = asked.mapInArrow(rows, "lead long, query_id long, term long, n int")
    weighed = written(parts.join(known, "term"), "queries")
    asked_blocks = written(query_blocks(weighed, row_count(weighed)), "query-blocks")
    postings = known.where("term is not null").agg(F.sum("df")).first()[0] or 0
    lots = max(1, min(n, docs.sparkSession.sparkContext.defaultParallelism * LOTS_A_CORE), -(-postings // LOT_POSTS))
    stream = dealt(frame, asked_blocks, lots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lot = Lot(mean, k)
        for b in batches:
            asks = np.flatnonzero(np.asarray(b.column("kind")))
            texts = b.num_rows - len(asks)
            if texts:
                lot.add(b.column("doc_id").slice(0, texts), b.column("text").slice(0, texts))
            for i in asks.tolist():
                yield from lot.answer(Asked({c: b.column(c)[i].as_py() for c in BLOBS}, n))
        yield from lot.answers()

    found_in = stream.mapInArrow(run, "query_id long, doc_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first())
    return found_in.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def op2_bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each document whose id is divisible by 50, against all documents."""
    return search(documents(spark, sf_dir, "doc_id", "text"), F.col("doc_id") % 50 == 0)


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE text IS NOT NULL
), p AS (SELECT doc_id, t, count(*) AS n FROM (SELECT doc_id, unnest(w) AS t FROM d) GROUP BY ALL),
s AS (SELECT count(*) AS n_docs, avg(len(coalesce(w, []))) AS mean FROM documents LEFT JOIN d USING (doc_id)),
f AS (SELECT t, count(*) AS df FROM p GROUP BY t),
r AS (
  SELECT q.doc_id AS query_id, p.doc_id,
    round(sum(q.n * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * p.n * 2.2 / (p.n + 1.2 * (0.25 + 0.75 * len(w) / mean))), 6) AS score
  FROM p AS q JOIN f USING (t) JOIN p ON p.t = q.t JOIN d ON d.doc_id = p.doc_id, s
  WHERE q.doc_id % 50 = 0 GROUP BY ALL
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM r QUALIFY rank <= 10
"""

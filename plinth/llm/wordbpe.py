"""Byte-pair encoding with word ends: a backtracking encoder and an offset-table decoder.

The encoder finds, with one Aho-Corasick pass over the reversed word, every
vocabulary token that starts at each position. It takes the longest, checks it
against the previous token in a pair-compatibility table, falls back to shorter
ones and steps back from dead ends. Every position is given up at most once, so
the work is linear in the word, and the result equals the merges applied in rank
order. Decoding gathers token texts from one buffer by an offset table.
"""

from __future__ import annotations

import json
import os
import unicodedata
from functools import lru_cache

import numpy as np
import regex

#: Characters at which ``str.split`` splits but the tokenizer's ``\\s`` does not.
ODD_SPACE = ("\x1c", "\x1d", "\x1e", "\x1f")
#: Words and pieces kept per process; frequent ones come early, so a memo is simply not extended beyond this.
MEMO_WORDS, MEMO_PIECES = 120_000, 150_000
LIBRARY_WORDS, LIBRARY_PIECES = 300_000, 400_000
MEMO_PAIRS = 200_000
#: Up to here (Latin Extended-B) letters and marks are alike in all versions of Unicode in use.
LAST_LATIN = "\u024f"


def default_vocabulary() -> str:
    """Path of the vocabulary file that the queries name; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> list[str]:
    """The printable stand-in for each byte used by byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = {}, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(spare)
            spare += 1
    return [out[b] for b in range(256)]


class Cutter:
    """Cuts a stretch without white space and special tokens into normalised pre-tokens.

    Words of Latin letters, with or without one closing mark, need no pattern, and
    other Latin stretches meet the file's pattern here. Beyond Latin, where Unicode
    versions differ, the library's own normaliser and splitter decide.
    """

    def __init__(self, path: str, pattern: str):
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        self.normalize, self.split = whole.normalizer.normalize_str, whole.pre_tokenizer.pre_tokenize_str
        self.find = regex.compile(pattern, regex.V1).findall
        self.byte = {c: b for b, c in enumerate(byte_letters())}

    def __call__(self, unit: str) -> list[str]:
        if unit.isascii():
            text = unit.lower()
        elif max(unit) <= LAST_LATIN:
            text = unicodedata.normalize("NFC", unit).lower()
            if max(text) > LAST_LATIN:
                return self.beyond(unit)
        else:
            return self.beyond(unit)
        if text.isalpha():
            return [text]
        if text[-1] in ".,!|;:" and (head := text[:-1]).isalpha():
            return [head, text[-1]]
        return self.find(text)

    def beyond(self, unit: str) -> list[str]:
        return [bytes([self.byte[c] for c in piece]).decode("utf-8", "surrogatepass") for piece, _ in self.split(self.normalize(unit))]


class Unsupported(ValueError):
    """The vocabulary file uses a feature that this encoder does not implement."""


class WordBpe:
    """Encodes and decodes as the vocabulary file prescribes; truncation and padding are not applied.

    >>> bpe = WordBpe(default_vocabulary())
    >>> bpe.decode(bpe.encode("To be"))
    'to</w> be</w>'
    """

    def __init__(self, path: str):
        import ahocorasick

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]], [x["type"] for x in pre]
        if kinds != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) or spec["decoder"] or spec["post_processor"] or model["ignore_merges"]:
            raise Unsupported(path)
        self.end = model["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.cut = Cutter(path, pre[0]["pattern"]["Regex"])

        # Ranks: single symbols first, then merges in order; a word's last symbol is a symbol of its own.
        letters = byte_letters()
        self.letter = letters
        base = [*letters, *(c + self.end for c in letters)]
        rank = {s: i for i, s in enumerate(base)}
        self.split = [(i, i) for i in range(len(base))]
        self.pair: dict[tuple[int, int], int] = {}
        for left, right in merges:
            made = left + right
            if made in rank:
                raise Unsupported(f"{path}: two merges make {made!r}")
            rank[made] = len(self.split)
            self.pair[rank[left], rank[right]] = rank[made]
            self.split.append((rank[left], rank[right]))
        self.ids = np.full(len(rank), -1, np.int64)
        trie = ahocorasick.Automaton()
        for token, r in rank.items():
            self.ids[r] = vocab[token]
            symbols = self._symbols(token[: -len(self.end)], True) if token.endswith(self.end) else self._symbols(token, False)
            trie.add_word(symbols[::-1], (len(symbols), r))
        trie.make_automaton()
        self.trie = trie
        self.id_list = self.ids.tolist()
        self.compatible: dict[int, bool] = {}
        self.memo: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

        # Offset tables: token texts, each followed by a blank, and ids in decimal.
        text = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        size = max(text) + 1
        self.token_table = offset_table([text.get(i, "").encode() + b" " for i in range(size)])
        self.decimal_table = offset_table([str(i).encode() + b" " for i in range(size)])

    def _symbols(self, letters: str, last: bool) -> str:
        """Letters as a string over symbols; the last letter of a word is shifted out of the others' range."""
        return letters[:-1] + chr(ord(letters[-1]) + 0x1000) if last else letters

    def _fits(self, left: int, right: int) -> bool:
        """Whether merging never joins across the border of two adjacent tokens."""
        key = left << 20 | right
        known = self.compatible.get(key)
        if known is not None:
            return known
        pair, split, a, b, limit, out = self.pair, self.split, left, right, 1 << 62, True
        while True:
            made = pair.get((a, b))
            if made is not None and made < limit:
                out = False
                break
            if a > b:
                limit = a
                a = split[a][1]
                if a == limit:
                    limit = b + 1
                    b = split[b][0]
                    if b + 1 == limit:
                        break
            else:
                limit = b + 1
                b = split[b][0]
                if b + 1 == limit:
                    limit = a
                    a = split[a][1]
                    if a == limit:
                        break
        if len(self.compatible) < MEMO_PAIRS:
            self.compatible[key] = out
        return out

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one pre-token, which is a whole word for the merges."""
        letter = self.letter
        word = self._symbols("".join([letter[b] for b in piece.encode("utf-8", "surrogatepass")]), True)
        n = len(word)
        starts: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, found in self.trie.iter(word[::-1]):  # longest first at each place
            starts[n - 1 - end].append(found)
        dead = bytearray(n + 1)
        tokens: list[int] = []
        sizes: list[int] = []
        taken = [0] * n  # how many of a position's tokens were tried
        pos = 0
        while pos < n:
            options, k, moved = starts[pos], taken[pos], False
            last = tokens[-1] if tokens else -1
            while k < len(options):
                size, token = options[k]
                k += 1
                if not dead[pos + size] and (last < 0 or self._fits(last, token)):
                    taken[pos] = k
                    tokens.append(token)
                    sizes.append(size)
                    pos += size
                    if pos < n:
                        taken[pos] = 0
                    moved = True
                    break
            if not moved:
                dead[pos] = 1
                tokens.pop()
                pos -= sizes.pop()
        return [self.id_list[t] for t in tokens]

    def _piece(self, piece: str) -> bytes:
        got = np.array(self.encode_piece(piece), "<u4").tobytes()
        if len(piece) <= 64 and len(self.pieces) < MEMO_PIECES:
            self.pieces[piece] = got
        return got

    def _unit(self, unit: str) -> bytes:
        """Ids of a stretch without white space, as little-endian 32-bit integers."""
        get, own = self.pieces.get, self._piece
        got = b"".join([get(p) or own(p) for p in self.cut(unit)])
        if len(unit) <= 64 and len(self.memo) < MEMO_WORDS:
            self.memo[unit] = got
        return got

    def encode_bytes(self, text: str | None) -> bytes:
        """Ids of a text as little-endian 32-bit integers; null counts as empty."""
        if not text:
            return b""
        if self.cut_special is not None and "<|" in text and len(parts := self.cut_special.split(text)) > 1:
            return b"".join(np.array([self.special[p]], "<u4").tobytes() if k % 2 else self.encode_bytes(p) for k, p in enumerate(parts))
        if any(c in text for c in ODD_SPACE):
            units = regex.findall(r"[^\x20\x09-\x0D]+", text)
        else:
            units = text.split()
        memo, own = self.memo, self._unit
        get = memo.get
        return b"".join([get(u) or own(u) for u in units])

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """Token texts with a blank between, in UTF-8, gathered by the offset table."""
        return gather(self.token_table, ids)

    def decode(self, ids) -> str:
        return self.decode_bytes(np.asarray(ids, np.int64)).decode()

    def decimals(self, ids: np.ndarray) -> bytes:
        """The ids in decimal with a blank between."""
        return gather(self.decimal_table, ids)


def offset_table(entries: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One buffer with each entry's start and length."""
    lengths = np.array([len(e) for e in entries], np.int64)
    return np.frombuffer(b"".join(entries), np.uint8), np.cumsum(lengths) - lengths, lengths


def gather(table: tuple[np.ndarray, np.ndarray, np.ndarray], ids: np.ndarray, block: int = 1 << 16) -> bytes:
    """Entries of ``ids`` end to end, without the last entry's closing blank; works in blocks of bounded size."""
    buffer, start, length = table
    out = []
    for i in range(0, len(ids), block):
        some = ids[i : i + block].astype(np.int64, copy=False)
        sizes = length[some]
        ends = np.cumsum(sizes)
        index = np.arange(ends[-1]) + np.repeat(start[some] - ends + sizes, sizes)
        out.append(buffer[index].tobytes())
    return b"".join(out)[:-1]


@lru_cache(maxsize=2)
def bpe(path: str) -> WordBpe:
    """One encoder a process and file; its memo serves all tasks of that process."""
    return WordBpe(path)


class LibraryUnits:
    """The tokenizers library over distinct words, with its results kept for the process.

    A text is cut at white space, where neither normalisation nor merges reach
    across. Each distinct word is normalised and split as the file prescribes, and
    each distinct piece goes to the library's model once; what it returns is kept by
    piece and by word. Texts with special tokens go to the library whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]], [x["type"] for x in spec["pre_tokenizer"]["pretokenizers"]]
        self.plain = kinds == (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) and not spec["post_processor"]
        if self.plain:
            self.cut = Cutter(path, spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.letters = byte_letters()
        self.memo: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def encode_whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        letters = self.letters
        word = piece if piece.isascii() and piece.isprintable() else "".join([letters[b] for b in piece.encode("utf-8", "surrogatepass")])
        got = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(word)])
        if len(piece) <= 64 and len(self.pieces) < LIBRARY_PIECES:
            self.pieces[piece] = got
        return got

    def _unit(self, unit: str) -> bytes:
        get, own = self.pieces.get, self._piece
        got = b"".join([get(p) or own(p) for p in self.cut(unit)])
        if len(unit) <= 64 and len(self.memo) < LIBRARY_WORDS:
            self.memo[unit] = got
        return got

    def encode_one(self, text: str | None) -> bytes:
        """Ids of a text as little-endian 32-bit integers; null counts as empty."""
        if not text:
            return b""
        if not self.plain or "<|" in text or any(c in text for c in ODD_SPACE):
            return self.encode_whole(text)
        get, own = self.memo.get, self._unit
        return b"".join([get(u) or own(u) for u in text.split()])

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        return [self.encode_one(t) for t in texts]


@lru_cache(maxsize=2)
def library(path: str) -> LibraryUnits:
    """One wrapper a process and file."""
    return LibraryUnits(path)

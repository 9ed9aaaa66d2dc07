"""Operator 6: secrets by patterns and by sliding-window entropy.

Base kinds are patterns. The method adds kind ``entropy``: within candidate
strings, runs of characters that keys are written in, a window of fixed width
moves on one character at a time and its Shannon entropy is kept up to date from
character counts. The threshold depends on the string's character class. Windows
above it merge to spans. An allow-list suppresses strings that only look random.
The work is a map over rows: no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from math import log2

from pyspark.sql import DataFrame, SparkSession

from plinth.llm.common import bounded_batches, documents, map_texts
from plinth.llm.spans import Free, digest, joined, ordered, replaced

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
NAMES = ("passw", "secret", "token", "apikey", "api_key")
DIGIT = re.compile(r"[0-9]")

#: Width of the window; least bits a character in it by character class; least length of a candidate.
WIDTH = 20
THRESHOLDS = {"hex": 3.0, "alnum": 3.6, "base64": 3.7}
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Strings that are random-looking but public: identifiers, digests in integrity notes, paths, data of pictures.
ALLOWED = re.compile(
    r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|(sha(1|224|256|384|512)|md5)[-_=].*|(?:/[a-z][a-z0-9_-]*+){3,}+/?|[A-Z_]+|[a-z_-]+|[0-9_=/+-]+|iVBORw0KGgo.*|R0lGOD.*|(0123456789|abcdefghijklmnopqrstuvwxyz|ABCDEFGHIJKLMNOPQRSTUVWXYZ|[/+=_-])+"
)
#: ``c log2 c``; a character enters the window before another leaves it.
_TERM = [0.0, *(c * log2(c) for c in range(1, WIDTH + 2))]


def char_class(s: str) -> str | None:
    """``hex``, ``alnum`` or ``base64``; null for strings without both digits and letters."""
    if not DIGIT.search(s) or not re.search("[A-Za-z]", s):
        return None
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", s):
        return "hex"
    return "alnum" if s.isalnum() else "base64"


def hot_windows(s: str, least: float, width: int = WIDTH) -> list[tuple[int, int]]:
    """Merged stretches of windows whose entropy is at least ``least`` bits a character."""
    counts: dict[str, int] = {}
    total = 0.0  # sum of c log2 c; entropy = log2 width - total / width
    bound = width * (log2(width) - least) + 1e-9
    out: list[tuple[int, int]] = []
    for i, c in enumerate(s):
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += _TERM[n + 1] - _TERM[n]
        if i >= width:
            gone = s[i - width]
            n = counts[gone]
            counts[gone] = n - 1
            total += _TERM[n - 1] - _TERM[n]
        if i >= width - 1 and total <= bound:
            start = i - width + 1
            if out and start <= out[-1][1]:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((start, i + 1))
    return out


def mixed_enough(s: str, kind: str) -> bool:
    """Whether a stretch changes between letters and digits as keys do, not as a word with a number does."""
    changes = sum(a.isdigit() != b.isdigit() for a, b in zip(s, s[1:], strict=False))
    return changes >= (4 if kind == "hex" else 5) or (changes >= 3 and re.search("[a-z]", s) is not None and re.search("[A-Z]", s) is not None)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the three patterns, leftmost and not overlapping within a kind."""
    low, out = text.lower(), []
    if any(n in low for n in NAMES) or not text.isascii():
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return out


def entropy_spans(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The method's own spans: none that a base span overlaps."""
    if not DIGIT.search(text):
        return []
    out, free = [], Free(taken)
    for m in CANDIDATE.finditer(text):
        s = m[0]
        kind = char_class(s)
        if kind is None or ALLOWED.fullmatch(s):
            continue
        for a, b in hot_windows(s, THRESHOLDS[kind]):
            if mixed_enough(s[a:b], kind) and free(m.start() + a, m.start() + b):
                out.append(("entropy", m.start() + a, m.start() + b))
    return out


def find_secrets(text: str | None) -> tuple[list, list]:
    """Base spans and all spans, both in order."""
    base = ordered(base_spans(text or ""), KINDS)
    return base, ordered(base + entropy_spans(text or "", base), KINDS)


def scan_secrets(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, counts of the base kinds and of ``entropy``, ``base_sha256`` and ``spans``.

    Null and empty texts have no spans; texts are scanned whole; repeated rows each
    give a row; an empty table gives no rows; other columns are not read.
    """

    def kernel(texts: Iterable[str | None]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_entropy")}
        for t in texts:
            base, spans = find_secrets(t)
            for k in KINDS[:3]:
                out[f"n_{k}"].append(sum(s[0] == k for s in base))
            out["base_sha256"].append(digest(base))
            out["spans"].append(joined(spans))
            out["n_entropy"].append(len(spans) - len(base))
        return out

    return map_texts(docs, kernel, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_entropy long", keep=keep)


def redact_secrets(docs: DataFrame, mark: str = "[secret]", length: str = "n_chars") -> DataFrame:
    """``docs`` with every span in ``text`` put as ``mark`` and, if there, the column ``length`` set anew.

    Null texts stay null and empty ones empty. Texts are scanned whole, however long.
    Rows without a span are returned as they are; repeated rows each stay; an empty
    table gives no rows. Other columns pass through, whatever their names.
    """
    import pyarrow as pa

    names = docs.columns
    bounded_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            at = names.index("text")
            texts, changed = batch.column(at).to_pylist(), {}
            for i, t in enumerate(texts):
                if t and (spans := find_secrets(t)[1]):
                    changed[i] = replaced(t, spans, mark)
            if changed:
                columns = batch.columns
                columns[at] = pa.array([changed.get(i, t) for i, t in enumerate(texts)], batch.schema.field(at).type)
                if length in names:
                    k = names.index(length)
                    columns[k] = pa.array([len(changed[i]) if i in changed else v for i, v in enumerate(batch.column(k).to_pylist())], batch.schema.field(k).type)
                batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            yield batch

    # Places instead of names, so that any name passes.
    plain = docs.toDF(*(f"c{k}" for k in range(len(names))))
    return plain.mapInArrow(run, plain.schema).toDF(*names)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    return scan_secrets(documents(spark, sf_dir, "doc_id", "text"))

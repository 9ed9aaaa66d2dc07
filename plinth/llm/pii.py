"""Operator 4: personal data by patterns and a skip-chain conditional random field.

Patterns give the base spans, which stay as they are. A document's mentions
(numbers, addresses and the user names and digits that occur in them) form the
nodes of a graph: neighbours in the text share a chain potential, and distant
mentions that repeat or resemble each other share a skip potential. Loopy belief
propagation settles each mention's label over the whole document, so a number that
is a phone number once is one wherever it stands, in whatever form. Mentions that
end with a label and overlap no base span are the method's spans.

Weights are trained here, by pseudo-likelihood on a bounded sample of documents
whose mentions the patterns label (``SAMPLE`` rows with mentions; a rare pattern
that the sample lacks keeps its prior weights). Skip edges tie a mention to the
nearest earlier one with the same key and to the first, not to all, so a repeated
mention costs its count and no more. The work is a map over rows: no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.llm.common import documents, map_texts
from plinth.llm.spans import Free, digest, joined, ordered

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
#: Each takes a whole run and then, if it can, the rest; a run without the rest is passed over and costs its length.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]++(@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)?")
IP = re.compile(r"[0-9]++((?:\.[0-9]+){3})?")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
NUMBER = re.compile(r"\+?\(?[0-9](?:[\x20().-]{0,2}[0-9])*")
WORD_MENTION = re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+@-]*[A-Za-z0-9]")

#: Documents that train the weights, rounds of message passing, and the least belief for a span.
SAMPLE, ROUNDS, LEAST_BELIEF = 400, 12, 0.9
#: A user name must have this many characters and a digit or point to be looked for elsewhere.
USER_CHARS = 6


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c)
        total += (d * 2 - 9 if d > 4 else d * 2) if k % 2 else d
    return total % 10 == 0


def only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the four patterns; matches that fail their test are dropped and not tried again."""
    out = []
    if "@" in text:
        out += [("email", *m.span()) for m in EMAIL.finditer(text) if m[1]]
    if DIGIT.search(text):
        if "." in text:
            out += [("ip", *m.span()) for m in IP.finditer(text) if m[1] and all(len(q := p.lstrip("0")) < 4 and int(q or "0") <= 255 for p in m[0].split("."))]
        out += [("card", *m.span()) for m in CARD.finditer(text) if 14 <= len(d := only_digits(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            out += [("phone", *m.span()) for m in PHONE.finditer(text) if 10 <= len(only_digits(m[0])) <= 15]
    return ordered(out, KINDS)


@dataclass
class Mention:
    """A node: where it stands, its pattern's label if any, and the key that ties it to others."""

    start: int
    end: int
    text: str
    label: int  # -1: not labelled by a pattern
    key: str


def mentions(text: str, base: list[tuple[str, int, int]]) -> list[Mention]:
    """Base spans, other numbers of 7 digits or more, and words equal to a user name of an address."""
    out = [Mention(s, e, text[s:e], KINDS.index(k) + 1, key_of(text[s:e], k)) for k, s, e in base]
    users = {m.text.split("@")[0].lower() for m in out if m.label == 1}
    users = {u for u in users if len(u) >= USER_CHARS and re.search("[0-9._]", u)}
    taken = sorted((s, e) for _, s, e in base)
    free = Free(base)
    if DIGIT.search(text):
        at = 0
        for s, e in [*taken, (len(text), len(text))]:  # numbers between the base spans
            for m in NUMBER.finditer(text, at, s) if s > at else ():
                digits = only_digits(m[0])
                if len(digits) >= 7:
                    out.append(Mention(m.start(), m.end(), m[0], -1, "d" + digits[-9:]))
            at = max(at, e)
    if users:
        for m in WORD_MENTION.finditer(text):
            if m[0].lower() in users and free(m.start(), m.end()):
                out.append(Mention(m.start(), m.end(), m[0], -1, "u" + m[0].lower()))
    return sorted(out, key=lambda m: (m.start, m.end))


def key_of(s: str, kind: str) -> str:
    """Numbers resemble each other if their last nine digits agree, addresses if their user names do."""
    return "u" + s.split("@")[0].lower() if kind == "email" else "d" + only_digits(s)[-9:]


CUES = {"email": ("mail", "contact", "write"), "ip": ("ip", "host", "server", "address"), "card": ("card", "visa", "credit", "pay"), "phone": ("phone", "tel", "call", "fax", "mobile")}
FEATURES = 20


def features(m: Mention, text: str) -> list[int]:
    """Indexes of the features that hold: the mention's shape and cue words before it."""
    d = len(only_digits(m.text))
    out = [0]
    out.append(1 + (d > 0) + (d > 6) + (d > 9) + (d > 13) + (d > 15) + (d > 19))
    out += [8] * ("@" in m.text) + [9] * m.text.startswith("+") + [10] * (m.text.count(".") == 3) + [11] * ("(" in m.text) + [12] * bool(re.search("[A-Za-z]", m.text))
    if 14 <= d <= 19 and m.text[-1] in "0123456789":
        out.append(13 + luhn(only_digits(m.text)))
    before = text[max(0, m.start - 24) : m.start].lower()
    for k, kind in enumerate(KINDS):
        if any(re.search(rf"\b{c}", before) for c in CUES[kind]):
            out.append(15 + k)
    if "." in m.text and "@" not in m.text:
        out.append(19)
    return out


def edges(ms: list[Mention]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Chain edges between neighbours that are near, skip edges between mentions of one key."""
    chain = [(i, i + 1) for i in range(len(ms) - 1) if ms[i + 1].start - ms[i].end <= 40]
    first: dict[str, int] = {}
    last: dict[str, int] = {}
    skip = []
    for i, m in enumerate(ms):
        if m.key in last:
            skip.append((last[m.key], i))
            if first[m.key] != last[m.key]:
                skip.append((first[m.key], i))
        first.setdefault(m.key, i)
        last[m.key] = i
    return chain, skip


@dataclass
class Weights:
    """Potentials in logs: features by label, and label by label for chain and skip edges."""

    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def prior() -> Weights:
    """Weights before training: labels need evidence, and equal keys ask for equal labels."""
    n = len(LABELS)
    unary = np.zeros((FEATURES, n))
    unary[0] = [2.0, 0, 0, 0, 0]
    return Weights(unary, np.zeros((n, n)), 4.0 * np.eye(n))


def beliefs(ms: list[Mention], text: str, w: Weights, rounds: int = ROUNDS) -> np.ndarray:
    """Label beliefs of each mention by loopy sum-product, in parallel rounds with damping."""
    n, labels = len(ms), len(LABELS)
    unary = np.array([w.unary[features(m, text)].sum(0) for m in ms])
    for i, m in enumerate(ms):
        if m.label >= 0:  # the patterns' spans are evidence
            unary[i] = -30.0
            unary[i, m.label] = 0.0
    chain, skip = edges(ms)
    pairs = chain + skip
    if pairs:
        a = np.array([p[0] for p in pairs] + [p[1] for p in pairs])
        b = np.array([p[1] for p in pairs] + [p[0] for p in pairs])
        forward = np.array([w.chain] * len(chain) + [w.skip] * len(skip))
        potential = np.concatenate([forward, forward.transpose(0, 2, 1)])
        back = np.roll(np.arange(len(a)), len(pairs))
        sent = np.zeros((len(a), labels))
        for _ in range(rounds):
            total = unary.copy()
            np.add.at(total, b, sent)
            out = _log_sum(total[a][:, :, None] - sent[back][:, :, None] + potential)
            out -= _log_sum(out[:, :, None])
            if np.abs(out - sent).max() < 1e-4:
                sent = out
                break
            sent = 0.5 * sent + 0.5 * out
        np.add.at(unary, b, sent)
    unary -= unary.max(1, keepdims=True)
    p = np.exp(unary)
    return p / p.sum(1, keepdims=True)


def _log_sum(x: np.ndarray) -> np.ndarray:
    top = x.max(1)
    return top + np.log(np.exp(x - top[:, None]).sum(1))


def train(texts: list[str], steps: int = 60, rate: float = 0.5, decay: float = 0.02) -> Weights:
    """Weights by gradient steps on the pseudo-likelihood of the patterns' labels, from the prior, which decay pulls back to.

    A mention that no pattern labels counts as ``none`` unless one of its key is labelled.
    """
    w, start = prior(), prior()
    rows, truth, pairs = [], [], {"chain": [], "skip": []}
    for text in texts:
        ms = mentions(text, base_spans(text))
        named = {m.key for m in ms if m.label >= 0}
        offset = len(rows)
        for m in ms:
            f = np.zeros(FEATURES)
            f[features(m, text)] = 1
            rows.append(f)
            truth.append(-1 if m.label < 0 and m.key in named else max(m.label, 0))
        for name, found in zip(("chain", "skip"), edges(ms), strict=True):
            pairs[name] += [(offset + i, offset + j) for i, j in found]
    if not rows:
        return w
    x, y = np.array(rows), np.array(truth)
    known = y >= 0
    target = np.eye(len(LABELS))[np.maximum(y, 0)]
    arrays = {k: np.array([p for p in v if known[p[0]] and known[p[1]]], np.int64).reshape(-1, 2) for k, v in pairs.items()}
    n = max(int(known.sum()), 1)
    for _ in range(steps):
        score = x @ w.unary
        for k, table in (("chain", w.chain), ("skip", w.skip)):
            i, j = arrays[k].T
            np.add.at(score, i, table[:, y[j]].T)
            np.add.at(score, j, table[y[i]])
        score -= score.max(1, keepdims=True)
        p = np.exp(score)
        p /= p.sum(1, keepdims=True)
        wrong = (target - p) * known[:, None]
        w.unary += rate * (x.T @ wrong / n * 10 - decay * (w.unary - start.unary))
        for k, table, zero in (("chain", w.chain, start.chain), ("skip", w.skip, start.skip)):
            i, j = arrays[k].T
            step = np.zeros_like(table)
            np.add.at(step.T, y[j], wrong[i])
            np.add.at(step, y[i], wrong[j])
            table += rate * (step / n * 5 - decay * (table - zero))
    return w


def find_personal(text: str | None, w: Weights) -> tuple[list, list]:
    """Base spans and all spans, both in order."""
    text = text or ""
    base = base_spans(text)
    if not base:  # without evidence there is nothing for a document's mentions to agree with
        return base, base
    ms = mentions(text, base)
    if len(ms) == len(base):
        return base, base
    belief = beliefs(ms, text, w)
    own = []
    for m, p in zip(ms, belief, strict=True):
        k = int(p.argmax())
        if m.label < 0 and k and p[k] >= LEAST_BELIEF:
            own.append((LABELS[k], m.start, m.end))
    kept: list[tuple[str, int, int]] = []
    for s in own:
        if not kept or kept[-1][2] <= s[1]:  # mentions are in order
            kept.append(s)
    return base, ordered(base + kept, KINDS)


def fit(docs: DataFrame, rows: int = SAMPLE) -> Weights:
    """Weights from the ``rows`` documents with the smallest hashes among those with a digit or an address sign.

    The order of files and partitions does not matter. Hashes are ranked first, so
    that only the chosen texts leave the executors.
    """
    marked = docs.select("text", F.xxhash64("text").alias("h")).where(F.col("text").rlike("[0-9@]"))
    least = [r["h"] for r in marked.select("h").distinct().orderBy("h").limit(rows).collect()]
    some = marked.where(F.col("h") <= least[-1]).dropDuplicates(["h"]).collect() if least else []
    return train([r["text"] for r in sorted(some, key=lambda r: r["h"])])


def scan_personal(docs: DataFrame, weights: Weights | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, counts of the base kinds, ``base_sha256``, ``spans`` and ``n_added``.

    Null and empty texts have no spans; texts are scanned whole; repeated rows each
    give a row; an empty table gives no rows; other columns are not read.
    """
    w = weights or fit(docs)

    def kernel(texts: Iterable[str | None]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in (*(f"n_{x}" for x in KINDS), "base_sha256", "spans", "n_added")}
        for t in texts:
            base, spans = find_personal(t, w)
            for k in KINDS:
                out[f"n_{k}"].append(sum(s[0] == k for s in base))
            out["base_sha256"].append(digest(base))
            out["spans"].append(joined(spans))
            out["n_added"].append(len(spans) - len(base))
        return out

    return map_texts(docs, kernel, ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_added long", keep=keep)


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    return scan_personal(documents(spark, sf_dir, "doc_id", "text"))

"""Spans of kinds within a text, in the form that the scanning operators return."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from itertools import accumulate


def ordered(spans: list[tuple[str, int, int]], kinds: tuple[str, ...]) -> list[tuple[str, int, int]]:
    """By start, then by kind as listed."""
    return sorted(spans, key=lambda s: (s[1], kinds.index(s[0]), s[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    """``kind:start:end``, comma-joined; code points, end exclusive."""
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()


class Free:
    """Whether a stretch overlaps none of the given ones; each answer takes the logarithm of their number."""

    def __init__(self, taken: list[tuple[str, int, int]]):
        own = sorted((s, e) for _, s, e in taken)
        self.starts = [s for s, _ in own]
        self.ends = list(accumulate((e for _, e in own), max))

    def __call__(self, start: int, end: int) -> bool:
        k = bisect_left(self.starts, end)
        return k == 0 or self.ends[k - 1] <= start


def replaced(text: str, spans: list[tuple[str, int, int]], mark: str) -> str:
    """The text with each stretch that spans cover put as ``mark``; overlapping spans share one mark."""
    out, at = [], 0
    for _, s, e in sorted(spans, key=lambda x: (x[1], x[2])):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])

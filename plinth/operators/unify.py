"""Anti-unification of syntax trees: what two clones share and where they differ."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from plinth.functions.sequences import lcs_pairs
from plinth.sources.facts import TARGETS, _extract, size_of
from plinth.sources.ts_parser import Node


@dataclass
class Generalisation:
    """Nodes that both trees have, their sizes, and the places where they differ as (kind, left, right)."""

    shared: int = 0
    left_size: int = 0
    right_size: int = 0
    variables: list[tuple[str, str, str]] = field(default_factory=list)

    @property
    def similarity(self) -> float:
        return self.shared / max(self.left_size, self.right_size, 1)


def shown(n: Node | None) -> str:
    if n is None:
        return ""
    return n.attrs.get("name") or n.attrs.get("raw") or n.attrs.get("text") or n.type


def anti_unify(left: Node, right: Node) -> Generalisation:
    """One walk of both trees; children of unlike lists are aligned by their kinds, in the time of that alignment."""
    out = Generalisation(left_size=size_of(left), right_size=size_of(right))

    def differ(kind: str, a: Node | None, b: Node | None) -> None:
        out.variables.append((kind, shown(a), shown(b)))

    def walk(a: Node, b: Node) -> None:
        if a.type != b.type:
            differ("structural", a, b)
            return
        if a.attrs != b.attrs:
            kind = {"Identifier": "identifier", "Literal": "literal", "TemplateElement": "literal", "TSType": "type"}.get(a.type)
            if kind is None:
                named = {k: v for k, v in a.attrs.items() if k != "name"} == {k: v for k, v in b.attrs.items() if k != "name"}
                kind = "identifier" if named else "structural"
            differ(kind, a, b)
            if kind in ("structural", "literal", "type"):
                return
        out.shared += 1
        ka, kb = ([(k, c.type) for k, c in x.children] for x in (a, b))
        if ka == kb:
            for (_, x), (_, y) in zip(a.children, b.children, strict=True):
                walk(x, y)
            return
        pairs = lcs_pairs(ka, kb)
        for i, j in pairs:
            walk(a.children[i][1], b.children[j][1])
        for i in set(range(len(ka))) - {i for i, _ in pairs}:
            differ("structural", a.children[i][1], None)
        for j in set(range(len(kb))) - {j for _, j in pairs}:
            differ("structural", None, b.children[j][1])

    walk(left, right)
    return out


def classify(g: Generalisation) -> str:
    """Structural differences decide; else one kind alone names the class, several are mixed, none is a mere rename."""
    kinds = {k for k, _, _ in g.variables}
    if "structural" in kinds:
        return "structural-diff"
    if not kinds or kinds == {"identifier"}:
        return "rename-only"
    return {"literal": "literal-variant", "type": "type-variant"}[next(iter(kinds))] if len(kinds) == 1 else "mixed"


def suggested_params(diffs: list[Generalisation]) -> list[tuple[str, str, str]] | None:
    """Parameters that would make a group one, from its first pair, if all pairs differ in one way."""
    classes = {classify(g) for g in diffs}
    return sorted(set(diffs[0].variables)) if len(classes) == 1 and classes <= {"literal-variant", "type-variant", "rename-only"} else None


PAIRS = "path string, left_off int, right_off int, similarity double, diff string, n_variables int"


def file_pairs(files: DataFrame, least: float = 0.7, min_size: int = 12) -> DataFrame:
    """Neighbouring clone targets of one file and kind that are alike to ``least`` or more, with how they differ.

    Targets are compared with the next of their kind in the order of their sizes, so a
    file of n targets costs n comparisons and not their pairs.
    """

    def rows(path: str, text: str, root: Node) -> list[tuple]:
        by: dict[str, list[tuple[int, int, Node]]] = {}
        for n in root.walk():
            if n.type in TARGETS and (size := size_of(n)) >= min_size:
                by.setdefault(n.type, []).append((size, n.start, n))
        out = []
        for found in by.values():
            found.sort(key=lambda x: x[:2])
            for (_, i, a), (_, j, b) in zip(found, found[1:], strict=False):
                if a.end <= b.start or b.end <= a.start:
                    g = anti_unify(a, b)
                    if g.similarity >= least:
                        out.append((path, i, j, g.similarity, classify(g), len(g.variables)))
        return out

    return _extract(files, PAIRS, rows)

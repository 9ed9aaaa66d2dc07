"""Search for a code pattern (I8): a statement or expression in which ``$name`` stands for any node and ``$$name`` for any list."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

from plinth.sources.facts import _extract, canonical
from plinth.sources.ts_parser import Node, ParseError, parse

FOUND = "path string, start_off int, end_off int, line int, text string, bindings string"


def compile_pattern(pattern: str) -> Node:
    """The pattern's node; an expression on its own matches expressions."""
    tree = parse(pattern)
    if len(tree.children) != 1:
        raise ParseError("a pattern is one statement or expression")
    node = tree.children[0][1]
    return node.get("expression") if node.type == "ExpressionStatement" and not pattern.rstrip().endswith(";") else node


def _hole(n: Node) -> str | None:
    """The name of the hole that a pattern's node is, with its dollar signs."""
    if n.type == "ExpressionStatement" and n.children:
        n = n.children[0][1]
    name = n.attrs.get("name", "") if n.type == "Identifier" else ""
    return name if name.startswith("$") and len(name) > 1 else None


def match(p: Node, n: Node, held: dict[str, list[Node]]) -> bool:
    """Whether ``n`` fits; a hole that occurs again must fit an equal node."""

    def bind(name: str, nodes: list[Node]) -> bool:
        if name in held:
            form = lambda xs: canonical(Node("held", 0, 0, {}, [("held", x) for x in xs]), None)
            return form(held[name]) == form(nodes)
        held[name] = nodes
        return True

    hole = _hole(p)
    if hole and not hole.startswith("$$"):
        return bind(hole, [n])
    if p.type != n.type or p.attrs != n.attrs:
        return False
    keys = list(dict.fromkeys([k for k, _ in p.children] + [k for k, _ in n.children]))
    return all(_lists(p.all(k), n.all(k), held, bind) for k in keys)


def _lists(ps: list[Node], ns: list[Node], held: dict, bind) -> bool:
    if not ps:
        return not ns
    hole = _hole(ps[0])
    if hole and hole.startswith("$$"):
        for k in range(len(ns) - len(ps) + 1, -1, -1):
            before = dict(held)
            if bind(hole, ns[:k]) and _lists(ps[1:], ns[k:], held, bind):
                return True
            held.clear()
            held.update(before)
        return False
    return bool(ns) and match(ps[0], ns[0], held) and _lists(ps[1:], ns[1:], held, bind)


def find_pattern(files: DataFrame, pattern: str) -> DataFrame:
    """``path, start_off, end_off, line, text, bindings`` of all nodes that fit; ``bindings`` is JSON from holes to texts.

    Texts are at most 300 characters. Files that do not parse have no rows; a pattern
    that does not parse raises.
    """
    compile_pattern(pattern)

    def rows(path: str, text: str, root: Node) -> list[tuple]:
        wanted, out = compile_pattern(pattern), []
        for n in root.walk():
            held: dict[str, list[Node]] = {}
            if match(wanted, n, held):
                made = {k: text[v[0].start : v[-1].end][:300] if v else "" for k, v in sorted(held.items())}
                out.append((path, n.start, n.end, text.count("\n", 0, n.start) + 1, text[n.start : n.end].strip()[:300], json.dumps(made)))
        return out

    return _extract(files, FOUND, rows)

"""Fact tables from source files: syntax nodes, relations, canonical fingerprints, control-flow facts.

Each extractor is one pass of Arrow batches over ``files(path, source_text)``; a file
that does not parse gives no facts but a row in :func:`parse_errors`.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from plinth.sources.rewrites import normalised
from plinth.sources.ts_parser import Node, ParseError, parse

FUNCTIONS = frozenset(("FunctionDeclaration", "FunctionExpression", "ArrowFunctionExpression"))
NESTING = frozenset(("IfStatement", "ForStatement", "ForOfStatement", "ForInStatement", "WhileStatement", "DoWhileStatement", "SwitchStatement", "ConditionalExpression", "CatchClause"))
EXITS = frozenset(("ReturnStatement", "ThrowStatement", "BreakStatement", "ContinueStatement"))


def _extract(files: DataFrame, schema: str, rows: Callable[[str, str, Node], list[tuple]]) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(files.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    made = rows(path, text or "", parse(text or ""))
                except ParseError:
                    continue
                if made:
                    columns = list(zip(*made, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return files.select("path", "source_text").mapInArrow(run, schema)


def parse_errors(files: DataFrame) -> DataFrame:
    """``path, message`` of the files that detectors must skip."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bad = []
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    parse(text or "")
                except ParseError as e:
                    bad.append((path, str(e)))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in bad], pa.string()) for k in (0, 1)], names=["path", "message"])

    return files.select("path", "source_text").mapInArrow(run, "path string, message string")


NODES = "path string, node_id int, parent_id int, pre int, post int, depth int, type string, key string, child_ix int, start_off int, end_off int, line int, fn_id int, nest int, attrs map<string,string>"


def ast_nodes(files: DataFrame) -> DataFrame:
    """Syntax nodes in pre-order with nested-set numbers; a subtree is the range ``pre .. post``.

    ``fn_id`` is the enclosing function (its own id for a function, -1 at the top),
    ``nest`` how many nesting constructs of that function hold the node; an ``else if``
    nests no deeper than its ``if``, and both have that ``if`` as their ``chain``.
    """

    def rows(path: str, text: str, root: Node) -> list[tuple]:
        out: list[list] = []
        breaks = [i for i, c in enumerate(text) if c == "\n"]
        from bisect import bisect_left

        def visit(n: Node, parent: int, depth: int, key: str, ix: int, fn: int, nest: int, chain: int = -1) -> int:
            me = len(out)
            if n.type in FUNCTIONS:
                fn, nest = me, 0
            attrs = list(n.attrs.items())
            if n.type == "IfStatement":
                chain = me if chain < 0 else chain
                attrs.append(("chain", str(chain)))
            row = [path, me, parent, me, me, depth, n.type, key, ix, n.start, n.end, bisect_left(breaks, n.start) + 1, fn, nest, attrs]
            out.append(row)
            inner = nest + (n.type in NESTING)
            for k, (name, c) in enumerate(n.children):
                chained = n.type == "IfStatement" and name == "alternate" and c.type == "IfStatement"
                kept = name in ("test", "discriminant") or chained
                row[4] = visit(c, me, depth + 1, name, k, fn, nest if kept else inner, chain if chained else -1)
            return out[-1][3]

        visit(root, -1, 0, "", 0, -1, 0)
        return [tuple(r) for r in out]

    return _extract(files, NODES, rows)


RELATIONS = "path string, type string, specifier string, imported string, local string, is_type boolean, offset int"


def relations(files: DataFrame) -> DataFrame:
    """One row an imported or exported name: ``imports``, ``re-exports``, ``exports``, ``dynamic``; a whole module's name is ``*``."""

    def rows(path: str, text: str, root: Node) -> list[tuple]:
        out = []
        for n in root.walk():
            if n.type == "ImportDeclaration":
                kind = n.attrs.get("importKind") == "type"
                for s in n.all("specifiers"):
                    out.append((path, "imports", n.attrs["source"], s.attrs.get("imported", "*"), s.attrs["local"], kind or s.attrs.get("kind") == "type", n.start))
                if not n.children:
                    out.append((path, "imports", n.attrs["source"], None, None, kind, n.start))
            elif n.type == "ExportNamedDeclaration":
                for s in n.all("specifiers"):
                    source = n.attrs.get("source")
                    out.append((path, "re-exports" if source is not None else "exports", source, s.attrs["local"], s.attrs["imported"], n.attrs.get("exportKind") == "type" or s.attrs.get("kind") == "type", n.start))
                d = n.get("declaration")
                if d is not None:
                    names = [x.get("id") for x in d.all("declarations")] if d.type == "VariableDeclaration" else [d.get("id")]
                    for i in names:
                        if i is not None and i.type == "Identifier":
                            out.append((path, "exports", None, i.attrs["name"], i.attrs["name"], d.type in ("TSTypeAliasDeclaration", "TSInterfaceDeclaration"), n.start))
            elif n.type == "ExportDefaultDeclaration":
                out.append((path, "exports", None, "default", "default", False, n.start))
            elif n.type == "ExportAllDeclaration":
                out.append((path, "re-exports", n.attrs["source"], "*", n.attrs.get("exported"), False, n.start))
            elif n.type == "ImportExpression":
                arg = n.children[0][1] if n.children else None
                plain = arg is not None and arg.type == "Literal" and arg.attrs.get("kind") == "string"
                out.append((path, "dynamic", arg.attrs["raw"][1:-1] if plain else None, "*", None, False, n.start))
        return out

    return _extract(files, RELATIONS, rows)


# -- canonical fingerprints

TARGETS = frozenset((*FUNCTIONS, "ClassDeclaration", "ClassExpression", "MethodDefinition", "TSTypeAliasDeclaration", "TSInterfaceDeclaration"))


def bound_names(n: Node) -> set[str]:
    """Names that a subtree declares: parameters, variables, functions, classes, catch parameters."""
    out: set[str] = set()

    def pattern(p: Node) -> None:
        if p.type == "Identifier":
            out.add(p.attrs["name"])
        elif p.type == "Property":
            pattern(p.get("value"))
        else:
            for k, c in p.children:
                if k in ("elements", "properties", "argument", "left"):
                    pattern(c)

    for x in n.walk():
        if x.type in FUNCTIONS:
            for p in x.all("params"):
                pattern(p)
            if x.type == "FunctionDeclaration" and x is not n and x.get("id") is not None:
                out.add(x.get("id").attrs["name"])
        elif x.type == "VariableDeclarator":
            pattern(x.get("id"))
        elif x.type == "CatchClause" and x.get("param") is not None:
            pattern(x.get("param"))
    return out


def canonical(n: Node, bound: set[str] | None, names: dict[str, str] | None = None) -> str:
    """A text that two nodes share if they are alike: positions and a target's own name do not count.

    With ``bound`` None names count as written; else bound ones are numbered by first
    occurrence. Lengths are written before texts, so no two token lists run together.
    """
    names = {} if names is None else names
    out: list[str] = []

    def emit(x: Node, key: str, top: bool) -> None:
        attrs = dict(x.attrs)
        if x.type == "Identifier" and bound is not None and attrs.get("name") in bound:
            attrs["name"] = "\x00" + names.setdefault(attrs["name"], str(len(names)))
        if x.type in ("TSType", "TSInterfaceBody", "object-type"):
            attrs["text"] = " ".join(attrs.get("text", "").split())
        if top:
            attrs.pop("name", None)
        kind = {"TSInterfaceBody": "object-type", "TSTypeLiteral": "object-type"}.get(x.type, x.type)
        parts = [key, kind, *(f"{k}={v}" for k, v in sorted(attrs.items()))]
        out.append("(" + "".join(f"{len(p)}:{p}" for p in parts))
        for k, c in x.children:
            if not (top and k == "id"):
                emit(c, k, False)
        out.append(")")

    emit(n, "", True)
    return "".join(out)


def size_of(n: Node) -> int:
    """Nodes of a subtree; what types and interfaces hold counts by its words."""
    return sum(1 + (len(re.findall(r"\w+", x.attrs.get("text", ""))) if x.type in ("TSType", "TSInterfaceBody") else 0) for x in n.walk())


def is_skeleton(n: Node) -> bool:
    """Targets without a decision of their own: no body, a bare pass-through, an accessor chain, identity, an empty contract, an alias."""
    if n.type in ("TSTypeAliasDeclaration",):
        t = n.get("typeAnnotation")
        return t is not None and not t.children and len(t.attrs.get("text", "").split()) == 1
    if n.type == "TSInterfaceDeclaration":
        return n.get("body").attrs.get("empty") == "True"
    f = n.get("value") if n.type == "MethodDefinition" else n
    if f.type not in FUNCTIONS:
        return False
    body = f.get("body")
    if body is None or (body.type == "BlockStatement" and not body.children):
        return True
    value = body
    if body.type == "BlockStatement":
        if len(body.children) != 1 or body.children[0][1].type not in ("ReturnStatement", "ExpressionStatement"):
            return False
        inner = body.children[0][1].children
        if not inner:
            return True
        value = inner[0][1]
    if value.type in ("Identifier", "Literal", "ThisExpression"):
        return True
    if value.type == "CallExpression":
        given = [a.attrs.get("name") for a in value.all("arguments") if a.type == "Identifier"]
        return [p.attrs.get("name") for p in f.all("params")] == given and len(given) == len(value.all("arguments")) and value.get("callee").type in ("Identifier", "MemberExpression")
    while value.type == "MemberExpression" and value.attrs.get("computed") is None:
        value = value.get("object")
    return value.type in ("Identifier", "ThisExpression")


PRINTS = "path string, start_off int, end_off int, line int, kind string, name string, size int, exact string, shape string, normal string"


def contract_form(n: Node) -> Node:
    """An interface without parents and an alias of an object type in one form; other nodes as they are."""
    body = n.get("body") if n.type == "TSInterfaceDeclaration" and not n.all("extends") else None
    if n.type == "TSTypeAliasDeclaration" and (t := n.get("typeAnnotation")) is not None:
        inner = t.get("member")
        body = t if inner is not None and (inner.start, inner.end) == (t.start, t.end) else None
    if body is None:
        return n
    own = Node("object-type", body.start, body.end, {"text": body.attrs.get("text", "")})
    return Node("contract", n.start, n.end, dict(n.attrs), [*((k, c) for k, c in n.children if k in ("id", "typeParameters")), ("body", own)])


def fingerprints(files: DataFrame, min_size: int = 12) -> DataFrame:
    """Clone targets with their exact, alpha-renamed and normalised fingerprints.

    Anonymous functions and types below ``min_size`` nodes, and skeletons, are left out.
    """

    def rows(path: str, text: str, root: Node) -> list[tuple]:
        out = []
        for n in root.walk():
            if n.type not in TARGETS or is_skeleton(n):
                continue
            ident = n.get("id")
            name = ident.attrs.get("name") if ident is not None else n.attrs.get("name")
            size = size_of(n)
            small = size < min_size and (n.type in ("TSTypeAliasDeclaration", "TSInterfaceDeclaration") or not name)
            if small:
                continue
            sha = lambda s: hashlib.sha1(s.encode("utf-8", "surrogatepass")).hexdigest()
            normal = normalised(contract_form(n))
            out.append((path, n.start, n.end, text.count("\n", 0, n.start) + 1, n.type, name or "anonymous", size, sha(canonical(n, None)), sha(canonical(n, bound_names(n))), sha(canonical(normal, bound_names(normal)))))
        return out

    return _extract(files, PRINTS, rows)

"""State that outlives a call: module variables and class fields, who writes and who reads them, and who calls whom."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.sources.facts import EXITS, FUNCTIONS, _extract, bound_names
from plinth.sources.ts_parser import Node

STATES = "path string, line int, state string, fn string, reads boolean, writes boolean, guarded boolean"


def _uses(fn: Node, is_state) -> tuple[bool, bool]:
    """Whether a function reads and writes what ``is_state(node)`` tells; a compound write reads too."""
    reads = writes = False

    def visit(n: Node, written: bool, read: bool) -> None:
        nonlocal reads, writes
        if is_state(n):
            reads, writes = reads or read, writes or written
            return
        for k, c in n.children:
            if k == "key" and c.type == "Identifier":
                continue
            if n.type == "AssignmentExpression" and k == "left":
                visit(c, True, n.attrs["operator"] != "=")
            elif n.type == "UpdateExpression":
                visit(c, True, True)
            else:
                visit(c, False, True)

    visit(fn, False, True)
    return reads, writes


def _guarded(fn: Node, is_state) -> bool:
    """Whether the function first leaves if a test of the state says so."""
    body = fn.get("body")
    first = body.children[0][1] if body is not None and body.type == "BlockStatement" and body.children else None
    if first is None or first.type != "IfStatement" or not any(is_state(x) for x in first.get("test").walk()):
        return False
    then = first.get("consequent")
    last = then.children[-1][1] if then.type == "BlockStatement" and then.children else then
    return last.type in EXITS


def _exported(root: Node):
    """Names and nodes of exported functions, and exported classes."""
    for n in root.children:
        n = n[1]
        d = n.get("declaration") if n.type in ("ExportNamedDeclaration", "ExportDefaultDeclaration") else None
        if d is None:
            continue
        if d.type == "VariableDeclaration":
            for v in d.all("declarations"):
                if v.get("init") is not None and v.get("init").type in FUNCTIONS and v.get("id").type == "Identifier":
                    yield v.get("id").attrs["name"], v.get("init")
        else:
            yield (d.get("id").attrs["name"] if d.get("id") is not None else "default"), d


def state_uses(files: DataFrame) -> DataFrame:
    """``path, line, state, fn, reads, writes, guarded`` for each exported function or method that touches a state.

    States are ``let`` and ``var`` of a module and fields of exported classes;
    constructors do not count, nor functions that have the name for something of their own.
    """

    def rows(path: str, text: str, root: Node) -> list[tuple]:
        out = []
        line = lambda n: text.count("\n", 0, n.start) + 1
        tops = [c.get("declaration") if c.type == "ExportNamedDeclaration" and c.get("declaration") is not None else c for _, c in root.children]
        states = {v.get("id").attrs["name"]: v for d in tops if d.type == "VariableDeclaration" and d.attrs.get("kind") in ("let", "var") for v in d.all("declarations") if v.get("id").type == "Identifier"}

        def add(fn: Node, name: str, state: str, at: Node, is_state) -> None:
            reads, writes = _uses(fn, is_state)
            if reads or writes:
                out.append((path, line(at), state, name, reads, writes, _guarded(fn, is_state)))

        for name, d in _exported(root):
            if d.type in FUNCTIONS:
                own = bound_names(d)
                for s, at in states.items():
                    if s not in own:
                        add(d, name, s, at, lambda n, s=s: n.type == "Identifier" and n.attrs.get("name") == s)
            elif d.type == "ClassDeclaration":
                members = [m for k, b in d.children for _, m in ([("", b)] if k == "body" and b.type in ("MethodDefinition", "PropertyDefinition") else b.children if k == "body" else [])]
                methods = [m for m in members if m.type == "MethodDefinition" and m.attrs.get("kind") != "constructor" and m.get("value") is not None]
                for f in (m for m in members if m.type == "PropertyDefinition" and m.attrs.get("name")):
                    field = f.attrs["name"]
                    for m in methods:
                        add(m.get("value"), f"{name}.{m.attrs.get('name')}", f"{name}.{field}", f, lambda n, field=field: n.type == "MemberExpression" and n.attrs.get("name") == field and n.get("object").type == "ThisExpression")
        return out

    return _extract(files, STATES, rows)


CALLS = "path string, caller string, callee string"


def calls(files: DataFrame) -> DataFrame:
    """``path, caller, callee``: names that a function calls, by name or as a method; ``caller`` tells the function by where it begins."""

    def rows(path: str, text: str, root: Node) -> list[tuple]:
        out = set()

        def visit(n: Node, fn: str) -> None:
            if n.type in FUNCTIONS:
                fn = str(n.start)
            if n.type == "CallExpression" and (callee := n.get("callee")) is not None and callee.attrs.get("name"):
                out.add((path, fn, callee.attrs["name"]))
            for _, c in n.children:
                visit(c, fn)

        visit(root, "module")
        return sorted(out)

    return _extract(files, CALLS, rows)


def temporal_couplings(files: DataFrame) -> DataFrame:
    """``path, line, state, writers, readers`` of states with a function that writes and another that only reads.

    Held are readers that leave first if the state is not there, and readers that have
    callers all of which call a writer too, in whatever order: that the
    order is wrong is not proved.
    """
    uses = state_uses(files)
    writers = uses.where("writes").select("path", "state", F.col("fn").alias("writer"))
    pure = uses.where("reads and not writes and not guarded").select("path", "line", "state", F.col("fn").alias("reader"))
    met = pure.join(writers.groupBy("path", "state").agg(F.collect_set("writer").alias("ws")), ["path", "state"])
    last = lambda c: F.element_at(F.split(c, "[.]"), -1)
    made = calls(files).groupBy(F.col("path").alias("at"), "caller").agg(F.collect_set("callee").alias("made"))
    each = met.withColumn("name", last(F.col("reader")))
    called = calls(files).select(F.col("path").alias("at"), "caller", F.col("callee").alias("name")).join(made, ["at", "caller"])
    cover = each.join(called, "name").groupBy("path", "state", "reader").agg(F.bool_and(F.arrays_overlap(F.transform("ws", last), "made")).alias("covered"))
    left = met.join(cover.where("covered"), ["path", "state", "reader"], "left_anti")
    return left.groupBy("path", "line", "state").agg(F.first("ws").alias("ws"), F.count_distinct("reader").alias("readers")).select("path", "line", "state", F.size("ws").cast("long").alias("writers"), "readers")

"""Control-flow and definition facts of functions, from syntax trees.

A function becomes nodes and edges with definitions and uses at the nodes. Branches
whose test is a literal lose their dead arm. A name's scope is resolved from the
declarations around it: ``var`` and functions belong to the function, ``let``,
``const`` and classes to their block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from plinth.sources.facts import FUNCTIONS, _extract
from plinth.sources.ts_parser import Node

NORMAL, TRUE, FALSE, EXCEPTION = 0, 1, 2, 3


def static_truth(n: Node | None) -> bool | None:
    """The truth of a test that is known from its text: literals, ``!`` and ``void``."""
    if n is None:
        return True
    if n.type == "Literal":
        raw, kind = n.attrs["raw"], n.attrs["kind"]
        if kind == "boolean":
            return raw == "true"
        if kind == "null":
            return False
        if kind == "string":
            return len(raw) > 2
        if kind == "number":
            return any(c in "123456789abcdefABCDEF" for c in raw.removeprefix("0x").removeprefix("0X"))
        return True
    if n.type == "UnaryExpression" and n.attrs["operator"] == "!":
        inner = static_truth(n.get("argument"))
        return None if inner is None else not inner
    if n.type == "UnaryExpression" and n.attrs["operator"] == "void":
        return False
    return None


class Scopes:
    """Where each name of a function is declared."""

    def __init__(self, fn: Node):
        self.fn = fn
        self.names: dict[int, set[str]] = {id(fn): set()}
        for p in fn.all("params"):
            self.pattern(p, self.names[id(fn)])
        self.collect(fn.get("body"), [fn])

    def pattern(self, p: Node, into: set[str]) -> None:
        if p.type == "Identifier":
            into.add(p.attrs["name"])
        elif p.type == "Property":
            self.pattern(p.get("value"), into)
        else:
            for k, c in p.children:
                if k in ("elements", "properties", "argument", "left"):
                    self.pattern(c, into)

    def collect(self, n: Node | None, stack: list[Node]) -> None:
        if n is None:
            return
        if n.type in ("BlockStatement", "ForStatement", "ForOfStatement", "ForInStatement", "SwitchStatement", "CatchClause"):
            stack = [*stack, n]
            self.names.setdefault(id(n), set())
        if n.type == "CatchClause" and n.get("param") is not None:
            self.pattern(n.get("param"), self.names[id(n)])
        if n.type == "VariableDeclaration":
            into = self.names[id(self.fn if n.attrs["kind"] == "var" else stack[-1])]
            for d in n.all("declarations"):
                self.pattern(d.get("id"), into)
        if n.type in ("FunctionDeclaration", "ClassDeclaration") and n.get("id") is not None:
            self.names[id(stack[-1])].add(n.get("id").attrs["name"])
        if n.type in FUNCTIONS:
            return
        for _, c in n.children:
            self.collect(c, stack)

    def find(self, name: str, stack: list[Node]) -> str | None:
        """The binding's key, or null for names from outside."""
        for s in reversed(stack):
            if name in self.names.get(id(s), ()):
                return f"{name}@{s.start}"
        return None


class Flow:
    """Builds one function's graph. ``defs`` hold (node, offset, variable, kind), ``uses`` (node, variable, offset)."""

    def __init__(self, fn: Node):
        self.fn, self.scopes = fn, Scopes(fn)
        self.edges: set[tuple[int, int, int]] = set()
        self.defs: list[tuple[int, int, str, str]] = []
        self.uses: list[tuple[int, str, int]] = []
        self.captured: set[str] = set()
        self.n = 1
        self.loops: list[tuple[list[int], list[int], str | None]] = []
        self.handlers: list[int] = []
        self.exits: list[int] = []
        for p in fn.all("params"):
            self.write_pattern(p, 0, [fn], "parameter")
        body = fn.get("body")
        if body is not None:
            if body.type == "BlockStatement":
                self.block(body, [0], [fn])
            else:
                node = self.step([0])
                self.read(body, node, [fn])

    def node(self) -> int:
        self.n += 1
        return self.n - 1

    def link(self, sources: list[int], to: int, kind: int = NORMAL) -> None:
        for s in sources:
            self.edges.add((s, to, kind))

    def step(self, sources: list[int]) -> int:
        """A new node after ``sources``; inside ``try`` it may also lead to the handler."""
        me = self.node()
        self.link(sources, me)
        if self.handlers:
            self.edges.add((me, self.handlers[-1], EXCEPTION))
        return me

    # -- reads and writes of an expression, in evaluation order as far as definitions go
    def read(self, n: Node | None, node: int, stack: list[Node]) -> None:
        if n is None:
            return
        t = n.type
        if t in FUNCTIONS or t in ("ClassDeclaration", "ClassExpression"):
            self.capture(n, stack)
            return
        if t == "Identifier":
            if (key := self.scopes.find(n.attrs["name"], stack)) is not None:
                self.uses.append((node, key, n.start))
            return
        if t == "AssignmentExpression":
            left, op = n.get("left"), n.attrs["operator"]
            if op != "=":
                self.read(left, node, stack)
            self.read(n.get("right"), node, stack)
            self.write_pattern(left, node, stack, "assignment" if op == "=" else "compound")
            return
        if t == "UpdateExpression":
            self.read(n.get("argument"), node, stack)
            self.write_pattern(n.get("argument"), node, stack, "update")
            return
        if t.startswith("TS") and t not in ("TSAsExpression", "TSNonNullExpression"):
            return
        for _, c in n.children:
            self.read(c, node, stack)

    def capture(self, n: Node, stack: list[Node]) -> None:
        """Names that a closure mentions stay alive as long as it may run."""
        for x in n.walk():
            if x.type == "Identifier" and (key := self.scopes.find(x.attrs.get("name", ""), stack)) is not None:
                self.captured.add(key)

    def write_pattern(self, p: Node, node: int, stack: list[Node], kind: str) -> None:
        if p.type == "Identifier":
            if (key := self.scopes.find(p.attrs["name"], stack)) is not None:
                self.defs.append((node, p.start, key, kind))
        elif p.type in ("ArrayPattern", "ObjectPattern", "ArrayExpression", "ObjectExpression", "RestElement", "SpreadElement", "Property", "AssignmentPattern"):
            for k, c in p.children:
                if k in ("elements", "properties", "argument", "left", "value"):
                    self.write_pattern(c, node, stack, kind)
                elif k == "right":
                    self.read(c, node, stack)
        else:
            self.read(p, node, stack)

    # -- statements: each takes the nodes that lead to it and returns those that leave it
    def block(self, n: Node, at: list[int], stack: list[Node], key: str = "body") -> list[int]:
        stack = [*stack, n]
        for s in n.all(key):
            at = self.statement(s, at, stack)
        return at

    def simple(self, n: Node, at: list[int], stack: list[Node]) -> list[int]:
        me = self.step(at)
        self.read(n, me, stack)
        return [me]

    def statement(self, n: Node, at: list[int], stack: list[Node], label: str | None = None) -> list[int]:
        handler = getattr(self, f"s_{n.type}", None)
        if handler is not None:
            return handler(n, at, stack, label)
        return self.simple(n, at, stack) if at else at

    def s_EmptyStatement(self, n, at, stack, label):
        return at

    def s_BlockStatement(self, n, at, stack, label):
        if label is None:
            return self.block(n, at, stack)
        breaks: list[int] = []
        self.loops.append((breaks, [], label))
        out = self.block(n, at, stack)
        self.loops.pop()
        return out + breaks

    def s_LabeledStatement(self, n, at, stack, label):
        return self.statement(n.get("body"), at, stack, n.get("label").attrs["name"])

    def s_FunctionDeclaration(self, n, at, stack, label):
        self.capture(n, stack)
        return at

    def s_VariableDeclaration(self, n, at, stack, label):
        for d in n.all("declarations"):
            if not at:
                return at
            me = self.step(at)
            init = d.get("init")
            self.read(init, me, stack)
            if init is not None:
                self.write_pattern(d.get("id"), me, stack, "declaration")
            at = [me]
        return at

    def s_IfStatement(self, n, at, stack, label):
        if not at:
            return at
        test = self.step(at)
        self.read(n.get("test"), test, stack)
        truth, no = static_truth(n.get("test")), n.get("alternate")
        out = [] if truth is False else self.statement(n.get("consequent"), [test], stack)
        if truth is not True:
            out = out + (self.statement(no, [test], stack) if no is not None else [test])
        return out

    def loop(self, n, at, stack, label, test, update, first_test=True):
        head = self.step(at)
        if test is not None:
            self.read(test, head, stack)
        breaks, again = [], []
        self.loops.append((breaks, again, label))
        truth = static_truth(test) if first_test else None
        body_in = self.node()
        self.link([head], body_in)
        out = [] if truth is False else self.statement(n.get("body"), [body_in], stack)
        self.loops.pop()
        back = out + again
        if update is not None and back:
            me = self.step(back)
            self.read(update, me, stack)
            back = [me]
        self.link(back, head)
        return breaks + ([] if truth is True else [head])

    def s_WhileStatement(self, n, at, stack, label):
        return self.loop(n, at, stack, label, n.get("test"), None) if at else at

    def s_ForStatement(self, n, at, stack, label):
        if not at:
            return at
        inner = [*stack, n]
        init = n.get("init")
        if init is not None:
            at = self.statement(init, at, inner) if init.type == "VariableDeclaration" else self.simple(init, at, inner)
        return self.loop(n, at, inner, label, n.get("test"), n.get("update"))

    def each(self, n, at, stack, label):
        if not at:
            return at
        inner = [*stack, n]
        source = self.step(at)
        self.read(n.get("right"), source, inner)
        head = self.step([source])
        left = n.get("left")
        targets = [d.get("id") for d in left.all("declarations")] if left.type == "VariableDeclaration" else [left]
        item = self.step([head])
        for t in targets:
            self.write_pattern(t, item, inner, "loop")
        breaks, again = [], []
        self.loops.append((breaks, again, label))
        out = self.statement(n.get("body"), [item], inner)
        self.loops.pop()
        self.link(out + again, head)
        return [*breaks, head]

    s_ForOfStatement = s_ForInStatement = each

    def s_DoWhileStatement(self, n, at, stack, label):
        if not at:
            return at
        start = self.step(at)
        breaks, again = [], []
        self.loops.append((breaks, again, label))
        out = self.statement(n.get("body"), [start], stack) + again
        self.loops.pop()
        if not out:
            return breaks
        test = self.step(out)
        self.read(n.get("test"), test, stack)
        self.link([test], start)
        return [*breaks, test]

    def s_SwitchStatement(self, n, at, stack, label):
        if not at:
            return at
        inner = [*stack, n]
        value = self.step(at)
        self.read(n.get("discriminant"), value, inner)
        breaks: list[int] = []
        self.loops.append((breaks, None, label))
        fall: list[int] = []
        has_default = False
        for c in n.all("cases"):
            has_default |= c.get("test") is None
            me = self.step([value, *fall])
            self.read(c.get("test"), me, inner)
            fall = [me]
            for s in c.all("consequent"):
                fall = self.statement(s, fall, inner)
        self.loops.pop()
        return fall + breaks + ([] if has_default else [value])

    def s_TryStatement(self, n, at, stack, label):
        if not at:
            return at
        handler, final = n.get("handler"), n.get("finalizer")
        catch = self.node()
        self.link(at, catch, EXCEPTION)
        self.handlers.append(catch)
        out = self.block(n.get("block"), at, stack)
        self.handlers.pop()
        if handler is not None:
            inner = [*stack, handler]
            if handler.get("param") is not None:
                self.write_pattern(handler.get("param"), catch, inner, "parameter")
            out = out + self.block(handler.get("body"), [catch], inner)
        if final is not None:
            if handler is None:
                self.block(final, [catch], stack)
            if out:
                out = self.block(final, out, stack)
            elif handler is not None:
                self.block(final, [catch], stack)
        return out

    def s_ReturnStatement(self, n, at, stack, label):
        if at:
            self.simple(n, at, stack)
        return []

    s_ThrowStatement = s_ReturnStatement

    def s_BreakStatement(self, n, at, stack, label):
        name = n.get("label")
        for breaks, _, own in reversed(self.loops):
            if (name is None and own is None) or (name is None and breaks is not None) or (name is not None and own == name.attrs["name"]):
                breaks += at
                break
        return []

    def s_ContinueStatement(self, n, at, stack, label):
        name = n.get("label")
        for _, again, own in reversed(self.loops):
            if again is not None and (name is None or own == name.attrs["name"]):
                again += at
                break
        return []


EDGES = "path string, fn int, src long, dst long, edge_type int"
DEFS = "path string, fn int, node long, def_id long, var string, ix long, write_kind string, is_parameter boolean, captured boolean"
USES = "path string, fn int, node long, var string, use_id long"


def _functions(root: Node):
    return [n for n in root.walk() if n.type in FUNCTIONS and n.get("body") is not None]


def cfg_edges(files: DataFrame) -> DataFrame:
    """Edges of all functions; ``fn`` is a function's offset."""
    return _extract(files, EDGES, lambda path, _, root: [(path, f.start, *e) for f in _functions(root) for e in sorted(Flow(f).edges)])


def cfg_defs(files: DataFrame) -> DataFrame:
    """Definitions; ``def_id`` is the name's offset. Equal ones from a finally block that is walked twice count once."""

    def rows(path: str, text: str, root: Node) -> list[tuple]:
        out = []
        for f in _functions(root):
            flow, seen = Flow(f), set()
            for ix, (node, offset, var, kind) in enumerate(flow.defs):
                if (node, offset) not in seen:
                    seen.add((node, offset))
                    out.append((path, f.start, node, offset, var, ix, kind, kind == "parameter", var in flow.captured))
        return out

    return _extract(files, DEFS, rows)


def cfg_uses(files: DataFrame) -> DataFrame:
    """Reads of local names."""
    return _extract(files, USES, lambda path, _, root: [(path, f.start, *u) for f in _functions(root) for u in Flow(f).uses])


def _line(offset: str):
    from pyspark.sql import functions as F

    return F.size(F.split(F.substr("source_text", F.lit(1), F.col(offset).cast("int") + 1), "\n"))


def lifetime_findings(files: DataFrame, max_lines: int = 30) -> DataFrame:
    """``path, line, var, lines, burden``: definitions whose last use is over ``max_lines`` lines later.

    ``burden`` is the number of such definitions in the function. Parameters do not count.
    """
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from plinth.operators.dataflow import def_use_pairs

    keys = ["path", "fn"]
    pairs = def_use_pairs(keys, cfg_edges(files), cfg_defs(files).where("not is_parameter"), cfg_uses(files))
    spans = pairs.groupBy(*keys, "def_id", "var").agg(F.max("use_id").alias("last")).join(files.select("path", "source_text"), "path")
    placed = spans.select(*keys, F.split("var", "@")[0].alias("var"), _line("def_id").alias("line"), _line("last").alias("last_line"))
    long = placed.withColumn("lines", F.col("last_line") - F.col("line")).where(F.col("lines") > max_lines)
    return long.withColumn("burden", F.count("*").over(Window.partitionBy(*keys))).select("path", "line", "var", "lines", "burden")


def pressure_findings(files: DataFrame, max_live: int = 7, min_lines: int = 40) -> DataFrame:
    """``path, fn, max_live, n_lines``: functions of at least ``min_lines`` lines in which ``max_live`` variables or more live at once."""
    from pyspark.sql import functions as F

    from plinth.operators.dataflow import liveness
    from plinth.sources.facts import ast_nodes

    fns = ast_nodes(files).where("fn_id >= 0").groupBy("path", "fn_id").agg(F.min("start_off").alias("fn"), (F.max("line") - F.min("line") + 1).alias("n_lines"))
    live = liveness(["path", "fn"], cfg_edges(files), cfg_defs(files), cfg_uses(files))
    return live.join(fns, ["path", "fn"]).where((F.col("max_live") >= max_live) & (F.col("n_lines") >= min_lines)).select("path", "fn", "max_live", "n_lines")


def mutation_findings(files: DataFrame, max_writes: int) -> DataFrame:
    """``path, fn, var, writes``: variables written more than ``max_writes`` times after their declaration; loop variables do not count."""
    from pyspark.sql import functions as F

    writes = cfg_defs(files).where("write_kind in ('assignment', 'compound', 'update')").select("path", "fn", "var", "def_id").distinct()
    return writes.groupBy("path", "fn", F.split("var", "@")[0].alias("var")).agg(F.count("*").alias("writes")).where(F.col("writes") > max_writes)


def dead_store_findings(files: DataFrame) -> DataFrame:
    """Dead stores of source files: ``path, line, var, kind``.

    Held back are captured variables, parameters, variables that nothing reads,
    compound and update writes and loop variables.
    """
    from pyspark.sql import functions as F

    from plinth.operators.dataflow import dead_stores

    keys = ["path", "fn"]
    defs = cfg_defs(files)
    captured = defs.where("captured").select(*keys, "def_id")
    found = dead_stores(keys, cfg_edges(files), defs, cfg_uses(files), captured)
    plain = defs.where("write_kind in ('declaration', 'assignment')").select(*keys, "def_id").distinct()
    text = files.select("path", "source_text")
    line = F.size(F.split(F.substr("source_text", F.lit(1), F.col("def_id").cast("int")), "\n"))
    out = found.join(plain, [*keys, "def_id"]).join(text, "path")
    return out.select("path", line.alias("line"), F.split("var", "@")[0].alias("var"), "kind").distinct()

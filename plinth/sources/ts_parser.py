"""A parser for a subset of TypeScript that yields ESTree-like nodes.

Covered: statements, expressions, classes, functions, modules, templates, and types as
spans (their text is kept, object types are nodes). A construct outside the subset
raises :class:`ParseError`; the fact extractor then marks the file, and detectors
skip it, as they do files with errors.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field


class ParseError(ValueError):
    """The text is outside the subset or no TypeScript."""


@dataclass
class Node:
    type: str
    start: int
    end: int
    attrs: dict[str, str] = field(default_factory=dict)
    children: list[tuple[str, Node]] = field(default_factory=list)

    def get(self, key: str) -> Node | None:
        return next((c for k, c in self.children if k == key), None)

    def all(self, key: str) -> list[Node]:
        return [c for k, c in self.children if k == key]

    def walk(self):
        yield self
        for _, c in self.children:
            yield from c.walk()


@dataclass
class Token:
    kind: str  # name, num, str, template, regex, punct, end
    text: str
    start: int
    end: int
    newline: bool


PUNCT = sorted(
    "{ } ( ) [ ] ; , < > <= >= == != === !== + - * / % ** ++ -- << >> >>> & | ^ ! ~ && || ?? ? ?. : = += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??= => . ... @ #".split(), key=len, reverse=True
)
NAME = re.compile(r"[#]?[A-Za-z_$\u0080-\U0010ffff][\w$\u0080-\U0010ffff]*")
NUMBER = re.compile(r"0[xX][\da-fA-F_]+n?|0[bB][01_]+n?|0[oO][0-7_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?")
SPACE = re.compile(r"(?:\s|﻿|//[^\n]*|/\*[\s\S]*?\*/)*")
STRING = re.compile(r"'(?:\\[\s\S]|[^'\\\n])*'|\"(?:\\[\s\S]|[^\"\\\n])*\"")
REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
BEFORE_REGEX_NAMES = frozenset("return typeof instanceof in of new delete void throw case do else await yield".split())
BINARY = {"??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7, "<": 8, ">": 8, "<=": 8, ">=": 8, "instanceof": 8, "in": 8, "<<": 9, ">>": 9, ">>>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12}
RESERVED = frozenset("break case catch const continue debugger default delete do else enum export extends finally for function if in instanceof new return switch throw try typeof var void while with".split())
ASSIGN = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
MODIFIERS = frozenset("public private protected static readonly abstract override declare async accessor".split())


def tokenize(src: str) -> list[Token]:
    out: list[Token] = []
    i, n = 0, len(src)
    braces: list[str] = []  # what each open brace belongs to: "{" or "`"
    while True:
        j = SPACE.match(src, i).end()
        newline = "\n" in src[i:j]
        i = j
        if i >= n:
            out.append(Token("end", "", n, n, newline))
            return out
        c = src[i]
        if c == "`" or (c == "}" and braces and braces[-1] == "`"):
            if c == "}":
                braces.pop()
            j = i + 1
            while j < n and src[j] != "`":
                if src[j] == "\\":
                    j += 1
                elif src.startswith("${", j):
                    break
                j += 1
            if j >= n:
                raise ParseError("unended template")
            if src[j] == "$":
                braces.append("`")
                j += 2
            else:
                j += 1
            out.append(Token("template", src[i:j], i, j, newline))
            i = j
            continue
        if c in "'\"":
            m = STRING.match(src, i)
            if not m:
                raise ParseError(f"unended string at {i}")
            out.append(Token("str", m[0], i, m.end(), newline))
        elif c.isdigit() or (c == "." and i + 1 < n and src[i + 1].isdigit()):
            m = NUMBER.match(src, i)
            out.append(Token("num", m[0], i, m.end(), newline))
        elif m := NAME.match(src, i):
            out.append(Token("name", m[0], i, m.end(), newline))
        else:
            last = out[-1] if out else None
            ends_value = last is not None and (last.kind in ("num", "str", "regex") or (last.kind == "name" and last.text not in BEFORE_REGEX_NAMES) or (last.kind == "template" and last.text.endswith("`")) or last.text in (")", "]", "}"))
            m = REGEX.match(src, i) if c == "/" and not ends_value else None
            if m:
                out.append(Token("regex", m[0], i, m.end(), newline))
            else:
                p = next((p for p in PUNCT if src.startswith(p, i)), None)
                if p is None:
                    raise ParseError(f"character {c!r} at {i}")
                if p in (">>", ">>>", ">=", ">>=", ">>>="):
                    p = ">"  # joined again in expressions
                if p == "{":
                    braces.append("{")
                elif p == "}" and braces:
                    braces.pop()
                out.append(Token("punct", p, i, i + len(p), newline))
        i = out[-1].end


class Parser:
    def __init__(self, src: str):
        self.src, self.t, self.i = src, tokenize(src), 0

    # -- tokens
    @property
    def tok(self) -> Token:
        return self.t[self.i]

    def peek(self, k: int = 1) -> Token:
        return self.t[min(self.i + k, len(self.t) - 1)]

    def at(self, *texts: str) -> bool:
        return self.tok.kind in ("punct", "name") and self.tok.text in texts

    def take(self, text: str | None = None) -> Token:
        t = self.tok
        if text is not None and not (t.kind in ("punct", "name") and t.text == text):
            raise ParseError(f"{text!r} expected at {t.start}, found {t.text!r}")
        self.i += 1
        return t

    def eat(self, *texts: str) -> bool:
        if self.at(*texts):
            self.i += 1
            return True
        return False

    def end(self) -> int:
        return self.t[self.i - 1].end if self.i else 0

    def semicolon(self) -> None:
        if not self.eat(";") and not (self.at("}") or self.tok.kind == "end" or self.tok.newline):
            raise ParseError(f"end of statement expected at {self.tok.start}")

    def node(self, type_: str, start: int, *children: tuple[str, Node | None], **attrs) -> Node:
        return Node(type_, start, self.end(), {k: str(v) for k, v in attrs.items() if v is not None and v is not False}, [(k, c) for k, c in children if c is not None])

    def name(self) -> Node:
        t = self.tok
        if t.kind != "name" or t.text in RESERVED:
            raise ParseError(f"name expected at {t.start}, found {t.text!r}")
        self.i += 1
        return self.node("Identifier", t.start, name=t.text)

    # -- program and statements
    def program(self) -> Node:
        body = []
        while self.tok.kind != "end":
            body.append(("body", self.statement()))
        return Node("Program", 0, len(self.src), {}, body)

    def block(self) -> Node:
        start = self.take("{").start
        body = []
        while not self.at("}"):
            body.append(("body", self.statement()))
        self.take("}")
        return self.node("BlockStatement", start, *body)

    def statement(self) -> Node:
        t = self.tok
        start = t.start
        if t.kind == "punct":
            if t.text == "{":
                return self.block()
            if t.text == ";":
                self.take()
                return self.node("EmptyStatement", start)
            if t.text == "@":
                self.decorators()
                return self.statement()
        if t.kind == "name":
            nxt = self.peek()
            kind = getattr(self, f"s_{t.text}", None)
            if kind is not None and not (nxt.text in (":", ".", "=", "?.", ",", ")") and t.text not in ("return",)):
                made = kind()
                if made is not None:
                    return made
            if nxt.text == ":" and nxt.kind == "punct":
                label = self.name()
                self.take(":")
                return self.node("LabeledStatement", start, ("label", label), ("body", self.statement()))
        value = self.expression()
        self.semicolon()
        return self.node("ExpressionStatement", start, ("expression", value))

    def variables(self, in_for: bool = False) -> Node:
        t = self.take()
        decls = []
        while True:
            s = self.tok.start
            target = self.binding()
            self.eat("!")
            kind = self.annotation()
            init = self.assignment(no_in=in_for) if self.eat("=") else None
            decls.append(("declarations", self.node("VariableDeclarator", s, ("id", target), ("typeAnnotation", kind), ("init", init))))
            if not self.eat(","):
                break
        return self.node("VariableDeclaration", t.start, *decls, kind=t.text)

    def _vars(self) -> Node | None:
        if self.tok.text == "const" and self.peek().text == "enum":
            self.take()
            return self.s_enum()
        if self.tok.text == "let" and self.peek().kind not in ("name",) and self.peek().text not in ("[", "{"):
            return None
        made = self.variables()
        self.semicolon()
        made.end = self.end()
        return made

    s_var = s_let = s_const = _vars

    def s_function(self) -> Node:
        return self.function("FunctionDeclaration")

    def s_async(self) -> Node | None:
        return self.function("FunctionDeclaration") if self.peek().text == "function" else None

    def s_class(self) -> Node:
        return self.klass("ClassDeclaration")

    def s_abstract(self) -> Node | None:
        if self.peek().text != "class":
            return None
        start = self.take().start
        made = self.klass("ClassDeclaration")
        made.start, made.attrs["abstract"] = start, "True"
        return made

    def s_declare(self) -> Node | None:
        if self.peek().kind != "name" or self.peek().newline:
            return None
        start = self.take().start
        made = self.statement()
        made.start, made.attrs["declare"] = start, "True"
        return made

    def s_namespace(self) -> Node | None:
        if self.peek().kind not in ("name", "str"):
            return None
        start = self.take().start
        ident = self.take().text
        while self.eat("."):
            ident += "." + self.take().text
        body = self.block() if self.at("{") else None
        return self.node("TSModuleDeclaration", start, ("body", body), name=ident)

    s_module = s_namespace

    def s_type(self) -> Node | None:
        if self.peek().kind != "name":
            return None
        start = self.take().start
        ident = self.name()
        params = self.type_parameters()
        self.take("=")
        made = self.type_()
        self.semicolon()
        return self.node("TSTypeAliasDeclaration", start, ("id", ident), ("typeParameters", params), ("typeAnnotation", made))

    def s_interface(self) -> Node | None:
        if self.peek().kind != "name":
            return None
        start = self.take().start
        ident = self.name()
        params = self.type_parameters()
        heirs = []
        if self.eat("extends"):
            while True:
                heirs.append(("extends", self.type_(stop=("{", ","))))
                if not self.eat(","):
                    break
        return self.node("TSInterfaceDeclaration", start, ("id", ident), ("typeParameters", params), *heirs, ("body", self.object_type("TSInterfaceBody")))

    def s_enum(self) -> Node | None:
        if self.peek().kind != "name":
            return None
        start = self.take("enum").start
        ident = self.name()
        self.take("{")
        members = []
        while not self.at("}"):
            s = self.tok.start
            key = self.take().text
            members.append(("members", self.node("TSEnumMember", s, ("initializer", self.assignment() if self.eat("=") else None), name=key)))
            if not self.eat(","):
                break
        self.take("}")
        return self.node("TSEnumDeclaration", start, ("id", ident), *members)

    def s_if(self) -> Node:
        start = self.take().start
        self.take("(")
        test = self.expression()
        self.take(")")
        yes = self.statement()
        no = self.statement() if self.eat("else") else None
        return self.node("IfStatement", start, ("test", test), ("consequent", yes), ("alternate", no))

    def s_while(self) -> Node:
        start = self.take().start
        self.take("(")
        test = self.expression()
        self.take(")")
        return self.node("WhileStatement", start, ("test", test), ("body", self.statement()))

    def s_do(self) -> Node:
        start = self.take().start
        body = self.statement()
        self.take("while")
        self.take("(")
        test = self.expression()
        self.take(")")
        self.eat(";")
        return self.node("DoWhileStatement", start, ("body", body), ("test", test))

    def s_for(self) -> Node:
        start = self.take().start
        wait = self.eat("await")
        self.take("(")
        init = None
        if not self.at(";"):
            init = self.variables(in_for=True) if self.at("var", "let", "const") else self.expression(no_in=True)
        if self.at("of", "in"):
            kind = "ForOfStatement" if self.take().text == "of" else "ForInStatement"
            right = self.expression()
            self.take(")")
            return self.node(kind, start, ("left", init), ("right", right), ("body", self.statement()), wait=wait)
        self.take(";")
        test = None if self.at(";") else self.expression()
        self.take(";")
        update = None if self.at(")") else self.expression()
        self.take(")")
        return self.node("ForStatement", start, ("init", init), ("test", test), ("update", update), ("body", self.statement()))

    def s_switch(self) -> Node:
        start = self.take().start
        self.take("(")
        value = self.expression()
        self.take(")")
        self.take("{")
        cases = []
        while not self.at("}"):
            s = self.tok.start
            test = None
            if self.take().text == "case":
                test = self.expression()
            self.take(":")
            body = []
            while not self.at("case", "default", "}"):
                body.append(("consequent", self.statement()))
            cases.append(("cases", self.node("SwitchCase", s, ("test", test), *body)))
        self.take("}")
        return self.node("SwitchStatement", start, ("discriminant", value), *cases)

    def s_try(self) -> Node:
        start = self.take().start
        body, handler, final = self.block(), None, None
        if self.at("catch"):
            s = self.take().start
            param = None
            if self.eat("("):
                param = self.binding()
                self.annotation()
                self.take(")")
            handler = (param, s, self.block())
            handler = self.node("CatchClause", s, ("param", param), ("body", handler[2]))
        if self.eat("finally"):
            final = self.block()
        return self.node("TryStatement", start, ("block", body), ("handler", handler), ("finalizer", final))

    def _jump(self) -> Node:
        t = self.take()
        label = self.name() if self.tok.kind == "name" and not self.tok.newline else None
        self.semicolon()
        return self.node("BreakStatement" if t.text == "break" else "ContinueStatement", t.start, ("label", label))

    s_break = s_continue = _jump

    def _result(self) -> Node:
        t = self.take()
        value = None if self.at(";", "}") or self.tok.kind == "end" or self.tok.newline else self.expression()
        self.semicolon()
        return self.node("ReturnStatement" if t.text == "return" else "ThrowStatement", t.start, ("argument", value))

    s_return = s_throw = _result

    def s_import(self) -> Node | None:
        if self.peek().text in ("(", "."):
            return None
        start = self.take().start
        attrs: dict = {}
        if self.at("type") and self.peek().text not in ("from", ","):
            self.take()
            attrs["importKind"] = "type"
        specs = []
        if self.tok.kind != "str":
            specs = self.import_names()
            if self.eat("="):
                value = self.assignment()
                self.semicolon()
                return self.node("TSImportEqualsDeclaration", start, *specs, ("value", value))
            self.take("from")
        source = self.take().text[1:-1]
        self.semicolon()
        return self.node("ImportDeclaration", start, *specs, source=source, **attrs)

    def import_names(self) -> list[tuple[str, Node]]:
        specs = []
        while True:
            s = self.tok.start
            if self.eat("*"):
                self.take("as")
                specs.append(("specifiers", self.node("ImportNamespaceSpecifier", s, local=self.take().text)))
            elif self.eat("{"):
                while not self.at("}"):
                    specs.append(("specifiers", self.specifier("ImportSpecifier")))
                    if not self.eat(","):
                        break
                self.take("}")
            else:
                specs.append(("specifiers", self.node("ImportDefaultSpecifier", s, local=self.take().text, imported="default")))
            if not self.eat(","):
                return specs

    def specifier(self, kind: str) -> Node:
        s = self.tok.start
        attrs = {}
        if self.at("type") and self.peek().text not in (",", "}", "as"):
            self.take()
            attrs["kind"] = "type"
        one = self.take().text.strip("'\"")
        two = self.take().text.strip("'\"") if self.eat("as") else one
        imported, local = (one, two) if kind == "ImportSpecifier" else (two, one)
        return self.node(kind, s, imported=imported, local=local, **attrs)

    def s_export(self) -> Node:
        start = self.take().start
        if self.eat("default"):
            if self.at("class", "abstract"):
                self.eat("abstract")
                value = self.klass("ClassDeclaration")
            elif self.at("function") or (self.at("async") and self.peek().text == "function"):
                value = self.function("FunctionDeclaration")
            elif self.at("interface"):
                value = self.s_interface()
            else:
                value = self.assignment()
                self.semicolon()
            return self.node("ExportDefaultDeclaration", start, ("declaration", value))
        if self.eat("*"):
            exported = self.take().text if self.eat("as") else None
            self.take("from")
            source = self.take().text[1:-1]
            self.semicolon()
            return self.node("ExportAllDeclaration", start, source=source, exported=exported)
        if self.eat("="):
            value = self.expression()
            self.semicolon()
            return self.node("TSExportAssignment", start, ("expression", value))
        kind = None
        if self.at("type") and self.peek().text in ("{", "*"):
            self.take()
            kind = "type"
            if self.eat("*"):
                exported = self.take().text if self.eat("as") else None
                self.take("from")
                source = self.take().text[1:-1]
                self.semicolon()
                return self.node("ExportAllDeclaration", start, source=source, exported=exported)
        if self.eat("{"):
            specs = []
            while not self.at("}"):
                specs.append(("specifiers", self.specifier("ExportSpecifier")))
                if not self.eat(","):
                    break
            self.take("}")
            source = self.take().text[1:-1] if self.eat("from") else None
            self.semicolon()
            return self.node("ExportNamedDeclaration", start, *specs, source=source, exportKind=kind)
        return self.node("ExportNamedDeclaration", start, ("declaration", self.statement()))

    # -- functions and classes
    def function(self, kind: str) -> Node:
        start = self.tok.start
        is_async = self.eat("async")
        self.take("function")
        generator = self.eat("*")
        ident = self.name() if self.tok.kind == "name" else None
        return self.callable(kind, start, ident, is_async=is_async, generator=generator)

    def callable(self, kind: str, start: int, ident: Node | None = None, **attrs) -> Node:
        tps = self.type_parameters()
        params = self.parameters()
        returns = self.annotation()
        if self.at("{"):
            body = self.block()
        else:
            self.semicolon()
            body = None
        return self.node(kind, start, ("id", ident), ("typeParameters", tps), *params, ("returnType", returns), ("body", body), **attrs)

    def parameters(self) -> list[tuple[str, Node]]:
        self.take("(")
        out = []
        while not self.at(")"):
            self.decorators()
            while self.tok.text in MODIFIERS and self.peek().kind in ("name",):
                self.take()
            out.append(("params", self.parameter()))
            if not self.eat(","):
                break
        self.take(")")
        return out

    def parameter(self) -> Node:
        start = self.tok.start
        rest = self.eat("...")
        target = self.binding()
        self.eat("?")
        self.annotation()
        if self.eat("="):
            return self.node("AssignmentPattern", start, ("left", target), ("right", self.assignment()))
        return self.node("RestElement", start, ("argument", target)) if rest else target

    def binding(self) -> Node:
        start = self.tok.start
        if self.eat("["):
            items = []
            while not self.at("]"):
                if self.eat(","):
                    continue
                items.append(("elements", self.parameter()))
                if not self.at("]"):
                    self.take(",")
            self.take("]")
            return self.node("ArrayPattern", start, *items)
        if self.eat("{"):
            items = []
            while not self.at("}"):
                s = self.tok.start
                if self.eat("..."):
                    items.append(("properties", self.node("RestElement", s, ("argument", self.binding()))))
                else:
                    computed = self.eat("[")
                    key = self.assignment() if computed else self.key_node()
                    if computed:
                        self.take("]")
                    if self.eat(":"):
                        value = self.parameter()
                    else:
                        value = Node("Identifier", key.start, key.end, {"name": key.attrs.get("name", "")})
                        if self.eat("="):
                            value = self.node("AssignmentPattern", s, ("left", value), ("right", self.assignment()))
                    items.append(("properties", self.node("Property", s, *([("key", key)] if computed else []), ("value", value), name=key.attrs.get("name"))))
                if not self.eat(","):
                    break
            self.take("}")
            return self.node("ObjectPattern", start, *items)
        return self.name()

    def decorators(self) -> int:
        n = 0
        while self.eat("@"):
            self.unary()
            n += 1
        return n

    def klass(self, kind: str) -> Node:
        start = self.take("class").start
        ident = self.name() if self.tok.kind == "name" and not self.at("extends", "implements") else None
        self.type_parameters()
        base = None
        if self.eat("extends"):
            base = self.unary()
            if self.at("<"):
                self.type_arguments()
        if self.eat("implements"):
            while True:
                self.type_(stop=("{", ","))
                if not self.eat(","):
                    break
        s = self.take("{").start
        members = []
        while not self.at("}"):
            if self.eat(";"):
                continue
            members.append(("body", self.member()))
        self.take("}")
        return self.node(kind, start, ("id", ident), ("superClass", base), ("body", self.node("ClassBody", s, *members)))

    def member(self) -> Node:
        start = self.tok.start
        decorated = self.decorators()
        mods = set()
        if self.at("static") and self.peek().text == "{":
            self.take()
            return self.node("StaticBlock", start, ("body", self.block()))
        while self.tok.text in MODIFIERS and self.peek().text not in ("(", "=", ";", ":", "?", "!", "}", "<"):
            mods.add(self.take().text)
        generator = self.eat("*")
        kind = "method"
        if self.at("get", "set") and self.peek().text not in ("(", "=", ";", ":", "?", "!", "}"):
            kind = self.take().text
        if self.at("[") and self.peek().kind == "name" and self.peek(2).text == ":":  # index signature
            depth = 0
            while True:
                t = self.take()
                depth += (t.text == "[") - (t.text == "]")
                if not depth:
                    break
            self.annotation()
            self.semicolon()
            return self.node("TSIndexSignature", start)
        computed = self.eat("[")
        key = self.assignment() if computed else self.key_node()
        if computed:
            self.take("]")
        self.eat("?", "!")
        name = key.attrs.get("name", "") if not computed else ""
        attrs = {"name": name, "decorated": decorated or None, "computed": computed, **{m: True for m in mods if m != "async"}}
        if self.at("(", "<"):
            value = self.callable("FunctionExpression", self.tok.start, is_async="async" in mods, generator=generator)
            return self.node("MethodDefinition", start, *([("key", key)] if computed else []), ("value", value), kind="constructor" if name == "constructor" else kind, **attrs)
        kind_ = self.annotation()
        value = self.assignment() if self.eat("=") else None
        self.semicolon()
        return self.node("PropertyDefinition", start, *([("key", key)] if computed else []), ("typeAnnotation", kind_), ("value", value), **attrs)

    def key_node(self) -> Node:
        t = self.take()
        if t.kind not in ("name", "str", "num"):
            raise ParseError(f"key expected at {t.start}, found {t.text!r}")
        return self.node("Identifier" if t.kind == "name" else "Literal", t.start, name=t.text.strip("'\""))

    # -- types, kept as spans
    def annotation(self) -> Node | None:
        return self.type_() if self.eat(":") else None

    def type_parameters(self) -> Node | None:
        return self.type_arguments("TSTypeParameterDeclaration") if self.at("<") else None

    def type_arguments(self, kind: str = "TSTypeParameterInstantiation") -> Node:
        start, depth = self.tok.start, 0
        while True:
            t = self.take()
            if t.kind == "end":
                raise ParseError(f"unended type arguments at {start}")
            if t.text in ("<", "(", "[", "{"):
                depth += 1
            elif t.text in (">", ")", "]", "}"):
                depth -= 1
            if not depth:
                return self.node(kind, start)

    def type_(self, stop: tuple[str, ...] = ()) -> Node:
        start, parts, objects = self.tok.start, 0, []
        if self.at("asserts") and self.peek().kind == "name":
            self.take()
        while True:
            self.eat("|", "&")
            objects += self.type_operand(stop)
            parts += 1
            if self.at("|", "&"):
                continue
            if self.at("is") and not self.tok.newline:
                self.take()
                continue
            if self.at("extends") and "{" not in stop and "extends" not in stop:
                self.take()
                objects += self.type_(("?",)).all("member")
                if self.eat("?"):
                    objects += self.type_().all("member")
                    self.take(":")
                    objects += self.type_().all("member")
            break
        return self.node("TSType", start, *(("member", o) for o in objects), text=self.src[start : self.end()])

    def type_operand(self, stop: tuple[str, ...]) -> list[Node]:
        found = []
        while self.at("keyof", "typeof", "readonly", "unique", "infer", "new", "abstract") and self.peek().text not in (",", ")", ";", "=", ">", "|", "]", "}"):
            self.take()
        t = self.tok
        if t.text == "{" and t.kind == "punct":
            found.append(self.object_type("TSTypeLiteral"))
        elif t.text in ("(", "<") and t.kind == "punct":
            if t.text == "<":
                self.type_arguments()
            self.skip_balanced()
            if self.eat("=>"):
                return found + self.type_(stop).all("member")
        elif t.text == "[" and t.kind == "punct":
            self.skip_balanced()
        elif t.kind == "template":
            self.template()
        elif t.kind in ("name", "str", "num"):
            self.take()
        elif t.text == "-":
            self.take()
            self.take()
        else:
            raise ParseError(f"type expected at {t.start}, found {t.text!r}")
        while True:
            if self.at(".") :
                self.take()
                self.take()
            elif self.at("<") and not self.tok.newline:
                self.type_arguments()
            elif self.at("[") and not self.tok.newline:
                self.skip_balanced()
            elif self.at("(") and self.t[self.i - 1].text == "import":
                self.skip_balanced()
            else:
                return found

    def skip_balanced(self) -> None:
        depth = 0
        while True:
            t = self.take()
            if t.kind == "end":
                raise ParseError("unended bracket")
            if t.kind == "punct":
                depth += (t.text in "([{") - (t.text in ")]}")
            if not depth:
                return

    def object_type(self, kind: str) -> Node:
        start = self.tok.start
        inner = self.i + 1
        self.skip_balanced()
        empty = self.i - inner == 1
        return self.node(kind, start, empty=empty, text=self.src[start : self.end()] if kind == "TSInterfaceBody" else None)

    # -- expressions
    def expression(self, no_in: bool = False) -> Node:
        start = self.tok.start
        first = self.assignment(no_in)
        if not self.at(","):
            return first
        items = [("expressions", first)]
        while self.eat(","):
            items.append(("expressions", self.assignment(no_in)))
        return self.node("SequenceExpression", start, *items)

    def is_arrow(self) -> bool:
        """Whether a parenthesis here opens an arrow function's parameters."""
        depth, k = 0, self.i
        while True:
            t = self.t[k]
            if t.kind == "end":
                return False
            if t.kind == "punct":
                depth += (t.text in ("(", "[", "{")) - (t.text in (")", "]", "}"))
            k += 1
            if not depth:
                break
        if self.t[k].text == "=>":
            return True
        if self.t[k].text != ":":
            return False
        keep, self.i = self.i, k + 1
        try:
            self.type_()
            return self.at("=>")
        except ParseError:
            return False
        finally:
            self.i = keep

    def arrow(self, start: int, is_async: bool) -> Node:
        if self.at("(", "<"):
            tps = self.type_parameters()
            params = self.parameters()
            returns = self.annotation()
        else:
            tps, returns, params = None, None, [("params", self.name())]
        self.take("=>")
        body = self.block() if self.at("{") else self.assignment()
        return self.node("ArrowFunctionExpression", start, ("typeParameters", tps), *params, ("returnType", returns), ("body", body), is_async=is_async)

    def assignment(self, no_in: bool = False) -> Node:
        t = self.tok
        start = t.start
        if t.kind == "name":
            if t.text == "async" and not self.peek().newline and ((self.peek().kind == "name" and self.peek(2).text == "=>") or self.peek().text in ("(", "<")):
                keep = self.i
                self.take()
                if self.tok.kind == "name" or self.at("<") or self.is_arrow():
                    return self.arrow(start, True)
                self.i = keep
            if self.peek().text == "=>":
                return self.arrow(start, False)
            if t.text == "yield":
                self.take()
                star = self.eat("*")
                value = None if self.at(")", "]", "}", ",", ";") or self.tok.newline else self.assignment(no_in)
                return self.node("YieldExpression", start, ("argument", value), delegate=star)
        elif t.kind == "punct" and ((t.text == "(" and self.is_arrow()) or t.text == "<"):
            return self.arrow(start, False)
        left = self.conditional(no_in)
        op = self.joined(ASSIGN)
        if op:
            return self.node("AssignmentExpression", start, ("left", left), ("right", self.assignment(no_in)), operator=op)
        return left

    def joined(self, among) -> str | None:
        """An operator of ``among`` here, closing angle brackets joined again; taken if there."""
        t = self.tok
        if t.kind not in ("punct", "name"):
            return None
        if t.text == ">":
            text, k = ">", self.i + 1
            while self.t[k].start == self.t[k - 1].end and self.t[k].kind == "punct" and self.t[k].text in (">", "=", "==", "==="):
                text += self.t[k].text
                k += 1
            while text and text not in among:
                text, k = text[:-1], k - 1
            if text:
                self.i = k
            return text or None
        if t.text in among:
            self.i += 1
            return t.text
        return None

    def conditional(self, no_in: bool) -> Node:
        start = self.tok.start
        test = self.binary(0, no_in)
        if not self.eat("?"):
            return test
        yes = self.assignment()
        self.take(":")
        return self.node("ConditionalExpression", start, ("test", test), ("consequent", yes), ("alternate", self.assignment(no_in)))

    def binary(self, least: int, no_in: bool) -> Node:
        start = self.tok.start
        left = self.unary()
        while True:
            if self.at("as", "satisfies") and not self.tok.newline:
                self.take()
                left = self.node("TSAsExpression", start, ("expression", left), ("typeAnnotation", self.type_()))
                continue
            keep = self.i
            op = self.joined(BINARY)
            if op is None or (op == "in" and no_in) or BINARY[op] <= least:
                self.i = keep
                return left
            right = self.binary(BINARY[op] - (op == "**"), no_in)
            left = self.node("LogicalExpression" if op in ("&&", "||", "??") else "BinaryExpression", start, ("left", left), ("right", right), operator=op)

    def unary(self) -> Node:
        t = self.tok
        if (t.kind == "punct" and t.text in ("!", "-", "+", "~")) or (t.kind == "name" and t.text in ("typeof", "void", "delete")):
            self.take()
            return self.node("UnaryExpression", t.start, ("argument", self.unary()), operator=t.text)
        if t.kind == "punct" and t.text in ("++", "--"):
            self.take()
            return self.node("UpdateExpression", t.start, ("argument", self.unary()), operator=t.text, prefix=True)
        if t.kind == "name" and t.text == "await" and self.peek().text not in (")", ";", ",", "=", "."):
            self.take()
            return self.node("AwaitExpression", t.start, ("argument", self.unary()))
        value = self.postfix(self.primary(), t.start)
        if self.at("++", "--") and not self.tok.newline:
            op = self.take().text
            value = self.node("UpdateExpression", t.start, ("argument", value), operator=op)
        return value

    def postfix(self, value: Node, start: int, calls: bool = True) -> Node:
        while True:
            if self.at("."):
                self.take()
                value = self.node("MemberExpression", start, ("object", value), name=self.take().text)
            elif self.at("?."):
                self.take()
                if self.at("("):
                    value = self.node("CallExpression", start, ("callee", value), *self.arguments(), optional=True)
                elif self.eat("["):
                    key = self.expression()
                    self.take("]")
                    value = self.node("MemberExpression", start, ("object", value), ("property", key), computed=True, optional=True)
                else:
                    value = self.node("MemberExpression", start, ("object", value), name=self.take().text, optional=True)
            elif self.at("["):
                self.take()
                key = self.expression()
                self.take("]")
                value = self.node("MemberExpression", start, ("object", value), ("property", key), computed=True)
            elif self.at("(") and calls:
                args = self.arguments()
                value = self.node("CallExpression", start, ("callee", value), *args)
            elif self.tok.kind == "template" and self.tok.text.startswith("`"):
                value = self.node("TaggedTemplateExpression", start, ("tag", value), ("quasi", self.template()))
            elif self.at("!") and not self.tok.newline and self.peek().text not in ("=",):
                self.take()
                value = self.node("TSNonNullExpression", start, ("expression", value))
            elif self.at("<") and calls and self.call_types():
                self.type_arguments()
            else:
                return value

    def call_types(self) -> bool:
        """Whether angle brackets here are type arguments of a call."""
        depth, k = 0, self.i
        while True:
            t = self.t[k]
            if t.kind == "punct" and t.text in ("<", "[", "(", "{"):
                depth += 1
            elif t.kind == "punct" and t.text in (">", "]", ")", "}"):
                depth -= 1
            elif t.kind not in ("name", "str", "num") and t.text not in (",", ".", "|", "&", ":", ";", "?", "=>", "..."):
                return False
            if t.text in ("&&", "||") or depth < 0:
                return False
            k += 1
            if not depth:
                return self.t[k].text in ("(",) or self.t[k].kind == "template"

    def arguments(self) -> list[tuple[str, Node]]:
        self.take("(")
        out = []
        while not self.at(")"):
            out.append(("arguments", self.spread()))
            if not self.eat(","):
                break
        self.take(")")
        return out

    def spread(self) -> Node:
        start = self.tok.start
        if self.eat("..."):
            return self.node("SpreadElement", start, ("argument", self.assignment()))
        return self.assignment()

    def template(self) -> Node:
        start, parts = self.tok.start, []
        while True:
            t = self.take()
            parts.append(("quasis", self.node("TemplateElement", t.start, value=t.text)))
            if t.text.endswith("`") and (len(t.text) > 1 or len(parts) > 1):
                return self.node("TemplateLiteral", start, *parts)
            if t.text == "`":
                return self.node("TemplateLiteral", start, *parts)
            parts.append(("expressions", self.expression()))
            if self.tok.kind != "template":
                raise ParseError(f"unended template at {start}")

    def primary(self) -> Node:
        t = self.tok
        start = t.start
        if t.kind in ("num", "str", "regex"):
            self.take()
            return self.node("Literal", start, raw=t.text, kind={"num": "number", "str": "string", "regex": "regex"}[t.kind])
        if t.kind == "template":
            return self.template()
        if t.kind == "punct":
            if self.eat("("):
                value = self.expression()
                self.take(")")
                return value
            if self.eat("["):
                items = []
                while not self.at("]"):
                    if self.eat(","):
                        continue
                    items.append(("elements", self.spread()))
                    if not self.at("]"):
                        self.take(",")
                self.take("]")
                return self.node("ArrayExpression", start, *items)
            if t.text == "{":
                return self.object()
            if t.text == "@":
                self.decorators()
                return self.klass("ClassExpression")
            raise ParseError(f"expression expected at {start}, found {t.text!r}")
        if t.text == "function" or (t.text == "async" and self.peek().text == "function"):
            return self.function("FunctionExpression")
        if t.text == "class":
            return self.klass("ClassExpression")
        if t.text == "new" and self.peek().text != ".":
            self.take()
            s = self.tok.start
            callee = self.postfix(self.primary(), s, calls=False)
            if self.at("<") and self.call_types():
                self.type_arguments()
            args = self.arguments() if self.at("(") else []
            return self.node("NewExpression", start, ("callee", callee), *args)
        if t.text == "import" and self.peek().text == "(":
            self.take()
            return self.node("ImportExpression", start, *self.arguments())
        if t.text in ("true", "false", "null"):
            self.take()
            return self.node("Literal", start, raw=t.text, kind="boolean" if t.text != "null" else "null")
        if t.text in ("this", "super"):
            self.take()
            return self.node("ThisExpression" if t.text == "this" else "Super", start)
        if t.kind == "end":
            raise ParseError("text ends within an expression")
        return self.name()

    def object(self) -> Node:
        start = self.take("{").start
        items = []
        while not self.at("}"):
            s = self.tok.start
            if self.at("..."):
                items.append(("properties", self.spread()))
            else:
                is_async = self.at("async") and self.peek().text not in (":", ",", "}", "(", "=") and bool(self.take())
                generator = self.eat("*")
                kind = self.take().text if self.at("get", "set") and self.peek().text not in (":", ",", "}", "(", "=") else "init"
                computed = self.eat("[")
                key = self.assignment() if computed else self.key_node()
                if computed:
                    self.take("]")
                named = [("key", key)] if computed else []
                if self.at("(", "<"):
                    value = self.callable("FunctionExpression", self.tok.start, is_async=is_async, generator=generator)
                    items.append(("properties", self.node("Property", s, *named, ("value", value), name=key.attrs.get("name"), kind=kind, method=True)))
                elif self.eat(":"):
                    items.append(("properties", self.node("Property", s, *named, ("value", self.assignment()), name=key.attrs.get("name"), computed=computed)))
                else:
                    value = Node("Identifier", key.start, key.end, {"name": key.attrs.get("name", "")})
                    if self.eat("="):
                        value = self.node("AssignmentPattern", s, ("left", value), ("right", self.assignment()))
                    items.append(("properties", self.node("Property", s, ("value", value), name=key.attrs.get("name"), shorthand=True)))
            if not self.eat(","):
                break
        self.take("}")
        return self.node("ObjectExpression", start, *items)


def parse(src: str) -> Node:
    """The program of a source text."""
    try:
        return Parser(src).program()
    except RecursionError as e:
        raise ParseError("nested too deeply") from e
    except IndexError as e:
        raise ParseError("text ends early") from e

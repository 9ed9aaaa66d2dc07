"""Rewrites that bring equivalent code to one form before it is fingerprinted.

Nodes are rewritten from the leaves up; what a rewrite makes is rewritten again. A
function inside the target stays as it is written.
"""

from __future__ import annotations

from plinth.sources.ts_parser import Node

FUNCTIONS = frozenset(("FunctionDeclaration", "FunctionExpression", "ArrowFunctionExpression"))
LOOPS = frozenset(("ForStatement", "ForOfStatement", "ForInStatement", "WhileStatement", "DoWhileStatement"))


def made(kind: str, like: Node, /, *children: tuple[str, Node], **attrs: str) -> Node:
    return Node(kind, like.start, like.end, dict(attrs), list(children))


def negated(n: Node) -> Node:
    """The operand's negation; a double one falls away."""
    return n.get("argument") if is_not(n) else made("UnaryExpression", n, ("argument", n), operator="!")


def is_not(n: Node) -> bool:
    return n.type == "UnaryExpression" and n.attrs.get("operator") == "!"


def closing_return(n: Node) -> Node | None:
    """A function body without its last statement, if that is a bare ``return``."""
    if n.type in FUNCTIONS and (body := n.get("body")) is not None and body.type == "BlockStatement" and body.children:
        last = body.children[-1][1]
        if last.type == "ReturnStatement" and not last.children:
            cut = Node(body.type, body.start, body.end, dict(body.attrs), body.children[:-1])
            return Node(n.type, n.start, n.end, dict(n.attrs), [(k, cut if c is body else c) for k, c in n.children])
    return None


def inverted_choice(n: Node) -> Node | None:
    """``!x ? a : b`` as ``x ? b : a``."""
    if n.type == "ConditionalExpression" and is_not(n.get("test")):
        return made(n.type, n, ("test", n.get("test").get("argument")), ("consequent", n.get("alternate")), ("alternate", n.get("consequent")), **n.attrs)
    return None


def spread_negation(n: Node) -> Node | None:
    """``!(a && b)`` as ``!a || !b``, and the other way round."""
    inner = n.get("argument") if is_not(n) else None
    if inner is not None and inner.type == "LogicalExpression" and (other := {"&&": "||", "||": "&&"}.get(inner.attrs["operator"])):
        return made(inner.type, n, ("left", negated(inner.get("left"))), ("right", negated(inner.get("right"))), operator=other)
    return None


def only_statement(n: Node | None) -> Node | None:
    if n is not None and n.type == "BlockStatement":
        return n.children[0][1] if len(n.children) == 1 else None
    return n


def choice_of_branches(n: Node) -> Node | None:
    """An ``if`` whose sides both return, both assign one name, or both are one expression, as a conditional expression."""
    if n.type != "IfStatement":
        return None
    yes, no = only_statement(n.get("consequent")), only_statement(n.get("alternate"))
    if yes is None or no is None or yes.type != no.type:
        return None
    choose = lambda a, b: made("ConditionalExpression", n, ("test", n.get("test")), ("consequent", a), ("alternate", b))
    if yes.type == "ReturnStatement" and yes.children and no.children:
        return made("ReturnStatement", n, ("argument", choose(yes.get("argument"), no.get("argument"))))
    if yes.type == "ExpressionStatement":
        a, b = yes.get("expression"), no.get("expression")
        if a.type == b.type == "AssignmentExpression":
            left, right = a.get("left"), b.get("left")
            if a.attrs["operator"] != "=" or b.attrs["operator"] != "=" or left.type != "Identifier" or right.type != "Identifier" or left.attrs["name"] != right.attrs["name"]:
                return None
            return made("ExpressionStatement", n, ("expression", made(a.type, n, ("left", left), ("right", choose(a.get("right"), b.get("right"))), operator="=")))
        if "AssignmentExpression" not in (a.type, b.type):
            return made("ExpressionStatement", n, ("expression", choose(a, b)))
    return None


def plain_member(n: Node) -> Node | None:
    """``a?.b`` as ``a != null ? a.b : undefined``; calls stay."""
    if n.type == "MemberExpression" and n.attrs.get("optional"):
        plain = Node(n.type, n.start, n.end, {k: v for k, v in n.attrs.items() if k != "optional"}, list(n.children))
        there = made("BinaryExpression", n, ("left", n.get("object")), ("right", made("Literal", n, raw="null", kind="null")), operator="!=")
        return made("ConditionalExpression", n, ("test", there), ("consequent", plain), ("alternate", made("Identifier", n, name="undefined")))
    return None


def joined_text(n: Node) -> Node | None:
    """A template as a sum of its texts and values; empty texts are left out, but the first if a value would begin."""
    if n.type != "TemplateLiteral":
        return None
    parts = []
    for k, c in n.children:
        if k == "quasis":
            text = c.attrs["value"]
            text = text[1:] if text[:1] in "`}" else text
            text = text[:-2] if text.endswith("${") else text[:-1] if text.endswith("`") else text
            if text:
                parts.append(made("Literal", c, raw="'" + text.replace("'", "\\'") + "'", kind="string"))
        else:
            parts.append(c)
    if not parts or not (parts[0].type == "Literal" and parts[0].attrs.get("kind") == "string"):
        parts.insert(0, made("Literal", n, raw="''", kind="string"))
    out = parts[0]
    for p in parts[1:]:
        out = made("BinaryExpression", n, ("left", out), ("right", p), operator="+")
    return out


def continues(n: Node) -> bool:
    """Whether a ``continue`` in a loop's body is for this loop; a labelled one may be."""
    if n.type == "ContinueStatement":
        return True
    return any(continues(c) or (c.type == "ContinueStatement") for _, c in n.children if c.type not in FUNCTIONS and (c.type not in LOOPS or labelled(c)))


def labelled(n: Node) -> bool:
    return any(x.type == "ContinueStatement" and x.children for x in n.walk())


def counted_loop(n: Node) -> list[Node] | None:
    """A ``for`` as its start and a ``while`` with the update at the end; loops with a ``continue`` stay."""
    if n.type != "ForStatement" or continues(n.get("body")):
        return None
    body, update, init = n.get("body"), n.get("update"), n.get("init")
    inside = list(body.children) if body.type == "BlockStatement" else [("body", body)]
    if update is not None:
        inside.append(("body", made("ExpressionStatement", update, ("expression", update))))
    test = n.get("test") or made("Literal", n, raw="true", kind="boolean")
    loop = made("WhileStatement", n, ("test", test), ("body", made("BlockStatement", body, *inside)))
    if init is None:
        return [loop]
    return [init if init.type == "VariableDeclaration" else made("ExpressionStatement", init, ("expression", init)), loop]


RULES = (closing_return, inverted_choice, spread_negation, choice_of_branches, plain_member, joined_text)


def normalised(n: Node, depth: int = 0) -> Node:
    """The node in normal form; rules are tried in order, the loop rule where statements stand in a list."""
    children: list[tuple[str, Node]] = []
    for k, c in n.children:
        if c.type in FUNCTIONS and n.type != "MethodDefinition":
            children.append((k, c))
            continue
        new = normalised(c, depth + 1)
        split = counted_loop(new) if k in ("body", "consequent") and n.type in ("BlockStatement", "Program", "StaticBlock", "SwitchCase") else None
        children += [(k, s) for s in split] if split else [(k, new)]
    out = Node(n.type, n.start, n.end, dict(n.attrs), children)
    for rule in RULES:
        again = rule(out)
        if again is not None:
            return normalised(again, depth)
    return out

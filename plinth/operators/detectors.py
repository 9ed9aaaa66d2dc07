"""Detectors over syntax facts: each is joins and aggregates over ``ast_nodes``, ``relations`` or ``fingerprints``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NEST_TYPES = ("IfStatement", "ForStatement", "ForOfStatement", "ForInStatement", "WhileStatement", "DoWhileStatement", "SwitchStatement", "ConditionalExpression", "CatchClause")
EXIT_TYPES = ("ReturnStatement", "ThrowStatement", "BreakStatement", "ContinueStatement")
FUNCTION_TYPES = ("FunctionDeclaration", "FunctionExpression", "ArrowFunctionExpression")
ARRAY_CALLBACKS = ("forEach", "map", "filter", "some", "every", "find", "findIndex", "reduce", "flatMap")


def children(nodes: DataFrame, prefix: str) -> DataFrame:
    """Nodes keyed by their parent, columns prefixed."""
    return nodes.select("path", F.col("parent_id").alias("node_id"), *(F.col(c).alias(f"{prefix}_{c}") for c in ("node_id", "type", "key", "child_ix", "pre", "post", "start_off", "end_off")))


def statement_counts(nodes: DataFrame) -> DataFrame:
    """``path, node_id, n_stmts, last_type``: statements of a block, or 1 for a bare statement, and the type of the last."""
    body = nodes.where("key = 'body' or key = 'consequent'").select("path", F.col("parent_id").alias("node_id"), "child_ix", "type")
    blocks = nodes.where("type = 'BlockStatement'").select("path", "node_id")
    in_block = blocks.join(body, ["path", "node_id"], "left").groupBy("path", "node_id").agg(F.count("child_ix").alias("n_stmts"), F.max_by("type", "child_ix").alias("last_type"))
    bare = nodes.where("type <> 'BlockStatement'").select("path", "node_id", F.lit(1).cast("long").alias("n_stmts"), F.col("type").alias("last_type"))
    return in_block.unionByName(bare)


def function_metrics(nodes: DataFrame) -> DataFrame:
    """``path, fn_id, line, n_lines, max_depth, complexity`` of every function.

    Complexity: a nesting construct counts 1 and its depth, an ``else`` 1 (an ``else if``
    1 and no depth), each run of ``&&`` 1, a labelled jump 1. Functions inside are
    functions of their own.
    """
    parent = nodes.select("path", F.col("node_id").alias("parent_id"), F.col("type").alias("p_type"), F.element_at("attrs", "operator").alias("p_operator"))
    n = nodes.where("fn_id >= 0").join(parent, ["path", "parent_id"], "left")
    else_if = (F.col("type") == "IfStatement") & (F.col("key") == "alternate") & (F.col("p_type") == "IfStatement")
    op = F.element_at("attrs", "operator")
    cost = (
        F.when(else_if, 1)
        .when(F.col("type").isin(*NEST_TYPES), 1 + F.col("nest"))
        .when((F.col("key") == "alternate") & (F.col("p_type") == "IfStatement"), 1)
        .when((F.col("type") == "LogicalExpression") & (op == "&&") & ~F.coalesce((F.col("p_type") == "LogicalExpression") & (F.col("p_operator") == "&&"), F.lit(False)), 1)
        .when((F.col("type") == "Identifier") & (F.col("key") == "label") & F.col("p_type").isin("BreakStatement", "ContinueStatement"), 1)
        .otherwise(0)
    )
    deep = F.when(F.col("type").isin(*NEST_TYPES), F.col("nest") + F.when(else_if, 0).otherwise(1)).otherwise(0)
    return n.groupBy("path", "fn_id").agg(
        F.min("line").alias("line"), (F.max("line") - F.min("line") + 1).cast("long").alias("n_lines"), F.max(deep).cast("long").alias("max_depth"), F.sum(cost).cast("long").alias("complexity")
    )


def callback_depths(nodes: DataFrame) -> DataFrame:
    """``path, fn_id, callback_depth``: functions given as arguments that hold this one, itself included.

    A sum over each file in nested-set order: one more where such a function begins,
    one less after its end.
    """
    fns = nodes.where(F.col("type").isin(*FUNCTION_TYPES)).withColumn("given", (F.col("key") == "arguments").cast("int"))
    begins = fns.select("path", F.col("pre").alias("at"), F.lit(0).alias("order"), F.col("given").alias("d"), F.col("node_id").alias("fn_id"))
    ends = fns.where("given = 1").select("path", F.col("post").alias("at"), F.lit(1).alias("order"), F.lit(-1).alias("d"), F.lit(None).cast("int").alias("fn_id"))
    depth = F.sum("d").over(Window.partitionBy("path").orderBy("at", "order").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return begins.unionByName(ends).withColumn("callback_depth", depth).where("fn_id is not null and callback_depth > 0").select("path", "fn_id", "callback_depth")


def quadratic_targets(nodes: DataFrame) -> DataFrame:
    """``path, fn_id, targets``: names over which a loop or array method iterates inside another one over the same name.

    Iterations are ``for`` of and in a name, ``for`` up to a name's length, and array
    methods of a name. A sum over each name's iterations in nested-set order tells
    those that lie in another; the function is that of the inner one.
    """
    kid = children(nodes, "c").join(nodes.select("path", F.col("node_id").alias("c_node_id"), F.element_at("attrs", "name").alias("c_name")), ["path", "c_node_id"])
    named = kid.where("c_type = 'Identifier'")
    over = nodes.where("type in ('ForOfStatement', 'ForInStatement')").join(named.where("c_key = 'right'").select("path", "node_id", F.col("c_name").alias("name")), ["path", "node_id"])
    owner = named.where("c_key = 'object'").select("path", F.col("node_id").alias("member"), F.col("c_name").alias("name"))
    lengths = kid.where("c_key = 'right' and c_type = 'MemberExpression' and c_name = 'length'").select("path", F.col("node_id").alias("test"), F.col("c_node_id").alias("member")).join(owner, ["path", "member"])
    tests = kid.where("c_key = 'test' and c_type = 'BinaryExpression'").select("path", "node_id", F.col("c_node_id").alias("test"))
    counted = nodes.where("type = 'ForStatement'").join(tests, ["path", "node_id"]).join(lengths.select("path", "test", "name"), ["path", "test"])
    methods = kid.where((F.col("c_key") == "callee") & (F.col("c_type") == "MemberExpression") & F.col("c_name").isin(*ARRAY_CALLBACKS)).select("path", "node_id", F.col("c_node_id").alias("member")).join(owner, ["path", "member"])
    called = nodes.where("type = 'CallExpression'").join(methods.select("path", "node_id", "name"), ["path", "node_id"])
    columns = ["path", "node_id", "fn_id", "pre", "post", "name"]
    every = over.select(*columns).unionByName(counted.select(*columns)).unionByName(called.select(*columns))
    begins = every.select("path", "name", F.col("pre").alias("at"), F.lit(0).alias("order"), F.lit(1).alias("d"), "fn_id")
    ends = every.select("path", "name", F.col("post").alias("at"), F.lit(1).alias("order"), F.lit(-1).alias("d"), F.lit(None).cast("int").alias("fn_id"))
    depth = F.sum("d").over(Window.partitionBy("path", "name").orderBy("at", "order").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    inner = begins.unionByName(ends).withColumn("depth", depth).where("order = 0 and depth > 1")
    return inner.groupBy("path", "fn_id").agg(F.array_sort(F.collect_set("name")).alias("targets"))


def promise_chains(nodes: DataFrame) -> DataFrame:
    """``path, fn_id, chain_depth``: most calls of ``then``, ``catch`` and ``finally`` in one chain of a function; a chain's calls begin at one place."""
    kid = children(nodes, "c").join(nodes.select("path", F.col("node_id").alias("c_node_id"), F.element_at("attrs", "name").alias("c_name")), ["path", "c_node_id"])
    links = kid.where("c_key = 'callee' and c_type = 'MemberExpression' and c_name in ('then', 'catch', 'finally')").select("path", "node_id")
    chains = nodes.where("type = 'CallExpression'").join(links, ["path", "node_id"]).groupBy("path", "fn_id", "start_off").agg(F.count("*").alias("n"))
    return chains.groupBy("path", "fn_id").agg(F.max("n").alias("chain_depth"))


def nesting_findings(nodes: DataFrame, max_depth: int = 3, max_complexity: int = 15, max_callbacks: int = 3, max_chain: int = 3, min_lines: int = 8, max_density: float = 0.5) -> DataFrame:
    """Functions with any signal, the first in order being the kind; bounds are met at ``>=``, density at ``>``."""
    m = function_metrics(nodes).join(callback_depths(nodes), ["path", "fn_id"], "left").withColumn("callback_depth", F.coalesce("callback_depth", F.lit(0)))
    m = m.join(quadratic_targets(nodes), ["path", "fn_id"], "left").join(promise_chains(nodes), ["path", "fn_id"], "left").withColumn("chain_depth", F.coalesce("chain_depth", F.lit(0)))
    signal = lambda name, fires: F.when(fires, F.lit(name))
    signals = F.array_compact(F.array(
        signal("accidental-quadratic", F.col("targets").isNotNull()),
        signal("high-cognitive-complexity", F.col("complexity") >= max_complexity), signal("callback-depth", F.col("callback_depth") >= max_callbacks),
        signal("promise-chain-depth", F.col("chain_depth") >= max_chain), signal("deep-nesting", F.col("max_depth") >= max_depth), signal("complexity-density", (F.col("n_lines") >= min_lines) & (F.col("complexity") / F.col("n_lines") > max_density)),
    ))
    return m.withColumn("signals", signals).where(F.size("signals") > 0).withColumn("kind", F.col("signals")[0])


def collapsible_ifs(nodes: DataFrame, least: int = 3) -> DataFrame:
    """Ifs without ``else`` that hold only another such if, and else blocks that hold only an if; scored by the inner statements."""
    ifs = nodes.where("type = 'IfStatement'").select("path", "node_id", "fn_id", "line")
    kid = children(nodes, "c")
    count = statement_counts(nodes)
    with_else = kid.where("c_key = 'alternate'").select("path", "node_id").distinct()
    then = kid.where("c_key = 'consequent'").select("path", F.col("node_id").alias("if_id"), F.col("c_node_id").alias("node_id"))
    other = kid.where("c_key = 'alternate' and c_type = 'BlockStatement'").select("path", F.col("node_id").alias("if_id"), F.col("c_node_id").alias("node_id"))

    def only_if(blocks: DataFrame) -> DataFrame:
        one = blocks.join(count.where("n_stmts = 1").select("path", "node_id"), ["path", "node_id"])
        return one.join(kid.where("c_type = 'IfStatement' and c_key = 'body'").select("path", "node_id", F.col("c_node_id").alias("inner")), ["path", "node_id"])

    plain = ifs.join(with_else, ["path", "node_id"], "left_anti").select("path", F.col("node_id").alias("if_id"), "fn_id", "line")
    inner_plain = ifs.join(with_else, ["path", "node_id"], "left_anti").select("path", F.col("node_id").alias("inner"))
    inner_then = then.select("path", F.col("if_id").alias("inner"), "node_id").join(count, ["path", "node_id"]).select("path", "inner", "n_stmts")
    nested = plain.join(only_if(then), ["path", "if_id"]).join(inner_plain, ["path", "inner"]).join(inner_then, ["path", "inner"])
    a = nested.where(F.col("n_stmts") >= 3).select("path", "if_id", "fn_id", "line", F.lit("collapsible-if").alias("kind"), F.col("n_stmts").alias("score"))
    elses = ifs.select("path", F.col("node_id").alias("if_id"), "fn_id", "line").join(only_if(other), ["path", "if_id"]).join(inner_then, ["path", "inner"])
    b = elses.select("path", "if_id", "fn_id", "line", F.lit("collapsible-else-if").alias("kind"), F.greatest("n_stmts", F.lit(3)).cast("long").alias("score"))
    return a.unionByName(b).where(F.col("score") >= least)


def invertible_ifs(nodes: DataFrame, short: int = 3) -> DataFrame:
    """If-else whose short side has at most ``short`` statements and exits, the other being twice as long or more."""
    kid = children(nodes, "c").select("path", F.col("node_id").alias("if_id"), F.col("c_node_id").alias("node_id"), "c_key", "c_type")
    count = statement_counts(nodes)
    sides = kid.where("c_key in ('consequent', 'alternate')").join(count, ["path", "node_id"])
    side = lambda key, p: sides.where(F.col("c_key") == key).select("path", "if_id", F.col("n_stmts").alias(f"{p}_n"), F.col("last_type").alias(f"{p}_last"), F.col("c_type").alias(f"{p}_type"))
    both = side("consequent", "t").join(side("alternate", "e"), ["path", "if_id"]).where("e_type <> 'IfStatement'")
    yes_short = (F.col("t_n") <= short) & F.col("t_last").isin(*EXIT_TYPES) & (F.col("e_n") >= 2 * F.col("t_n"))
    no_short = (F.col("e_n") <= short) & F.col("e_last").isin(*EXIT_TYPES) & (F.col("t_n") >= 2 * F.col("e_n"))
    own = nodes.where("type = 'IfStatement'").select("path", F.col("node_id").alias("if_id"), "fn_id", "line")
    return both.where(yes_short | no_short).join(own, ["path", "if_id"]).select("path", "if_id", "fn_id", "line", F.lit("invertible-if-else").alias("kind"), F.greatest("t_n", "e_n").alias("score"))


def wrapping_ifs(nodes: DataFrame) -> DataFrame:
    """An if without ``else`` of two statements or more that ends a function's body."""
    fns = nodes.where(F.col("type").isin(*FUNCTION_TYPES)).select("path", F.col("node_id").alias("fn"))
    kid = children(nodes, "c")
    body = kid.where("c_key = 'body' and c_type = 'BlockStatement'").select("path", F.col("node_id").alias("fn"), F.col("c_node_id").alias("node_id")).join(fns, ["path", "fn"])
    last = kid.groupBy("path", "node_id").agg(F.max(F.struct("c_child_ix", "c_node_id", "c_type")).alias("m")).where("m.c_type = 'IfStatement'")
    tails = body.join(last, ["path", "node_id"]).select("path", F.col("m.c_node_id").alias("node_id"))
    no_else = tails.join(kid.where("c_key = 'alternate'").select("path", "node_id").distinct(), ["path", "node_id"], "left_anti")
    then = kid.where("c_key = 'consequent'").select("path", "node_id", F.col("c_node_id").alias("then"))
    count = statement_counts(nodes).select("path", F.col("node_id").alias("then"), "n_stmts")
    own = nodes.select("path", "node_id", "fn_id", "line")
    return no_else.join(then, ["path", "node_id"]).join(count, ["path", "then"]).where("n_stmts >= 2").join(own, ["path", "node_id"]).select("path", F.col("node_id").alias("if_id"), "fn_id", "line", F.lit("wrapping-if").alias("kind"), F.col("n_stmts").alias("score"))


LOOP_TYPES = ("ForStatement", "ForOfStatement", "ForInStatement", "WhileStatement", "DoWhileStatement")


def _in_loops(nodes: DataFrame) -> DataFrame:
    """``path, block, in_loop`` of the statement lists that are a function's or a loop's body."""
    holders = nodes.where(F.col("type").isin(*FUNCTION_TYPES, *LOOP_TYPES)).select("path", F.col("node_id").alias("parent_id"), F.col("type").isin(*LOOP_TYPES).alias("in_loop"))
    return nodes.where("type = 'BlockStatement' and key = 'body'").join(holders, ["path", "parent_id"]).select("path", F.col("node_id").alias("block"), "in_loop")


def _leaves(last, in_loop):
    """Whether a last statement leaves: the function, or within a loop its round."""
    return last.isin("ReturnStatement", "ThrowStatement") | (in_loop & last.isin("ContinueStatement", "BreakStatement"))


def implicit_elses(nodes: DataFrame, most: int = 3) -> DataFrame:
    """An if without ``else`` that leaves, twice as long or more as the up to ``most`` statements after it, which leave too or end a loop's round."""
    kid = children(nodes, "c")
    count = statement_counts(nodes)
    lists = _in_loops(nodes).join(count.select("path", F.col("node_id").alias("block"), F.col("n_stmts").alias("n"), F.col("last_type").alias("end")), ["path", "block"])
    no_else = nodes.where("type = 'IfStatement'").join(kid.where("c_key = 'alternate'").select("path", "node_id").distinct(), ["path", "node_id"], "left_anti").select("path", F.col("node_id").alias("if_id"), F.col("parent_id").alias("block"), "child_ix", "fn_id", "line")
    then = kid.where("c_key = 'consequent'").select("path", F.col("node_id").alias("if_id"), F.col("c_node_id").alias("node_id")).join(count, ["path", "node_id"]).select("path", "if_id", "n_stmts", "last_type")
    met = no_else.join(lists, ["path", "block"]).join(then, ["path", "if_id"]).withColumn("after", F.col("n") - F.col("child_ix") - 1)
    fits = (F.col("after") >= 1) & (F.col("after") <= most) & (F.col("n_stmts") >= 2 * F.col("after")) & _leaves(F.col("last_type"), F.col("in_loop")) & (F.col("in_loop") | _leaves(F.col("end"), F.lit(False)))
    return met.where(fits).select("path", "if_id", "fn_id", "line", F.lit("implicit-else").alias("kind"), F.col("n_stmts").alias("score"))


def cascade_guards(nodes: DataFrame) -> DataFrame:
    """Chains of two ifs or more whose branches all leave.

    With a closing ``else`` the score is the chain's length times that side's statements,
    without one the branches' statements; chains of single exits with a closing
    ``else`` of one statement only choose, and are left out.
    """
    kid = children(nodes, "c")
    count = statement_counts(nodes)
    ifs = nodes.where("type = 'IfStatement'").select("path", "node_id", F.element_at("attrs", "chain").cast("int").alias("chain"))
    side = lambda key: kid.where(F.col("c_key") == key).select("path", "node_id", F.col("c_node_id").alias("branch"), "c_type").join(count.select("path", F.col("node_id").alias("branch"), "n_stmts", "last_type"), ["path", "branch"])
    then = ifs.join(side("consequent"), ["path", "node_id"])
    closing = ifs.join(side("alternate").where("c_type <> 'IfStatement'"), ["path", "node_id"]).select("path", "chain", F.col("n_stmts").alias("closing"))
    place = nodes.where("type = 'IfStatement'").select("path", F.col("node_id").alias("chain"), "fn_id", "line", F.col("parent_id").alias("block"))
    lists = _in_loops(nodes)
    known = then.join(place, ["path", "chain"]).join(lists, ["path", "block"], "left").withColumn("in_loop", F.coalesce("in_loop", F.lit(False)))
    chains = known.groupBy("path", "chain", "fn_id", "line").agg(F.count("*").alias("n"), F.sum("n_stmts").alias("branches"), F.bool_and(_leaves(F.col("last_type"), F.col("in_loop"))).alias("leaves"), F.count(F.when(F.col("n_stmts") <= 1, 1)).alias("single"))
    found = chains.where("n >= 2 and leaves").join(closing, ["path", "chain"], "left").where("closing is null or (closing > 0 and not (single = n and closing <= 1))")
    return found.select("path", F.col("chain").alias("if_id"), "fn_id", "line", F.lit("cascade-guard").alias("kind"), F.when(F.col("closing").isNull(), F.col("branches")).otherwise(F.col("n") * F.col("closing")).alias("score"))


def early_returns(nodes: DataFrame, least: int = 2) -> DataFrame:
    """Reductions of each function: the sum of scores, at least ``least``, and the best part's kind."""
    parts = invertible_ifs(nodes).unionByName(wrapping_ifs(nodes)).unionByName(implicit_elses(nodes)).unionByName(cascade_guards(nodes))
    return parts.groupBy("path", "fn_id").agg(F.sum("score").alias("score"), F.min_by("kind", F.struct((-F.col("score")).alias("s"), "line", "if_id")).alias("kind"), F.min("line").alias("line")).where(F.col("score") >= least)


def clone_tiers(prints: DataFrame) -> DataFrame:
    """``tier, fp, n, path, start_off, line, name, size, is_primary`` of exact groups, then of renamed groups that no exact group already is, then of normalised groups that neither is."""
    every = prints.groupBy("exact").agg(F.count("*").alias("n"), F.min("shape").alias("s"), F.min("normal").alias("m")).where("n > 1")
    shape = prints.groupBy("shape").agg(F.count("*").alias("n"), F.count_distinct("exact").alias("kinds"), F.min("normal").alias("m")).where("n > 1 and kinds > 1")
    shape = shape.join(every.select(F.col("s").alias("shape")).distinct(), "shape", "left_anti")
    normal = prints.groupBy("normal").agg(F.count("*").alias("n"), F.count_distinct("shape").alias("kinds")).where("n > 1 and kinds > 1")
    normal = normal.join(every.select(F.col("m").alias("normal")).unionByName(shape.select(F.col("m").alias("normal"))).distinct(), "normal", "left_anti")
    columns = ("n", "path", "start_off", "line", "name", "size")
    parts = [prints.join(groups.select(fp, "n"), fp).select(F.lit(tier).alias("tier"), F.col(fp).alias("fp"), *columns) for tier, fp, groups in (("exact", "exact", every), ("shape", "shape", shape), ("normalized", "normal", normal))]
    first = Window.partitionBy("tier", "fp").orderBy("path", "start_off")
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("is_primary", F.row_number().over(first) == 1)


# -- modules


def is_index(path):
    return path.rlike("(^|/)index[.]ts$")


def barrel_statements(nodes: DataFrame) -> DataFrame:
    """Bare ``export *`` anywhere, and statements of an index file that are no re-exports."""
    top = nodes.where("parent_id = 0")
    star = top.where((F.col("type") == "ExportAllDeclaration") & F.element_at("attrs", "exported").isNull()).select("path", "line", F.lit("export-star").alias("kind"))
    reexport = (F.col("type") == "ExportAllDeclaration") | ((F.col("type") == "ExportNamedDeclaration") & F.element_at("attrs", "source").isNotNull()) | (F.col("type") == "EmptyStatement")
    other = top.where(is_index(F.col("path")) & ~reexport).select("path", "line", F.lit("invalid-index-statement").alias("kind"))
    return star.unionByName(other)


def deep_imports(resolved: DataFrame, files: DataFrame) -> DataFrame:
    """Imports of a file that is no index, outside the importer's own and ancestor directories: ``deep-import`` if an index is there to use, else ``missing-index``."""
    folder = lambda c: F.regexp_replace(c, "/?[^/]*$", "")
    edges = resolved.where("target is not null and type = 'imports'").select("path", "target").distinct().withColumn("dir", folder(F.col("target"))).withColumn("own", folder(F.col("path")))
    outside = edges.where(~is_index(F.col("target")) & (F.col("own") != F.col("dir")) & ~F.concat(F.col("own"), F.lit("/")).startswith(F.concat(F.col("dir"), F.lit("/"))))
    index = files.where(is_index(F.col("path"))).select(folder(F.col("path")).alias("dir"), F.lit(True).alias("has")).distinct()
    return outside.join(index, "dir", "left").select("path", "target", F.when(F.col("has"), "deep-import").otherwise("missing-index").alias("kind"))


# -- lint rules


def unused_imports(nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """Imported names that nothing in the file mentions (L14); mentions in types count."""
    names = nodes.where("type = 'Identifier'").select("path", F.element_at("attrs", "name").alias("local"))
    in_types = nodes.where("type in ('TSType', 'TSTypeParameterInstantiation', 'TSTypeParameterDeclaration')").select("path", F.explode(F.expr(r"regexp_extract_all(coalesce(element_at(attrs, 'text'), ''), '[A-Za-z_$][A-Za-z0-9_$]*', 0)")).alias("local"))
    exported = relations.where("type = 'exports'").select("path", F.col("imported").alias("local"))
    used = names.unionByName(in_types).unionByName(exported).distinct()
    return relations.where("type = 'imports' and local is not null").select("path", "local", "offset").join(used, ["path", "local"], "left_anti")


def simple_lints(nodes: DataFrame) -> DataFrame:
    """Rules that one node decides: inline object types, bracket notation, computed dynamic imports."""
    kid = children(nodes, "c").join(nodes.select("path", F.col("node_id").alias("c_node_id"), F.col("attrs").alias("c_attrs")), ["path", "c_node_id"])
    inline = nodes.where("type = 'TSTypeLiteral'").select("path", "line", F.lit("no-inline-object-type").alias("rule"))
    literal = kid.where("c_type = 'Literal' and c_key = 'property' and element_at(c_attrs, 'kind') = 'string'").select("path", "node_id")
    bracket = nodes.where("type = 'MemberExpression'").join(literal, ["path", "node_id"]).select("path", "line", F.lit("no-bracket-notation").alias("rule"))
    plain = kid.where("c_type = 'Literal' and element_at(c_attrs, 'kind') = 'string'").select("path", "node_id")
    dynamic = nodes.where("type = 'ImportExpression'").join(plain, ["path", "node_id"], "left_anti").select("path", "line", F.lit("no-dynamic-import").alias("rule"))
    umbrella = nodes.where("type = 'TSType' and element_at(attrs, 'text') in ('object', 'Object', 'Function', '{}')").select("path", "line", F.lit("no-umbrella-types").alias("rule"))
    return inline.unionByName(bracket).unionByName(dynamic).unionByName(umbrella)


def tombstones(files: DataFrame) -> DataFrame:
    """Files that are empty, hold only comments, or only ``export {}``."""
    bare = F.regexp_replace("source_text", r"//[^\n]*|(?s)/\*.*?\*/", "")
    return files.where(F.trim(F.regexp_replace(bare, r"\s+|export\s*\{\s*\}\s*;?", "")) == "").select("path")


def exported_classes(nodes: DataFrame) -> DataFrame:
    """Files that export several classes, or a class beside something else."""
    top = nodes.where("parent_id = 0 and type in ('ExportNamedDeclaration', 'ExportDefaultDeclaration', 'ExportAllDeclaration')").select("path", "node_id")
    kinds = nodes.where("key = 'declaration'").select("path", F.col("parent_id").alias("node_id"), "type")
    per = top.join(kinds, ["path", "node_id"], "left").groupBy("path").agg(F.count(F.when(F.col("type") == "ClassDeclaration", 1)).alias("classes"), F.count("*").alias("exports"))
    return per.where("classes > 1 or (classes = 1 and exports > 1)")


def member_order(nodes: DataFrame) -> DataFrame:
    """Class members that stand after one of a higher rank; setters do not count (L2)."""
    has = lambda k: F.element_at("attrs", k).isNotNull()
    kind = F.when(F.col("type") == "PropertyDefinition", 0).when(F.col("type") == "StaticBlock", 1).when(F.element_at("attrs", "kind") == "constructor", 2).when(F.element_at("attrs", "kind") == "get", 3).otherwise(4)
    access = F.when(has("private"), 2).when(has("protected"), 1).otherwise(0)
    rank = kind * 6 + F.when(has("static"), 0).otherwise(3) + access
    members = nodes.where("key = 'body' and type in ('PropertyDefinition', 'StaticBlock', 'MethodDefinition')").where(~(F.coalesce(F.element_at("attrs", "kind") == "set", F.lit(False)))).withColumn("rank", rank)
    w = Window.partitionBy("path", "parent_id").orderBy("child_ix").rowsBetween(Window.unboundedPreceding, -1)
    return members.withColumn("before", F.max("rank").over(w)).where("rank < before").select("path", "line", F.element_at("attrs", "name").alias("name"), "rank", "before")


# -- indirection


def thin_wrappers(nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """``path, fn_id, line, name, callee``: named functions that only pass their parameters on, one for one, to a free name.

    Async and exported functions, overloaded names, wrappers of themselves and those
    whose name is mentioned other than in a call are held.
    """
    fns = nodes.where("type = 'FunctionDeclaration' and element_at(attrs, 'is_async') is null").select("path", "node_id", "line", "parent_id")
    kid = children(nodes.withColumn("end_off", F.col("end_off")), "c").join(nodes.select("path", F.col("node_id").alias("c_node_id"), F.element_at("attrs", "name").alias("c_name"), F.col("attrs").alias("c_attrs")), ["path", "c_node_id"])
    own = kid.where("c_key = 'id'").select("path", "node_id", F.col("c_name").alias("name"))
    gather = lambda key, out: kid.where(F.col("c_key") == key).groupBy("path", "node_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("c_child_ix", F.coalesce("c_name", F.lit("?")).alias("n"), "c_type"))), lambda x: F.concat_ws(":", x["c_type"], x["n"])).alias(out))
    params = gather("params", "params")
    body = kid.where("c_key = 'body' and c_type = 'BlockStatement'").select("path", "node_id", F.col("c_node_id").alias("block"))
    only = kid.where("c_key = 'body'").groupBy("path", F.col("node_id").alias("block")).agg(F.count("*").alias("n"), F.first("c_node_id").alias("stmt"), F.first("c_type").alias("stmt_type")).where("n = 1 and stmt_type in ('ReturnStatement', 'ExpressionStatement')")
    call = kid.where("c_type = 'CallExpression' and c_key in ('argument', 'expression')").select("path", F.col("node_id").alias("stmt"), F.col("c_node_id").alias("call"))
    callee = kid.where("c_key = 'callee' and c_type = 'Identifier'").select("path", F.col("node_id").alias("call"), F.col("c_name").alias("callee"))
    args = gather("arguments", "args").withColumnRenamed("node_id", "call")
    shaped = fns.join(own, ["path", "node_id"]).join(body, ["path", "node_id"]).join(only, ["path", "block"]).join(call, ["path", "stmt"]).join(callee, ["path", "call"])
    none = F.array().cast("array<string>")
    full = shaped.join(params, ["path", "node_id"], "left").join(args, ["path", "call"], "left")
    passed = full.where(F.coalesce("params", none) == F.coalesce("args", none)).where(~F.exists(F.coalesce("params", none), lambda p: ~p.startswith("Identifier:"))).where("callee <> name").where(~F.array_contains(F.coalesce("params", none), F.concat(F.lit("Identifier:"), F.col("callee"))))
    exported = relations.where("type = 'exports'").select("path", F.col("imported").alias("name")).union(relations.where("type = 'exports'").select("path", "local")).distinct()
    twice = fns.join(own, ["path", "node_id"]).groupBy("path", "name").count().where("count > 1").select("path", "name")
    escapes = nodes.where("type = 'Identifier' and key not in ('callee', 'id')").select("path", F.element_at("attrs", "name").alias("name")).distinct()
    out = passed.join(exported, ["path", "name"], "left_anti").join(twice, ["path", "name"], "left_anti").join(escapes, ["path", "name"], "left_anti")
    return out.select("path", F.col("node_id").alias("fn_id"), "line", "name", "callee")


def forward_chains(wrappers: DataFrame, max_depth: int = 1) -> DataFrame:
    """``path, name, depth`` of wrappers whose chain of wrappers in the file is longer than ``max_depth``; rings are not reported."""
    from plinth.operators.graph import chain_depths

    key = lambda c: F.concat_ws("\x00", "path", c)
    depths = chain_depths(wrappers.select(key("name").alias("u"), key("callee").alias("v")))
    return depths.where(F.col("depth") > max_depth).select(F.split("node", "\x00")[0].alias("path"), F.split("node", "\x00")[1].alias("name"), "depth")


def type_remaps(nodes: DataFrame) -> DataFrame:
    """Aliases of a bare type name without parameters: ``path, line``."""
    alias = nodes.where("type = 'TSTypeAliasDeclaration' and element_at(attrs, 'declare') is null").select("path", "node_id", "line")
    kid = nodes.select("path", F.col("parent_id").alias("node_id"), "key", F.element_at("attrs", "text").alias("text"))
    generic = kid.where("key = 'typeParameters'").select("path", "node_id")
    plain = "any unknown never string number boolean bigint symbol void null undefined object".split()
    bare = kid.where((F.col("key") == "typeAnnotation") & F.col("text").rlike(r"^[A-Za-z_$][\w$.]*$") & ~F.col("text").isin(*plain)).select("path", "node_id")
    return alias.join(bare, ["path", "node_id"]).join(generic, ["path", "node_id"], "left_anti").select("path", "line")


def interface_rewraps(nodes: DataFrame) -> DataFrame:
    """Empty interfaces without parameters that extend exactly one: ``path, line``."""
    own = nodes.where("type = 'TSInterfaceDeclaration'").select("path", "node_id", "line")
    kid = nodes.select("path", F.col("parent_id").alias("node_id"), "key", "type", F.element_at("attrs", "empty").alias("empty"))
    one = kid.where("key = 'extends'").groupBy("path", "node_id").count().where("count = 1").select("path", "node_id")
    empty = kid.where("type = 'TSInterfaceBody' and empty = 'True'").select("path", "node_id")
    generic = kid.where("key = 'typeParameters'").select("path", "node_id")
    return own.join(one, ["path", "node_id"]).join(empty, ["path", "node_id"]).join(generic, ["path", "node_id"], "left_anti").select("path", "line")


# -- error flow


def inside(points: DataFrame, holders: DataFrame) -> DataFrame:
    """The rows of ``points(path, fn_id, pre, ..)`` that lie in one of ``holders(path, fn_id, pre, post)`` of their function.

    A sum over each function in nested-set order: one more where a holder begins, one
    less after its end.
    """
    columns = points.columns
    events = points.withColumns({"order": F.lit(1), "d": F.lit(0), "at": F.col("pre")})
    edge = lambda at, order, d: holders.select("path", "fn_id", F.col(at).alias("at"), F.lit(order).alias("order"), F.lit(d).alias("d"))
    every = events.unionByName(edge("pre", 0, 1), allowMissingColumns=True).unionByName(edge("post", 2, -1), allowMissingColumns=True)
    depth = F.sum("d").over(Window.partitionBy("path", "fn_id").orderBy("at", "order").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return every.withColumn("depth", depth).where("order = 1 and depth > 0").select(*columns)


PROMISE_FACTORIES = ("resolve", "reject", "all", "allSettled", "any", "race")


def proven_promises(nodes: DataFrame, thenables: DataFrame | None = None) -> DataFrame:
    """``path, node_id`` of expressions that are promises: ``new Promise``, factories of ``Promise``, calls of an async function of the file, chains upon one, and what ``thenables(path, start_off, end_off)`` tells.

    An async function's name counts if nothing else of the file has it.
    """
    kid = children(nodes, "c").join(nodes.select("path", F.col("node_id").alias("c_node_id"), F.element_at("attrs", "name").alias("c_name"), F.element_at("attrs", "is_async").alias("c_async")), ["path", "c_node_id"])
    named = kid.where("c_key = 'callee' and c_type = 'Identifier'").select("path", "node_id", "c_name")
    built = nodes.where("type = 'NewExpression'").select("path", "node_id").join(named.where("c_name = 'Promise'"), ["path", "node_id"]).select("path", "node_id")
    members = kid.where("c_key = 'callee' and c_type = 'MemberExpression'").select("path", "node_id", F.col("c_node_id").alias("member"), F.col("c_name").alias("method"))
    owners = kid.where("c_key = 'object' and c_type = 'Identifier'").select("path", F.col("node_id").alias("member"), F.col("c_name").alias("owner"))
    factories = members.where(F.col("method").isin(*PROMISE_FACTORIES)).join(owners.where("owner = 'Promise'"), ["path", "member"]).select("path", "node_id")
    declared = kid.where("c_key = 'id' and c_type = 'Identifier'").select("path", "node_id", "c_name")
    functions = nodes.where("type = 'FunctionDeclaration' and element_at(attrs, 'is_async') = 'True'").select("path", "node_id").join(declared, ["path", "node_id"])
    arrows = kid.where(F.col("c_key").eqNullSafe("init") & F.col("c_type").isin(*FUNCTION_TYPES) & (F.col("c_async") == "True")).select("path", "node_id").join(declared, ["path", "node_id"])
    once = declared.groupBy("path", "c_name").count().where("count = 1").select("path", "c_name")
    shadowed = kid.where("c_key = 'params' and c_type = 'Identifier'").select("path", "c_name")
    own = functions.unionByName(arrows).join(once, ["path", "c_name"]).join(shadowed, ["path", "c_name"], "left_anti").select("path", "c_name").distinct()
    called = nodes.where("type = 'CallExpression'").select("path", "node_id").join(named, ["path", "node_id"]).join(own, ["path", "c_name"]).select("path", "node_id")
    roots = built.unionByName(factories).unionByName(called)
    if thenables is not None:
        roots = roots.unionByName(nodes.join(thenables.select("path", "start_off", "end_off"), ["path", "start_off", "end_off"], "left_semi").select("path", "node_id"))
    # A chain's calls begin where its root begins, and each holds the one before it.
    root_at = nodes.join(roots.distinct(), ["path", "node_id"]).groupBy("path", "start_off").agg(F.min("end_off").alias("root_end"))
    links = nodes.where("type = 'CallExpression'").join(members.where("method in ('then', 'catch', 'finally')").select("path", "node_id"), ["path", "node_id"])
    chained = links.join(root_at, ["path", "start_off"]).where("end_off > root_end").select("path", "node_id")
    return roots.unionByName(chained).distinct()


def promise_findings(nodes: DataFrame, thenables: DataFrame | None = None) -> DataFrame:
    """``path, line, kind``: promises thrown away (but not ``new Promise``, whose executor has run), chains without a ``catch``, promises returned from a ``try`` without ``await``, promise variables that nothing reads."""
    promises = proven_promises(nodes, thenables)
    kid = children(nodes, "c").join(nodes.select("path", F.col("node_id").alias("c_node_id"), F.element_at("attrs", "name").alias("c_name")), ["path", "c_node_id"])
    is_promise = promises.select("path", F.col("node_id").alias("c_node_id"))
    at = nodes.select("path", "node_id", "type", "line", "pre", "post", "fn_id")
    found = lambda df, kind: df.select("path", "line", F.lit(kind).alias("kind"))
    dropped = at.where("type = 'ExpressionStatement'").join(kid.where("c_key = 'expression' and c_type <> 'NewExpression'").join(is_promise, ["path", "c_node_id"]).select("path", "node_id", "c_node_id"), ["path", "node_id"])
    calls = kid.where("c_key = 'callee' and c_type = 'MemberExpression' and c_name in ('then', 'catch', 'finally')").select("path", F.col("node_id").alias("c_node_id"), F.col("c_name").alias("method"))
    # A chain is what begins at one place; a second argument of then is a handler too.
    handlers = kid.where("c_key = 'arguments'").groupBy("path", F.col("node_id").alias("c_node_id")).agg(F.count("*").alias("n_args"))
    placed = nodes.select("path", F.col("node_id").alias("c_node_id"), "start_off")
    linked = calls.join(placed, ["path", "c_node_id"]).join(handlers, ["path", "c_node_id"], "left")
    handled = linked.where("method = 'catch' or (method = 'then' and n_args >= 2)").select("path", "start_off").distinct()
    whole = dropped.join(placed, ["path", "c_node_id"]).join(linked.select("path", "start_off", F.lit(True).alias("chain")).distinct(), ["path", "start_off"], "left").join(handled, ["path", "start_off"], "left_anti")
    floating, loose = whole.where("chain is null"), whole.where("chain")
    handler = kid.where("c_key = 'handler'").select("path", "node_id")
    blocks = kid.where("c_key = 'block'").join(handler, ["path", "node_id"]).select("path", F.col("c_node_id").alias("node_id"))
    tries = at.join(blocks, ["path", "node_id"]).select("path", "fn_id", "pre", "post")
    asyncs = nodes.where("element_at(attrs, 'is_async') = 'True'").where(F.col("type").isin(*FUNCTION_TYPES)).select("path", F.col("node_id").alias("fn_id"))
    back = at.where("type = 'ReturnStatement'").join(kid.where("c_key = 'argument'").join(is_promise, ["path", "c_node_id"]).select("path", "node_id"), ["path", "node_id"]).join(asyncs, ["path", "fn_id"])
    returned = inside(back, tries)
    names = kid.where("c_key = 'id' and c_type = 'Identifier'").select("path", "node_id", "c_name", F.col("c_node_id").alias("id_node"))
    kept = at.where("type = 'VariableDeclarator'").join(kid.where("c_key = 'init'").join(is_promise, ["path", "c_node_id"]).select("path", "node_id"), ["path", "node_id"]).join(names, ["path", "node_id"])
    exported = nodes.where("type = 'ExportNamedDeclaration'").select("path", F.col("pre").alias("e_pre"), F.col("post").alias("e_post"), "fn_id")
    shown = inside(kept, exported.select("path", "fn_id", F.col("e_pre").alias("pre"), F.col("e_post").alias("post"))).select("path", "node_id")
    mentions = nodes.where("type = 'Identifier'").groupBy("path", F.element_at("attrs", "name").alias("c_name")).agg(F.count("*").alias("n"))
    unread = kept.join(shown, ["path", "node_id"], "left_anti").join(mentions.where("n = 1"), ["path", "c_name"])
    parts = [found(floating, "floating-promises"), found(loose, "catch-or-return"), found(returned, "return-await-in-try"), found(unread, "unobserved-variable")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def error_flow(nodes: DataFrame, thenables: DataFrame | None = None) -> DataFrame:
    """``path, line, kind``: thrown literals, async promise executors, jumps out of ``finally``, empty ``catch``, lost causes, async callbacks of array methods.

    Beside them what is proved of promises (:func:`promise_findings`); what needs types
    that ``thenables`` does not tell is held.
    """
    kid = children(nodes, "c").join(nodes.select("path", F.col("node_id").alias("c_node_id"), F.col("attrs").alias("c_attrs"), F.col("pre").alias("cp"), F.col("post").alias("cq")), ["path", "c_node_id"])
    at = nodes.select("path", "node_id", "type", "line", "pre", "post", "fn_id")
    found = lambda df, kind: df.select("path", "line", F.lit(kind).alias("kind"))
    thrown = at.where("type = 'ThrowStatement'").join(kid.where("c_key = 'argument' and (c_type in ('TemplateLiteral', 'ObjectExpression', 'ArrayExpression') or c_type = 'Literal')").select("path", "node_id"), ["path", "node_id"])
    named = lambda name: kid.where((F.col("c_key") == "callee") & (F.col("c_type") == "Identifier") & (F.element_at("c_attrs", "name") == name)).select("path", "node_id")
    is_async = F.col("c_type").isin(*FUNCTION_TYPES) & (F.element_at("c_attrs", "is_async") == "True")
    with_async = kid.where((F.col("c_key") == "arguments") & is_async).select("path", "node_id").distinct()
    executor = at.where("type = 'NewExpression'").join(named("Promise"), ["path", "node_id"]).join(with_async, ["path", "node_id"])
    final = at.join(kid.where("c_key = 'finalizer'").select("path", F.col("c_node_id").alias("node_id")), ["path", "node_id"]).select("path", "fn_id", "pre", "post")
    jumps = inside(at.where("type in ('ReturnStatement', 'ThrowStatement')"), final)
    clause = at.where("type = 'CatchClause'")
    bodies = kid.where("c_key = 'body' and c_type = 'BlockStatement'").select("path", "node_id", F.col("c_node_id").alias("block"))
    filled = nodes.select("path", F.col("parent_id").alias("block")).distinct()
    empty = clause.join(bodies, ["path", "node_id"]).join(filled, ["path", "block"], "left_anti")
    errors = at.where("type = 'NewExpression'").join(named("Error"), ["path", "node_id"])
    caused = kid.where((F.col("c_key") == "arguments") & (F.col("c_type") == "ObjectExpression")).select("path", "node_id").distinct()
    throws = nodes.where("type = 'NewExpression' and key = 'argument'").join(nodes.where("type = 'ThrowStatement'").select("path", F.col("node_id").alias("parent_id")), ["path", "parent_id"]).select("path", "node_id")
    lost = inside(errors.join(throws, ["path", "node_id"]).join(caused, ["path", "node_id"], "left_anti"), clause.select("path", "fn_id", "pre", "post"))
    method = kid.where((F.col("c_key") == "callee") & (F.col("c_type") == "MemberExpression") & F.element_at("c_attrs", "name").isin("forEach", "filter", "some", "every", "find", "findIndex", "sort")).select("path", "node_id")
    misused = at.where("type = 'CallExpression'").join(method, ["path", "node_id"]).join(with_async, ["path", "node_id"])
    parts = [found(thrown, "throw-non-error"), found(executor, "promise-constructor-hygiene"), found(jumps, "unsafe-finally"), found(empty, "empty-catch"), found(lost, "missing-error-cause"), found(misused, "misused-promises")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.unionByName(promise_findings(nodes, thenables)).distinct()


def circular_dependencies(resolved: DataFrame) -> DataFrame:
    """``component, ix, node`` of one cycle of each strongly connected group of files; type-only imports do not count."""
    from plinth.operators.graph import greedy_cycles, strongly_connected

    edges = resolved.where("target is not null and type in ('imports', 're-exports') and not is_type and path <> target").select(F.col("path").alias("u"), F.col("target").alias("v")).distinct()
    return greedy_cycles(edges, strongly_connected(edges))


def unused_files(resolved: DataFrame, files: DataFrame, entries: DataFrame) -> DataFrame:
    """Files that no entry reaches over imports (G1); without entries nothing is told."""
    from plinth.operators.graph import reachable

    if entries.isEmpty():
        return files.select("path").limit(0)
    edges = resolved.where("target is not null").select(F.col("path").alias("u"), F.col("target").alias("v")).distinct()
    seen = reachable(edges, entries.select(F.col("path").alias("node"))).select(F.col("node").alias("path"))
    return files.select("path").join(seen, "path", "left_anti")


def global_mutations(nodes: DataFrame) -> DataFrame:
    """Writes to, updates and deletes of members of ``globalThis``, and ``Object`` calls that define some."""
    member = nodes.where("type = 'MemberExpression'").select("path", "node_id", "parent_id", "key", "line")
    names = nodes.where("type = 'Identifier' and element_at(attrs, 'name') = 'globalThis'").select("path", F.col("parent_id").alias("node_id"), F.col("key").alias("name_key"))
    owner = nodes.select("path", F.col("node_id").alias("parent_id"), F.col("type").alias("p_type"), F.element_at("attrs", "operator").alias("op"))
    on_global = member.join(names.where("name_key = 'object'").select("path", "node_id"), ["path", "node_id"]).join(owner, ["path", "parent_id"])
    written = on_global.where("(p_type = 'AssignmentExpression' and key = 'left') or p_type = 'UpdateExpression' or (p_type = 'UnaryExpression' and op = 'delete')").select("path", "line")
    calls = nodes.where("type = 'CallExpression'").select("path", "node_id", "line").join(names.where("name_key = 'arguments'").select("path", "node_id"), ["path", "node_id"])
    callee = nodes.where(F.col("type").eqNullSafe("MemberExpression") & (F.col("key") == "callee") & F.element_at("attrs", "name").isin("assign", "defineProperty", "defineProperties", "setPrototypeOf")).select("path", F.col("parent_id").alias("node_id"))
    return written.unionByName(calls.join(callee, ["path", "node_id"]).select("path", "line"))


def test_file_mapping(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """Specs without the file they are for, and files with functions or classes without a spec, in one directory."""
    spec = files.where(F.col("path").rlike(r"[.]spec[.]ts$")).select(F.regexp_replace("path", r"[.]spec[.]ts$", ".ts").alias("impl"), "path")
    impl = files.where(~F.col("path").rlike(r"[.]spec[.]ts$")).select("path")
    orphan = spec.join(impl.select(F.col("path").alias("impl")), "impl", "left_anti").select("path", F.lit("spec-without-file").alias("kind"))
    logic = nodes.where(F.col("type").isin(*FUNCTION_TYPES, "ClassDeclaration")).select("path").distinct()
    bare = impl.where(~is_index(F.col("path"))).join(logic, "path", "left_semi").join(spec.select(F.col("impl").alias("path")), "path", "left_anti").select("path", F.lit("file-without-spec").alias("kind"))
    return orphan.unionByName(bare)


def describe_titles(nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """Top-level ``describe`` calls of specs whose title is neither the file's stem nor a name that it imports."""
    top = nodes.where(F.col("path").rlike(r"[.]spec[.]ts$") & (F.col("key") == "expression") & (F.col("type") == "CallExpression") & (F.col("depth") == 2)).select("path", "node_id", "line")
    callee = nodes.where("type = 'Identifier' and key = 'callee' and element_at(attrs, 'name') = 'describe'").select("path", F.col("parent_id").alias("node_id"))
    title = nodes.where("key = 'arguments' and type = 'Literal' and child_ix = 1").select("path", F.col("parent_id").alias("node_id"), F.expr("substring(element_at(attrs, 'raw'), 2, length(element_at(attrs, 'raw')) - 2)").alias("title"))
    stem = F.regexp_extract("path", r"([^/]*)[.]spec[.]ts$", 1)
    used = relations.where("type = 'imports'").select("path", F.col("local").alias("title")).distinct()
    return top.join(callee, ["path", "node_id"]).join(title, ["path", "node_id"]).where(F.col("title") != stem).join(used, ["path", "title"], "left_anti").select("path", "line", "title")

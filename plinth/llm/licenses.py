"""Operator 9: license scan by ordered signature rules, with DataFrame and SQL functions only.

A text first meets one test for the few words without which no rule can match, then
each rule's own keyword, then the rule's pattern. Matches become intervals; an
interval inside another of a better rule, or inside a longer one of its tier, is
suppressed, in one pass over the sorted intervals. What is left names the text's licenses. Base phrases are found over
words and always stay. The work is a map over rows: no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.llm.common import documents
from plinth.llm.license_rules import TIERS, signatures
from plinth.llm.quality import let

#: A word, before lower-casing A-Z.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Base phrases and their labels, as the contract fixes them.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Every rule's pattern has one of these within a word, but those that begin with ``cc by``.
GATE = ("licen", "gpl", "creative", "copy", "public", "attribution", "eclipse", "mozilla", "software", "reserved", "network", "invariant", "redistribution", "version", "bsl11", "wtfpl", "scripts.sil", "cc0")


def literal(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_places(words: str) -> str:
    """SQL for the start of every place where a base phrase's words stand; no two phrases start alike."""
    tests = []
    for p, _ in PHRASES:
        parts = p.split()
        same = " AND ".join(f"get({words}, i + {k}) <=> '{w}'" for k, w in enumerate(parts))
        tests.append(f"({same})")
    return f"filter(sequence(0, size({words}) - 1), i -> {' OR '.join(tests)})"


def sql_rules() -> str:
    """The rules as one constant array."""
    rows = ", ".join(f"named_struct('label', {literal(s.label)}, 'keyword', {literal(s.keyword)}, 'pattern', {literal(s.pattern)}, 'priority', {s.priority}, 'weight', {s.weight}D)" for s in signatures())
    return f"array({rows})"


#: Matches or hits that a fold gathers before they are set aside, so that no array is copied once an item.
STRIDE = 256
HIT = "struct<s:int,ne:int,priority:int,label:string,weight:double,e:int>"


def sql_fold(count: str, start: str, step: str, gathered: str) -> str:
    """SQL for what ``step`` gathers over ``0 .. count - 1``, in two levels.

    ``step`` maps a state ``a`` and an index ``k`` to a state; ``start`` is the first, both
    without the field ``out``, an array of ``gathered`` to which ``step`` adds.
    """
    none, nests = f"cast(array() AS array<{gathered}>)", f"cast(array() AS array<array<{gathered}>>)"
    inner = f"aggregate(sequence(b * {STRIDE}, least({count}, (b + 1) * {STRIDE}) - 1), named_struct('state', o.state, 'out', {none}), (a, k) -> {step})"
    outer = let(inner, "i", "named_struct('state', i.state, 'out', concat(o.out, array(i.out)))")
    return f"CASE WHEN {count} = 0 THEN {none} ELSE aggregate(sequence(0, ({count} - 1) DIV {STRIDE}), named_struct('state', {start}, 'out', {nests}), (o, b) -> {outer}, o -> flatten(o.out)) END"


def sql_hits(text: str) -> str:
    """SQL for the intervals of all rules whose keyword the lower-cased ``text`` has.

    Starts follow from the lengths of the stretches between matches and of the matches.
    """
    at, end = "a.state + length(p[k])", "a.state + length(p[k]) + length(m[k])"
    hit = f"named_struct('s', {at}, 'ne', -({end}), 'priority', r.priority, 'label', r.label, 'weight', r.weight, 'e', {end})"
    found = sql_fold("size(m)", "0", f"named_struct('state', {end}, 'out', concat(a.out, array({hit})))", HIT)
    spans = let(f"regexp_extract_all({text}, r.pattern, 0)", "m", let(f"split({text}, r.pattern)", "p", found))
    return f"flatten(transform(filter({sql_rules()}, r -> contains({text}, r.keyword)), r -> {spans}))"


def sql_best(hits: str) -> str:
    """SQL for the hits that no hit of a better tier contains, nor a longer or better one of their own.

    Hits are sorted by start, the longer first and then the better; a hit is contained
    in one before it if that one's end is not before its own, so the greatest end of
    each tier so far decides. Hits alike in place and rule share a verdict.
    """
    tiers = range(TIERS)
    bound = "CASE h.priority DIV 1000 " + " ".join(f"WHEN {t} THEN greatest(-1, {', '.join(f'a.state.m{j}' for j in range(t + 1))})" for t in tiers) + " END"
    same = "h.s = a.state.s AND h.e = a.state.e AND h.priority = a.state.p"
    moved = ", ".join(f"'m{t}', CASE WHEN h.priority DIV 1000 = {t} THEN greatest(a.state.m{t}, h.e) ELSE a.state.m{t} END" for t in tiers)
    state = f"named_struct({moved}, 's', h.s, 'e', h.e, 'p', h.priority, 'kept', good)"
    step = let("q[k]", "h", let(f"CASE WHEN {same} THEN a.state.kept ELSE {bound} < h.e END", "good", f"named_struct('state', {state}, 'out', CASE WHEN good THEN concat(a.out, array(h)) ELSE a.out END)"))
    start = "named_struct(" + ", ".join(f"'m{t}', -1" for t in tiers) + ", 's', -1, 'e', -1, 'p', -1, 'kept', false)"
    return let(f"array_sort({hits})", "q", sql_fold("size(q)", start, step, HIT))


def scan_licenses(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` with ``n_words``, the base columns, ``labels``, ``score`` and ``hits``.

    ``score`` is the greatest weight of what was found: base phrases 0.6, rules by
    kind up to 1; 0 if nothing was. ``hits`` has label, start, end (in code points)
    of the rules' intervals. Null and empty texts have no words and no labels; texts
    are read whole; repeated rows each give a row; an empty table gives no rows;
    other columns are not read.
    """
    low = F.lower("text")
    frame = docs.select(*keep, F.coalesce(text, F.lit("")).alias("text"))
    # No rule and no base phrase matches a text without one of these.
    gate = low.contains(GATE[0])
    for word in GATE[1:]:
        gate = gate | low.contains(word)
    gate = gate | (low.contains("cc") & low.rlike(r"cc[^0-9a-z]+by"))
    marked = frame.select(*keep, F.regexp_count("text", F.lit(WORD)).cast("long").alias("n_words"), F.when(gate, F.col("text")).alias("text"))
    empty_places = "cast(array() AS array<int>)"
    words = let(f"transform(regexp_extract_all(text, {literal(WORD)}, 0), w -> lower(w))", "ws", f"CASE WHEN size(ws) = 0 THEN named_struct('places', {empty_places}, 'labels', cast(array() AS array<string>)) ELSE " + let(sql_places("ws"), "ps", "named_struct('places', ps, 'labels', array_distinct(transform(ps, i -> CASE " + " ".join(f"WHEN ws[i] = '{p.split()[0]}' THEN '{label}'" for p, label in PHRASES) + " END)))") + " END")
    found = marked.select(
        *keep, "n_words",
        F.expr(f"CASE WHEN text IS NOT NULL THEN {words} END").alias("base"),
        F.expr(f"CASE WHEN text IS NOT NULL THEN {let(let('lower(text)', 'low', sql_hits('low')), 'hs', sql_best('hs'))} END").alias("best"),
    )
    none = F.array().cast("array<string>")
    places = F.col("base.places")
    base_labels = F.array_sort(F.coalesce(F.col("base.labels"), none))
    own = F.coalesce(F.transform("best", lambda h: h["label"]), none)
    return found.select(
        *keep, "n_words",
        F.when(places.isNull(), F.lit(0)).otherwise(F.size(places)).cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"),
        F.array_max(places).cast("long").alias("last_word"),
        F.concat_ws(",", base_labels).alias("base_labels"),
        F.concat_ws(",", F.array_sort(F.array_distinct(F.concat(base_labels, own)))).alias("labels"),
        F.greatest(F.when(F.size(base_labels) > 0, F.lit(0.6)).otherwise(F.lit(0.0)), F.coalesce(F.array_max(F.transform("best", lambda h: h["weight"])), F.lit(0.0))).alias("score"),
        F.transform("best", lambda h: F.struct(h["label"].alias("label"), h["s"].alias("start"), h["e"].alias("end"))).alias("hits"),
    )


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses of every document."""
    return scan_licenses(documents(spark, sf_dir, "doc_id", "text")).drop("hits")

"""Operator 1: quality rules as a short-circuit cascade, with DataFrame and SQL functions only.

Each rule's cost and rejections are estimated on a sample: its rejections as
measured there, its cost from the sample's mean text length and word count. Rules
are then ordered greedily by rejections per cost among the documents that earlier
rules leave, and evaluated in one CASE expression, so a document pays for no rule
after the first that rejects it. The order changes the cost and which rule is
named, never the verdict. The whole is a map over rows: no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.llm.common import WORD, documents

#: Words of a window, least words of a document, and documents in the sample that orders the rules.
WINDOW, MIN_WORDS, SAMPLE = 8, 20, 256
SYMBOLS = r"[#*$%&|<>]"


def let(value: str, name: str, body: str) -> str:
    """SQL that binds ``value`` to ``name`` once for ``body``."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def sql_words(text: str) -> str:
    return f"regexp_extract_all({text}, '{WORD}', 0)".replace("\\", "\\\\")


def sql_repeat_words(words: str, window: int = WINDOW) -> str:
    """SQL for the number of words in windows that occur twice or more; ``words`` is an array.

    Windows are compared by 64-bit hashes of their words' hashes. Documents whose
    windows all differ end at ``array_distinct``; the others sort their windows, so
    the work stays within n log n for texts of any length.
    """
    reach = ", ".join(f"h[i + {k}]" for k in range(window))
    hashes = let(f"transform({words}, w -> xxhash64(w))", "h", f"transform(sequence(0, size(h) - {window}), i -> xxhash64({reach}))")
    twice = "filter(s, (x, j) -> (j > 0 AND s[greatest(j, 1) - 1].k = x.k) OR (j < size(s) - 1 AND s[least(j + 1, size(s) - 1)].k = x.k))"
    covered = (
        f"aggregate(sort_array(transform({twice}, x -> x.i)), named_struct('last', {-window}, 'n', 0L), "
        f"(a, p) -> named_struct('last', p, 'n', a.n + least({window}, p - a.last)), a -> a.n)"
    )
    counted = let("sort_array(transform(g, (k, i) -> struct(k AS k, i AS i)))", "s", covered)
    return f"CASE WHEN size({words}) < {window + 1} THEN 0L ELSE {let(hashes, 'g', f'CASE WHEN size(array_distinct(g)) = size(g) THEN 0L ELSE {counted} END')} END"


@dataclass(frozen=True)
class Rule:
    """A reason to reject, as SQL over ``text`` and ``words``; costs in nanoseconds a character and a word."""

    name: str
    rejects: str
    per_char: float
    per_word: float


def _count(pattern: str) -> str:
    return f"regexp_count(text, '{pattern}')".replace("\\", "\\\\")


#: Lines that hold a word. Spark's parser reads the escape \f as the letter f, so a form feed has its code.
LINES = "filter(split(text, '\\\\n'), l -> length(btrim(l, ' \\t\\n\\u000b\\u000c\\r')) > 0)"

#: Any of these rejects. The first two are the contract's base.
RULES = (
    Rule("few_words", f"size(words) < {MIN_WORDS}", 0, 1),
    Rule("repeated_windows", f"100 * {sql_repeat_words('words')} > 30 * size(words)", 0, 400),
    Rule("many_symbols", f"10 * {_count(SYMBOLS)} > size(words)", 12, 0),
    Rule("upper_case", f"2 * {_count('[A-Z]')} > length(text)", 14, 0),
    Rule("word_length", "length(concat_ws('', words)) NOT BETWEEN 2 * size(words) AND 25 * size(words)", 1, 10),
    Rule("few_letters", f"2 * {_count(chr(92) + 'p{L}')} < length(concat_ws('', words))", 25, 10),
    Rule("repeated_lines", let(LINES, "ls", "10 * (size(ls) - size(array_distinct(ls))) > 5 * size(ls)"), 4, 0),
)


def order_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample: int = SAMPLE, text: str = "text") -> list[Rule]:
    """Rules by rejections per cost, each among the sampled documents that those before it leave.

    Only verdicts and lengths of at most ``sample`` documents reach the driver.
    """
    prepared = docs.select(F.coalesce(text, F.lit("")).alias("text")).withColumn("words", F.expr(sql_words("text")))
    seen = prepared.select(*(F.expr(r.rejects).alias(f"r{k}") for k, r in enumerate(rules)), F.length("text").alias("chars"), F.size("words").alias("n")).take(sample)
    if not seen:
        return list(rules)
    chars, words = sum(x["chars"] for x in seen) / len(seen), sum(x["n"] for x in seen) / len(seen)
    left, out, rest = seen, [], list(enumerate(rules))
    while rest:
        best = max(rest, key=lambda kr: (sum(x[f"r{kr[0]}"] for x in left) / (1 + kr[1].per_char * chars + kr[1].per_word * words), -kr[0]))
        rest.remove(best)
        out.append(best[1])
        left = [x for x in left if not x[f"r{best[0]}"]]
    return out


def sql_cascade(rules: list[Rule]) -> str:
    """SQL for the name of the first rule that rejects, else null; over ``text`` and ``words``."""
    branches = " ".join(f"WHEN {r.rejects} THEN '{r.name}'" for r in rules)
    return f"CASE {branches} END"


def quality_verdicts(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``keep`` with the base counts, ``base_failed``, ``kept`` and ``rejected_by``.

    Null texts count as empty and, like texts of white space, have no words and are
    rejected. Texts of any length are measured whole. Repeated rows each give a row.
    An empty table gives no rows. Other columns are not read, whatever their names.
    """
    ordered = order_rules(docs, rules)
    frame = docs.select(*keep, F.coalesce("text", F.lit("")).alias("text"))
    with_words = frame.withColumn("words", F.expr(sql_words("text")))
    own = [c for c in keep if c not in ("text", "words")]
    measured = with_words.select(
        *own, "text", "words",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.concat_ws("", "words")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.expr(let(LINES, "ls", "size(ls) - size(array_distinct(ls))")).cast("long").alias("n_dup_lines"),
        F.expr(sql_repeat_words("words")).cast("long").alias("n_repeat_words"),
    )
    # What is measured anyway is not computed again in the cascade.
    known = {
        sql_repeat_words("words"): "n_repeat_words",
        _count(SYMBOLS): "n_symbols",
        "length(concat_ws('', words))": "word_chars",
    }
    cheap = []
    for r in ordered:
        sql = r.rejects
        for long, short in known.items():
            sql = sql.replace(long, short)
        cheap.append(Rule(r.name, sql, r.per_char, r.per_word))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    judged = measured.select(*own, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), F.expr(sql_cascade(cheap)).alias("rejected_by"))
    return judged.withColumn("kept", F.col("rejected_by").isNull()).select(*own, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by")


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with all their columns; the cascade stops at a row's first rejection."""
    ordered = order_rules(docs, rules)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    inner = docs.select(row.alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    # The words are bound within the condition: as a column they would be split anew for each rule that names them.
    return inner.where(let(sql_words("text"), "words", sql_cascade(ordered)) + " IS NULL").select("row.*")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict for every document."""
    return quality_verdicts(documents(spark, sf_dir, "doc_id", "text")).drop("rejected_by")


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM documents
), x AS (SELECT row_number() OVER () AS id, * FROM d),
win AS (
  SELECT id, i, array_to_string(w[i:i + 7], ' ') AS k FROM (SELECT id, w, unnest(range(1, len(w) - 6)) AS i FROM x)
), twice AS (SELECT id, i FROM win QUALIFY count(*) OVER (PARTITION BY id, k) > 1),
rep AS (SELECT id, count(DISTINCT i + j) AS n FROM twice, range(0, 8) AS t(j) GROUP BY id),
m AS (
  SELECT x.id, doc_id, text, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(rep.n, 0) AS n_repeat_words,
    len(regexp_extract_all(text, '[A-Z]')) AS n_upper, len(regexp_extract_all(text, '\p{L}')) AS n_letters,
    len(lines) AS n_lines
  FROM x LEFT JOIN rep ON x.id = rep.id
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 10 * n_symbols > n_words OR 2 * n_upper > length(text)
    OR word_chars NOT BETWEEN 2 * n_words AND 25 * n_words OR 2 * n_letters < word_chars OR 10 * n_dup_lines > 5 * n_lines) AS kept
FROM m
"""

"""Metric queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.operators import metrics as M
from plinth.plans.helpers import table
from plinth.plans.registry import query


@query(r"""
    WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]+|[0-9]+|[^A-Za-z0-9\s]')) AS tok FROM documents),
    c AS (SELECT doc_id, tok, count(*) AS n, regexp_full_match(tok, '[^A-Za-z0-9]') AS op FROM t GROUP BY ALL),
    h AS (SELECT doc_id, count(*) FILTER (op) AS n1, count(*) FILTER (NOT op) AS n2, coalesce(sum(n) FILTER (op), 0)::BIGINT AS total1, coalesce(sum(n) FILTER (NOT op), 0)::BIGINT AS total2 FROM c GROUP BY doc_id)
    SELECT *, cast(round((total1 + total2) * log2((n1 + n2)::DOUBLE), 2) AS DECIMAL(18,2)) AS volume,
      CASE WHEN n2 > 0 THEN ((100 * n1 * total2 + n2) // (2 * greatest(n2, 1)))::DECIMAL(20,2) / 100 ELSE 0 END::DECIMAL(18,2) AS difficulty FROM h
    """)
def halstead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Halstead figures of each document's tokens, marks being operators."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    tokens = docs.select("doc_id", F.expr(r"regexp_extract_all(text, '[A-Za-z]+|[0-9]+|[^A-Za-z0-9\\s]', 0)").alias("tokens"))
    return M.halstead(tokens, ["doc_id"], "tokens", lambda t: t.rlike("^[^A-Za-z0-9]$"))


@query(r"""
    WITH m AS (SELECT page_id, unnest(regexp_extract_all(html, '</?[a-zA-Z][a-zA-Z0-9]*')) AS tag, generate_subscripts(regexp_extract_all(html, '</?[a-zA-Z][a-zA-Z0-9]*'), 1) AS pos FROM pages),
    d AS (SELECT page_id, sum(CASE WHEN starts_with(tag, '</') THEN -1 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY pos) AS depth FROM m)
    SELECT page_id, max(depth)::BIGINT AS max_depth, count(*) AS n_marks FROM d GROUP BY page_id
    """)
def nesting_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greatest depth of tags in each page."""
    pages = table(spark, sf_dir, "pages", "page_id", "html")
    marks = pages.select("page_id", F.posexplode(F.expr("regexp_extract_all(html, '</?[a-zA-Z][a-zA-Z0-9]*', 0)")).alias("pos", "tag"))
    return M.nesting(marks, ["page_id"], "pos", ~F.col("tag").startswith("</"), F.col("tag").startswith("</"))


@query(r"""
    WITH d AS (SELECT doc_id, len(regexp_extract_all(text, '\n')) + 1 AS loc, len(regexp_extract_all(text, '[,;:!?]')) AS cc FROM documents)
    SELECT doc_id, loc::BIGINT AS loc, cc::BIGINT AS cc FROM d WHERE loc >= 8 AND cc > 0.5 * loc
    """)
def complexity_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of 8 lines or more with more than one branch in two lines; the bounds are ``>=`` and ``>``."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    d = docs.select("doc_id", (F.regexp_count("text", F.lit("\n")) + 1).cast("long").alias("loc"), F.regexp_count("text", F.lit("[,;:!?]")).cast("long").alias("cc"))
    return d.where("loc >= 8 and cc > 0.5 * loc")


@query(r"""
    WITH d AS (SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE len(regexp_extract_all(text, '\r\n|[\n\r\x{2028}\x{2029}]')) + (NOT regexp_matches(text, '[\n\r\x{2028}\x{2029}]\z'))::INTEGER END::BIGINT AS n_lines FROM documents)
    SELECT doc_id, n_lines FROM d WHERE n_lines > 40
    """)
def giant_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of more than 40 lines (X11)."""
    return M.oversized(table(spark, sf_dir, "documents", "doc_id", "text"), "text", 40).select("doc_id", "n_lines")


@query("""
    SELECT l_orderkey, sum(l_linenumber * l_quantity)::DOUBLE AS score, arg_min(l_shipmode_, (row(-(l_linenumber * l_quantity), l_partkey, l_suppkey))) AS primary_kind
    FROM (SELECT *, l_returnflag || l_linestatus AS l_shipmode_ FROM lineitem) GROUP BY l_orderkey HAVING sum(l_linenumber * l_quantity) >= 200
    """)
def reduction_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of orders and their best part's kind."""
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus", "l_partkey", "l_suppkey").withColumn("kind", F.concat("l_returnflag", "l_linestatus"))
    return M.reduction_score(li, "l_orderkey", F.col("l_linenumber"), F.col("l_quantity"), "kind", ["l_partkey", "l_suppkey"]).where("score >= 200")

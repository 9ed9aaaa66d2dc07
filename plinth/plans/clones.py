"""Clone queries: exact and normalised groups, tiers, tables, runs, subsumption, representatives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.operators.clones import clone_groups, representative, runs_from_first, tier_exclusion
from plinth.operators.joins import subsumed
from plinth.plans.helpers import table
from plinth.plans.registry import query

#: Lines count from this length in :func:`clone_fragment_runs`.
LINE_CHARS = 12


@query(
    """
    SELECT 'dup-' || substr(sha1(text), 1, 12) AS id, count(*) AS n_members, min(doc_id) AS first_member
    FROM documents WHERE text IS NOT NULL GROUP BY sha1(text) HAVING count(*) > 1
    """
)
def clone_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact clone groups (A1) with content ids."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text").where("text is not null").select("doc_id", F.sha1("text").alias("fp"))
    return clone_groups(docs, "fp", "doc_id").select(F.concat(F.lit("dup-"), F.substring("fp", 1, 12)).alias("id"), "n_members", "first_member")


@query(
    """
    SELECT doc_id, 'dup-' || substr(h, 1, 12) AS group_id, rn = 1 AS is_primary FROM (
      SELECT doc_id, sha1(text) AS h, row_number() OVER (PARTITION BY sha1(text) ORDER BY doc_id) AS rn, count(*) OVER (PARTITION BY sha1(text)) AS n FROM documents
    ) WHERE n > 1
    """
)
def clone_exact_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of exact groups, the first being primary (O1, O2)."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.sha1("text").alias("h"))
    groups = docs.groupBy("h").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1")
    return docs.join(groups, "h").select("doc_id", F.concat(F.lit("dup-"), F.substring("h", 1, 12)).alias("group_id"), (F.col("doc_id") == F.col("first")).alias("is_primary"))


NORMAL_SQL = "trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))"


def _normal(text: str = "text"):
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


@query(f"""
    SELECT sha1({NORMAL_SQL}) AS fp, count(*) AS n_members, min(doc_id) AS first_member
    FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1
    """)
def clone_normalized_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups by the whole normalised text."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return clone_groups(docs.select("doc_id", F.sha1(_normal()).alias("fp")), "fp", "doc_id")


@query("""
    WITH k AS (SELECT p_partkey, sha1(concat_ws('|', p_name, p_brand, p_type, p_size)) AS x, sha1(concat_ws('|', p_name, p_size)) AS n FROM part),
    exact AS (SELECT x, min(p_partkey) AS rep FROM k GROUP BY x HAVING count(*) > 1),
    loose AS (SELECT n, count(*) AS n_members, min(p_partkey) AS first_member FROM k GROUP BY n HAVING count(*) > 1)
    SELECT n AS fp, n_members, first_member FROM loose
    WHERE NOT EXISTS (SELECT 1 FROM exact JOIN k ON k.p_partkey = exact.rep WHERE k.n = loose.n)
    """)
def clone_tier_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts alike in name and size, but for groups that a part of an exact group represents."""
    part = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_type", "p_size")
    keyed = part.select("p_partkey", F.sha1(F.concat_ws("|", "p_name", "p_brand", "p_type", "p_size")).alias("x"), F.sha1(F.concat_ws("|", "p_name", "p_size")).alias("fp"))
    return tier_exclusion(keyed, "x", "fp", "p_partkey")


@query("SELECT doc_id, n_chars FROM documents WHERE n_chars >= 20")
def clone_size_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of at least the least size."""
    return table(spark, sf_dir, "documents", "doc_id", "n_chars").where("n_chars >= 20")


@query("""
    WITH p AS (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS h FROM pages)
    SELECT sha1(array_to_string(h, '|')) AS fp, count(*) AS n_members, min(page_id) AS first_member, min(len(h))::BIGINT AS n_links
    FROM p WHERE len(h) >= 2 GROUP BY 1 HAVING count(*) > 1
    """)
def clone_data_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with the same list of two links or more, in order (C11)."""
    pages = table(spark, sf_dir, "pages", "page_id", "html").select("page_id", F.expr("regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)").alias("h")).where(F.size("h") >= 2)
    keyed = pages.select("page_id", F.sha1(F.array_join("h", "|")).alias("fp"), F.size("h").cast("long").alias("n"))
    return keyed.groupBy("fp").agg(F.count("*").alias("n_members"), F.min("page_id").alias("first_member"), F.min("n").alias("n_links")).where("n_members > 1")


@query(f"""
    WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents),
    k AS (SELECT doc_id, pos, sha1(line) AS fp FROM l WHERE length(line) >= {LINE_CHARS}),
    p AS (SELECT doc_id, pos, fp, lead(fp) OVER w AS fp2 FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY pos) QUALIFY lead(pos) OVER w = pos + 1),
    f AS (SELECT fp, fp2, min(struct_pack(d := doc_id, p := pos)) AS o FROM p GROUP BY fp, fp2),
    m AS (SELECT doc_id, pos, o.d AS first_doc, o.p AS first_pos FROM p JOIN f USING (fp, fp2) WHERE doc_id <> o.d),
    g AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, first_doc, first_pos - pos ORDER BY pos) AS island FROM m)
    SELECT doc_id, first_doc, min(pos)::BIGINT AS start, min(first_pos)::BIGINT AS first_start, count(*) + 1 AS n_lines
    FROM g GROUP BY doc_id, first_doc, first_pos - pos, island
    """)
def clone_fragment_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's maximal runs of two lines or more that an earlier document has, against the first that has them."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(F.length("line") >= LINE_CHARS)
    keyed = lines.select("doc_id", (F.col("pos") + 1).cast("long").alias("pos"), F.sha1("line").alias("fp"))
    return runs_from_first(keyed, "doc_id", "pos", "fp", 2).select(F.col("seq").alias("doc_id"), F.col("first_seq").alias("first_doc"), "start", "first_start", F.col("n").alias("n_lines"))


@query("""
    WITH s AS (SELECT user_id, event_type, min(event_id) AS s, max(event_id) AS e, user_id || '-' || event_type AS grp FROM events GROUP BY user_id, event_type)
    SELECT c.grp AS span_id FROM s c WHERE EXISTS (
      SELECT 1 FROM s p WHERE p.user_id = c.user_id AND p.grp <> c.grp AND p.s <= c.s AND p.e >= c.e AND NOT (p.s = c.s AND p.e = c.e AND c.grp < p.grp))
    """)
def clone_subsumption(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of (user, type) that another span of the user contains."""
    ev = table(spark, sf_dir, "events", "user_id", "event_type", "event_id")
    spans = ev.groupBy("user_id", "event_type").agg(F.min("event_id").alias("s"), F.max("event_id").alias("e"))
    items = spans.select(F.concat_ws("-", "user_id", "event_type").alias("group"), F.col("user_id").alias("key"), F.concat_ws("-", "user_id", "event_type").alias("id"), "s", "e")
    groups = items.select("group", F.lit(0).alias("tier"), F.lit(1).cast("long").alias("n"))
    return subsumed(groups, items).select(F.col("group").alias("span_id"))


@query("""
    SELECT a.p_partkey AS part_a, b.p_partkey AS part_b,
      CASE WHEN a.p_size <> b.p_size AND a.p_name <> b.p_name THEN 'mixed' WHEN a.p_name <> b.p_name THEN 'identifier' WHEN a.p_size <> b.p_size OR a.p_retailprice <> b.p_retailprice THEN 'literal' ELSE 'rename-only' END AS diff
    FROM (SELECT *, min(p_partkey) OVER (PARTITION BY p_brand, p_type) AS rep FROM part) b JOIN part a ON a.p_partkey = b.rep WHERE b.p_partkey <> b.rep
    """)
def clone_diff_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each part differs from its group's first."""
    part = table(spark, sf_dir, "part", "p_partkey", "p_brand", "p_type", "p_name", "p_size", "p_retailprice")
    own = F.struct("p_partkey", "p_name", "p_size", "p_retailprice")
    reps = part.groupBy("p_brand", "p_type").agg(F.min(own).alias("r"))
    j = part.join(reps, ["p_brand", "p_type"]).where(F.col("p_partkey") != F.col("r.p_partkey"))
    name, size, price = F.col("r.p_name") != F.col("p_name"), F.col("r.p_size") != F.col("p_size"), F.col("r.p_retailprice") != F.col("p_retailprice")
    diff = F.when(name & size, "mixed").when(name, "identifier").when(size | price, "literal").otherwise("rename-only")
    return j.select(F.col("r.p_partkey").alias("part_a"), F.col("p_partkey").alias("part_b"), diff.alias("diff"))


@query("""
    WITH m AS (SELECT source, list(n_chars ORDER BY n_chars)[(count(*) // 2 + 1)] AS med FROM documents GROUP BY source)
    SELECT source, doc_id, n_chars, med::BIGINT AS median_size FROM documents JOIN m USING (source)
    QUALIFY row_number() OVER (PARTITION BY source ORDER BY abs(n_chars - med), doc_id) = 1
    """)
def clone_representative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document nearest each source's upper median size."""
    return representative(table(spark, sf_dir, "documents", "source", "doc_id", "n_chars"), "source", "doc_id", "n_chars")

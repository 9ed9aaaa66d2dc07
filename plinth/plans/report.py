"""Report queries: uniform findings, catalog, digests, stores and the remaining lint rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.operators import joins as J
from plinth.operators import report as R
from plinth.plans import clones, flow, metrics
from plinth.plans.helpers import table
from plinth.plans.registry import ORACLE, query

CATALOG = (("CLONE", "copied text"), ("GIANT", "too many lines"), ("DEAD", "a value that nothing reads"), ("CYCLE", "a cycle"))
FLAT_SQL = f"""
    f AS (
      SELECT 'CLONE' AS code, 'duplicates' AS category, first_member::VARCHAR AS file, n_members AS line, 'exact' AS kind FROM ({ORACLE["clone_findings"]})
      UNION ALL SELECT 'GIANT', 'giant-file', doc_id::VARCHAR, n_lines, 'giant-file' FROM ({ORACLE["giant_file"]})
      UNION ALL SELECT 'DEAD', 'waste', event_id::VARCHAR, 1, 'dead-store' FROM ({ORACLE["dead_store"]}))
"""


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda df, category, code, file, line, kind: R.finding(df, category, code, F.col(file), F.col(line), F.lit(kind), F.lit(kind))
    return R.flatten(
        part(clones.clone_findings(spark, sf_dir), "duplicates", "CLONE", "first_member", "n_members", "exact"),
        part(metrics.giant_file(spark, sf_dir), "giant-file", "GIANT", "doc_id", "n_lines", "giant-file"),
        part(flow.dead_store(spark, sf_dir).withColumn("one", F.lit(1)), "waste", "DEAD", "event_id", "one", "dead-store"),
    )


@query(f"WITH {FLAT_SQL} SELECT category || '-' || substr(sha1(category || '|' || code || '|' || file || '|' || kind || '|' || kind || '|'), 1, 12) AS id, category, code, file, line::BIGINT AS line, kind FROM f")
def flatten_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of three detectors in one table."""
    return _findings(spark, sf_dir).select("id", "category", "code", "file", "line", "kind")


@query("SELECT DISTINCT event_type || '-' || substr(sha1(event_type || '|' || user_id), 1, 12) AS id, min(event_id) AS first_event FROM events GROUP BY event_type, user_id")
def unique_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an id, the first."""
    ev = table(spark, sf_dir, "events", "event_type", "user_id", "event_id").withColumn("id", R.short_id(F.col("event_type"), F.col("event_type"), F.col("user_id")))
    return J.first_per_key(ev, ["id"], [F.col("event_id")]).select("id", F.col("event_id").alias("first_event"))


@query(f"WITH {FLAT_SQL}, c(code, cause) AS (VALUES {', '.join(str(r) for r in CATALOG)}) SELECT code, cause FROM c WHERE code IN (SELECT code FROM f)")
def catalog_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog entries of the codes that were found."""
    return R.seen_catalog(_findings(spark, sf_dir), spark.createDataFrame(list(CATALOG), "code string, cause string"))


@query("SELECT source, sha1(string_agg(sha1(doc_id || ':' || text), '|' ORDER BY sha1(doc_id || ':' || text))) AS digest FROM documents GROUP BY source")
def inputs_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of each source's documents."""
    return R.digest(table(spark, sf_dir, "documents", "source", "doc_id", "text"), ["source"], F.concat_ws(":", F.col("doc_id").cast("string"), F.col("text")))


@query("SELECT source, count(*) AS n_rows FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 0) GROUP BY source")
def cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each source that another detector also names."""
    bad = table(spark, sf_dir, "labels", "doc_id", "quality").where("quality = 0").select("doc_id")
    return table(spark, sf_dir, "documents", "doc_id", "source").join(bad, "doc_id", "left_semi").groupBy("source").agg(F.count("*").alias("n_rows"))


@query("SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 200")
def top_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 200 greatest values."""
    return table(spark, sf_dir, "events", "event_id", "value").orderBy(F.col("value").desc(), "event_id").limit(200)


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def kv_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last value written under each key."""
    ev = table(spark, sf_dir, "events", "user_id", "event_type", "event_id", "ts", "value")
    latest = ev.groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id", "value")).alias("m"))
    return latest.select("user_id", "event_type", F.col("m.event_id").alias("event_id"), F.col("m.value").alias("value"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def lint_unmodified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that nothing finished (L4)."""
    done = table(spark, sf_dir, "orders", "o_custkey", "o_orderstatus").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return J.anti_report(table(spark, sf_dir, "customer", "c_custkey"), done, ["c_custkey"])


@query("SELECT doc_id, length(regexp_replace(text, '[A-Za-z0-9]+', '', 'g'))::BIGINT AS n_rest FROM documents WHERE length(regexp_replace(text, '[A-Za-z0-9]+', '', 'g')) < 4")
def lint_tombstone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with next to nothing beside letters and digits."""
    rest = F.length(F.regexp_replace("text", "[A-Za-z0-9]+", "")).cast("long")
    return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", rest.alias("n_rest")).where("n_rest < 4")


@query("""
    SELECT doc_id, 'no-label' AS kind FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
    UNION ALL SELECT doc_id, 'no-document' FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id)
    """)
def lint_file_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What either side lacks of the other."""
    docs, labels = table(spark, sf_dir, "documents", "doc_id"), table(spark, sf_dir, "labels", "doc_id")
    return J.anti_report(docs, labels, ["doc_id"]).withColumn("kind", F.lit("no-label")).union(J.anti_report(labels, docs, ["doc_id"]).withColumn("kind", F.lit("no-document")))


@query("SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_discount > 0.09)")
def lint_unused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts without a reference of one kind."""
    used = table(spark, sf_dir, "lineitem", "l_partkey", "l_discount").where("l_discount > 0.09").select(F.col("l_partkey").alias("p_partkey"))
    return J.anti_report(table(spark, sf_dir, "part", "p_partkey"), used, ["p_partkey"])


@query("SELECT s_nationkey, count(*) AS n_exports, count(DISTINCT s_name) AS n_names FROM supplier GROUP BY s_nationkey HAVING count(*) > 1")
def lint_single_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups with more than one export."""
    return table(spark, sf_dir, "supplier", "s_nationkey", "s_name").groupBy("s_nationkey").agg(F.count("*").alias("n_exports"), F.countDistinct("s_name").alias("n_names")).where("n_exports > 1")

"""Dependency queries: absence, attribution, layers, intervals and path resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.operators import joins as J
from plinth.plans.helpers import table
from plinth.plans.registry import query


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def dead_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that no line item uses."""
    used = table(spark, sf_dir, "lineitem", "l_orderkey").withColumnRenamed("l_orderkey", "o_orderkey")
    return J.anti_report(table(spark, sf_dir, "orders", "o_orderkey", "o_custkey"), used, ["o_orderkey"])


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def unlisted_dependency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a label."""
    return J.anti_report(table(spark, sf_dir, "documents", "doc_id", "source"), table(spark, sf_dir, "labels", "doc_id"), ["doc_id"])


@query("""
    SELECT p_partkey, p_brand FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_quantity >= 40)
      AND p_brand IS NOT NULL AND p_size > 5
    """)
def unused_dependency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that no returned large item uses and that nothing holds back."""
    part = table(spark, sf_dir, "part", "p_partkey", "p_brand", "p_size")
    used = table(spark, sf_dir, "lineitem", "l_partkey", "l_returnflag", "l_quantity").where("l_returnflag = 'R' and l_quantity >= 40").select(F.col("l_partkey").alias("p_partkey"))
    held = part.where("p_size <= 5").select("p_partkey")
    return J.anti_report(part, used, ["p_partkey"], [held]).where("p_brand is not null").select("p_partkey", "p_brand")


@query("""
    SELECT p_brand, s_nationkey, count(*) AS n_uses, count(DISTINCT l_orderkey) AS n_consumers
    FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL
    """)
def member_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uses attributed to brand and nation through two equi-joins."""
    li = table(spark, sf_dir, "lineitem", "l_partkey", "l_suppkey", "l_orderkey")
    part = table(spark, sf_dir, "part", "p_partkey", "p_brand").withColumnRenamed("p_partkey", "l_partkey")
    supp = table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey").withColumnRenamed("s_suppkey", "l_suppkey")
    return li.join(part, "l_partkey").join(supp, "l_suppkey").groupBy("p_brand", "s_nationkey").agg(F.count("*").alias("n_uses"), F.countDistinct("l_orderkey").alias("n_consumers"))


@query("SELECT p_name, count(DISTINCT p_brand) AS n_modules, min(p_brand) AS first_module FROM part GROUP BY p_name HAVING count(DISTINCT p_brand) >= 2")
def duplicate_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that two modules or more export (A2)."""
    return table(spark, sf_dir, "part", "p_name", "p_brand").groupBy("p_name").agg(F.countDistinct("p_brand").alias("n_modules"), F.min("p_brand").alias("first_module")).where("n_modules >= 2")


@query("SELECT l_suppkey, count(DISTINCT l_partkey) AS n_parts, bool_or(l_discount = 0) AS uses_all FROM lineitem GROUP BY l_suppkey")
def usage_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct consumers and a flag that any holds (A4)."""
    return table(spark, sf_dir, "lineitem", "l_suppkey", "l_partkey", "l_discount").groupBy("l_suppkey").agg(F.countDistinct("l_partkey").alias("n_parts"), F.bool_or(F.col("l_discount") == 0).alias("uses_all"))


LAYERS = [("core", "^(AFRICA|ASIA)$"), ("app", "^(EUROPE|AMERICA)$"), ("edge", ".*")]


@query("""
    WITH layer(r_regionkey, r_layer) AS (SELECT r_regionkey, CASE WHEN regexp_matches(r_name, '^(AFRICA|ASIA)$') THEN 'core' WHEN regexp_matches(r_name, '^(EUROPE|AMERICA)$') THEN 'app' ELSE 'edge' END FROM region),
    n AS (SELECT n_nationkey, r_layer FROM nation JOIN layer ON r_regionkey = n_regionkey)
    SELECT nc.r_layer AS from_layer, ns.r_layer AS to_layer, count(*) AS n_edges
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey
    JOIN n nc ON nc.n_nationkey = c_nationkey JOIN n ns ON ns.n_nationkey = s_nationkey
    WHERE nc.r_layer <> ns.r_layer AND NOT (nc.r_layer = 'app' AND ns.r_layer = 'core') GROUP BY ALL
    """)
def layer_violation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between layers that no rule allows; layers are the first pattern that fits."""
    layer = table(spark, sf_dir, "region", "r_regionkey", "r_name").select(F.col("r_regionkey").alias("n_regionkey"), J.first_rule(F.col("r_name"), LAYERS).alias("layer"))
    nation = table(spark, sf_dir, "nation", "n_nationkey", "n_regionkey").join(layer, "n_regionkey")
    cust = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey").join(nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("layer").alias("from_layer")), "c_nationkey")
    supp = table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey").join(nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("layer").alias("to_layer")), "s_nationkey")
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey").join(cust, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("l_orderkey"), "from_layer")
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_suppkey")
    pairs = li.join(orders, "l_orderkey").join(supp, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("from_layer", "to_layer").agg(F.count("*").alias("n_edges"))
    return pairs.where("from_layer <> to_layer and not (from_layer = 'app' and to_layer = 'core')")


SECOND = "CAST(floor(epoch(ts)) AS BIGINT)"


@query(f"""
    WITH p AS (SELECT event_id, {SECOND} AS t FROM events),
    i AS (
      SELECT 'h' || (x // 3600) AS id, (x // 3600) * 3600 AS s, (x // 3600) * 3600 + 3600 AS e FROM (SELECT DISTINCT (t // 7200) * 7200 AS x FROM p)
      UNION SELECT 'd' || (x // 21600), (x // 21600) * 21600, (x // 21600) * 21600 + 21600 FROM (SELECT DISTINCT (t // 21600) * 21600 AS x FROM p))
    SELECT event_id, id AS scope FROM p JOIN i ON t >= s AND t < e QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY e - s, id) = 1
    """)
def enclosing_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The narrowest of overlapping windows that holds each event."""
    seconds = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")
    p = table(spark, sf_dir, "events", "event_id", "ts").select("event_id", seconds.alias("t"))
    hour = p.select((F.floor(F.col("t") / 7200) * 7200).alias("s")).distinct().select("s", (F.col("s") + 3600).alias("e"), F.concat(F.lit("h"), F.floor(F.col("s") / 3600)).alias("id"))
    day = p.select((F.floor(F.col("t") / 21600) * 21600).alias("s")).distinct().select("s", (F.col("s") + 21600).alias("e"), F.concat(F.lit("d"), F.floor(F.col("s") / 21600)).alias("id"))
    met = J.innermost_interval(p, "t", hour.union(day), "s", "e", "id", 7200)
    return J.narrowest(met, ["event_id"], "s", "e", "id").select("event_id", F.col("id").alias("scope"))


PATH_SQL = r"regexp_replace(regexp_replace(url, '^[a-z]+://[^/]+', ''), '[?#].*$', '')"


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = table(spark, sf_dir, "pages", "url")
    return url.select(F.regexp_replace(F.regexp_replace("url", "^[a-z]+://[^/]+", ""), "[?#].*$", "").alias("path")).distinct()


SPEC_SQL = f"""
    f AS (SELECT DISTINCT {PATH_SQL} AS path FROM pages),
    h AS (SELECT DISTINCT regexp_extract(path, '^(.*[^/])', 1) AS spec FROM f UNION SELECT DISTINCT '/en/' || page_id FROM pages),
    c AS (SELECT spec, 0 AS rank, spec AS path FROM h UNION ALL SELECT spec, 1, spec || '/' FROM h UNION ALL SELECT spec, 2, spec || '.html' FROM h UNION ALL SELECT spec, 3, spec || '/index.html' FROM h)
"""


def _specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    stems = _paths(spark, sf_dir).select(F.regexp_extract("path", "^(.*[^/])", 1).alias("spec"))
    return stems.union(table(spark, sf_dir, "pages", "page_id").select(F.concat(F.lit("/en/"), F.col("page_id").cast("string")))).distinct()


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [F.concat(F.col("spec"), F.lit(end)) for end in ("", "/", ".html", "/index.html")]
    return J.resolve_ranked(_specs(spark, sf_dir), "spec", _paths(spark, sf_dir), "path", rules)


@query(f"WITH {SPEC_SQL} SELECT spec, path, rank::BIGINT AS rank FROM c JOIN f USING (path) QUALIFY row_number() OVER (PARTITION BY spec ORDER BY rank) = 1")
def import_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Specifiers resolved to pages by ranked candidates."""
    return _resolved(spark, sf_dir)


@query(f"WITH {SPEC_SQL} SELECT spec FROM h WHERE NOT EXISTS (SELECT 1 FROM c JOIN f USING (path) WHERE c.spec = h.spec)")
def unresolved_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Specifiers that no candidate resolves."""
    return J.anti_report(_specs(spark, sf_dir), _resolved(spark, sf_dir), ["spec"])


ROOTS_SQL = "r AS (SELECT DISTINCT regexp_extract(path, '^(/[^/]+)', 1) AS root FROM f WHERE regexp_matches(path, '^/[^/]+/') UNION SELECT DISTINCT regexp_extract(path, '^(/[^/]+/[^/]+)/', 1) FROM f WHERE regexp_matches(path, '^/[^/]+/[^/]+/'))"


def _roots(paths: DataFrame) -> DataFrame:
    one = paths.where(F.col("path").rlike("^/[^/]+/")).select(F.regexp_extract("path", "^(/[^/]+)", 1).alias("root"))
    two = paths.where(F.col("path").rlike("^/[^/]+/[^/]+/")).select(F.regexp_extract("path", "^(/[^/]+/[^/]+)/", 1).alias("root"))
    return one.union(two).distinct()


@query(f"WITH f AS (SELECT DISTINCT {PATH_SQL} AS path FROM pages), {ROOTS_SQL} SELECT root, count(*) AS n_paths FROM r JOIN f ON f.path = r.root OR starts_with(f.path, r.root || '/') GROUP BY root")
def prefix_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages under each root (J11), by equality on ancestors instead of a prefix comparison of all pairs."""
    paths = _paths(spark, sf_dir)
    met = paths.select(F.explode(J.ancestors(F.col("path"))).alias("root")).join(_roots(paths), "root")
    return met.groupBy("root").agg(F.count("*").alias("n_paths"))


@query(f"WITH f AS (SELECT DISTINCT {PATH_SQL} AS path FROM pages), {ROOTS_SQL} SELECT path, root FROM f JOIN r ON f.path = r.root OR starts_with(f.path, r.root || '/') QUALIFY row_number() OVER (PARTITION BY path ORDER BY length(root) DESC) = 1")
def longest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest root of each page."""
    paths = _paths(spark, sf_dir)
    return J.longest_prefix(paths, "path", _roots(paths), "root")


@query("SELECT DISTINCT o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM orders x WHERE x.o_custkey = o.o_custkey AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = x.o_orderkey))")
def universal_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers all of whose orders have line items."""
    used = table(spark, sf_dir, "lineitem", "l_orderkey").distinct().select(F.col("l_orderkey").alias("o_orderkey"), F.lit(True).alias("used"))
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey").join(used, "o_orderkey", "left")
    return J.all_satisfy(orders, ["o_custkey"], F.col("used"))


@query("SELECT s_suppkey, s_nationkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity = 50)")
def identity_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers that are used in one given way."""
    used = table(spark, sf_dir, "lineitem", "l_suppkey", "l_returnflag", "l_quantity").where("l_returnflag = 'R' and l_quantity = 50").select(F.col("l_suppkey").alias("s_suppkey"))
    return table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey").join(used, "s_suppkey", "left_semi")

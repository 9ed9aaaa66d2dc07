"""Graph queries over the users' graph: an edge leads from a user to the user of the next event."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plinth.operators import graph as G
from plinth.operators.sequences import global_lead
from plinth.operators.tables import written
from plinth.plans.helpers import table
from plinth.plans.registry import query

#: In the sparse graph an edge counts if it occurs so often; the whole graph has all edges.
STRONG = 3
EDGES_SQL = """
    e AS (SELECT user_id AS u, lead(user_id) OVER (ORDER BY ts, event_id) AS v FROM events),
    w AS (SELECT u, v, count(*) AS n FROM e WHERE v IS NOT NULL AND u <> v GROUP BY u, v),
    g AS (SELECT u, v FROM w {which})
"""
WHOLE, SPARSE = EDGES_SQL.format(which=""), EDGES_SQL.format(which=f"WHERE n >= {STRONG}")
#: Only the functional graph of :func:`chain_depth` has one edge a user: the most frequent, the smaller target of equals.
NEXT = EDGES_SQL.format(which="QUALIFY row_number() OVER (PARTITION BY u ORDER BY n DESC, v) = 1")


def _weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = global_lead(table(spark, sf_dir, "events", "event_id", "ts", "user_id"), ["ts", "event_id"], "user_id", "v")
    return led.where("v is not null and v <> user_id").groupBy(F.col("user_id").alias("u"), "v").agg(F.count("*").alias("n"))


def _edges(spark: SparkSession, sf_dir: str, least: int = 1) -> DataFrame:
    """The edges that occur ``least`` times or more."""
    return written(_weighted(spark, sf_dir).where(F.col("n") >= least).select("u", "v"), "user-edges")


def _roots(spark: SparkSession, node: int) -> DataFrame:
    return spark.createDataFrame([(node,)], "node long")


@query(f"WITH {WHOLE} SELECT u AS node, count(DISTINCT v) AS degree FROM g GROUP BY u")
def fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct targets of each user (A3)."""
    return _weighted(spark, sf_dir).groupBy(F.col("u").alias("node")).agg(F.count("v").alias("degree"))


@query(f"WITH RECURSIVE {WHOLE}, r(node) AS (SELECT 0::BIGINT UNION SELECT v FROM r JOIN g ON u = node) SELECT node FROM r")
def reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users reached from user 0 (G1)."""
    return G.reachable(_edges(spark, sf_dir), _roots(spark, 0)).select("node")


SCC_SQL = """
    c(a, b) AS (SELECT u, u FROM g UNION SELECT v, v FROM g UNION SELECT a, v FROM c JOIN g ON u = b),
    s AS (SELECT x.a AS node, min(x.b) AS component FROM c x JOIN c y ON x.a = y.b AND x.b = y.a GROUP BY x.a)
"""


@query(f"WITH RECURSIVE {SPARSE}, {SCC_SQL} SELECT node, component FROM s")
def scc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strongly connected components of the sparse graph."""
    return G.strongly_connected(_edges(spark, sf_dir, STRONG))


@query(f"WITH RECURSIVE {WHOLE}, {SCC_SQL} SELECT node, component FROM s")
def scc_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the whole graph."""
    return G.strongly_connected(_edges(spark, sf_dir))


CYCLE_SQL = """
    big AS (SELECT component FROM s GROUP BY component HAVING count(*) > 1),
    step AS (SELECT a.component, g.u, min(g.v) AS v FROM g JOIN s a ON a.node = g.u JOIN s b ON b.node = g.v AND b.component = a.component WHERE a.component IN (SELECT component FROM big) AND g.u <> g.v GROUP BY ALL),
    walk(component, pt, path, closing) AS (
      SELECT component, component, [component], 0 FROM big
      UNION ALL SELECT walk.component, step.v, CASE WHEN list_contains(path, step.v) THEN path ELSE list_append(path, step.v) END, coalesce(list_position(path, step.v), 0)
      FROM walk JOIN step ON step.component = walk.component AND step.u = walk.pt WHERE closing = 0),
    cyc AS (SELECT component, path[closing:] AS nodes FROM walk WHERE closing > 0),
    pos AS (SELECT component, generate_subscripts(nodes, 1) - 1 AS ix, unnest(nodes) AS node FROM cyc)
"""


def _cycles(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    edges = _edges(spark, sf_dir, STRONG)
    return edges, G.greedy_cycles(edges, G.strongly_connected(edges))


@query(f"WITH RECURSIVE {SPARSE}, {SCC_SQL}, {CYCLE_SQL} SELECT component, ix::INTEGER AS ix, node FROM pos")
def representative_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One cycle of each component."""
    return _cycles(spark, sf_dir)[1].select("component", "ix", "node")


@query(f"""
    WITH RECURSIVE {SPARSE}, {SCC_SQL}, {CYCLE_SQL},
    deg AS (SELECT u AS node, count(DISTINCT v) AS d FROM w GROUP BY u),
    p AS (SELECT component, ix, node, lead(node) OVER (PARTITION BY component ORDER BY ix) AS nxt FROM pos)
    SELECT component, node AS cut_from, nxt AS cut_to, greatest(coalesce(d, 0), 1)::BIGINT AS score FROM p LEFT JOIN deg USING (node) WHERE nxt IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY component ORDER BY greatest(coalesce(d, 0), 1) DESC, ix) = 1
    """)
def edge_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edge to cut in each cycle."""
    return G.edge_cuts(_cycles(spark, sf_dir)[1], fan_out(spark, sf_dir))


@query(f"""
    WITH RECURSIVE {NEXT}, n(first, pt, depth) AS (SELECT u, u, 0 FROM g UNION ALL SELECT first, v, depth + 1 FROM n JOIN g ON u = pt WHERE depth < 400)
    SELECT first AS node, CASE WHEN max(depth) >= 400 THEN -1 ELSE max(depth) END::BIGINT AS depth FROM n GROUP BY first
    """)
def chain_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps from each user along most frequent next users; -1 if they never end."""
    most = F.max_by("v", F.struct("n", -F.col("v")))
    return G.chain_depths(written(_weighted(spark, sf_dir).groupBy("u").agg(most.alias("v")), "user-next"))


@query(f"""
    WITH RECURSIVE {SPARSE}, d(node) AS (SELECT DISTINCT v FROM g WHERE v % 5 = 0),
    k AS (SELECT node, 0 AS r FROM d),
    p(r, dead) AS (SELECT 0, (SELECT list(node) FROM d) UNION ALL
      SELECT r + 1, list_concat(dead, (SELECT coalesce(list(x.u), []) FROM (SELECT u FROM g GROUP BY u HAVING bool_and(list_contains(dead, v))) x WHERE NOT list_contains(dead, x.u))) FROM p WHERE r < 60)
    SELECT unnest(dead) AS node FROM p WHERE r = 60
    """)
def dead_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users all of whose targets are dead, from a seed set on."""
    edges = _edges(spark, sf_dir, STRONG)
    seeds = edges.where("v % 5 = 0").select(F.col("v").alias("node"))
    return G.propagate_dead(edges, edges.select(F.col("u").alias("node")).distinct(), seeds)


@query(f"WITH RECURSIVE {WHOLE}, r(node) AS (SELECT 0::BIGINT UNION SELECT v FROM r JOIN g ON u = node WHERE v % 7 <> 3) SELECT DISTINCT v AS node FROM g WHERE v NOT IN (SELECT node FROM r)")
def set_domination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users that user 0 reaches only through a set, or not at all."""
    edges = _edges(spark, sf_dir)
    nodes = edges.select(F.col("v").alias("node")).distinct()
    free = G.reachable(edges, _roots(spark, 0), avoid=nodes.where("node % 7 = 3")).select("node")
    return nodes.join(free, "node", "left_anti")


@query(f"WITH RECURSIVE {WHOLE}, k AS (SELECT u, v FROM g WHERE u % 7 <> 3 OR (u + v) % 2 = 0), r(node) AS (SELECT 0::BIGINT UNION SELECT v FROM r JOIN k ON u = node) SELECT node FROM r")
def edge_bypass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users still reached when a set of users is left only over exceptional edges."""
    edges = _edges(spark, sf_dir)
    return G.reachable(edges.where("u % 7 <> 3 or (u + v) % 2 = 0"), _roots(spark, 0)).select("node")


@query("""
    WITH RECURSIVE a(conv_id, turn, steps) AS (SELECT conv_id, turn, 0 FROM conversations WHERE turn = 0 UNION ALL SELECT c.conv_id, c.turn, steps + 1 FROM a JOIN conversations c ON c.conv_id = a.conv_id AND c.turn = a.turn + 1)
    SELECT conv_id, max(steps)::BIGINT AS steps, count(*) AS n_aliases FROM a GROUP BY conv_id
    """)
def alias_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that follow one another from each conversation's first (G9): one gaps-and-islands pass instead of a recursion."""
    conv = table(spark, sf_dir, "conversations", "conv_id", "turn")
    island = F.col("turn") - F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) + 1
    return conv.withColumn("island", island).where("island = 0").groupBy("conv_id").agg(F.max("turn").alias("steps"), F.count("*").alias("n_aliases"))

"""Flow queries over events in order: definitions, uses, lifetimes, runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.operators import sequences as S
from plinth.plans.helpers import table
from plinth.plans.registry import query

ORDER = ["ts", "event_id"]
DEF, USE = "event_type = 'signup'", "event_type = 'purchase'"


def _events(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return table(spark, sf_dir, "events", "user_id", "ts", "event_id", "event_type", *more)


REACH_SQL = "r AS (SELECT *, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS def FROM events)"
DEFS_SQL = f"""{REACH_SQL},
    u AS (SELECT user_id, def, count(*) AS n, min(ts) AS first_use, max(ts) AS last_use, count(DISTINCT CAST(ts AS DATE)) AS days FROM r WHERE event_type = 'purchase' AND def IS NOT NULL GROUP BY user_id, def),
    d AS (SELECT user_id, event_id, ts, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NOT NULL AS overwritten FROM events WHERE event_type = 'signup')"""


@query(f"WITH {REACH_SQL} SELECT event_id, user_id, def AS reaching FROM r")
def reaching_def(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The definition that reaches each event."""
    return S.reaching_definition(_events(spark, sf_dir), ["user_id"], ORDER, F.expr(DEF), "event_id", "reaching").select("event_id", "user_id", "reaching")


def _defs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.definition_uses(_events(spark, sf_dir), ["user_id"], ORDER, F.expr(DEF), F.expr(USE), "event_id")


@query(f"WITH {DEFS_SQL} SELECT d.event_id, d.user_id FROM d LEFT JOIN u ON u.def = d.event_id AND u.user_id = d.user_id WHERE u.n IS NULL")
def dead_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions that nothing uses."""
    return _defs(spark, sf_dir).where("n_uses = 0").select("event_id", "user_id")


@query(f"WITH {DEFS_SQL} SELECT d.event_id, d.user_id FROM d LEFT JOIN u ON u.def = d.event_id AND u.user_id = d.user_id WHERE u.n IS NULL AND overwritten")
def dead_store_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions that are overwritten before any use."""
    return _defs(spark, sf_dir).where("n_uses = 0 and overwritten").select("event_id", "user_id")


@query(f"WITH {DEFS_SQL} SELECT d.event_id, d.user_id, coalesce(u.n, 0)::BIGINT AS n_uses FROM d LEFT JOIN u ON u.def = d.event_id AND u.user_id = d.user_id")
def def_use_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uses of each definition."""
    return _defs(spark, sf_dir).select("event_id", "user_id", "n_uses")


def _lives(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _events(spark, sf_dir)
    reached = S.reaching_definition(ev, ["user_id"], ORDER, F.expr(DEF), "event_id", "def").where(F.expr(USE) & F.col("def").isNotNull())
    uses = reached.groupBy("user_id", "def").agg(F.min("ts").alias("first_use"), F.max("ts").alias("last_use"), F.countDistinct(F.to_date("ts")).alias("days"))
    defs = ev.where(DEF).select("user_id", F.col("event_id").alias("def"), F.col("ts").alias("def_ts"))
    return defs.join(uses, ["user_id", "def"])


@query(f"WITH {DEFS_SQL} SELECT d.event_id, d.user_id, datesub('second', d.ts, u.last_use)::BIGINT AS lifetime FROM d JOIN u ON u.def = d.event_id AND u.user_id = d.user_id WHERE datesub('second', d.ts, u.last_use) > 86400")
def variable_lifetime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions whose last use is over a day later."""
    seconds = F.expr("timestampdiff(SECOND, def_ts, last_use)")
    return _lives(spark, sf_dir).select(F.col("def").alias("event_id"), "user_id", seconds.alias("lifetime")).where("lifetime > 86400")


@query(f"WITH {DEFS_SQL} SELECT d.event_id, d.user_id FROM d JOIN u ON u.def = d.event_id AND u.user_id = d.user_id WHERE u.days = 1 AND CAST(d.ts AS DATE) < CAST(u.first_use AS DATE)")
def scope_narrowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions all of whose uses fall on one later day."""
    return _lives(spark, sf_dir).where("days = 1 and to_date(def_ts) < to_date(first_use)").select(F.col("def").alias("event_id"), "user_id")


@query("""
    WITH s AS (SELECT user_id, event_type, min(event_id) AS s, max(event_id) AS e FROM events GROUP BY ALL),
    p AS (SELECT a.user_id, a.s AS pt, count(*) AS live FROM s a JOIN s b ON a.user_id = b.user_id AND b.s <= a.s AND b.e >= a.s GROUP BY ALL)
    SELECT user_id, max(live)::BIGINT AS max_live, arg_min(pt, row(-live, pt)) AS first_at FROM p GROUP BY user_id
    """)
def liveness_pressure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most (user, type) spans live at once, and where first."""
    spans = table(spark, sf_dir, "events", "user_id", "event_type", "event_id").groupBy("user_id", "event_type").agg(F.min("event_id").alias("s"), F.max("event_id").alias("e"))
    return S.live_pressure(spans, ["user_id"], "s", "e")


@query("SELECT user_id, event_type, count(*) AS n_writes, min(event_id) AS first_write FROM events GROUP BY ALL HAVING count(*) > 20")
def mutation_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with more than 20 writes."""
    return table(spark, sf_dir, "events", "user_id", "event_type", "event_id").groupBy("user_id", "event_type").agg(F.count("*").alias("n_writes"), F.min("event_id").alias("first_write")).where("n_writes > 20")


@query("""
    SELECT user_id, count(*) FILTER (event_type = 'signup') AS writers, count(*) FILTER (event_type = 'purchase') AS readers FROM events GROUP BY user_id
    HAVING min(ts) FILTER (event_type = 'purchase') < min(ts) FILTER (event_type = 'signup')
    """)
def temporal_coupling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users whose first read comes before their first write."""
    ev = table(spark, sf_dir, "events", "user_id", "ts", "event_type")
    at = lambda t: F.min(F.when(F.col("event_type") == t, F.col("ts")))
    n = lambda t: F.count(F.when(F.col("event_type") == t, 1))
    return ev.groupBy("user_id").agg(n("signup").alias("writers"), n("purchase").alias("readers"), at("purchase").alias("r"), at("signup").alias("w")).where("r < w").drop("r", "w")


RUNS_SQL = "c AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS ch FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), g AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM c)"


@query(f"WITH {RUNS_SQL} SELECT user_id, run::BIGINT AS run, min(event_type) AS event_type, count(*) AS n FROM g GROUP BY user_id, run HAVING count(*) >= 2")
def operator_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of one type per user."""
    return S.run_lengths(_events(spark, sf_dir), ["user_id"], ORDER, "event_type").where("n >= 2")


@query(f"WITH {RUNS_SQL} SELECT user_id, min(event_type) AS event_type, count(*) AS n FROM g JOIN (SELECT user_id, max(run) AS last FROM g GROUP BY user_id) USING (user_id) WHERE run = last GROUP BY user_id")
def trailing_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run that ends each user's events."""
    return S.trailing_run(_events(spark, sf_dir), ["user_id"], ORDER, "event_type")


@query("SELECT user_id, event_id, prev, event_type FROM (SELECT user_id, event_id, event_type, lag(event_type) OVER w AS prev, datesub('second', lag(ts) OVER w, ts) AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE prev <> event_type AND gap < 60")
def lint_group_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of group without the gap that should part them (L1)."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy(*ORDER)
    ev = _events(spark, sf_dir).withColumn("prev", F.lag("event_type").over(w)).withColumn("prev_ts", F.lag("ts").over(w))
    return ev.where((F.col("prev") != F.col("event_type")) & (F.expr("timestampdiff(SECOND, prev_ts, ts)") < 60)).select("user_id", "event_id", "prev", "event_type")


RANK_SQL = "CASE event_type WHEN 'signup' THEN 0 WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END"


@query(f"SELECT user_id, event_id, rank::INTEGER AS rank, before::INTEGER AS before FROM (SELECT *, max(rank) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (SELECT *, {RANK_SQL} AS rank FROM events)) WHERE rank < before")
def lint_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members out of rank order (L2)."""
    return S.ordered_violations(_events(spark, sf_dir), ["user_id"], ORDER, F.expr(RANK_SQL)).select("user_id", "event_id", "rank", "before")


@query("""
    WITH p AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)
    SELECT user_id, event_id, prev, event_type FROM p WHERE prev IS NOT NULL AND
      CASE WHEN prev = 'signup' AND event_type = 'view' THEN 'never' WHEN event_type = 'purchase' THEN 'always' WHEN prev = 'error' THEN 'always' ELSE 'any' END = 'always'
    """)
def lint_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours whose first fitting rule asks for padding (L3)."""
    rules = [("signup", "view", "never"), ("*", "purchase", "always"), ("error", "*", "always"), ("*", "*", "any")]
    return S.neighbour_rules(_events(spark, sf_dir), ["user_id"], ORDER, "event_type", rules).select("user_id", "event_id", "prev", "event_type")

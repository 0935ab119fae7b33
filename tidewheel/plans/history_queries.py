"""Step history and replay: sessions are customers, steps their orders in order of date."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewheel.operators import replay
from tidewheel.plans.registry import query, table
from tidewheel.sources import history

_STEPS = """s AS (SELECT o_custkey AS session_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS step, o_orderkey AS write_seq, o_orderdate AS created_at,
['Custom:' || o_orderstatus, 'Custom:' || o_orderstatus || o_orderpriority] AS ran FROM orders)"""


def _steps(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    node = F.concat(F.lit("Custom:"), "o_orderstatus")
    return o.select(F.col("o_custkey").alias("session_id"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).cast("bigint").alias("step"), F.col("o_orderkey").alias("write_seq"), F.col("o_orderdate").alias("created_at"), F.array(node, F.concat(node, "o_orderpriority")).alias("ran"))


@query(f"""WITH {_STEPS} SELECT session_id, max(step) AS step, arg_max(write_seq, step) AS write_seq FROM s GROUP BY 1""")
def ckpt_latest(spark, sf_dir):
    return history.latest(_steps(spark, sf_dir)).select("session_id", "step", "write_seq")


@query(f"""WITH {_STEPS} SELECT session_id, max(step) AS max_step, arg_max(step, write_seq) AS written_step FROM s GROUP BY 1""")
def ckpt_latest_rules(spark, sf_dir):
    s = _steps(spark, sf_dir)
    a = history.latest(s, "max_step").select("session_id", F.col("step").alias("max_step"))
    return a.join(history.latest(s, "last_written").select("session_id", F.col("step").alias("written_step")), "session_id")


@query(f"""WITH {_STEPS}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY step DESC) AS nth, count(*) OVER (PARTITION BY session_id) AS total FROM s)
SELECT session_id, step, total, 3 AS page_size, 2 AS page_offset, total > 5 AS has_next FROM r WHERE nth BETWEEN 3 AND 5""")
def ckpt_page(spark, sf_dir):
    return history.page(_steps(spark, sf_dir), limit=3, offset=2).select("session_id", "step", "total", "page_size", "page_offset", "has_next")


@query(f"""WITH {_STEPS}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY step DESC) AS nth FROM s WHERE step BETWEEN 2 AND 6 AND list_contains(ran, 'Custom:O')) SELECT session_id, step, nth FROM r WHERE nth <= 100""")
def ckpt_range(spark, sf_dir):
    """Steps 2 to 6 that ran node O exactly; Custom:O3-MEDIUM is another node."""
    return history.page(_steps(spark, sf_dir), min_step=2, max_step=6, ran="Custom:O").select("session_id", "step", F.col("nth").cast("bigint").alias("nth"))


@query(f"""WITH {_STEPS} SELECT session_id, step, write_seq FROM s QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY step DESC) <= 5""")
def ckpt_retention(spark, sf_dir):
    return history.retain(_steps(spark, sf_dir), newest=5).select("session_id", "step", "write_seq")


@query(f"""WITH {_STEPS}, g AS (SELECT session_id, count(*) AS n_steps, max(created_at) AS updated_at FROM s GROUP BY 1) SELECT session_id, n_steps, row_number() OVER (ORDER BY updated_at DESC, session_id) AS recency FROM g""")
def ckpt_sessions(spark, sf_dir):
    return history.list_sessions(_steps(spark, sf_dir)).select("session_id", "n_steps", F.col("recency").cast("bigint").alias("recency"))


@query(f"""WITH {_STEPS} SELECT c_custkey AS session_id, c_mktsegment AS segment, max(step) AS last_step, count(s.step) AS n_steps FROM customer LEFT JOIN s ON s.session_id = c_custkey GROUP BY 1, 2""")
def ckpt_view(spark, sf_dir):
    """Every customer's header with its latest step row."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("session_id"), F.col("c_mktsegment").alias("segment"))
    s = _steps(spark, sf_dir)
    n = s.groupBy("session_id").agg(F.max("step").alias("last_step"), F.count("*").alias("n_steps"))
    return history.latest_view(c.join(n, "session_id", "left"), s).na.fill(0, ["n_steps"]).select("session_id", "segment", "last_step", "n_steps")


@query(f"""WITH {_STEPS}, l AS (SELECT session_id, max(step) AS last_step FROM s GROUP BY 1)
SELECT c_custkey AS session_id, (c_custkey % 20)::BIGINT AS expected, last_step, CASE WHEN c_custkey % 20 = last_step THEN 'accepted' WHEN last_step IS NULL THEN 'missing' ELSE 'conflict' END AS outcome FROM customer LEFT JOIN l ON session_id = c_custkey""")
def ckpt_cas(spark, sf_dir):
    now = _steps(spark, sf_dir).groupBy("session_id").agg(F.max("step").alias("last_step"))
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("session_id"), (F.col("c_custkey") % 20).alias("expected"))
    return history.compare_and_set(now, asked)


@query(f"""WITH {_STEPS}, n AS (SELECT session_id, step + 1 AS step, write_seq + 1000000 AS write_seq FROM s WHERE session_id % 3 = 0), u AS (SELECT session_id, step, write_seq FROM s UNION ALL SELECT * FROM n) SELECT session_id, step, max(write_seq) AS write_seq FROM u GROUP BY 1, 2""")
def ckpt_upsert(spark, sf_dir):
    s = _steps(spark, sf_dir).select("session_id", "step", "write_seq")
    new = s.where("session_id % 3 = 0").select("session_id", (F.col("step") + 1).alias("step"), (F.col("write_seq") + 1_000_000).alias("write_seq"))
    return history.upsert(s, new)


@query("""WITH a AS (SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS idx, event_type AS v FROM events),
b AS (SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS idx, CASE WHEN event_id % 97 = 0 THEN 'other' ELSE event_type END AS v FROM events WHERE event_id % 53 <> 0)
SELECT session_id, count(a.v) AS n_left, count(b.v) AS n_right, min(CASE WHEN a.v IS NOT NULL AND b.v IS NOT NULL AND a.v <> b.v THEN idx END)::INT AS first_diff, count(a.v) = count(b.v) AND min(CASE WHEN a.v IS NOT NULL AND b.v IS NOT NULL AND a.v <> b.v THEN idx END) IS NULL AS equal FROM a FULL JOIN b USING (session_id, idx) GROUP BY 1""")
def replay_diff(spark, sf_dir):
    """The same events, but for some lost and some renamed ones."""
    e = table(spark, sf_dir, "events")
    idx = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("idx")
    a = e.select(F.col("user_id").alias("session_id"), idx, F.col("event_type").alias("v"))
    b = e.where("event_id % 53 <> 0").select(F.col("user_id").alias("session_id"), idx, F.when(F.col("event_id") % 97 == 0, "other").otherwise(F.col("event_type")).alias("v"))
    return replay.compare_sequences(a, b, ["v"])


@query("""WITH a AS (SELECT user_id AS session_id, event_type AS key, count(*) AS v FROM events WHERE event_type <> 'view' GROUP BY 1, 2), b AS (SELECT user_id AS session_id, event_type AS key, count(*) AS v FROM events WHERE event_id % 11 <> 0 AND event_type <> 'view' GROUP BY 1, 2)
SELECT session_id, key, a.v AS "left", b.v AS "right" FROM a FULL JOIN b USING (session_id, key) WHERE a.v IS DISTINCT FROM b.v""")
def replay_state(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumnsRenamed({"user_id": "session_id", "event_type": "key"})
    count = lambda d: d.groupBy("session_id", "key").agg(F.count("*").alias("value"))
    return replay.compare_maps(count(e), count(e.where("event_id % 11 <> 0")), ["view"])

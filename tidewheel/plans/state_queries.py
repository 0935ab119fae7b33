"""Messages, maps, errors, the barrier, gating, routing and whole runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewheel.model import provider_role, role_kind
from tidewheel.operators import engine, reduce, schedule
from tidewheel.plans.registry import query, table


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("step"), F.lit(0).alias("run_ord"), F.lit(0).alias("seq"), "role", F.col("text").alias("content"))


def _extra(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("session_id"), F.col("event_type").alias("key"), F.when(F.col("value") >= 5, F.round(F.col("value") * 100).cast("bigint")).alias("value"), "ts", "event_id")


@query("""SELECT conv_id AS session_id, count(*)::BIGINT AS n_messages, 1 + count(DISTINCT turn)::BIGINT AS version, arg_max(role, turn) AS last_role,
md5(string_agg(role || ':' || text, chr(10) ORDER BY turn)) AS transcript FROM conversations GROUP BY conv_id""")
def msg_append(spark, sf_dir):
    t = reduce.transcript(_messages(spark, sf_dir))
    text = F.array_join(F.transform("messages", lambda m: F.concat(m.role, F.lit(":"), m.content)), "\n")
    return t.select("session_id", "n_messages", "version", F.element_at("messages", -1).role.alias("last_role"), F.md5(text.cast("binary")).alias("transcript"))


@query("""SELECT CASE WHEN role IN ('user', 'assistant', 'system', 'tool') THEN role ELSE 'custom' END AS role_kind, CASE WHEN role = 'assistant' THEN role ELSE 'user' END AS provider_role,
count(*)::BIGINT AS n FROM conversations GROUP BY 1, 2""")
def role_parse(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.groupBy(role_kind(F.col("role")).alias("role_kind"), provider_role(F.col("role")).alias("provider_role")).agg(F.count("*").alias("n"))


@query("""SELECT session_id, key, value FROM (SELECT user_id AS session_id, event_type AS key, CASE WHEN value >= 5 THEN round(value * 100)::BIGINT END AS value,
row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1 AND value IS NOT NULL""")
def extra_last_writer(spark, sf_dir):
    return reduce.last_writer(_extra(spark, sf_dir), ["session_id", "key"], ["ts", "event_id"])


@query("""WITH d AS (SELECT user_id AS session_id, event_type AS key, ts::DATE AS step, arg_max_null(CASE WHEN value >= 5 THEN round(value * 100)::BIGINT END, (ts, event_id)) AS value FROM events GROUP BY 1, 2, 3),
c AS (SELECT session_id, step, value IS DISTINCT FROM lag(value) OVER (PARTITION BY session_id, key ORDER BY step) AS changed FROM d)
SELECT session_id, (1 + count(DISTINCT CASE WHEN changed THEN step END))::BIGINT AS version FROM c GROUP BY session_id""")
def extra_version(spark, sf_dir):
    """One barrier a day: the version grows where the day's last write changes a key; before the first write it is absent."""
    d = _extra(spark, sf_dir).groupBy("session_id", "key", F.to_date("ts").alias("step")).agg(F.max_by(F.struct("value"), F.struct("ts", "event_id")).alias("v")).select("session_id", "key", "step", "v.value")
    before = F.lag("value").over(Window.partitionBy("session_id", "key").orderBy("step"))
    c = d.withColumn("changed", ~F.col("value").eqNullSafe(before))
    return c.groupBy("session_id").agg((1 + F.count_distinct(F.when(F.col("changed"), F.col("step")))).alias("version"))


@query("""SELECT user_id AS session_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 4, CASE WHEN event_id % 4 = 3 THEN '' ELSE 'n' || (event_id % 7) END, CASE WHEN event_id % 4 = 3 THEN 0 ELSE event_id % 5 END, ts, event_id::VARCHAR)::INT AS error_ord
FROM events WHERE event_type = 'error'""")
def error_order(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    app = F.col("event_id") % 4 == 3
    scope = F.element_at(F.array(*map(F.lit, reduce.SCOPES)), (F.col("event_id") % 4 + 1).cast("int"))
    e = e.select(F.col("user_id").alias("session_id"), "event_id", scope.alias("scope"), F.when(~app, F.concat(F.lit("n"), (F.col("event_id") % 7).cast("string"))).alias("kind"), F.when(~app, F.col("event_id") % 5).alias("scope_step"), F.col("ts").alias("when"), F.col("event_id").cast("string").alias("message"))
    return reduce.rank_errors(e).select("session_id", "event_id", "error_ord")


@query("""WITH p AS (SELECT user_id AS session_id, event_type AS key, CASE WHEN value >= 5 THEN round(value * 100)::BIGINT END AS value, ts::DATE AS day, dense_rank() OVER (PARTITION BY user_id, ts::DATE ORDER BY event_id) AS run_ord FROM events),
o AS (SELECT session_id, key, value FROM (SELECT *, row_number() OVER (PARTITION BY session_id, key ORDER BY run_ord DESC) AS k FROM p WHERE day = '2024-01-10') WHERE k = 1 AND value IS NOT NULL),
n AS (SELECT session_id, key, value, k FROM (SELECT *, row_number() OVER (PARTITION BY session_id, key ORDER BY run_ord DESC) AS k FROM p WHERE day = '2024-01-11') WHERE k = 1),
x AS (SELECT session_id, key, CASE WHEN n.k IS NOT NULL THEN n.value ELSE o.value END AS value, o.value AS old FROM o FULL JOIN n USING (session_id, key)),
s AS (SELECT DISTINCT session_id FROM p),
m AS (SELECT session_id, count(*) AS n FROM p WHERE day = '2024-01-11' GROUP BY 1),
t AS (SELECT session_id, count(value) AS n_keys, coalesce(sum(value), 0)::BIGINT AS total, bool_or(value IS DISTINCT FROM old) AS moved FROM x GROUP BY 1)
SELECT s.session_id, coalesce(m.n, 0)::BIGINT AS n_messages, coalesce(n_keys, 0)::BIGINT AS n_keys, coalesce(total, 0)::BIGINT AS total,
(1 + (m.n IS NOT NULL)::INT)::BIGINT AS mv, (1 + coalesce(moved, false)::INT)::BIGINT AS ev,
concat_ws(',', CASE WHEN m.n IS NOT NULL THEN 'messages' END, CASE WHEN moved THEN 'extra' END) AS updated FROM s LEFT JOIN m USING (session_id) LEFT JOIN t USING (session_id)""")
def barrier_step(spark, sf_dir):
    """One step: a day's events as partials over the state that the day before left."""
    e = _extra(spark, sf_dir).withColumn("day", F.to_date("ts"))
    e = e.withColumn("run_ord", F.dense_rank().over(Window.partitionBy("session_id", "day").orderBy("event_id")))
    old, new = e.where("day = date'2024-01-10'"), e.where("day = date'2024-01-11'")
    versions = e.select("session_id").distinct().withColumns({"mv": F.lit(1).cast("bigint"), "ev": F.lit(1).cast("bigint")})
    line = lambda d: d.select("session_id", F.lit(1).alias("step"), "run_ord", F.lit(0).alias("seq"), F.lit("user").alias("role"), F.col("key").alias("content"))
    stored = reduce.last_writer(old, ["session_id", "key"], ["run_ord"])
    m, x, v, updated = reduce.barrier(line(new).limit(0), stored, versions, line(new), new)
    n = m.groupBy("session_id").agg(F.count("*").alias("n_messages"))
    k = x.groupBy("session_id").agg(F.count("*").alias("n_keys"), F.sum("value").alias("total"))
    out = v.join(updated, "session_id").join(n, "session_id", "left").join(k, "session_id", "left").na.fill(0)
    return out.select("session_id", "n_messages", "n_keys", "total", "mv", "ev", F.array_join("updated", ",").alias("updated"))


@query("""SELECT event_id, floor(value)::BIGINT > coalesce(max(floor(value)::BIGINT) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS run FROM events""")
def version_gate(spark, sf_dir):
    """A node (user, type) sees versions floor(value); it runs when one exceeds all that it saw. Each event is a session of
    its own, so that one gate decides all."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("session_id"), "user_id", F.col("event_type").alias("node"), F.floor("value").alias("mv"), "ts")
    before = Window.partitionBy("user_id", "node").orderBy("ts", "session_id").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("bigint")
    seen = e.select("session_id", "node", F.max("mv").over(before).alias("mv"), none.alias("ev")).where("mv IS NOT NULL")
    gated = schedule.gate(e.select("session_id", F.lit(0).alias("pos"), "node"), e.select("session_id", "mv", none.alias("ev")), seen)
    return gated.select(F.col("session_id").alias("event_id"), "run")


@query("""WITH f AS (SELECT user_id, event_type, (row_number() OVER (PARTITION BY user_id ORDER BY event_type) - 1)::INT AS pos FROM (SELECT DISTINCT user_id, event_type FROM events)),
v AS (SELECT user_id, count(*) AS mv, count(DISTINCT event_type) AS ev FROM events GROUP BY 1),
s AS (SELECT user_id, event_type, (count(*) + 40)::BIGINT AS mv, 5 AS ev FROM events WHERE event_type <> 'signup' GROUP BY 1, 2),
g AS (SELECT f.*, s.mv IS NULL OR v.mv > s.mv OR v.ev > s.ev AS run FROM f JOIN v USING (user_id) LEFT JOIN s USING (user_id, event_type))
SELECT user_id AS session_id, pos, event_type AS node, run, CASE WHEN run THEN row_number() OVER (PARTITION BY user_id, run ORDER BY pos) END::INT AS run_ord FROM g""")
def superstep_gate(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumnRenamed("user_id", "session_id")
    pair = e.select("session_id", F.col("event_type").alias("node")).distinct()
    frontier = pair.withColumn("pos", F.row_number().over(Window.partitionBy("session_id").orderBy("node")) - 1)
    versions = e.groupBy("session_id").agg(F.count("*").alias("mv"), F.count_distinct("event_type").alias("ev"))
    seen = e.where("event_type <> 'signup'").groupBy("session_id", F.col("event_type").alias("node")).agg((F.count("*") + 40).alias("mv")).withColumn("ev", F.lit(5))
    return schedule.gate(frontier, versions, seen).select("session_id", "pos", "node", "run", "run_ord")


@query("""SELECT o_orderkey, (t.i - 1)::INT AS idx, CASE o_orderstatus WHEN 'O' THEN ['open', 'audit'] WHEN 'P' THEN ['partial'] ELSE [] END[t.i] AS target
FROM orders, LATERAL (SELECT unnest(range(1, len(CASE o_orderstatus WHEN 'O' THEN ['open', 'audit'] WHEN 'P' THEN ['partial'] ELSE [] END) + 1)) AS i) t""")
def route_conditional(spark, sf_dir):
    """Orders are sessions that ran one node with a predicate of any number of targets."""
    s = F.col("o_orderstatus")
    targets = F.when(s == "O", F.array(F.lit("open"), F.lit("audit"))).when(s == "P", F.array(F.lit("partial"))).otherwise(F.array().cast("array<string>"))
    return _routed(spark, table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session_id"), targets.alias("targets")), ["open", "audit", "partial"]).select(F.col("session_id").alias("o_orderkey"), F.col("pos").alias("idx"), F.col("node").alias("target"))


def _routed(spark: SparkSession, asked: DataFrame, names: list[str]) -> DataFrame:
    """The frontier of sessions(session_id, targets) whose one node has nothing but a predicate."""
    ran = asked.select("session_id", F.lit(1).alias("run_ord"), F.lit("ask").alias("node"))
    edges = spark.createDataFrame([], "src string, dst string, pos int")
    commands = ran.limit(0).select("session_id", "node", F.lit(0).alias("cmd_pos"), F.lit("append").alias("kind"), F.array().cast("array<string>").alias("targets"))
    routed = asked.select("session_id", F.lit("ask").alias("node"), F.lit(0).alias("idx"), "targets")
    return schedule.next_frontier(ran, edges, commands, routed, spark.createDataFrame([(n,) for n in names], "node string"))


@query("""SELECT CASE WHEN o_totalprice >= 150000 THEN 'High' ELSE 'Low' END AS target, count(*)::BIGINT AS n, sum(o_orderkey)::BIGINT AS keys FROM orders GROUP BY 1""")
def route_threshold(spark, sf_dir):
    """Orders are sessions; a predicate routes each by its price."""
    asked = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session_id"), F.array(F.when(F.col("o_totalprice") >= 150_000, "High").otherwise("Low")).alias("targets"))
    return _routed(spark, asked, ["High", "Low"]).groupBy(F.col("node").alias("target")).agg(F.count("*").alias("n"), F.sum("session_id").alias("keys"))


def _routing(spark, sf_dir):
    """Brands are sessions, parts their ran nodes; sizes name the targets."""
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("session_id"), F.col("p_partkey").cast("int").alias("run_ord"), F.col("p_partkey").cast("string").alias("node"), "p_size")
    edges = p.select(F.col("node").alias("src"), F.concat(F.lit("s"), (F.col("p_size") % 11).cast("string")).alias("dst"), F.lit(0).alias("pos"))
    many = lambda *c: F.array(*c)
    name = lambda pre, c: F.concat(F.lit(pre), c.cast("string"))
    size = F.col("p_size")
    append = p.where("p_size % 3 = 0").select("session_id", "node", F.lit(0).alias("cmd_pos"), F.lit("append").alias("kind"), many(name("a", size % 7), F.lit("End")).alias("targets"))
    replace = p.where("p_size % 5 = 0").select("session_id", "node", F.lit(1).alias("cmd_pos"), F.lit("replace").alias("kind"), many(name("r", size % 4), name("x", size)).alias("targets"))
    routed = p.where("p_size % 2 = 0").select("session_id", "node", F.lit(0).alias("idx"), many(name("p", size % 9)).alias("targets"))
    nodes = spark.createDataFrame([(f"{c}{k}",) for c in "sarp" for k in range(11)], "node string")
    return p, edges, append.unionByName(replace), routed, nodes


@query("""WITH p AS (SELECT p_brand AS session_id, p_partkey AS run_ord, p_size AS z FROM part),
c AS (SELECT session_id, run_ord, 0 AS class, 0 AS a, 0 AS b, 's' || (z % 11) AS target FROM p WHERE z % 5 <> 0
UNION ALL SELECT session_id, run_ord, 1, 0, t.b, CASE t.b WHEN 0 THEN 'a' || (z % 7) ELSE 'End' END FROM p, (VALUES (0), (1)) t(b) WHERE z % 3 = 0 AND z % 5 <> 0
UNION ALL SELECT session_id, run_ord, 1, 1, 0, 'r' || (z % 4) FROM p WHERE z % 5 = 0
UNION ALL SELECT session_id, run_ord, 2, 0, 0, 'p' || (z % 9) FROM p WHERE z % 2 = 0 AND z % 5 <> 0),
f AS (SELECT session_id, target, min((run_ord, class, a, b)) AS place FROM c GROUP BY 1, 2)
SELECT session_id, (row_number() OVER (PARTITION BY session_id ORDER BY place) - 1)::INT AS pos, target AS node FROM f""")
def frontier_next(spark, sf_dir):
    """Static edges, Append on sizes divisible by 3, Replace by 5, predicates on even ones; unknown x-targets are dropped."""
    p, edges, commands, routed, nodes = _routing(spark, sf_dir)
    return schedule.next_frontier(p, edges, commands, routed, nodes)


@query("""SELECT o_orderpriority AS target, o_orderstatus AS side_of, o_orderpriority IN ('1-URGENT', '2-HIGH') AS registered, count(*)::BIGINT AS n FROM orders GROUP BY 1, 2, 3""")
def frontier_invalid(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("node"), F.col("o_orderstatus").alias("side_of"))
    nodes = spark.createDataFrame([("1-URGENT",), ("2-HIGH",)], "node string")
    known = o.join(nodes, "node", "left_semi").withColumn("registered", F.lit(True))
    lost = schedule.unregistered(o, nodes).withColumn("registered", F.lit(False))
    return known.unionByName(lost).groupBy(F.col("node").alias("target"), "side_of", "registered").agg(F.count("*").alias("n"))


def desk() -> engine.Workflow:
    """Start -> triage; by the last message's role on to answer or escalate; both end."""

    def triage(sessions, state):
        last = state.messages.groupBy("session_id").agg(F.max_by(F.struct("role", "content"), F.struct("step", "run_ord", "seq")).alias("m"))
        s = sessions.join(last, "session_id")
        return engine.Deltas(
            messages=s.select("session_id", F.lit(0).alias("seq"), F.lit("assistant").alias("role"), F.concat(F.lit("ran:triage:step:"), F.col("step").cast("string")).alias("content")),
            extra=s.select("session_id", F.lit("asked_by").alias("key"), F.col("m.role").alias("value")),
        )

    def speak(name):
        def run(sessions, state):
            return engine.Deltas(
                messages=sessions.select("session_id", F.lit(0).alias("seq"), F.lit("assistant").alias("role"), F.concat(F.lit(f"ran:{name}:step:"), F.col("step").cast("string")).alias("content")),
                extra=sessions.select("session_id", F.lit("handled_by").alias("key"), F.lit(name).alias("value")),
            )

        return run

    def route(sessions, state):
        asked = state.extra.where("key = 'asked_by'").select("session_id", "value")
        return sessions.join(asked, "session_id").select("session_id", F.array(F.when(F.col("value") == "user", "answer").otherwise("escalate")).alias("targets"))

    return engine.Workflow({"triage": triage, "answer": speak("answer"), "escalate": speak("escalate")}, [("Start", "triage"), ("answer", "End"), ("escalate", "End")], [("triage", route)])


@query("""WITH l AS (SELECT conv_id AS session_id, count(*) AS n, arg_max(role, turn) AS role FROM conversations GROUP BY 1)
SELECT session_id::VARCHAR AS session_id, (n + 2)::BIGINT AS n_messages, role AS asked_by, CASE WHEN role = 'user' THEN 'answer' ELSE 'escalate' END AS handled_by,
2::BIGINT AS step, 3::BIGINT AS mv, 3::BIGINT AS ev, 'ran:' || CASE WHEN role = 'user' THEN 'answer' ELSE 'escalate' END || ':step:2' AS last_message FROM l""")
def workflow_final(spark, sf_dir):
    """The support desk over all conversations at once: state after its two supersteps."""
    m = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").cast("int").alias("seq"), "role", F.col("text").alias("content"))
    end = engine.run_until_complete(desk(), engine.start(desk(), m))
    last = end.messages.groupBy("session_id").agg(F.count("*").alias("n_messages"), F.max_by("content", F.struct("step", "run_ord", "seq")).alias("last_message"))
    keys = end.extra.groupBy("session_id").agg(engine.value_of(end, "asked_by").alias("asked_by"), engine.value_of(end, "handled_by").alias("handled_by"))
    return end.versions.join(last, "session_id").join(keys, "session_id").select("session_id", "n_messages", "asked_by", "handled_by", "step", "mv", "ev", "last_message")


def _walk() -> engine.Workflow:
    """Two paths of unequal length that meet again: join runs twice, once for each arrival."""

    def say(name):
        return lambda sessions, state: engine.Deltas(messages=sessions.select("session_id", F.lit(0).alias("seq"), F.lit("assistant").alias("role"), F.concat(F.lit(f"{name}@"), F.col("step").cast("string")).alias("content")))

    return engine.Workflow({n: say(n) for n in ("a", "b", "c", "join")}, [("Start", "a"), ("Start", "b"), ("a", "join"), ("b", "c"), ("c", "join"), ("join", "End")])


@query("""SELECT n_nationkey::VARCHAR AS session_id, 'a@1,b@1,c@2,join@2,join@3' AS said, 3::BIGINT AS step, 4::BIGINT AS mv FROM nation""")
def superstep_fan_in(spark, sf_dir):
    """Fan-in does not wait: join runs in the steps after either predecessor."""
    m = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("session_id"), F.lit(0).alias("seq"), F.lit("user").alias("role"), F.col("n_name").alias("content"))
    end = engine.run_until_complete(_walk(), engine.start(_walk(), m))
    said = end.messages.where("role = 'assistant'").groupBy("session_id").agg(F.array_join(F.array_sort(F.collect_list("content")), ",").alias("said"))
    return end.versions.join(said, "session_id").select("session_id", "said", "step", "mv")


@query("""WITH f AS (SELECT user_id AS session_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events)
SELECT session_id, arg_min(event_type, pos) AS node, 'before' AS place FROM f WHERE event_type IN ('error', 'signup') GROUP BY 1""")
def interrupts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    f = e.select(F.col("user_id").alias("session_id"), F.col("event_type").alias("node"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("pos"))
    return schedule.interrupted(f, ["error", "signup"]).withColumn("place", F.lit("before"))


@query("""SELECT o_custkey AS session_id, bool_and(o_orderstatus = 'F') AS done FROM orders GROUP BY 1 UNION ALL SELECT c_custkey, true FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def completion(spark, sf_dir):
    f = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("session_id"), F.when(F.col("o_orderstatus") == "F", "End").otherwise("Custom:work").alias("node"))
    return schedule.complete(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("session_id")), f)

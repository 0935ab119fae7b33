"""Runs under control: interrupts, failures, histories, iterative sessions, event streams, replay and state helpers.

Sessions are nations, so that what the driver itself handles (events of steps, handles) is as small as it is meant to be."""

from __future__ import annotations

import queue

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.functions.clock import MockClock
from tidewheel.materialize import cut, shared_dir
from tidewheel.model import Conflict, GraphError, HandleConsumed, HubClosed, InvalidEntry, empty
from tidewheel.operators import engine, reduce, replay
from tidewheel.operators.engine import Deltas, Interrupts, Workflow
from tidewheel.operators.runner import Runner
from tidewheel.operators.session import restore, step_rows
from tidewheel.plans.registry import query, table
from tidewheel.sources import history
from tidewheel.streaming import hub


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine.one_message(table(spark, sf_dir, "nation"), F.col("n_name"), "n_nationkey")


def say(name: str):
    """A node that adds one message and one key."""

    def run(sessions, state):
        text = F.concat(F.lit(f"{name}@"), F.col("step").cast("string"))
        return Deltas(
            messages=sessions.select("session_id", F.lit(0).alias("seq"), F.lit("assistant").alias("role"), text.alias("content")),
            extra=sessions.select("session_id", F.lit("last").alias("key"), F.lit(name).alias("value")),
        )

    return run


def line_of(*names: str) -> Workflow:
    """Start -> each name in turn -> End."""
    w, at = Workflow(), "Start"
    for n in names:
        w.add_node(n, say(n)).add_edge(at, n)
        at = n
    return w.add_edge(at, "End")


def failing(sessions, state):
    """Fails for sessions divisible by 5, writes an error for those divisible by 3, speaks for the rest."""
    k = F.col("session_id").cast("int")
    good = sessions.where(k % 5 != 0)
    return Deltas(
        messages=say("b")(good, state).messages,
        errors=good.where(k % 3 == 0).select("session_id", F.lit("odd input").alias("message")),
        failures=sessions.where(k % 5 == 0).select("session_id", F.lit("missing input").alias("message")),
    )


def _folder(spark: SparkSession, name: str) -> str:
    import uuid

    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _said(state) -> DataFrame:
    """session_id, said: what assistants said, in order."""
    m = state.messages.where("role = 'assistant'").groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("step", "run_ord", "seq", "content"))).alias("m"))
    return m.select("session_id", F.array_join(F.transform("m", lambda x: x.content), ",").alias("said"))


@query("""SELECT n_nationkey::VARCHAR AS session_id, 1::BIGINT AS n_messages, 'user' AS role, n_name AS content, 1::BIGINT AS mv, 1::BIGINT AS ev, 'a' AS frontier FROM nation""")
def state_one_message(spark, sf_dir):
    s = engine.start(line_of("a"), _nations(spark, sf_dir))
    m = s.messages.groupBy("session_id").agg(F.count("*").alias("n_messages"), F.max("role").alias("role"), F.max("content").alias("content"))
    return m.join(s.versions, "session_id").join(s.frontier, "session_id").select("session_id", "n_messages", "role", "content", "mv", "ev", F.col("node").alias("frontier"))


@query("""SELECT r_regionkey::VARCHAR AS session_id, 'system:be brief,user:' || r_name || ',assistant:yes,tool:done' AS said, 'ns:cash:v2={"c":' || r_regionkey || '},tone=warm' AS extra FROM region""")
def state_builder(spark, sf_dir):
    b = engine.StateBuilder(spark)
    for r in table(spark, sf_dir, "region").collect():
        k = str(r.r_regionkey)
        b.with_system(k, "be brief").with_user(k, r.r_name).with_assistant(k, "yes").with_message(k, "tool", "done")
        b.with_extra(k, "tone", "cold").with_extra(k, "tone", "warm").with_typed_extra(k, "ns", "cash", 2, f'{{"c":{k}}}')
    m, x = b.build()
    said = m.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "role", "content"))), lambda y: F.concat(y.role, F.lit(":"), y.content)), ",").alias("said"))
    keys = x.groupBy("session_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat("key", F.lit("="), "value"))), ",").alias("extra"))
    return said.join(keys, "session_id")


@query("""SELECT n_nationkey::VARCHAR AS session_id, 2::BIGINT AS n_messages, 'blue' AS hue, 1::BIGINT AS mv, 1::BIGINT AS ev FROM nation""")
def state_mutation(spark, sf_dir):
    """Messages and keys straight into the state leave the versions alone."""
    m = _nations(spark, sf_dir)
    s = engine.add_messages(engine.start(line_of("a"), m), m.withColumn("content", F.lit("more")))
    pair = lambda v: m.select("session_id", F.lit("hue").alias("key"), F.lit(v).alias("value"))
    s = engine.add_extra(engine.add_extra(s, pair("red")), pair("blue"))
    n = s.messages.groupBy("session_id").agg(F.count("*").alias("n_messages"))
    return n.join(s.extra.select("session_id", F.col("value").alias("hue")), "session_id").join(s.versions, "session_id").select("session_id", "n_messages", "hue", "mv", "ev")


@query("""SELECT n_nationkey::VARCHAR AS session_id, CASE WHEN n_nationkey % 5 = 0 THEN 'failed' ELSE 'completed' END AS status, CASE WHEN n_nationkey % 5 = 0 THEN 2 ELSE 3 END::BIGINT AS step, CASE WHEN n_nationkey % 5 = 0 THEN 'missing input' END AS error,
CASE WHEN n_nationkey % 5 = 0 THEN 'a@1' ELSE 'a@1,b@2,c@3' END AS said, (CASE WHEN n_nationkey % 5 = 0 THEN 1 WHEN n_nationkey % 3 = 0 THEN 1 ELSE 0 END)::BIGINT AS n_errors FROM nation""")
def run_outcomes(spark, sf_dir):
    """Sessions are independent: those whose node fails stop with their error, the others run to the end."""
    w = line_of("a", "b", "c").add_node("b", failing)
    begun = engine.start(w, _nations(spark, sf_dir))
    end = engine.run_until_complete(w, begun)
    return engine.outcomes(end).join(_said(end), "session_id").join(engine.errors_added(begun, end), "session_id", "left").na.fill(0, ["n_errors"])


@query("""SELECT n_nationkey::VARCHAR AS session_id, v.kind, v.node, v.step::BIGINT AS step, v.round FROM nation, (VALUES ('after_node', 'a', 1, 1), ('before_node', 'b', 1, 2), ('after_step', NULL, 2, 3), ('after_step', NULL, 3, 4)) v(kind, node, step, round)""")
def interrupt_steps(spark, sf_dir):
    """Pauses after a, before b (no work), then after each step; once all is done a step pauses nothing."""
    w = line_of("a", "b", "c")
    s = engine.start(w, _nations(spark, sf_dir))
    out = None
    for k, i in enumerate([Interrupts(after=("a", "b")), Interrupts(before=("b",), each_step=True), Interrupts(each_step=True), Interrupts(each_step=True), Interrupts(each_step=True)]):
        s, _, pauses = engine.run_step(w, s, i)
        pauses = pauses.withColumn("round", F.lit(k + 1))
        out = pauses if out is None else out.unionByName(pauses)
    return out


@query("""SELECT n_nationkey::VARCHAR AS session_id, 'a@1,b@2,c@3' AS said, 3::BIGINT AS step, 4::BIGINT AS n_saved, 3::BIGINT AS n_ran FROM nation""")
def run_resume(spark, sf_dir):
    """One step with autosave, then a new runner that resumes from the files and ignores other messages."""
    store = history.open_store(spark, "files", _folder(spark, "history"))
    m = _nations(spark, sf_dir)
    first = Runner(line_of("a", "b", "c")).with_store(store)
    first.step(first.create(m))
    again = Runner(line_of("a", "b", "c")).with_store(history.open_store(spark, custom=store))
    end = again.invoke(m.withColumn("content", F.lit("ignored")))
    kept = store.read().groupBy("session_id").agg(F.count("*").alias("n_saved"), F.sum(F.size("ran").cast("bigint")).alias("n_ran"))
    return _said(end).join(end.versions, "session_id").join(kept, "session_id").select("session_id", "said", "step", "n_saved", "n_ran")


@query("""SELECT n_nationkey::VARCHAR AS session_id, 4::BIGINT AS n_messages, 'last=b' AS extra, (n_nationkey % 3 = 0)::INT::BIGINT AS n_errors, 'End' AS frontier, 2::BIGINT AS n_seen, 4::BIGINT AS mv, 3::BIGINT AS ev FROM nation""")
def state_codec(spark, sf_dir):
    """A state as step rows with JSON documents, and back."""
    w = line_of("a", "b")
    s = engine.run_until_complete(w, engine.start(w, _nations(spark, sf_dir)))
    odd = s.versions.where("session_id % 3 = 0").select("session_id", F.current_timestamp().alias("when"), F.lit("app").alias("scope"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("bigint").alias("scope_step"), F.lit("x").alias("message"), F.array(F.lit("t")).alias("tags"), F.lit(None).cast("string").alias("context"))
    s.errors = s.errors.unionByName(odd)
    s = engine.add_messages(s, _nations(spark, sf_dir))
    b = restore(step_rows(s))
    n = b.messages.groupBy("session_id").agg(F.count("*").alias("n_messages"))
    x = b.extra.groupBy("session_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat("key", F.lit("="), "value"))), ",").alias("extra"))
    e = b.errors.groupBy("session_id").agg(F.count("*").alias("n_errors"))
    f = b.frontier.groupBy("session_id").agg(F.max("node").alias("frontier"))
    q = b.seen.groupBy("session_id").agg(F.count("*").alias("n_seen"))
    return b.versions.join(n, "session_id").join(x, "session_id").join(e, "session_id", "left").join(f, "session_id").join(q, "session_id").na.fill(0, ["n_errors"]).withColumn("mv", F.col("mv") + 1).drop("step")


def _adder() -> Workflow:
    """Adds the tick of each invocation to a sum; a tick that is the same again counts again."""

    def add(sessions, state):
        v = state.extra.groupBy("session_id").agg(engine.value_of(state, "tick").cast("bigint").alias("tick"), engine.value_of(state, "sum").cast("bigint").alias("sum"))
        s = sessions.join(v, "session_id").select("session_id", F.explode(F.array(F.struct(F.lit("sum").alias("key"), (F.coalesce("sum", F.lit(0)) + F.col("tick")).cast("string").alias("value")), F.struct(F.lit("last_step").alias("key"), F.col("step").cast("string").alias("value")))).alias("p"))
        return Deltas(extra=s.select("session_id", "p.*"))

    return Workflow().add_node("add", add).add_edge("Start", "add").add_edge("add", "End")


@query("""SELECT user_id::VARCHAR AS session_id, sum(round(value * 100)::BIGINT)::BIGINT AS total, 3::BIGINT AS step, '3' AS last_step, 'InvalidEntry' AS bad_entry, 'HandleConsumed' AS after_end FROM events GROUP BY 1""")
def iterative_runs(spark, sf_dir):
    """Three invocations of iterative sessions: a third of the events each, summed by the node through the state."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session_id"), (F.col("event_id") % 3).alias("part"), F.round(F.col("value") * 100).cast("bigint").alias("cents"))
    users = e.select("session_id").distinct()
    ticks = cut(e.groupBy("session_id", "part").agg(F.sum("cents").alias("cents")))
    it = Runner(_adder()).iterative(engine.one_message(users, F.lit("go")))
    for k in range(3):
        t = users.join(ticks.where(F.col("part") == k), "session_id", "left").select("session_id", F.lit("tick").alias("key"), F.coalesce("cents", F.lit(0)).cast("string").alias("value"))
        it.invoke_next(extra=t)
    bad = after = None
    try:
        it.invoke_next(entry="End")
    except InvalidEntry as x:
        bad = type(x).__name__
    end = it.finish()
    try:
        it.invoke_next()
    except HandleConsumed as x:
        after = type(x).__name__
    v = end.extra.groupBy("session_id").agg(engine.value_of(end, "sum").cast("bigint").alias("total"), engine.value_of(end, "last_step").alias("last_step"))
    return v.join(end.versions.select("session_id", "step"), "session_id").withColumns({"bad_entry": F.lit(bad), "after_end": F.lit(after)})


@query("""SELECT * FROM (VALUES ('node', 'ran', '25 sessions', 'a', '1'), ('node', 'ran', '25 sessions', 'b', '2'), ('diagnostic', '__stream_end__', 'status=completed sessions=25 step=2', NULL, NULL)) t(type, scope, message, node, step)""")
def run_channel(spark, sf_dir):
    """A run with a queue that gets every event; nothing is saved."""
    store = history.MemoryStore(spark)
    _, channel = Runner(line_of("a", "b")).with_store(store).invoke_with_channel(_nations(spark, sf_dir))
    sink = hub.MemorySink()
    while not channel.empty():
        sink(channel.get_nowait())
    f = sink.to_frame(spark)
    return f.select("type", "scope", "message", F.col("metadata")["node"].alias("node"), F.col("metadata")["step"].alias("step"))


@query("""SELECT 'completed' AS status, 25::BIGINT AS n, 3::BIGINT AS n_events, 'HandleConsumed' AS second_take, 'HandleConsumed' AS second_join, true AS finished, 'start,finish' AS hooks""")
def run_streaming(spark, sf_dir):
    """A run in the background with its stream of events, which can be taken once; an observer that raises stops nothing."""
    seen = []

    class Watch(engine.Observer):
        def on_invocation_start(self, **meta):
            seen.append("start")

        def on_invocation_finish(self, **meta):
            seen.append("finish")

        def on_node_finish(self, **meta):
            raise RuntimeError("broken observer")

    h = Runner(line_of("a", "b")).with_observer(Watch()).with_clock(MockClock(7)).invoke_streaming(_nations(spark, sf_dir))
    n = sum(1 for _ in h.stream())
    end = h.join()
    second = []
    for again in (h.stream, h.join):
        try:
            again()
        except HandleConsumed as x:
            second.append(type(x).__name__)
    out = engine.outcomes(end).groupBy("status").agg(F.count("*").alias("n"))
    return out.withColumns({"n_events": F.lit(n).cast("bigint"), "second_take": F.lit(second[0]), "second_join": F.lit(second[1]), "finished": F.lit(h.is_finished()), "hooks": F.lit(",".join(seen))})


@query("""SELECT true AS order_free, true AS counts_conditionals, true AS differs_by_edge, true AS config_same, true AS config_differs, 3 AS nodes, 4 AS edges, 2 AS conditionals, 'error:[0:append];extra:[0:merge_map,1:extra];message:[0:append]' AS reducers""")
def run_metadata(spark, sf_dir):
    """Fingerprints of graphs and configurations."""
    free = lambda sessions, state: sessions.select("session_id", F.array(F.lit("b")).alias("targets"))
    base = lambda: line_of("a", "b", "c").add_conditional("a", free).add_conditional("a", free).with_reducer("extra", "extra", reduce.append)
    turned = Workflow().add_node("c", say("c")).add_node("Start", say("x")).add_node("b", say("b")).add_node("a", say("a")).add_edge("c", "End").add_edge("b", "c").add_edge("a", "b").add_edge("Start", "a")
    turned.add_conditional("a", free).add_conditional("a", free).with_reducers(base().reducers)
    g = base().metadata()
    one = lambda **k: Runner(base(), **k).metadata()["config_hash"]
    rows = [(g["hash"] == turned.metadata()["hash"], g["hash"] != base().add_conditional("a", free).metadata()["hash"], g["hash"] != base().add_edge("a", "End").metadata()["hash"], one() == one(invocation="x"), one() != one(clock=MockClock()), g["nodes"], g["edges"], g["conditionals"], ";".join(g["reducers"]))]
    return spark.createDataFrame(rows, "order_free boolean, counts_conditionals boolean, differs_by_edge boolean, config_same boolean, config_differs boolean, nodes int, edges int, conditionals int, reducers string")


@query("""SELECT * FROM (VALUES ('fine', 'ok', ''), ('no entry', 'missing entry', 'Start'), ('loop', 'cycle', 'a,b,a'), ('island', 'unreachable', 'c'), ('twice', 'duplicate edge', 'Start,a'), ('past the end', 'edge from End', 'x'), ('stranger', 'unknown source', 'x'), ('stuck', 'no path to End', 'c')) t(workflow, problem, names)""")
def graph_compile(spark, sf_dir):
    """Compiling workflows: the first violation of each."""
    free = lambda sessions, state: sessions.select("session_id", F.array(F.lit("c")).alias("targets"))
    two = lambda: line_of("a", "b")
    made = {
        "fine": two().add_node("c", say("c")).add_conditional("a", free), "no entry": Workflow().add_node("a", say("a")).add_edge("a", "End"), "loop": two().add_edge("b", "a"), "island": two().add_node("c", say("c")),
        "twice": two().add_edge("Start", "a"), "past the end": Workflow(two().nodes, [*two().edges, ("End", "x")]),
        "stranger": two().add_edge("b", "x").add_edge("x", "End").add_conditional("a", free), "stuck": two().add_node("c", say("c")).add_edge("a", "c"),
    }
    rows = []
    for name, w in made.items():
        try:
            w.compile()
            rows.append((name, "ok", ""))
        except GraphError as x:
            rows.append((name, x.kind, ",".join(x.names)))
    return spark.createDataFrame(rows, "workflow string, problem string, names string")


@query("""SELECT n_nationkey::VARCHAR AS session_id, d.ord, d.difference FROM nation, (VALUES (0, 'final state differs: messages_version', 7), (1, 'event count differs: left=2 right=1', 4), (2, 'event 1 differs', 3)) d(ord, difference, m) WHERE n_nationkey % d.m = 0""")
def replay_run(spark, sf_dir):
    """Two runs that differ in a version, in the number of events and in an event; times never count."""
    s = engine.start(line_of("a"), _nations(spark, sf_dir))
    k = F.col("session_id").cast("int")
    other = engine.State(s.messages, s.extra, s.errors, s.versions.withColumn("mv", F.when(k % 7 == 0, F.col("mv") + 1).otherwise(F.col("mv"))), s.frontier, s.seen)
    e = s.versions.select("session_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("idx")).select("session_id", "idx", F.concat(F.lit("m"), F.col("idx").cast("string")).alias("message"), F.current_timestamp().alias("timestamp"))
    f = e.where(~((k % 4 == 0) & (F.col("idx") == 2))).withColumns({"timestamp": F.lit("2000-01-01").cast("timestamp"), "message": F.when((k % 3 == 0) & (F.col("idx") == 1), "other").otherwise(F.col("message"))})
    d = replay.compare_runs(replay.Run(s, e), replay.Run(other, f))
    return d.select("session_id", "ord", F.regexp_replace("difference", " left=[0-9]+ right=[0-9]+$", "").alias("difference")).where("ord <> 1").unionByName(d.where("ord = 1"))


@query("""SELECT n_nationkey::VARCHAR AS session_id, 'extra_version' AS part, '1' AS "left", '2' AS "right", CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE 0 END::BIGINT AS n_raw, 'ProfileConflict' AS conflict FROM nation WHERE n_nationkey % 5 = 0
UNION ALL SELECT n_nationkey::VARCHAR, 'none', '', '', CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE 0 END, 'ProfileConflict' FROM nation WHERE n_nationkey % 5 <> 0""")
def replay_profile(spark, sf_dir):
    """Maps that differ in ignored keys only are alike, but for their versions; a custom normaliser looks at lengths."""
    m = _nations(spark, sf_dir)
    k = F.col("session_id").cast("int")
    pair = lambda v: m.select("session_id", F.lit("clock").alias("key"), v.alias("value"))
    a, b = (engine.start(line_of("a"), m, pair(v)) for v in (F.lit("1"), F.when(k % 2 == 0, "2").otherwise("1")))
    b.versions = b.versions.withColumn("ev", F.when(k % 5 == 0, F.col("ev") + 1).otherwise(F.col("ev")))
    p = replay.Profile().ignore_keys("clock", "clock").ignore_slot("ns", "x", 1, "step").ignore_slot("ns", "x", 1, "step")
    conflict = None
    try:
        p.ignore_slot("ns", "x", 1, "session")
    except replay.ProfileConflict as x:
        conflict = type(x).__name__
    d = replay.compare_states(a, b, p)
    raw = replay.compare_states(a, b).where("part = 'extra'").groupBy("session_id").agg(F.count("*").alias("n_raw"))
    same = replay.compare_events(m.select("session_id", F.lit(1).alias("idx"), "content"), m.select("session_id", F.lit(1).alias("idx"), F.reverse("content").alias("content")), lambda e: e.select("session_id", "idx", F.length("content").alias("value")))
    replay.assert_equal(same)
    out = m.select("session_id").join(d, "session_id", "left").join(raw, "session_id", "left").na.fill(0, ["n_raw"]).na.fill({"part": "none", "left": "", "right": ""})
    return out.withColumn("conflict", F.lit(conflict))


@query("""SELECT n_nationkey::VARCHAR AS session_id, 3::BIGINT AS n_messages, CASE WHEN n_nationkey % 2 = 0 THEN 'v2' ELSE 'v1' END AS a, n_nationkey % 4 <> 0 AS has_b, 1::BIGINT AS n_errors, 'KeyError' AS missing FROM nation""")
def reducers_all(spark, sf_dir):
    """All channels through a registry with a second reducer for messages; an unknown channel takes an empty delta only."""
    m = _nations(spark, sf_dir).select("session_id", F.lit(0).cast("bigint").alias("step"), F.lit(0).alias("run_ord"), "seq", "role", "content")
    k = F.col("session_id").cast("int")
    x = m.select("session_id", F.explode(F.create_map(F.lit("a"), F.lit("v1"), F.lit("b"), F.lit("w"))).alias("key", "value"))
    dx = m.where(k % 2 == 0).select("session_id", F.lit("a").alias("key"), F.lit("v2").alias("value"), F.lit(0).alias("run_ord")).unionByName(m.where(k % 4 == 0).select("session_id", F.lit("b").alias("key"), F.lit(None).cast("string").alias("value"), F.lit(0).alias("run_ord")))
    e = m.select("session_id", F.lit("boom").alias("message"))
    r = reduce.Reducers().register("message", "again", reduce.append)
    out = r.apply_all({"message": m, "extra": x, "error": e.limit(0)}, {"message": m, "extra": dx, "error": e})
    missing = None
    r.apply("other", m, m.limit(0))
    try:
        r.apply("other", m, m)
    except KeyError as y:
        missing = type(y).__name__
    n = lambda d, c: d.groupBy("session_id").agg(F.count("*").alias(c))
    v = out["extra"].groupBy("session_id").agg(F.max(F.when(F.col("key") == "a", F.col("value"))).alias("a"), (F.count_if(F.col("key") == "b") > 0).alias("has_b"))
    return n(out["message"], "n_messages").join(v, "session_id").join(n(out["error"], "n_errors"), "session_id").withColumn("missing", F.lit(missing))


@query("""SELECT o_custkey::VARCHAR AS session_id, max(step) AS step, arg_max(o_orderkey, step) AS at_step, 'Conflict' AS stale, CASE WHEN count(*) > 1 THEN 3 ELSE 2 END::BIGINT AS last_save, max(step) AS memory_step FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS step FROM orders) GROUP BY 1""")
def store_files(spark, sf_dir):
    """Later steps are saved before earlier ones, then expected ones again; of two writers with one expectation one loses."""
    from tidewheel.plans.history_queries import _steps

    s = _steps(spark, sf_dir).select(F.col("session_id").cast("string").alias("session_id"), "step", F.lit(None).cast("bigint").alias("write_seq"), F.current_timestamp().alias("created_at"), F.col("write_seq").cast("string").alias("state_json"), *(F.array().cast("array<string>").alias(c) for c in ("frontier", "ran", "skipped", "updated")))
    s = cut(s)
    last = s.groupBy("session_id").agg(F.max("step").alias("step"))
    top, rest = s.join(last, ["session_id", "step"]), s.join(last, ["session_id", "step"], "left_anti")
    store = history.Store(spark, _folder(spark, "store"))
    store.save(top.limit(0))
    store.save(top, expected=last.select("session_id", F.lit(None).cast("bigint").alias("expected")))
    store.save(rest, expected=last.select("session_id", F.col("step").alias("expected")))
    stale = None
    try:
        store.save(rest, expected=last.select("session_id", (F.col("step") - 1).alias("expected")))
    except Conflict as x:
        stale = type(x).__name__
    memory = history.open_store(spark, "memory")
    memory.save(rest)
    memory.save(top)
    got = store.load_latest().select("session_id", "step", F.col("state_json").cast("bigint").alias("at_step"))
    saves = store.read().groupBy("session_id").agg(F.max("write_seq").alias("last_save"))
    return got.join(saves, "session_id").join(memory.load_latest().select("session_id", F.col("step").alias("memory_step")), "session_id").withColumn("stale", F.lit(stale))


@query("""SELECT * FROM (VALUES ('memory', 'MemoryStore'), ('files', 'Store'), ('override', 'Store at override'), ('custom', 'Own'), ('unreachable', 'none'), ('unknown', 'StoreError')) t(asked, got)""")
def store_selection(spark, sf_dir):
    """Which back end a configuration gives; one that cannot be reached gives none, with a warning."""

    class Own:
        def save(self, rows, expected=None): ...

        def load_latest(self):
            return empty(spark, "session_id string")

        def list_sessions(self):
            return empty(spark, "session_id string")

    a, b = _folder(spark, "a"), _folder(spark, "override")
    name = lambda s: "none" if s is None else type(s).__name__
    over = history.open_store(spark, "files", a, settings={"TIDEWHEEL_STORE": b})
    rows = [("memory", name(history.open_store(spark))), ("files", name(history.open_store(spark, "files", a))), ("override", name(over) + (" at override" if "/override-" in over.path else "")), ("custom", name(history.open_store(spark, custom=Own()))), ("unreachable", name(history.open_store(spark, "files", None)))]
    try:
        history.open_store(spark, "tape")
    except Exception as x:
        rows.append(("unknown", type(x).__name__))
    return spark.createDataFrame(rows, "asked string, got string")


@query("""SELECT n_nationkey AS k, n_name AS message, 18::BIGINT AS missed, 7 AS capacity, 18 AS dropped FROM nation WHERE n_nationkey >= 18""")
def hub_lagging(spark, sf_dir):
    """A reader that comes to it late keeps the last events of a small hub, and is told how many it missed."""
    h = hub.Hub(7)
    s = h.subscribe()
    for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").collect():
        h.publish(hub.event("node", "x", r.n_name, k=r.n_nationkey))
    missed, got = None, []
    try:
        s.try_recv()
    except hub.Lagged as x:
        missed = x.missed
    while (e := s.try_recv()) is not None:
        got.append((int(e["metadata"]["k"]), e["message"], missed, h.metrics()["capacity"], h.metrics()["dropped"]))
    return spark.createDataFrame(got, "k int, message string, missed bigint, capacity int, dropped int")


@query("""SELECT * FROM (VALUES ('publish without reader', 'no subscriber'), ('only later events', 'two'), ('timeout', 'none'), ('drains after close', 'two,three'), ('closed', 'closed'), ('subscribe to closed', 'none'), ('shutdown first', 'none'), ('capacity 0', '1024'), ('no sinks', 'stdout'), ('same sink twice', 'memory'), ('taken twice', 'HandleConsumed')) t(what, got)""")
def hub_contract(spark, sf_dir):
    """The hub's rules, one a row."""
    import threading

    rows, h = [], hub.Hub()
    try:
        h.publish(hub.event("node", "x", "one"))
    except HubClosed as x:
        rows.append(("publish without reader", str(x)))
    early = h.subscribe()
    h.publish(hub.event("node", "x", "one"))
    late = h.subscribe()
    h.publish(hub.event("node", "x", "two"))
    rows.append(("only later events", late.try_recv()["message"]))
    rows.append(("timeout", str(late.next_timeout(0.01)).lower()))
    early.try_recv()
    h.publish(hub.event("node", "x", "three"))
    stopped = threading.Event()
    stopped.set()
    quiet = h.subscribe().with_shutdown(stopped)
    h.close()
    rows.append(("drains after close", ",".join(e["message"] for e in early)))
    try:
        h.publish(hub.event("node", "x", "four"))
    except HubClosed as x:
        rows.append(("closed", str(x)))
    rows.append(("subscribe to closed", str(h.subscribe().recv()).lower()))
    rows.append(("shutdown first", str(quiet.recv()).lower()))
    c = hub.BusConfig(0)
    rows.append(("capacity 0", str(c.resolved().capacity)))
    rows.append(("no sinks", ",".join(c.resolved().sinks)))
    rows.append(("same sink twice", ",".join(c.add_sink("memory").add_sink("memory").sinks)))
    once = hub.SingleTake(h.subscribe())
    once.take()
    try:
        once.take()
    except HandleConsumed as x:
        rows.append(("taken twice", type(x).__name__))
    return spark.createDataFrame(rows, "what string, got string")


@query("""SELECT * FROM (VALUES ('memory', 50::BIGINT, 0::BIGINT, NULL), ('channel', 50, 0, NULL), ('broken', 0, 50, 'no'), ('late', 25, 0, NULL), ('diagnostics', 50, 0, NULL)) t(sink, n_events, n_errors, last_error)""")
def hub_bus(spark, sf_dir):
    """A bus with a sink that raises, a sink that comes late and a restart; nothing is handled twice."""
    names = [r.n_name for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()]
    memory, channel, late = hub.MemorySink(), queue.Queue(), hub.MemorySink()

    def broken(e):
        raise RuntimeError("no")

    bus = hub.Bus(hub.BusConfig(64))
    bus.add("memory", memory).add("memory", broken).add("channel", channel.put_nowait).add("broken", broken)
    told = bus.diagnostics.subscribe()
    bus.start().start()
    for n in names:
        hub.Emitter(bus.hub, "a", 1, "s", "inv", 5).node("x", n)
    bus.restart().add("late", late)
    for n in names:
        hub.Emitter(bus.hub, "a", 1).llm(n, final=True)
    bus.stop()
    n = 0
    while told.try_recv() is not None:
        n += 1
    size = {"memory": len(memory.snapshot()), "channel": channel.qsize(), "broken": 0, "late": len(late.snapshot()), "diagnostics": n}
    rows = [(k, v, bus.health[k].errors if k in bus.health else 0, bus.health[k].last_error if k in bus.health else None) for k, v in size.items()]
    return spark.createDataFrame(rows, "sink string, n_events bigint, n_errors bigint, last_error string")


@query("""SELECT n_nationkey::VARCHAR AS session_id, n_name || '!' AS content FROM nation""")
def node_rows(spark, sf_dir):
    """A node of plain Python, at most two tasks at once."""

    def shout(batches):
        for b in batches:
            yield b.assign(content=b.content + "!")

    work = engine.row_node(shout, "session_id string, content string", 2)

    def node(sessions, state):
        asked = sessions.join(state.messages.where("role = 'user'").select("session_id", "content"), "session_id").select("session_id", "content")
        return Deltas(messages=work(asked).select("session_id", F.lit(0).alias("seq"), F.lit("assistant").alias("role"), "content"))

    w = Workflow().add_node("shout", node).add_edge("Start", "shout").add_edge("shout", "End")
    s, _ = engine.superstep(w, engine.start(w, _nations(spark, sf_dir)))
    return s.messages.where("role = 'assistant'").select("session_id", "content")

"""Edges of the engine: failures, commands, iterative sessions, validation, history, replay, JSON."""

import pytest
from pyspark.sql import functions as F

from tidewheel.functions import hashing, jsonx
from tidewheel.model import Conflict, GraphError, InvalidEntry, decode_node, encode_node
from tidewheel.operators import engine, graph, reduce, replay
from tidewheel.plans.state_queries import _walk
from tidewheel.sources.history import Store


def _seed(spark, ids):
    return spark.createDataFrame([(i, 0, "user", "hi") for i in ids], "session_id string, seq int, role string, content string")


def _say(name, **more):
    def run(sessions, state):
        m = sessions.select("session_id", F.lit(0).alias("seq"), F.lit("assistant").alias("role"), F.lit(name).alias("content"))
        return engine.Deltas(messages=m, **{k: f(sessions) for k, f in more.items()})

    return run


def test_failure_keeps_the_session_as_it_was(spark):
    fails = lambda s: s.where("session_id = 'bad'").select("session_id", F.lit("boom").alias("message"))
    w = engine.Workflow({"a": _say("a", failures=fails), "b": _say("b")}, [("Start", "a"), ("Start", "b"), ("a", "End"), ("b", "End")])
    state, report = engine.superstep(w, engine.start(w, _seed(spark, ["bad", "good"])))
    n = {r.session_id: r["count"] for r in state.messages.groupBy("session_id").count().collect()}
    assert n == {"bad": 1, "good": 3}
    v = {r.session_id: (r.step, r.mv) for r in state.versions.collect()}
    assert v == {"bad": (1, 1), "good": (1, 2)}
    assert [r.message for r in state.errors.collect()] == ["boom"]
    assert {r.node for r in state.frontier.where("session_id = 'bad'").collect()} == {"a", "b"}


def test_sessions_fail_alone(spark):
    """The failing session stops where it was; the others run to the end, and a step hook that raises stops nobody."""
    fails = lambda s: s.where("session_id = 'bad'").select("session_id", F.lit("boom").alias("message"))
    w = engine.Workflow({"a": _say("a", failures=fails), "b": _say("b")}, [("Start", "a"), ("a", "b"), ("b", "End")])

    def hook(*_):
        raise RuntimeError("broken hook")

    end = engine.run_until_complete(w, engine.start(w, _seed(spark, ["bad", "good"])), on_step=hook)
    assert {tuple(r) for r in engine.outcomes(end).collect()} == {("bad", 1, "failed", "boom"), ("good", 2, "completed", None)}


def test_a_workflow_is_validated_before_it_starts(spark):
    w = engine.Workflow().add_node("a", _say("a")).add_node("End", _say("x")).add_edge("Start", "a")
    with pytest.raises(GraphError):
        engine.start(w, _seed(spark, ["s"]))
    assert "End" not in w.nodes and engine.start(w.add_edge("a", "End"), _seed(spark, ["s"])).frontier.first().node == "a"


def test_logs_are_compacted(spark, monkeypatch):
    monkeypatch.setattr(engine, "COMPACT", 2)
    w = engine.Workflow({n: _say(n) for n in "abc"}, [("Start", "a"), ("a", "b"), ("b", "c"), ("c", "End")])
    end = engine.run_until_complete(w, engine.start(w, _seed(spark, ["s"])))
    assert sorted(r.content for r in end.messages.collect()) == ["a", "b", "c", "hi"]


def test_concurrency_is_one_at_least(spark):
    assert engine.concurrency(spark, 0) == 1 and engine.concurrency(spark, 3) == 3 and engine.concurrency(spark) == spark.sparkContext.defaultParallelism


def test_large_graphs_validate_without_the_driver(spark, monkeypatch):
    """Past LOCAL_EDGES the same violations come from DataFrames."""
    monkeypatch.setattr(graph, "LOCAL_EDGES", 0)
    nodes, none = spark.createDataFrame([("a",), ("b",)], "node string"), spark.createDataFrame([], "src string, idx int")
    for edges, kind in (([("Start", "a"), ("a", "b"), ("b", "a"), ("b", "End")], "cycle"), ([("Start", "a"), ("a", "End")], "unreachable"), ([("Start", "a"), ("a", "b"), ("b", "End"), ("b", "End")], "duplicate edge")):
        with pytest.raises(GraphError) as e:
            graph.validate(nodes, spark.createDataFrame(edges, "src string, dst string"), none)
        assert e.value.kind == kind


def test_replace_suppresses_and_append_extends(spark):
    command = lambda kind, to: lambda s: s.select("session_id", F.lit(0).alias("cmd_pos"), F.lit(kind).alias("kind"), F.array(*map(F.lit, to)).alias("targets"))
    for kind, to, want in (("replace", ["c"], ["c"]), ("append", ["c", "nowhere"], ["b", "c"]), ("replace", [], [])):
        nowhere = lambda sessions, state: sessions.select("session_id", F.array().cast("array<string>").alias("targets"))
        w = engine.Workflow({"a": _say("a", commands=command(kind, to)), "b": _say("b"), "c": _say("c")}, [("Start", "a"), ("a", "b")], [("a", nowhere)])
        state, _ = engine.superstep(w, engine.start(w, _seed(spark, ["s"])))
        assert [r.node for r in state.frontier.orderBy("pos").collect()] == want


def test_iterative_sessions_go_on(spark):
    w = _walk()
    state = engine.run_until_complete(w, engine.start(w, _seed(spark, ["s"])))
    again = engine.invoke_next(w, state, _seed(spark, ["s"]), None, "c")
    assert again.versions.first().step == state.versions.first().step + 2
    with pytest.raises(InvalidEntry):
        engine.invoke_next(w, state, None, None, "End")


@pytest.mark.parametrize(
    "edges, kind",
    [
        ([("a", "End")], "missing entry"), ([("Start", "a"), ("a", "b"), ("b", "a"), ("b", "End")], "cycle"), ([("Start", "a"), ("a", "End"), ("b", "End")], "unreachable"),
        ([("Start", "a"), ("Start", "b"), ("a", "End")], "no path to End"), ([("Start", "a"), ("Start", "b"), ("a", "End"), ("a", "End"), ("b", "End")], "duplicate edge"),
    ],
)
def test_validation(spark, edges, kind):
    nodes = spark.createDataFrame([("a",), ("b",)], "node string")
    none = spark.createDataFrame([], "src string, idx int")
    with pytest.raises(GraphError) as e:
        graph.validate(nodes, spark.createDataFrame(edges, "src string, dst string"), none)
    assert e.value.kind == kind


def test_map_merge_deletes_and_sets(spark):
    old = spark.createDataFrame([("s", "a", "1"), ("s", "b", "2")], "session_id string, key string, value string")
    new = spark.createDataFrame([("s", "a", None, 1), ("s", "b", None, 1), ("s", "b", "3", 2)], "session_id string, key string, value string, run_ord int")
    assert [tuple(r) for r in reduce.merge_map(old, new).collect()] == [("s", "b", "3")]


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "h"))
    row = lambda step: spark.createDataFrame([("x", step, None, None, "{}", ["a"], ["a"], [], [])], "session_id string, step bigint, write_seq bigint, created_at timestamp, state_json string, frontier array<string>, ran array<string>, skipped array<string>, updated array<string>")
    s.save(row(5))
    s.save(row(2))
    assert s.load_latest().first().step == 5 and s.load_latest("last_written").first().step == 2
    want = spark.createDataFrame([("x", 4)], "session_id string, expected bigint")
    with pytest.raises(Conflict):
        s.save(row(6), want)
    other = Store(spark, str(tmp_path / "h"))  # two writers with one expectation: one gets the next number
    five = spark.createDataFrame([("x", 5)], "session_id string, expected bigint")
    other.save(row(6), five)
    with pytest.raises(Conflict):
        s.save(row(6), five)
    assert [n for n, _ in s.entries()] == [1, 2, 3]


def test_hash_json_codec(spark):
    def fnv(parts):
        h = 14695981039346656037
        for p in parts:
            for b in p.encode() + b"\xff":
                h = (h ^ b) * 1099511628211 % 2**64
        return f"{h:016x}"

    parts = ["edge:ä→b", "", "x"]
    df = spark.createDataFrame([(parts,)], "p array<string>")
    assert df.select(hashing.fnv_parts(F.col("p"))).first()[0] == fnv(parts)
    assert jsonx.merge_values('{"a":[1],"b":{"c":1}}', '{"a":[1],"b":{"d":2}}', "deep") == '{"a":[1,1],"b":{"c":1,"d":2}}'
    with pytest.raises(jsonx.MergeConflict):
        jsonx.merge_values('{"a":[1]}', '{"a":[1]}', "fail")
    assert jsonx.set_value("{}", "a.b", "1") == '{"a":{"b":1}}'
    names = spark.createDataFrame([("Start",), ("x",), ("Custom:y",)], "n string")
    assert [r[0] for r in names.select(decode_node(encode_node(F.col("n")))).collect()] == ["Start", "x", "Custom:y"]


def test_replay_and_dot(spark):
    a = spark.createDataFrame([("s", 1, "x"), ("s", 2, "y")], "session_id string, idx int, v string")
    b = spark.createDataFrame([("s", 1, "x"), ("s", 2, "z"), ("s", 3, "w")], "session_id string, idx int, v string")
    assert tuple(replay.compare_sequences(a, b, ["v"]).first()) == ("s", 2, 3, 2, False)
    with pytest.raises(replay.ReplayMismatch):
        replay.assert_equal(replay.compare_sequences(a, b, ["v"]))
    replay.assert_equal(replay.compare_sequences(a, a, ["v"]))
    replay.assert_equal(replay.compare_maps(a.selectExpr("session_id", "v AS key", "idx AS value"), a.selectExpr("session_id", "v AS key", "idx AS value")))
    edges = spark.createDataFrame([("Start", "a"), ("a", "End")], "src string, dst string")
    assert "0 -> 1" in graph.to_dot(spark.createDataFrame([("a",)], "node string"), edges)

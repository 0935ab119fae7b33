"""A run that stops resumes from its history."""

from pyspark.sql import functions as F

from tidewheel.operators import engine, session
from tidewheel.plans.state_queries import _walk
from tidewheel.sources.history import Store


def test_autosave_and_resume(spark, tmp_path):
    w = _walk()
    seed = lambda *ids: spark.createDataFrame([(i, 0, "user", "hi") for i in ids], "session_id string, seq int, role string, content string")
    store = Store(spark, str(tmp_path / "h"))
    state = session.create_or_resume(w, store, seed("a"))
    state, report = engine.superstep(w, state)
    session.autosave(store)(1, state, report)
    state = session.create_or_resume(w, store, seed("a", "b"))
    assert {r.session_id: r.step for r in state.versions.collect()} == {"a": 1, "b": 0}
    assert not hasattr(store, "failed")
    end = engine.run_until_complete(w, state)
    assert {r.session_id: (r.step, r.mv) for r in end.versions.collect()} == {"a": (3, 4), "b": (3, 4)}
    assert end.messages.where("role = 'assistant'").groupBy("session_id").agg(F.count("*").alias("n")).select("n").distinct().collect()[0].n == 5
    last = store.read().where("session_id = 'a' and step = 1").first()
    assert sorted(last.ran) == ["Custom:a", "Custom:b"] and last.skipped == []

"""Sessions that outlive a run: states as step rows, autosave, create-or-resume and restore."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.materialize import cut
from tidewheel.model import decode_node, encode_node
from tidewheel.operators import engine
from tidewheel.sources.history import Checkpointer

#: A whole state as one JSON document; fields missing in older documents read as null and count as empty.
DOCUMENT = (
    "messages array<struct<step:bigint,run_ord:int,seq:int,role:string,content:string>>, extra array<struct<key:string,value:string>>, "
    "errors array<struct<when:timestamp,scope:string,kind:string,scope_step:bigint,message:string,tags:array<string>,context:string>>, "
    "seen array<struct<node:string,mv:bigint,ev:bigint>>, mv bigint, ev bigint"
)


def _gathered(df: DataFrame, name: str, fields: list[str], order: list[str] | None = None) -> DataFrame:
    rows = F.collect_list(F.struct(*fields))
    return df.groupBy("session_id").agg((F.array_sort(rows) if order is None else rows).alias(name))


def step_rows(state: engine.State, report: DataFrame | None = None) -> DataFrame:
    """One row a session in the layout of the step history; ran, skipped and updated come from the step's report."""
    out = state.versions
    for name, df, fields in (
        ("messages", state.messages, ["step", "run_ord", "seq", "role", "content"]), ("extra", state.extra, ["key", "value"]),
        ("errors", state.errors, ["when", "scope", "kind", "scope_step", "message", "tags", "context"]), ("seen", state.seen, ["node", "mv", "ev"]),
    ):
        out = out.join(_gathered(df, name, fields), "session_id", "left")
    out = out.select("session_id", "step", F.to_json(F.struct("messages", "extra", "errors", "seen", "mv", "ev")).alias("state_json"))
    front = state.frontier.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "node"))), lambda x: encode_node(x.node)).alias("frontier"))
    out = out.join(front, "session_id", "left")
    none = F.array().cast("array<string>")
    if report is not None:
        listed = lambda ran: F.filter(F.transform(F.array_sort(F.collect_list(F.struct("pos", "node", "ran"))), lambda x: F.when(x.ran == ran, encode_node(x.node))), lambda x: x.isNotNull())
        out = out.join(report.groupBy("session_id").agg(listed(True).alias("ran"), listed(False).alias("skipped")), "session_id", "left")
    else:
        out = out.withColumns({"ran": none, "skipped": none})
    return out.select("session_id", "step", F.lit(None).cast("bigint").alias("write_seq"), F.current_timestamp().alias("created_at"), "state_json", *(F.coalesce(c, none).alias(c) for c in ("frontier", "ran", "skipped")), none.alias("updated"))


def restore(rows: DataFrame) -> engine.State:
    """The state that step rows (one a session) hold."""
    d = cut(rows.select("session_id", "step", "frontier", F.from_json("state_json", DOCUMENT).alias("d")))
    each = lambda name: d.select("session_id", F.inline(f"d.{name}"))
    frontier = d.select("session_id", F.posexplode("frontier").alias("pos", "node")).withColumn("node", decode_node(F.col("node")))
    versions = d.select("session_id", "step", F.coalesce("d.mv", F.lit(1)).alias("mv"), F.coalesce("d.ev", F.lit(1)).alias("ev"))
    errors = each("errors").withColumn("when", F.coalesce("when", F.current_timestamp()))  # a time that doesn't decode
    return engine.State(each("messages"), each("extra"), errors, versions, frontier, each("seen"))


def create_or_resume(workflow: engine.Workflow, store: Checkpointer, messages: DataFrame, observer: engine.Observer | None = None) -> engine.State:
    """Sessions with history resume from it, whatever messages say; the others begin and are saved as step 0."""
    known = store.load_latest()
    engine.told(observer, "on_checkpoint_load", sessions=known.select("session_id"))
    fresh = engine.start(workflow, messages.join(known.select("session_id"), "session_id", "left_anti"))
    if not fresh.versions.isEmpty():
        store.save(step_rows(fresh))
    return restore(store.load_latest())


def autosave(store: Checkpointer, observer: engine.Observer | None = None) -> Callable[[int, engine.State, DataFrame], None]:
    """For run_until_complete(on_step=...): the sessions that this step moved; a failing save doesn't stop the run."""

    def save(_: int, state: engine.State, report: DataFrame) -> None:
        rows, began = step_rows(state, report), time.monotonic()
        try:
            store.save(rows.join(report.where("ran").select("session_id").distinct(), "session_id", "left_semi"))
            engine.told(observer, "on_checkpoint_save", seconds=time.monotonic() - began)
        except Exception as e:  # kept for the caller to look at
            store.failed = e

    return save

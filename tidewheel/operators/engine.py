"""Bulk-synchronous runs of many sessions at once: one plan a superstep advances all of them.

Messages and errors are logs: a superstep writes what it adds, and the state is the union of these tables, joined into one
after COMPACT of them. Only maps, versions, memory and frontiers are written whole."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.functions.hashing import fnv_text
from tidewheel.materialize import cut, cut_all
from tidewheel.model import COMMANDS, END, ERRORS, EXTRA, MESSAGES, SEEN, START, GraphError, InvalidEntry, NoStartNodes, UnexpectedPause, empty
from tidewheel.operators import graph, schedule
from tidewheel.operators.reduce import Reducers, append, barrier, rank_errors

log = logging.getLogger("tidewheel")
#: Tables of additions after which a log is written as one.
COMPACT = 16
DELTA = "session_id string, key string, value string, run_ord int"
FAILED = "session_id string, step bigint, node string, message string"
PAUSES = "session_id string, kind string, node string, step bigint"


@dataclass
class Deltas:
    """What a node writes: messages(session_id, seq, role, content), extra(session_id, key, value; null deletes),
    errors(session_id, message), commands(session_id, cmd_pos, kind, targets), failures(session_id, message)."""

    messages: DataFrame | None = None
    extra: DataFrame | None = None
    errors: DataFrame | None = None
    commands: DataFrame | None = None
    failures: DataFrame | None = None


@dataclass
class State:
    messages: DataFrame
    extra: DataFrame
    errors: DataFrame
    versions: DataFrame  # session_id, step, mv, ev
    frontier: DataFrame
    seen: DataFrame
    failed: DataFrame | None = None  # session_id, step, node, message: sessions that stopped
    parts: dict[str, int] = field(default_factory=dict)  # tables that a log consists of

    def halted(self) -> DataFrame:
        return self.failed.select("session_id").distinct() if self.failed is not None else empty(self.versions.sparkSession, "session_id string")


#: A node maps (sessions it runs for: session_id, step; the state before the step) to its deltas.
Node = Callable[[DataFrame, State], Deltas]
#: A predicate maps the state after the barrier to (session_id, targets array<string>).
Predicate = Callable[[DataFrame, State], DataFrame]


@dataclass
class Workflow:
    nodes: dict[str, Node] = field(default_factory=dict)
    edges: list[tuple[str, str]] = field(default_factory=list)
    predicates: list[tuple[str, Predicate]] = field(default_factory=list)
    reducers: Reducers = field(default_factory=Reducers)
    compiled: bool = False

    def add_node(self, name: str, node: Node) -> "Workflow":
        """The last node of a name counts; Start and End cannot be given one and are ignored with a warning."""
        if name in (START, END):
            log.warning("%s is virtual, its node is ignored", name)
        else:
            self.nodes[name], self.compiled = node, False
        return self

    def add_edge(self, src: str, dst: str) -> "Workflow":
        self.edges.append((src, dst))
        self.compiled = False
        return self

    def add_conditional(self, src: str, predicate: Predicate) -> "Workflow":
        self.predicates.append((src, predicate))
        self.compiled = False
        return self

    def with_reducer(self, channel: str, label: str, f: Callable[[DataFrame, DataFrame], DataFrame]) -> "Workflow":
        self.reducers.register(channel, label, f)
        return self

    def with_reducers(self, reducers: Reducers) -> "Workflow":
        self.reducers = reducers
        return self

    def tables(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        pos: dict[str, int] = {}
        rows = []
        for src, dst in self.edges:
            rows.append((src, dst, pos.setdefault(src, 0)))
            pos[src] += 1
        return spark.createDataFrame([(n,) for n in self.nodes], "node string"), spark.createDataFrame(rows, "src string, dst string, pos int")

    def compile(self) -> "Workflow":
        """Validates once and freezes: the same workflow, or GraphError with the first violation. The definition is held by
        the driver, so no job runs."""
        if not self.compiled:
            if found := graph.first_violation(list(self.nodes), self.edges, [s for s, _ in self.predicates]):
                raise GraphError(*found)
            self.compiled = True
        return self

    def metadata(self) -> dict:
        """Fingerprint of the definition: node, edge, conditional and reducer lines, whatever order they were added in."""
        stored = lambda n: n if n in (START, END) else f"Custom:{n}"
        lines = [f"node:{x}" for x in sorted(map(stored, self.nodes))]
        lines += sorted(f"edge:{stored(a)}->{stored(b)}" for a, b in self.edges)
        lines += [f"conditional:{k}:{s}" for k, s in enumerate(sorted(stored(s) for s, _ in self.predicates))]
        signature = self.reducers.signature()
        lines += [f"reducer:{x}" for x in signature]
        return {"hash": fnv_text(["graph-v1", *lines]), "nodes": len(self.nodes), "edges": len(self.edges), "conditionals": len(self.predicates), "reducers": signature, "lines": lines}


class StateBuilder:
    """Messages and extra of new sessions, in the order of the calls; a later extra of a key counts."""

    def __init__(self, spark: SparkSession):
        self.spark, self.rows, self.pairs = spark, [], {}

    def with_message(self, session: str, role: str, content: str) -> "StateBuilder":
        self.rows.append((session, len(self.rows), role, content))
        return self

    def with_user(self, session: str, content: str) -> "StateBuilder":
        return self.with_message(session, "user", content)

    def with_assistant(self, session: str, content: str) -> "StateBuilder":
        return self.with_message(session, "assistant", content)

    def with_system(self, session: str, content: str) -> "StateBuilder":
        return self.with_message(session, "system", content)

    def with_extra(self, session: str, key: str, value: str) -> "StateBuilder":
        self.pairs[session, key] = value
        return self

    def with_typed_extra(self, session: str, namespace: str, name: str, version: int, value: str) -> "StateBuilder":
        return self.with_extra(session, f"{namespace}:{name}:v{version}", value)

    def build(self) -> tuple[DataFrame, DataFrame]:
        m = self.spark.createDataFrame(self.rows, "session_id string, seq int, role string, content string")
        return m, self.spark.createDataFrame([(*k, v) for k, v in self.pairs.items()], "session_id string, key string, value string")


def one_message(sessions: DataFrame, content: Column, key: str = "session_id") -> DataFrame:
    """Messages of new sessions with one user message each."""
    return sessions.select(F.col(key).cast("string").alias("session_id"), F.lit(0).alias("seq"), F.lit("user").alias("role"), content.alias("content"))


def add_messages(state: State, messages: DataFrame) -> State:
    """Messages(session_id, seq, role, content) straight into the state, without a new version."""
    at = state.versions.select("session_id", "step")
    return replace(state, messages=append(state.messages, messages.join(at, "session_id").select("session_id", "step", F.lit(1 << 30).alias("run_ord"), "seq", "role", "content")))


def add_extra(state: State, extra: DataFrame) -> State:
    """Pairs (session_id, key, value) straight into the map, without a new version; a null value is stored nowhere."""
    new = extra.select("session_id", "key", "value")
    return replace(state, extra=state.extra.join(new.select("session_id", "key"), ["session_id", "key"], "left_anti").unionByName(new.where("value IS NOT NULL")))


def start(workflow: Workflow, messages: DataFrame, extra: DataFrame | None = None) -> State:
    """The state of new sessions: versions 1, frontier at Start's static successors."""
    spark = messages.sparkSession
    first = [dst for src, dst in workflow.compile().edges if src == START]
    if not first:
        raise NoStartNodes(START)
    m = messages.select("session_id", F.lit(0).cast("bigint").alias("step"), F.lit(0).alias("run_ord"), "seq", "role", "content")
    x = extra.select("session_id", "key", "value") if extra is not None else empty(spark, EXTRA).select("session_id", "key", "value")
    sessions = m.select("session_id").union(x.select("session_id")).distinct()
    f = sessions.select("session_id", F.posexplode(F.array(*map(F.lit, first))).alias("pos", "node"))
    v = sessions.select("session_id", F.lit(0).cast("bigint").alias("step"), F.lit(1).cast("bigint").alias("mv"), F.lit(1).cast("bigint").alias("ev"))
    return State(m, x, empty(spark, ERRORS), v, f, empty(spark, SEEN))


def _grown(state: State, name: str, new: DataFrame | None) -> DataFrame:
    """A log with what a step adds."""
    old = getattr(state, name)
    if new is None:
        return old
    state.parts[name] = state.parts.get(name, 0) + 1
    both = append(old, new)
    if state.parts[name] < COMPACT:
        return both
    state.parts[name] = 0
    return cut(both)


def _open(state: State) -> DataFrame:
    """Sessions that can go on: neither done nor stopped."""
    return schedule.complete(state.versions, state.frontier).where("not done").select("session_id").join(state.halted(), "session_id", "left_anti")


def superstep(workflow: Workflow, state: State, only: DataFrame | None = None) -> tuple[State, DataFrame]:
    """The next state, and the report (session_id, step, pos, node, ran, failed) of this step.

    Of sessions that are done or not in only(session_id) the report has a row for each frontier node, which did not run. A
    session with a failing node keeps its state, frontier and memory, gains one error and stops; the others go on."""
    spark = state.versions.sparkSession
    nodes, edges = workflow.tables(spark)
    goes = _open(state) if only is None else _open(state).join(only.select("session_id"), "session_id", "left_semi")
    f = state.frontier.join(goes.withColumn("goes", F.lit(True)), "session_id", "left").na.fill(False, ["goes"])
    gated = cut(schedule.gate(f, state.versions, state.seen))
    gated = gated.withColumn("run", F.col("run") & F.col("goes"))
    goes, ran = gated.where("goes").select("session_id").distinct(), gated.where("run")
    found: dict[str, list[DataFrame]] = {k: [] for k in ("messages", "extra", "errors", "commands")}
    lost = schedule.unregistered(ran, nodes).select("session_id", "node", F.lit("scheduler").alias("scope"), F.concat(F.lit("unregistered node "), "node").alias("message"))
    for name, node in workflow.nodes.items():
        mine = ran.where(F.col("node") == name).select("session_id", (F.col("step") + 1).alias("step"), "run_ord", "node")
        got = node(mine.select("session_id", "step"), state)
        tag = lambda df, mine=mine: df.join(mine, "session_id")
        if got.messages is not None:
            found["messages"].append(tag(got.messages).select("session_id", "step", "run_ord", F.col("seq").cast("int").alias("seq"), "role", "content"))
        if got.extra is not None:
            found["extra"].append(tag(got.extra).select("session_id", "key", "value", "run_ord"))
        if got.errors is not None:
            found["errors"].append(tag(got.errors).select("session_id", F.current_timestamp().alias("when"), F.lit("node").alias("scope"), F.col("node").alias("kind"), F.col("step").alias("scope_step"), "message", F.array().cast("array<string>").alias("tags"), F.lit(None).cast("string").alias("context")))
        if got.commands is not None:
            found["commands"].append(tag(got.commands).select("session_id", "run_ord", "node", F.col("cmd_pos").cast("int").alias("cmd_pos"), "kind", "targets"))
        if got.failures is not None:
            lost = lost.unionByName(tag(got.failures).select("session_id", "node", F.lit("node").alias("scope"), "message"))
    united = {}
    for k, frames in found.items():
        for d in frames:
            united[k] = united[k].unionByName(d) if k in united else d
    first = lost.groupBy("session_id").agg(F.min_by(F.struct("node", "scope", "message"), F.struct("node", "message")).alias("f")).select("session_id", "f.*")
    failed, *made = cut_all(first, *(united.get(k) for k in found))
    made = dict(zip(found, made, strict=True))
    some = not failed.isEmpty()
    good = (lambda df: df.join(failed.select("session_id"), "session_id", "left_anti")) if some else (lambda df: df)
    none = lambda k, schema: good(made[k]) if made[k] is not None else empty(spark, schema)
    ok = good(ran)
    new_m = good(made["messages"]) if made["messages"] is not None else None
    new_x = none("extra", DELTA)
    m, x, v, _ = barrier(state.messages, state.extra, state.versions.select("session_id", "mv", "ev"), new_m if new_m is not None else empty(spark, MESSAGES), new_x, workflow.reducers)
    stepped = v.join(state.versions.select("session_id", "step"), "session_id").join(goes.withColumn("o", F.lit(1)), "session_id", "left").select("session_id", (F.col("step") + F.coalesce("o", F.lit(0))).alias("step"), "mv", "ev")
    errors = rank_errors(good(made["errors"])).drop("error_ord") if made["errors"] is not None else None
    stopped = state.failed
    if some:
        at = failed.join(state.versions, "session_id")
        failure = at.select("session_id", F.current_timestamp().alias("when"), "scope", F.col("node").alias("kind"), (F.col("step") + 1).alias("scope_step"), "message", F.array(F.col("scope")).alias("tags"), F.lit(None).cast("string").alias("context"))
        errors = failure if errors is None else errors.unionByName(failure)
        row = at.select("session_id", (F.col("step") + 1).alias("step"), "node", "message")
        stopped = cut(row if stopped is None else stopped.unionByName(row))
    logs = workflow.reducers.only_appends("message")
    x, stepped, seen, errors, m = cut_all(x if made["extra"] is not None else None, stepped, schedule.remember(state.seen, ok), errors, None if logs else m)
    if made["extra"] is None:
        x = state.extra
    parts = replace(state, parts=dict(state.parts))
    m = _grown(parts, "messages", new_m) if logs else m
    e = workflow.reducers.apply("error", state.errors, errors) if errors is not None and not workflow.reducers.only_appends("error") else _grown(parts, "errors", errors)
    after = State(m, x, e, stepped, state.frontier, seen, stopped, parts.parts)
    routed = empty(spark, "session_id string, node string, idx int, targets array<string>")
    for idx, (src, predicate) in enumerate(workflow.predicates):
        at = ok.where(F.col("node") == src).select("session_id")
        routed = routed.unionByName(predicate(at, after).select("session_id", F.lit(src).alias("node"), F.lit(idx).alias("idx"), "targets"))
    moved = schedule.next_frontier(ok, edges, none("commands", COMMANDS), routed, nodes)
    kept = state.frontier.join(good(goes), "session_id", "left_anti")
    report = gated.select("session_id", (F.col("step") + F.col("goes").cast("int")).alias("step"), "pos", "node", F.col("run").alias("ran"))
    report = report.join(failed.select("session_id", F.lit(True).alias("failed")), "session_id", "left").na.fill(False, ["failed"]) if some else report.withColumn("failed", F.lit(False))
    return replace(after, frontier=cut(moved.unionByName(kept.select("session_id", "pos", "node")))), report


@dataclass(frozen=True)
class Interrupts:
    """Nodes before or after which a session pauses, or every step."""

    before: tuple[str, ...] = ()
    after: tuple[str, ...] = ()
    each_step: bool = False

    def any(self) -> bool:
        return bool(self.before or self.after or self.each_step)


def run_step(workflow: Workflow, state: State, interrupts: Interrupts = Interrupts()) -> tuple[State, DataFrame, DataFrame]:
    """One superstep of every session that may go on: the state, the report, and pauses(session_id, kind, node, step).

    A session with a frontier node to pause before does no work; the first such node in frontier order is named. After the
    step the first node that ran and is to pause after, else each step, pauses it. Pausing keeps nothing but the state:
    calling again without that interrupt goes on."""
    spark = state.versions.sparkSession
    pauses, only = empty(spark, PAUSES), None
    if interrupts.before:
        at = _open(state).join(schedule.interrupted(state.frontier, list(interrupts.before)), "session_id")
        before = cut(at.join(state.versions, "session_id").select("session_id", F.lit("before_node").alias("kind"), "node", "step"))
        pauses, only = before, state.versions.select("session_id").join(before, "session_id", "left_anti")
    state, report = superstep(workflow, state, only)
    did = report.where("ran and not failed")
    if interrupts.after:
        hit = did.where(F.col("node").isin(list(interrupts.after))).groupBy("session_id", "step").agg(F.min_by("node", "pos").alias("node"))
        pauses = pauses.unionByName(hit.select("session_id", F.lit("after_node").alias("kind"), "node", "step"))
    if interrupts.each_step:
        went = report.where("not failed").join(state.versions.select("session_id", F.col("step").alias("now")), "session_id").where("step = now").select("session_id", "step").distinct()
        moved = went.join(did.select("session_id").distinct(), "session_id", "left_semi").join(pauses, "session_id", "left_anti")
        pauses = pauses.unionByName(moved.select("session_id", F.lit("after_step").alias("kind"), F.lit(None).cast("string").alias("node"), "step"))
    return state, report, pauses


class Observer:
    """Hooks of a run. Each may be overridden; one that raises is logged and the run goes on."""

    def on_invocation_start(self, **meta) -> None: ...

    def on_invocation_finish(self, **meta) -> None: ...

    def on_node_finish(self, **meta) -> None: ...

    def on_checkpoint_load(self, **meta) -> None: ...

    def on_checkpoint_save(self, **meta) -> None: ...

    def on_event_bus_emit(self, **meta) -> None: ...


def told(observer, hook: str, **meta) -> None:
    """Calls a hook of an observer, or the hook itself, and logs what it raises."""
    if observer is None:
        return
    try:
        getattr(observer, hook)(**meta)
    except Exception as e:  # an observer must not stop the run
        log.warning("observer %s: %s", hook, e)


def run_until_complete(workflow: Workflow, state: State, most: int = 1000, on_step: Callable[[int, State, DataFrame], None] | None = None, interrupt_before: list[str] = (), observer: Observer | None = None, stop: Callable[[], bool] = lambda: False) -> State:
    """Supersteps until every session is done or stopped; the loop is as long as the longest session.

    Sessions are independent: one with a failing node stops with its error, the others run on (State.failed, outcomes). A
    session that an interrupt would pause is an error here. An on_step or observer that raises is logged."""
    for k in range(most):
        left = _open(state)
        if left.isEmpty() or stop():
            return state
        if interrupt_before and not schedule.interrupted(state.frontier.join(left, "session_id"), list(interrupt_before)).isEmpty():
            raise UnexpectedPause(", ".join(interrupt_before))
        began = time.monotonic()
        state, report = superstep(workflow, state)
        if on_step:
            try:
                on_step(k + 1, state, report)
            except Exception as e:
                log.warning("on_step: %s", e)
        if observer is not None:  # ran and skipped nodes alike, with the step's duration
            for r in report.groupBy("node", "ran").agg(F.count("*").alias("sessions")).collect():
                told(observer, "on_node_finish", node=r.node, ran=r.ran, sessions=r.sessions, seconds=time.monotonic() - began)
    raise RuntimeError(f"not complete after {most} supersteps")


def outcomes(state: State) -> DataFrame:
    """session_id, step, status (completed, failed or open) and the error of a failed one."""
    s = schedule.complete(state.versions, state.frontier).join(state.versions.select("session_id", "step"), "session_id")
    failed = state.failed if state.failed is not None else empty(state.versions.sparkSession, FAILED)
    s = s.join(failed.groupBy("session_id").agg(F.min("message").alias("error")), "session_id", "left")
    return s.select("session_id", "step", F.when(F.col("error").isNotNull(), "failed").when(F.col("done"), "completed").otherwise("open").alias("status"), "error")


def entry_nodes(workflow: Workflow, entry: str = START) -> list[str]:
    """Where an invocation begins: Start's static successors, or a registered node."""
    targets = [dst for src, dst in workflow.edges if src == START] if entry == START else [entry]
    if not targets:
        raise NoStartNodes(entry)
    if entry == END or any(t not in workflow.nodes for t in targets if t != END):
        raise InvalidEntry(entry)
    return targets


def prepare_next(workflow: Workflow, state: State, messages: DataFrame | None, extra: DataFrame | None, entry: str = START) -> State:
    """The state for one more invocation: input passes the barrier, the frontier is the entry, memory is cleared, so that
    the same input runs again; steps go on, and sessions that had stopped may go on."""
    targets = entry_nodes(workflow, entry)
    spark = state.versions.sparkSession
    at = state.versions.select("session_id", "step")
    new_m = messages.join(at, "session_id").select("session_id", "step", F.lit(1 << 30).alias("run_ord"), "seq", "role", "content") if messages is not None else empty(spark, MESSAGES)
    new_x = extra.select("session_id", "key", "value", F.lit(0).alias("run_ord")) if extra is not None else empty(spark, DELTA)
    m, x, v, _ = barrier(state.messages, state.extra, state.versions.select("session_id", "mv", "ev"), new_m, new_x, workflow.reducers)
    f = state.versions.select("session_id", F.posexplode(F.array(*map(F.lit, targets))).alias("pos", "node"))
    v = v.join(at, "session_id").select("session_id", "step", "mv", "ev")
    logs = workflow.reducers.only_appends("message")
    m, x, v = cut_all((new_m if messages is not None else None) if logs else m, x if extra is not None else None, v)
    parts = replace(state, parts=dict(state.parts))
    return State(_grown(parts, "messages", m) if logs else m, x if x is not None else state.extra, state.errors, v, f, empty(spark, SEEN), None, parts.parts)


def invoke_next(workflow: Workflow, state: State, messages: DataFrame | None, extra: DataFrame | None, entry: str = START, **run) -> State:
    """One more invocation of iterative sessions, run until complete."""
    return run_until_complete(workflow, prepare_next(workflow, state, messages, extra, entry), **run)


def errors_added(before: State, after: State) -> DataFrame:
    """Per session, how many errors a step's partials brought."""
    n = lambda s, name: s.errors.groupBy("session_id").agg(F.count("*").alias(name))
    return n(after, "now").join(n(before, "was"), "session_id", "left").select("session_id", (F.col("now") - F.coalesce("was", F.lit(0))).alias("n_errors"))


def concurrency(spark: SparkSession, limit: int | None = None) -> int:
    """Nodes at once: 1 at least, the cores that Spark sees by default."""
    return spark.sparkContext.defaultParallelism if limit is None else max(1, limit)


def row_node(f: Callable, schema: str, limit: int | None = None) -> Callable[[DataFrame], DataFrame]:
    """A plain Python function of batches, run by at most `limit` tasks at once: rows are dealt over so many partitions."""

    def run(rows: DataFrame) -> DataFrame:
        return rows.repartition(concurrency(rows.sparkSession, limit)).mapInPandas(f, schema)

    return run


def value_of(state: State, key: str) -> Column:
    return F.max(F.when(F.col("key") == key, F.col("value")))

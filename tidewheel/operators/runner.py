"""Run control: one object that puts a workflow, a history, a bus, a clock and an observer together."""

from __future__ import annotations

import queue
import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.functions.clock import MockClock
from tidewheel.model import FRONTIER, HandleConsumed, HubClosed, NotFound
from tidewheel.operators import engine
from tidewheel.operators.engine import Interrupts, Observer, State, Workflow
from tidewheel.operators.session import autosave, create_or_resume, restore
from tidewheel.sources.history import Checkpointer
from tidewheel.streaming.hub import INVOCATION_END, STREAM_END, Bus, BusConfig, SingleTake, Stream, config_hash, event


@dataclass(frozen=True)
class Runner:
    """Configuration of runs; each `with_` returns a changed copy."""

    workflow: Workflow
    store: Checkpointer | None = None
    saves: bool = True
    bus: Bus | None = None
    clock: MockClock | None = None
    observer: Observer | None = None
    session: str | None = None
    store_name: str | None = None
    invocation: str = field(default_factory=lambda: uuid.uuid4().hex)

    def with_store(self, store: Checkpointer | None, name: str | None = None) -> "Runner":
        return replace(self, store=store, store_name=name)

    def with_autosave(self, saves: bool) -> "Runner":
        return replace(self, saves=saves)

    def with_bus(self, bus: Bus) -> "Runner":
        return replace(self, bus=bus)

    def with_clock(self, clock: MockClock) -> "Runner":
        return replace(self, clock=clock)

    def with_observer(self, observer: Observer) -> "Runner":
        return replace(self, observer=observer)

    def metadata(self) -> dict:
        """Fingerprints of what is run and how."""
        bus = self.bus.config if self.bus is not None else BusConfig()
        custom = self.store is not None and type(self.store).__module__ != "tidewheel.sources.history"
        clock = "unset" if self.clock is None else "mock" if isinstance(self.clock, MockClock) else "custom"
        g = self.workflow.metadata()
        return {"graph_hash": g["hash"], "config_hash": config_hash(bus, self.session, self.store_name, custom, clock), **{k: g[k] for k in ("nodes", "edges", "conditionals", "reducers")}}

    def emit(self, kind: str, scope: str, message: str, **about) -> None:
        """An event on the bus; without one, or where nobody listens, nothing happens."""
        if self.bus is not None:
            if self.clock is not None:
                about["clock_ms"] = self.clock.seconds * 1000
            e = event(kind, scope, message, invocation=self.invocation, **about)
            try:
                self.bus.publish(e)
            except HubClosed:
                return
            engine.told(self.observer, "on_event_bus_emit", event=e)

    def create(self, messages: DataFrame, extra: DataFrame | None = None) -> State:
        """New sessions, or those that the history has."""
        if self.store is None:
            return engine.start(self.workflow, messages, extra)
        return create_or_resume(self.workflow, self.store, messages, self.observer)

    def session_ids(self) -> DataFrame:
        if self.store is None:
            raise NotFound("no history")
        return self.store.list_sessions()

    def load(self, session: str) -> State:
        """One stored session."""
        rows = self.store.load_latest().where(F.col("session_id") == session) if self.store is not None else None
        if rows is None or rows.isEmpty():
            raise NotFound(session)
        return restore(rows)

    def step(self, state: State, interrupts: Interrupts = Interrupts()) -> tuple[State, DataFrame, DataFrame]:
        """One superstep with interrupts; saved where the runner saves."""
        state, report, pauses = engine.run_step(self.workflow, state, interrupts)
        self._after(0, state, report)
        return state, report, pauses

    def _after(self, k: int, state: State, report: DataFrame) -> None:
        if self.store is not None and self.saves:
            autosave(self.store, self.observer)(k, state, report)
        if self.bus is not None:
            for r in report.groupBy("step", "node", "ran").agg(F.count("*").alias("n")).orderBy("step", "node", "ran").collect():  # nodes of the workflow, not sessions
                self.emit("node", "ran" if r.ran else "skipped", f"{r.n} sessions", node=r.node, step=r.step)

    def _ends(self, state: State, scope: str) -> None:
        for r in engine.outcomes(state).groupBy("status").agg(F.count("*").alias("n"), F.max("step").alias("step")).collect():
            self.emit("diagnostic", scope, f"status={r.status} sessions={r.n} step={r.step}")

    def run(self, state: State, stop: Callable[[], bool] = lambda: False, end: str = STREAM_END) -> State:
        """Until every session is done or stopped; then the end is told."""
        engine.told(self.observer, "on_invocation_start", invocation=self.invocation)
        error = None
        try:
            state = engine.run_until_complete(self.workflow, state, on_step=self._after, observer=self.observer, stop=stop)
            return state
        except Exception as e:
            error = str(e)
            raise
        finally:
            if error is None:
                self._ends(state, end)
            else:
                self.emit("diagnostic", end, f"status=error error={error}")
            engine.told(self.observer, "on_invocation_finish", invocation=self.invocation, error=error)

    def invoke(self, messages: DataFrame, extra: DataFrame | None = None) -> State:
        """Sessions created or resumed and run to the end."""
        return self.run(self.create(messages, extra))

    def invoke_with_sinks(self, messages: DataFrame, sinks: dict[str, Callable[[dict], None]]) -> State:
        """The same with sinks of its own and without saving."""
        bus = Bus()
        for name, sink in sinks.items():
            bus.add(name, sink)
        bus.start()
        try:
            return replace(self, bus=bus, saves=False).invoke(messages)
        finally:
            bus.stop()

    def invoke_with_channel(self, messages: DataFrame) -> tuple[State, "queue.Queue[dict]"]:
        """The same with a queue that gets every event."""
        channel: queue.Queue = queue.Queue()
        return self.invoke_with_sinks(messages, {"channel": channel.put_nowait}), channel

    def invoke_streaming(self, messages: DataFrame) -> "Handle":
        """Runs in the background; the handle has the stream of events, and waits or aborts."""
        bus = self.bus or Bus()
        return Handle(replace(self, bus=bus), messages)

    def iterative(self, messages: DataFrame, entry: str = engine.START) -> "IterativeSession":
        return IterativeSession(self, messages, entry)


class Handle:
    def __init__(self, runner: Runner, messages: DataFrame):
        runner.bus.start()
        self.events = SingleTake(runner.bus.hub.subscribe())
        self.stopped, self.result, self.error, self.joined = threading.Event(), None, None, False
        spark = messages.sparkSession

        def work():
            try:
                self.result = runner.run(runner.create(messages), self.stopped.is_set)
            except Exception as e:
                self.error = e
            finally:
                runner.bus.stop()

        self.thread = threading.Thread(target=inheritable_thread_target(spark)(work), daemon=True)
        self.thread.start()

    def stream(self) -> Stream:
        return self.events.take()

    def abort(self) -> None:
        """No superstep begins after this one."""
        self.stopped.set()

    def is_finished(self) -> bool:
        return not self.thread.is_alive()

    def join(self) -> State:
        """Waits and gives the state, once; what the run raised is raised here."""
        if self.joined:
            raise HandleConsumed("run")
        self.joined = True
        self.thread.join()
        if self.error is not None:
            raise self.error
        return self.result


class IterativeSession:
    """Many invocations of the same sessions: the state and the event stream stay open between them."""

    def __init__(self, runner: Runner, messages: DataFrame, entry: str = engine.START):
        runner.workflow.compile()
        engine.entry_nodes(runner.workflow, entry)  # before anything is written
        self.runner, self.entry, self.finished = runner, entry, False
        self.state = replace(runner.create(messages), frontier=engine.empty(messages.sparkSession, FRONTIER))

    def invoke_next(self, messages: DataFrame | None = None, extra: DataFrame | None = None, entry: str | None = None) -> State:
        if self.finished:
            raise HandleConsumed("iterative session")
        begun = engine.prepare_next(self.runner.workflow, self.state, messages, extra, entry or self.entry)
        self.state = self.runner.run(begun, end=INVOCATION_END)
        return self.state

    def finish(self) -> State:
        """Tells the end of the stream; no invocation may follow."""
        self.finished = True
        self.runner._ends(self.state, STREAM_END)
        return self.state


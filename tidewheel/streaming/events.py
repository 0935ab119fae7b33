"""Event log, bounded buffers as a model, sink health, metrics, and Structured Streaming sinks."""

from __future__ import annotations

import queue
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

BUFFER_DEFAULT = 1024


def envelope(kind: Column, scope: Column, message: Column, timestamp: Column, metadata: Column) -> Column:
    return F.struct(kind.alias("type"), scope.alias("scope"), message.alias("message"), timestamp.alias("timestamp"), metadata.alias("metadata"))


def joined_metadata(kind: Column, fields: Column, user: Column) -> Column:
    """On equal names fields win for node events, the user's for LLM events."""
    return F.map_zip_with(fields, user, lambda k, f, u: F.when(kind == "llm", F.coalesce(u, f)).otherwise(F.coalesce(f, u)))


def llm_scope(chunk: Column, final: Column, error: Column) -> Column:
    return F.when(error, "error").when(final, "stream").otherwise("chunk")


def json_line(event: Column, pretty: bool = False) -> Column:
    return F.to_json(event, {"pretty": "true"} if pretty else {})


def only(events: DataFrame, kinds: list[str] | None = None, scopes: list[str] | None = None) -> DataFrame:
    """A consumer's part of the events, batch or stream: by type and by scope."""
    for c, wanted in (("type", kinds), ("scope", scopes)):
        if wanted is not None:
            events = events.where(F.col(c).isin(wanted))
    return events


def buffered(events: DataFrame, capacity: int, subscriber: str, order: list[str]) -> DataFrame:
    """What a subscriber that reads late still gets: the last `capacity` events; `dropped` tells how many it missed."""
    w = Window.partitionBy(subscriber)
    e = events.withColumn("n__", F.count("*").over(w)).withColumn("nth__", F.row_number().over(w.orderBy(*order)))
    return e.where(F.col("nth__") > F.col("n__") - capacity).withColumn("dropped", F.greatest(F.col("n__") - capacity, F.lit(0))).drop("n__", "nth__")


def lag(events: DataFrame, capacity: int, subscriber: str) -> DataFrame:
    n = events.groupBy(subscriber).agg(F.count("*").alias("published"))
    return n.select(subscriber, "published", F.least("published", F.lit(capacity)).alias("retained"), F.greatest(F.col("published") - capacity, F.lit(0)).alias("dropped"))


def occurrences(failures: DataFrame, sink: str = "sink", order: tuple[str, ...] = ("when",)) -> DataFrame:
    return failures.withColumn("occurrence", F.row_number().over(Window.partitionBy(sink).orderBy(*order)))


def sink_health(failures: DataFrame, sink: str = "sink", order: tuple[str, ...] = ("when",)) -> DataFrame:
    return failures.groupBy(sink).agg(F.count("*").alias("n_errors"), F.max_by("error", F.struct(*order)).alias("last_error"), F.max(order[0]).alias("last_when"))


#: Upper bounds of the duration histogram in milliseconds (fixed values); the last bucket has none.
BUCKETS = (1, 5, 10, 50, 100, 500, 1000)


def histogram(rows: DataFrame, labels: list[str], value: str, bounds: tuple[float, ...] = BUCKETS) -> DataFrame:
    """(labels, le, n): how many values are at most each bound, rows without a value left out; le is null for all."""
    timed = rows.where(F.col(value).isNotNull())
    n = timed.groupBy(*labels).agg(*(F.count_if(F.col(value) <= b).alias(f"b{k}") for k, b in enumerate(bounds)), F.count("*").alias("all__"))
    each = F.array(*(F.struct(F.lit(float(b)).alias("le"), F.col(f"b{k}").alias("n")) for k, b in enumerate(bounds)), F.struct(F.lit(None).cast("double").alias("le"), F.col("all__").alias("n")))
    return n.select(*labels, F.inline(each))


def metrics(rows: DataFrame, labels: list[str], value: str) -> DataFrame:
    """Counts by label, and the sum of durations of rows that have one."""
    return rows.groupBy(*labels).agg(F.count("*").alias("n"), F.count(value).alias("n_timed"), F.sum(value).alias("total"))


def stream_end(session: Column, status: Column, step: Column, error: Column) -> Column:
    part = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(f"{name}="), c.cast("string")))
    return F.concat_ws(" ", part("session", session), part("status", status), part("step", step), part("error", error))


@dataclass
class Sinks:
    """foreachBatch fan-out: a sink that raises is counted and recorded with its time, the others and the stream go on."""

    handlers: dict[str, Callable[[DataFrame, int], None]] = field(default_factory=dict)
    failures: list[tuple[str, str, int, float]] = field(default_factory=list)

    def add(self, name: str, handler: Callable[[DataFrame, int], None]) -> "Sinks":
        self.handlers.setdefault(name, handler)
        return self

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        for name, handler in self.handlers.items():
            try:
                handler(batch, epoch)
            except Exception as e:  # a sink must not stop the bus
                self.failures.append((name, str(e), epoch, time.time()))

    def diagnostics(self, spark: SparkSession) -> DataFrame:
        """sink, error, when, occurrence of every failure."""
        rows = [(n, e, datetime.fromtimestamp(t, timezone.utc)) for n, e, _, t in self.failures]
        return occurrences(spark.createDataFrame(rows, "sink string, error string, when timestamp"))


def jsonl_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Each batch replaces its own folder, so a batch that runs again writes nothing twice."""
    return lambda batch, epoch: batch.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(f"{path}/epoch={epoch}")


def stdout_sink(pretty: bool = False) -> Callable[[DataFrame, int], None]:
    """One JSON object a line (or indented) on the driver's output, row by row as they arrive."""

    def put(batch: DataFrame, epoch: int) -> None:
        for row in batch.select(json_line(F.struct("*"), pretty).alias("value")).toLocalIterator():
            print(row.value, flush=True)

    return put


def channel_sink(q: "queue.Queue") -> Callable[[DataFrame, int], None]:
    def put(batch: DataFrame, epoch: int) -> None:
        for row in batch.toLocalIterator():
            q.put_nowait(row.asDict())

    return put


class Captured(list):
    """Rows that a memory sink holds."""

    def snapshot(self) -> list[dict]:
        return list(self)


def memory_sink(rows: list) -> Callable[[DataFrame, int], None]:
    return lambda batch, epoch: rows.extend(r.asDict() for r in batch.toLocalIterator())


def start(stream: DataFrame, sinks: Sinks, checkpoint: str) -> StreamingQuery:
    """One query for all sinks: a batch is read once and given to each in turn."""
    return stream.writeStream.foreachBatch(sinks).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class StreamBus:
    """One query a sink, so that a slow one holds up no other: started once, sinks added later start at once, stopped and
    started again from their checkpoints."""

    def __init__(self, stream: DataFrame, checkpoint: str):
        self.stream, self.checkpoint, self.sinks, self.queries, self.running = stream, checkpoint, {}, {}, False

    def add(self, name: str, handler: Callable[[DataFrame, int], None]) -> "StreamBus":
        if name not in self.sinks:
            self.sinks[name] = Sinks().add(name, handler)
            if self.running:
                self._run(name)
        return self

    def _run(self, name: str) -> None:
        self.queries[name] = start(self.stream, self.sinks[name], f"{self.checkpoint}/{name}")

    def start(self) -> "StreamBus":
        if not self.running:
            self.running = True
            for name in self.sinks:
                self._run(name)
        return self

    def wait(self, seconds: float | None = None) -> bool:
        """Until every sink has what there is; False if the time is over before."""
        return all([q.awaitTermination(seconds) is not False for q in self.queries.values()])

    def stop(self) -> None:
        for q in self.queries.values():
            q.stop()
        self.queries, self.running = {}, False

    def restart(self) -> "StreamBus":
        self.stop()
        return self.start()

    def failures(self) -> list[tuple[str, str, int, float]]:
        return [f for s in self.sinks.values() for f in s.failures]


def running_sum(stream: DataFrame, key: str, value: str) -> DataFrame:
    """Per key the sum and number of values so far, kept as state: an iterative session a key."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(k, batches: Iterator[pd.DataFrame], state):
        total, n = state.get if state.exists else (0, 0)
        for b in batches:
            total, n = total + int(b[value].sum()), n + len(b)
        state.update((total, n))
        yield pd.DataFrame({key: [k[0]], "total": [total], "n": [n]})

    return stream.groupBy(key).applyInPandasWithState(step, f"{key} bigint, total bigint, n bigint", "total bigint, n bigint", "update", GroupStateTimeout.NoTimeout)

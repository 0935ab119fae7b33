"""Step history: saving, loading, paging, retention and compare-and-set over tables of steps."""

from __future__ import annotations

import logging
import uuid
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewheel.materialize import cut
from tidewheel.model import STEPS, Conflict, StoreError, empty
from tidewheel.operators.graph import ranked

log = logging.getLogger("tidewheel")

PAGE_DEFAULT, PAGE_MOST = 100, 1000


def upsert(stored: DataFrame, new: DataFrame) -> DataFrame:
    """One row a (session, step): the write with the highest write_seq."""
    both = stored.unionByName(new)
    return both.groupBy("session_id", "step").agg(F.max_by(F.struct(*[c for c in both.columns if c not in ("session_id", "step")]), "write_seq").alias("r")).select("session_id", "step", "r.*")


def latest(steps: DataFrame, rule: str = "max_step", key: str = "session_id") -> DataFrame:
    """Each session's latest step row: the highest step, or the one written last."""
    by = {"max_step": "step", "last_written": "write_seq"}[rule]
    return steps.groupBy(key).agg(F.max_by(F.struct(*[c for c in steps.columns if c != key]), by).alias("r")).select(key, "r.*")


def page(steps: DataFrame, limit: int | None = None, offset: int = 0, min_step: int | None = None, max_step: int | None = None, ran: str | None = None, skipped: str | None = None, key: str = "session_id") -> DataFrame:
    """Rows of one page of every session, newest first, with total, page_size, page_offset and has_next."""
    size = min(PAGE_DEFAULT if limit is None else limit, PAGE_MOST)
    for test in ((F.col("step") >= min_step) if min_step is not None else None, (F.col("step") <= max_step) if max_step is not None else None, F.array_contains("ran", ran) if ran else None, F.array_contains("skipped", skipped) if skipped else None):
        if test is not None:
            steps = steps.where(test)
    w = Window.partitionBy(key)
    out = steps.withColumn("total", F.count("*").over(w)).withColumn("nth", F.row_number().over(w.orderBy(F.desc("step"))))
    return out.where((F.col("nth") > offset) & (F.col("nth") <= offset + size)).withColumns({"page_size": F.lit(size), "page_offset": F.lit(offset), "has_next": F.col("total") > offset + size})


def retain(steps: DataFrame, newest: int | None = None, since: Column | None = None, key: str = "session_id") -> DataFrame:
    if since is not None:
        steps = steps.where(F.col("created_at") >= since)
    if newest is not None:
        steps = steps.withColumn("nth__", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("step")))).where(F.col("nth__") <= newest).drop("nth__")
    return steps


def list_sessions(steps: DataFrame, key: str = "session_id", at: str = "created_at") -> DataFrame:
    """Sessions with their number of steps, the most recently written first (recency 1)."""
    s = steps.groupBy(key).agg(F.count("*").alias("n_steps"), F.max(at).alias("updated_at"))
    return ranked(s, [-F.unix_micros(F.col("updated_at").cast("timestamp")), F.col(key)], 0, "recency")


def headers(stored: DataFrame, new: DataFrame, key: str = "session_id") -> DataFrame:
    """Session headers (key, last_step, updated_at) after new step rows (key, step, created_at): the pointer moves only
    forward, whatever order the steps are written in."""
    both = stored.select(key, "last_step", "updated_at").unionByName(new.select(key, F.col("step").alias("last_step"), F.col("created_at").alias("updated_at")))
    return both.groupBy(key).agg(F.max("last_step").alias("last_step"), F.max("updated_at").alias("updated_at"))


def with_header(steps: DataFrame, sessions: DataFrame, key: str = "session_id") -> DataFrame:
    """Step rows with the columns of their session's header."""
    return steps.join(sessions, key)


def latest_view(sessions: DataFrame, steps: DataFrame, key: str = "session_id") -> DataFrame:
    """Every header(key, last_step, ...) with its latest step row, nulls where none is stored."""
    return sessions.join(steps.withColumnRenamed("step", "last_step"), [key, "last_step"], "left")


def compare_and_set(current: DataFrame, expected: DataFrame, key: str = "session_id") -> DataFrame:
    """(key, expected, last_step, outcome): accepted, conflict, or missing where nothing is stored but a step is expected."""
    j = expected.join(current.select(key, "last_step"), key, "left")
    outcome = F.when(F.col("expected").eqNullSafe(F.col("last_step")), "accepted").when(F.col("last_step").isNull(), "missing").otherwise("conflict")
    return j.select(key, "expected", "last_step", outcome.alias("outcome"))


class Checkpointer(Protocol):
    """What a history back end offers; any object with these methods may take the place of the ones here."""

    def save(self, rows: DataFrame, expected: DataFrame | None = None) -> None: ...

    def load_latest(self) -> DataFrame: ...

    def list_sessions(self) -> DataFrame: ...


_FIELDS = [c.strip().split(" ")[0] for c in STEPS.split(", ")]


def _check(last: DataFrame, expected: DataFrame) -> None:
    bad = compare_and_set(last, expected).where("outcome <> 'accepted'").limit(20).collect()
    if bad:
        raise Conflict("; ".join(map(str, bad)))


class MemoryStore:
    """Keeps each session's last write only, for as long as the program runs."""

    def __init__(self, spark: SparkSession):
        self.spark, self.rows, self.seq = spark, empty(spark, STEPS), 0

    def save(self, rows: DataFrame, expected: DataFrame | None = None) -> None:
        if expected is not None:
            _check(self.rows.select("session_id", F.col("step").alias("last_step")), expected)
        self.seq += 1
        new = self.rows.unionByName(rows.withColumn("write_seq", F.lit(self.seq).cast("bigint")).select(_FIELDS))
        self.rows = cut(latest(new, "last_written").select(_FIELDS))

    def load_latest(self) -> DataFrame:
        return self.rows

    def list_sessions(self) -> DataFrame:
        return self.rows.select("session_id")


class Store:
    """A history in one folder: each save is one immutable table in `data`, published by a numbered entry in `log` that
    names it.

    An entry is made only where none of its number exists, so of two writers one gets it; the other looks at what has
    changed and, if its expectations still hold, tries the next number. A plain save reads none of the rows saved before."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def entries(self) -> list[tuple[int, str]]:
        """(number, table) of the saves that count; the table is part of the entry's name."""
        p, fs = self._fs("log")
        names = sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []
        taken: dict[int, str] = {}
        for n in names:
            number, _, table = n.partition("-")
            if table:
                taken.setdefault(int(number), table)
        return sorted(taken.items())

    def _publish(self, number: int, table: str) -> bool:
        """Takes the number by creating a file that must not exist, then names the table."""
        lock, fs = self._fs(f"log/{number:012d}")
        try:
            fs.create(lock, False).close()
        except Exception:
            if fs.exists(lock):
                return False
            raise
        entry, _ = self._fs(f"log/{number:012d}-{table}")
        return fs.rename(lock, entry) or fs.exists(entry)

    def _taken(self) -> int:
        p, fs = self._fs("log")
        return max((int(f.getPath().getName()[:12]) for f in fs.listStatus(p)), default=0) if fs.exists(p) else 0

    def _tables(self, entries: list[tuple[int, str]]) -> DataFrame:
        rows = empty(self.spark, STEPS)
        if entries:
            rows = self.spark.read.schema(f"{STEPS}, save string").option("basePath", f"{self.path}/data").parquet(*(f"{self.path}/data/save={t}" for _, t in entries))
            number = F.create_map(*(F.lit(x) for n, t in entries for x in (t, n)))
            rows = rows.withColumn("write_seq", number[F.col("save")].cast("bigint")).drop("save")
        return rows

    def read(self) -> DataFrame:
        """One row a (session, step): that of the last save."""
        return upsert(self._tables(self.entries()), empty(self.spark, STEPS))

    def save(self, rows: DataFrame, expected: DataFrame | None = None) -> None:
        """Adds step rows; with expected(session_id, expected) all must match the stored last step or none is written."""
        table = uuid.uuid4().hex
        rows.select([c for c in _FIELDS if c != "write_seq"]).withColumn("write_seq", F.lit(None).cast("bigint")).select(_FIELDS).write.parquet(f"{self.path}/data/save={table}")
        while True:
            number = self._taken() + 1
            if expected is not None:
                _check(self._tables(self.entries()).groupBy("session_id").agg(F.max("step").alias("last_step")), expected)
            if self._publish(number, table):
                return

    def load_latest(self, rule: str = "max_step") -> DataFrame:
        return latest(self.read(), rule)

    def list_sessions(self) -> DataFrame:
        return list_sessions(self.read())


def open_store(spark: SparkSession, kind: str = "memory", path: str | None = None, custom: Checkpointer | None = None, settings: dict[str, str] | None = None) -> Checkpointer | None:
    """A custom back end if there is one, else memory or files; settings (such as the environment) may override the path.

    A folder that cannot be reached is logged, and the run goes on without a history."""
    if custom is not None:
        return custom
    if kind == "memory":
        return MemoryStore(spark)
    if kind != "files":
        raise StoreError(kind)
    path = (settings or {}).get("TIDEWHEEL_STORE") or path
    try:
        if not path:
            raise StoreError("no path")
        store = Store(spark, path)
        p, fs = store._fs("log")
        if not fs.mkdirs(p):
            raise StoreError(path)
        return store
    except Exception as e:
        log.warning("no history: %s", e)
        return None

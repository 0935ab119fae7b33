"""Reducers and the barrier: partial updates of one step become the next state of three channels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.model import bumped

#: Rank of each error scope in the total order.
SCOPES = {"node": 0, "scheduler": 1, "runner": 2, "app": 3}


def append(state: DataFrame, delta: DataFrame) -> DataFrame:
    """Messages and errors only grow; order is in their columns."""
    return state.unionByName(delta, allowMissingColumns=True)


def transcript(messages: DataFrame, key: str = "session_id") -> DataFrame:
    """Ordered messages of each session, with count and version (1 + steps that brought any)."""
    m = F.array_sort(F.collect_list(F.struct("step", "run_ord", "seq", "role", "content")))
    return messages.groupBy(key).agg(m.alias("messages"), F.count("*").alias("n_messages"), (1 + F.count_distinct("step")).alias("version"))


def last_writer(deltas: DataFrame, keys: list[str], order: list[str], value: str = "value") -> DataFrame:
    """The last value of each key by `order`; a null value deletes the key."""
    last = F.max_by(F.struct(value), F.struct(*order)).alias("last__")
    return deltas.groupBy(*keys).agg(last).select(*keys, F.col(f"last__.{value}").alias(value)).where(F.col(value).isNotNull())


def merge_map(state: DataFrame, delta: DataFrame) -> DataFrame:
    """Shallow merge of (session_id, key, value): delta rows, ordered by run_ord, win over stored ones; null deletes."""
    both = state.withColumn("run_ord", F.lit(-1)).select("session_id", "key", "value", "run_ord").unionByName(delta.select("session_id", "key", "value", "run_ord"))
    return last_writer(both, ["session_id", "key"], ["run_ord"])


def fold_maps(maps: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Later maps win, nulls stay."""
    return maps.groupBy(*keys).agg(F.max_by(F.struct("value"), F.struct(*order)).alias("v")).select(*keys, "v.value")


def error_order() -> list[Column]:
    """Scope rank, then name, step, time and message."""
    rank = F.coalesce(*[F.when(F.col("scope") == s, F.lit(r)) for s, r in SCOPES.items()], F.lit(len(SCOPES)))
    return [rank, F.coalesce("kind", F.lit("")), F.coalesce("scope_step", F.lit(0)), F.col("when"), F.col("message")]


def rank_errors(errors: DataFrame, key: str = "session_id") -> DataFrame:
    return errors.withColumn("error_ord", F.row_number().over(Window.partitionBy(key).orderBy(*error_order())))


def changed_maps(old: DataFrame, new: DataFrame) -> DataFrame:
    """Sessions whose map differs in any key or value."""
    o, n = old.select("session_id", "key", F.col("value").alias("o")), new.select("session_id", "key", F.col("value").alias("n"))
    return o.join(n, ["session_id", "key"], "full_outer").where(~F.col("o").eqNullSafe(F.col("n"))).select("session_id").distinct()


class Reducers:
    """Reducers of each channel in order of registration; the defaults come first."""

    def __init__(self, defaults: bool = True):
        self.of: dict[str, list[tuple[str, Callable]]] = {}
        if defaults:
            self.register("message", "append", append).register("extra", "merge_map", merge_map).register("error", "append", append)

    def register(self, channel: str, label: str, f: Callable[[DataFrame, DataFrame], DataFrame]) -> "Reducers":
        self.of.setdefault(channel, []).append((label, f))
        return self

    def apply(self, channel: str, state: DataFrame, delta: DataFrame) -> DataFrame:
        """state after the channel's reducers in order of registration; without any, only an empty delta passes."""
        if channel not in self.of:
            if delta.isEmpty():
                return state
            raise KeyError(f"no reducer for channel {channel}")
        for _, f in self.of[channel]:
            state = f(state, delta)
        return state

    def apply_all(self, state: dict[str, DataFrame], delta: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """Every registered channel that has a delta; the channels are independent."""
        return {c: self.apply(c, d, delta[c]) if c in delta else d for c, d in state.items()}

    def only_appends(self, channel: str) -> bool:
        """Whether the channel is a plain log, of which only additions need be written."""
        return [f for _, f in self.of.get(channel, [])] == [append]

    def signature(self) -> list[str]:
        return sorted(f"{c}:[{','.join(f'{k}:{label}' for k, (label, _) in enumerate(fs))}]" for c, fs in self.of.items())


def barrier(messages: DataFrame, extra: DataFrame, versions: DataFrame, new_messages: DataFrame, new_extra: DataFrame, reducers: Reducers | None = None):
    """(messages, extra, versions, updated): versions gain 1 where messages grew or the map's value changed."""
    reducers = reducers or Reducers()
    m, x = reducers.apply("message", messages, new_messages), reducers.apply("extra", extra, new_extra)
    if reducers.only_appends("message"):
        grew = new_messages.select("session_id").distinct()
    else:
        n = lambda d, c: d.groupBy("session_id").agg(F.count("*").alias(c))
        grew = n(m, "now").join(n(messages, "was"), "session_id", "left").where("now <> coalesce(was, 0)").select("session_id")
    grew = grew.withColumn("m", F.lit(True))
    touched = new_extra.select("session_id").distinct()  # other sessions' maps cannot have changed
    moved = changed_maps(extra.join(touched, "session_id", "left_semi"), x.join(touched, "session_id", "left_semi")).withColumn("e", F.lit(True))
    v = versions.join(grew, "session_id", "left").join(moved, "session_id", "left").na.fill(False, ["m", "e"])
    updated = v.select("session_id", F.expr("filter(array(if(m, 'messages', null), if(e, 'extra', null)), c -> c is not null)").alias("updated"))
    return m, x, v.select("session_id", bumped(F.col("mv"), F.col("m")).alias("mv"), bumped(F.col("ev"), F.col("e")).alias("ev")), updated

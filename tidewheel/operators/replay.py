"""Replay comparison of runs: a run is a final state and a sequence of events, by session."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.operators.engine import State

#: What two runs of one workflow may differ in.
TIME = "timestamp"


class ReplayMismatch(AssertionError):
    pass


class ProfileConflict(ValueError):
    """One key with two lifecycles."""


@dataclass
class Run:
    """events: session_id, idx and the event's columns."""

    state: State
    events: DataFrame


@dataclass
class Profile:
    """Keys of the map that a comparison ignores. A raw name carries no lifecycle and agrees with any; a typed key
    (namespace:name:vN) carries one, and two different ones for one key conflict. Adding twice changes nothing."""

    ignored: dict[str, str | None] = field(default_factory=dict)

    def ignore_keys(self, *keys: str) -> "Profile":
        for k in keys:
            self.ignored.setdefault(k, None)
        return self

    def ignore_slot(self, namespace: str, name: str, version: int, lifecycle: str) -> "Profile":
        key = f"{namespace}:{name}:v{version}"
        if key in self.ignored and self.ignored[key] not in (None, lifecycle):
            raise ProfileConflict(f"{key} is {self.ignored[key]} and {lifecycle}")
        self.ignored.setdefault(key, lifecycle)
        return self


def normalise_event(events: DataFrame, key: str = "session_id", index: str = "idx") -> DataFrame:
    """(key, index, value): the event as text without its time."""
    fields = [c for c in events.columns if c not in (key, index, TIME)]
    return events.select(key, index, F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value"))


def compare_sequences(left: DataFrame, right: DataFrame, values: list[str], key: str = "session_id", index: str = "idx") -> DataFrame:
    """Per session: n_left, n_right, first_diff: the first differing place of the shared prefix, null without one; equal."""
    pack = lambda df, c: df.select(key, index, F.struct(*values).alias(c))
    both = pack(left, "l").join(pack(right, "r"), [key, index], "full_outer")
    out = both.groupBy(key).agg(
        F.count("l").alias("n_left"), F.count("r").alias("n_right"), F.min(F.when(F.col("l").isNotNull() & F.col("r").isNotNull() & ~F.col("l").eqNullSafe(F.col("r")), F.col(index))).alias("first_diff"))
    return out.withColumn("equal", (F.col("n_left") == F.col("n_right")) & F.col("first_diff").isNull())


def compare_events(left: DataFrame, right: DataFrame, normaliser: Callable[[DataFrame], DataFrame] = normalise_event) -> DataFrame:
    """compare_sequences of what the normaliser makes of both: (session_id, idx, value)."""
    return compare_sequences(normaliser(left), normaliser(right), ["value"])


def normalise_state(state: State, profile: Profile = Profile()) -> DataFrame:
    """(session_id, part, value): messages, extra, errors and the versions as texts; extra without ignored keys."""
    listed = lambda df, part, fields: df.groupBy("session_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct(*fields)))).alias("value")).select("session_id", F.lit(part).alias("part"), "value")
    x = state.extra.where(~F.col("key").isin(list(profile.ignored))) if profile.ignored else state.extra
    out = listed(state.messages, "messages", ["step", "run_ord", "seq", "role", "content"]).unionByName(listed(x, "extra", ["key", "value"]))
    out = out.unionByName(listed(state.errors, "errors", ["scope", "kind", "scope_step", "message"]))
    for part, c in (("messages_version", "mv"), ("extra_version", "ev")):
        out = out.unionByName(state.versions.select("session_id", F.lit(part).alias("part"), F.col(c).cast("string").alias("value")))
    return out


def compare_states(left: State, right: State, profile: Profile = Profile()) -> DataFrame:
    """(session_id, part, left, right) of the parts that differ. Versions count even where the keys behind them are ignored."""
    l, r = (normalise_state(s, profile).withColumnRenamed("value", c) for s, c in ((left, "left"), (right, "right")))
    return l.join(r, ["session_id", "part"], "full_outer").where(~F.col("left").eqNullSafe(F.col("right")))


def compare_runs(left: Run, right: Run, profile: Profile = Profile(), normaliser: Callable[[DataFrame], DataFrame] = normalise_event) -> DataFrame:
    """(session_id, ord, difference): those of the final state, then the number of events, then the first differing event."""
    states = compare_states(left.state, right.state, profile)
    text = F.concat(F.lit("final state differs: "), "part", F.lit(" left="), F.coalesce("left", F.lit("-")), F.lit(" right="), F.coalesce("right", F.lit("-")))
    out = states.select("session_id", F.lit(0).alias("ord"), text.alias("difference"))
    return out.unionByName(event_differences(compare_events(left.events, right.events, normaliser)))


def event_differences(compared: DataFrame, key: str = "session_id") -> DataFrame:
    """(key, ord, difference) of compare_sequences."""
    count = compared.where("n_left <> n_right").select(key, F.lit(1).alias("ord"), F.concat(F.lit("event count differs: left="), F.col("n_left").cast("string"), F.lit(" right="), F.col("n_right").cast("string")).alias("difference"))
    first = compared.where("first_diff is not null").select(key, F.lit(2).alias("ord"), F.concat(F.lit("event "), F.col("first_diff").cast("string"), F.lit(" differs")).alias("difference"))
    return count.unionByName(first)


def compare_maps(left: DataFrame, right: DataFrame, ignored: list[str] = ()) -> DataFrame:
    """(session_id, key, left, right) of the keys that differ, but for ignored ones."""
    cut_ = lambda d: d.where(~F.col("key").isin(list(ignored))) if ignored else d
    l, r = (cut_(d).select("session_id", "key", F.col("value").alias(c)) for d, c in ((left, "left"), (right, "right")))
    return l.join(r, ["session_id", "key"], "full_outer").where(~F.col("left").eqNullSafe(F.col("right")))


def assert_equal(differences: DataFrame, shown: int = 20) -> None:
    """Raises with the first differences; of compare_sequences only the rows that are not equal count."""
    rows = (differences.where("not equal") if "equal" in differences.columns else differences).limit(shown).collect()
    if rows:
        raise ReplayMismatch("\n".join(map(str, rows)))


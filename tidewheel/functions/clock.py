"""Time as data: the clock is a literal column, so runs repeat."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


class MockClock:
    """A clock that stands still until it is moved; whole seconds since 1970."""

    def __init__(self, now: int = 0):
        self.seconds = now

    def now(self) -> Column:
        return F.timestamp_seconds(F.lit(self.seconds))

    def milliseconds(self) -> Column:
        return F.lit(self.seconds * 1000).cast("bigint")

    def advance(self, seconds: float) -> "MockClock":
        """Parts of a second are dropped."""
        self.seconds += int(seconds)
        return self

    def set(self, now: int) -> "MockClock":
        self.seconds = now
        return self


def seconds(ts: Column) -> Column:
    return F.unix_seconds(ts.cast("timestamp"))


def since(now: Column, then: Column) -> Column:
    """Whole seconds, 0 at least."""
    return F.greatest(seconds(now) - seconds(then), F.lit(0))


def is_recent(now: Column, then: Column, most: int) -> Column:
    return since(now, then) <= most


def formatted(ts: Column) -> Column:
    return F.coalesce(F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC")), F.lit("invalid timestamp"))


def duration_between(a: Column, b: Column) -> Column:
    return since(b, a)

"""Maps of values as columns: construction, defaults, updates and clearing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def from_pairs(pairs: Column) -> Column:
    """map of array<struct<key, value>>; of equal keys the last counts."""
    keys = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    last = lambda k: F.element_at(F.filter(pairs, lambda p: p["key"] == k), -1)["value"]
    return F.map_from_arrays(keys, F.transform(keys, last))


def put(m: Column, key: Column, value: Column) -> Column:
    """m with key set to value."""
    return F.map_concat(F.map_filter(m, lambda k, _: k != key), F.create_map(key, value))


def put_typed(m: Column, key: Column, value: Column) -> Column:
    """map<string, string> of JSON texts with the JSON text of value under key: 1 becomes 1, x becomes "x"."""
    return put(m, key, F.regexp_replace(F.to_json(F.struct(value.alias("v"))), r'^\{"v":(.*)\}$', "$1"))


def get_or(m: Column, key: Column, default: Column) -> Column:
    """The value of key, null where it is stored as null; the default where the key is missing."""
    return F.when(F.map_contains_key(m, key), F.element_at(m, key)).otherwise(default)


def insert_or_update(m: Column, key: Column, value: Column, update: Callable[[Column], Column]) -> Column:
    """A missing key gets the value; one that is there gets what `update` makes of its own."""
    return put(m, key, F.when(F.map_contains_key(m, key), update(F.element_at(m, key))).otherwise(value))


def clear_keys(sessions: DataFrame, keys: list[str]) -> DataFrame:
    """Deltas (session_id, key, value) that delete the keys: null values, which the map's reducer drops."""
    return sessions.select("session_id", F.explode(F.array(*map(F.lit, keys))).alias("key"), F.lit(None).cast("string").alias("value"))

"""JSON helpers; shapes that SQL can't know go through Arrow batches."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

STRATEGIES = ("prefer_left", "prefer_right", "fail", "deep")


class MergeConflict(ValueError):
    pass


def _merge(a, b, strategy: str, path: str = ""):
    if isinstance(a, dict) and isinstance(b, dict):
        out = {}
        for k in {**a, **b}:
            out[k] = _merge(a[k], b[k], strategy, f"{path}.{k}") if k in a and k in b else a.get(k, b.get(k))
        return out
    lists = isinstance(a, list) and isinstance(b, list)
    if lists and strategy == "deep":
        return a + b
    if not lists and type(a) is type(b) and a == b:
        return a
    if strategy == "fail":
        raise MergeConflict(path or ".")
    return a if strategy == "prefer_left" else b


def merge_values(a: str | None, b: str | None, strategy: str) -> str:
    """Objects merge by key; two lists are joined under `deep`, chosen or in conflict otherwise, even when equal."""
    return json.dumps(_merge(json.loads(a or "null"), json.loads(b or "null"), strategy), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def merge(left: Column, right: Column, strategy: str) -> Column:
    if strategy not in STRATEGIES:
        raise ValueError(strategy)

    @F.pandas_udf("string")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([merge_values(x, y, strategy) for x, y in zip(a, b, strict=True)])

    return run(left, right)


def merge_flat(left: Column, right: Column, strategy: str) -> Column:
    """The same for maps of scalars of any type, without Python; `fail` raises on unequal values."""

    def pick(k, a, b):
        clash = a.isNotNull() & b.isNotNull() & (a != b)
        if strategy == "fail":
            return F.when(clash, F.raise_error(F.concat(F.lit("conflict at ."), k))).otherwise(F.coalesce(a, b))
        return F.coalesce(a, b) if strategy == "prefer_left" else F.coalesce(b, a)

    return F.map_zip_with(left, right, pick)


def merge_all(values: list[str], strategy: str) -> str:
    """Folded from an empty object, so that a first value that is none meets it."""
    out = "{}"
    for v in values:
        out = merge_values(out, v, strategy)
    return out


def merge_many(values: Column, strategy: str) -> Column:
    """merge_all of an array<string> column."""
    if strategy not in STRATEGIES:
        raise ValueError(strategy)

    @F.pandas_udf("string")
    def run(a: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else merge_all(list(x), strategy) for x in a])

    return run(values)


def map_to_json(m: Column) -> Column:
    return F.to_json(m)


def serialised(value: Column, context: str) -> Column:
    """JSON text of a struct, map or array; a value that has none raises with its context."""
    text = F.to_json(value)
    return F.when(text.isNull(), F.raise_error(F.lit(f"cannot serialise {context}"))).otherwise(text)


def deserialised(c: Column, schema: str, context: str) -> Column:
    """The typed value of JSON text; text that doesn't fit raises with its context."""
    got = F.from_json(c, schema, {"mode": "PERMISSIVE"})
    fits = F.try_parse_json(c).isNotNull() & got.isNotNull()
    return F.when(fits, got).otherwise(F.raise_error(F.concat(F.lit(f"cannot deserialise {context}: "), F.coalesce(c, F.lit("null")))))


def path_expressions(path: str) -> list[str]:
    """The JSON paths that a dotted path may mean: digits are a place of a list, or else a key of an object. The empty path
    is the document."""
    out = ["$"]
    for p in (p for p in path.split(".") if p):
        out = [x + end for x in out for end in ([f"[{int(p)}]", f".{p}"] if p.isdigit() else [f".{p}"])]
    return out


def get_path(c: Column, path: str) -> Column:
    return F.coalesce(*(F.get_json_object(c, p) for p in path_expressions(path)))


def has_path(c: Column, path: str) -> Column:
    """Whether something is at the path, be it JSON null."""
    v = F.try_parse_json(c)
    found = [F.coalesce(F.try_variant_get(v, p, "variant").isNotNull(), F.lit(False)) for p in path_expressions(path)]
    return F.greatest(*found, found[-1])


def path_or(c: Column, path: str, default: Column) -> Column:
    """What is at the path, null for a JSON null; the default where nothing is."""
    return F.when(has_path(c, path), get_path(c, path)).otherwise(default)


def set_value(document: str | None, path: str, value: str) -> str:
    """Creates missing objects; lists and scalars can't be entered."""
    root = json.loads(document or "{}")
    keys = [k for k in path.split(".") if k]
    if not keys:
        return value
    at = root
    for k in keys[:-1]:
        if not isinstance(at, dict):
            raise ValueError(f"cannot enter {k}")
        at = at.setdefault(k, {})
    if not isinstance(at, dict):
        raise ValueError(f"cannot set {keys[-1]}")
    at[keys[-1]] = json.loads(value)
    return json.dumps(root, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def set_path(c: Column, path: str, value: Column) -> Column:
    @F.pandas_udf("string")
    def run(d: pd.Series, v: pd.Series) -> pd.Series:
        return pd.Series([set_value(x, path, y) for x, y in zip(d, v, strict=True)])

    return run(c, value)


def has_keys(c: Column, keys: list[str]) -> Column:
    found = F.json_object_keys(c)
    return F.coalesce(F.forall(F.array(*map(F.lit, keys)), lambda k: F.array_contains(found, k)), F.lit(False))


def count_elements(c: Column) -> Column:
    """Members of an object or list, 1 for a scalar."""
    return F.coalesce(F.json_array_length(c), F.size(F.json_object_keys(c)), F.lit(1))


def is_empty(c: Column) -> Column:
    """Whether this is an object, list or string without content, or JSON null; null where there is no JSON text."""
    text = F.trim(c)
    return F.when(F.json_array_length(c).isNotNull(), F.json_array_length(c) == 0).when(F.json_object_keys(c).isNotNull(), F.size(F.json_object_keys(c)) == 0).otherwise(text.isin("null", '""'))


def keys(c: Column) -> Column:
    """Keys of an object in ascending order; none for anything else."""
    return F.array_sort(F.coalesce(F.json_object_keys(c), F.array().cast("array<string>")))

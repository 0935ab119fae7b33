"""The documented transforms of example nodes, by name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewheel.functions.jsonx import get_path

RULES = {"uppercase": F.upper, "lowercase": F.lower, "reverse": F.reverse}


def transform(name: str, value: Column) -> Column:
    """One of RULES; an unknown name leaves the value as it is."""
    return RULES.get(name, lambda c: c)(value)


def length(value: Column, is_array: bool = False) -> Column:
    """Bytes of a string, elements of an array."""
    return F.size(value) if is_array else F.octet_length(value)


def multiply(value: Column, factor: float | int) -> Column:
    return value * factor


def extract(document: Column, path: str) -> Column:
    return get_path(document, path)


def looked_up(value: Column, routes: dict[str, str], default: str) -> Column:
    """The route of a value, or the default."""
    if not routes:
        return F.lit(default)
    table = F.create_map(*(F.lit(x) for pair in routes.items() for x in pair))
    return F.coalesce(table[value], F.lit(default))

"""Typed views of JSON values, and error texts."""

from __future__ import annotations

from pyspark.errors import ParseException
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType


def slot(value: Column, schema: str) -> Column:
    """The typed value; null where it is missing or any part of it doesn't fit the schema."""
    try:
        wide = StructType.fromDDL(schema).add("bad__", StringType())
    except ParseException:  # an array, a map or a scalar
        return F.when(F.try_parse_json(value).isNotNull(), F.from_json(value, schema, {"mode": "PERMISSIVE"}))
    got = F.from_json(value, wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad__"})
    return F.when(got["bad__"].isNull() & value.isNotNull(), got.dropFields("bad__"))


def status(value: Column, schema: str) -> Column:
    """found, missing where nothing is stored, or undecodable where something is that doesn't fit."""
    return F.when(value.isNull(), "missing").when(slot(value, schema).isNull(), "undecodable").otherwise("found")


def require(value: Column, schema: str, key: str) -> Column:
    """The typed value; a missing or unfit one raises with its key and which of the two it is."""
    lost = F.concat(F.lit(f"slot {key} is "), status(value, schema))
    return F.when(status(value, schema) == "found", slot(value, schema)).otherwise(F.raise_error(lost))


def typed_get(document: Column, key: str, wanted: str) -> Column:
    """struct(value, problem) of an object's member as string, number or boolean: problem is null, missing or wrong type."""
    member = F.try_variant_get(F.try_parse_json(document), f"$.{key}", "variant")
    text, found = F.get_json_object(document, f"$.{key}"), kind(F.to_json(member))
    problem = F.when(found == "missing", "missing").when(found != wanted, "wrong type")
    value = F.when(problem.isNull(), text.try_cast({"string": "string", "number": "double", "boolean": "boolean"}[wanted]))
    return F.struct(value.alias("value"), problem.alias("problem"))


def kind(value: Column) -> Column:
    """string, number, boolean, array, object, null, or missing where there is no JSON text."""
    head = F.substring(F.ltrim(value), 1, 1)
    return (
        F.when(value.isNull(), "missing").when(head == '"', "string").when(head == "[", "array").when(head == "{", "object")
        .when(head.isin("t", "f"), "boolean").when(head == "n", "null").otherwise("number")
    )


def has_typed(document: Column, key: str, wanted: str) -> Column:
    """Whether the object's member is there with this kind."""
    member = F.try_variant_get(F.try_parse_json(document), f"$.{key}", "variant")
    return F.coalesce(kind(F.to_json(member)) == wanted, F.lit(False))


#: Terminal colours of an error's number and of its causes (fixed values), and the end of a colour.
RED, YELLOW, PLAIN = "\x1b[31m", "\x1b[33m", "\x1b[0m"


def error_text(number: Column, scope: Column, message: Column, causes: Column, tags: Column, context: Column | None = None, colour: str = "off", terminal: bool = False) -> Column:
    """Numbered error with indented causes, its tags and its context; colour is on, off or auto (as the terminal has it)."""
    if colour not in ("on", "off", "auto"):
        raise ValueError(colour)
    paint = (lambda c, x: F.concat(F.lit(c), x, F.lit(PLAIN))) if colour == "on" or (colour == "auto" and terminal) else (lambda c, x: x)
    head = paint(RED, F.concat(number.cast("string"), F.lit(". ["), scope, F.lit("] "), message))
    lines = F.transform(causes, lambda c, i: F.concat(F.repeat(F.lit("  "), i + 1), paint(YELLOW, F.concat(F.lit("cause: "), c))))
    none = F.array().cast("array<string>")
    tail = F.when(F.size(tags) > 0, F.array(F.concat(F.lit("  tags: "), F.array_join(tags, ", ")))).otherwise(none)
    about = F.when(context.isNotNull() & ~context.isin("null", "{}"), F.array(F.concat(F.lit("  context: "), context))).otherwise(none) if context is not None else none
    return F.array_join(F.concat(F.array(head), lines, tail, about), "\n")

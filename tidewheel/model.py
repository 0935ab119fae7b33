"""Identities and schemas: sessions are a column, order is data, every channel is a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

START, END = "Start", "End"
VERSION_MAX = 4_294_967_295

MESSAGES = "session_id string, step bigint, run_ord int, seq int, role string, content string"
EXTRA = "session_id string, step bigint, run_ord int, key string, value string"
ERRORS = "session_id string, when timestamp, scope string, kind string, scope_step bigint, message string, tags array<string>, context string"
VERSIONS = "session_id string, step bigint, mv bigint, ev bigint"
FRONTIER = "session_id string, pos int, node string"
SEEN = "session_id string, node string, mv bigint, ev bigint"
COMMANDS = "session_id string, run_ord int, node string, cmd_pos int, kind string, targets array<string>"
STEPS = "session_id string, step bigint, write_seq bigint, created_at timestamp, state_json string, frontier array<string>, ran array<string>, skipped array<string>, updated array<string>"


class EngineError(Exception):
    """Base of the engine's errors."""


class GraphError(EngineError):
    """A graph that does not validate: kind and the names concerned."""

    def __init__(self, kind: str, names: list[str]):
        super().__init__(f"{kind}: {', '.join(names)}")
        self.kind, self.names = kind, names


class NoStartNodes(EngineError):
    pass


class UnexpectedPause(EngineError):
    pass


class InvalidEntry(EngineError):
    pass


class HandleConsumed(EngineError):
    """An event stream or run handle that was already taken."""


class NotFound(EngineError):
    """A session that nothing is stored of."""


class StoreError(EngineError):
    """A history store that cannot be reached."""


class HubClosed(EngineError):
    """Publishing to a hub that is closed or that nobody listens to."""


class Conflict(EngineError):
    """The stored last step is not the expected one."""


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def encode_node(c: Column) -> Column:
    """Stored form: Start, End or Custom:<name>, whatever the name begins with."""
    return F.when(c.isin(START, END), c).otherwise(F.concat(F.lit("Custom:"), c))


def decode_node(c: Column) -> Column:
    return F.regexp_replace(c, "^Custom:", "")


def is_virtual(c: Column) -> Column:
    return c.isin(START, END)


def role_kind(c: Column) -> Column:
    """One of the known roles, else custom; exact and case-sensitive."""
    return F.when(c.isin("user", "assistant", "system", "tool"), c).otherwise(F.lit("custom"))


def provider_role(c: Column) -> Column:
    """Chat providers know user and assistant only."""
    return F.when(c == "assistant", c).otherwise(F.lit("user"))


def provider_text(parts: Column) -> Column:
    """Text of a provider's answer, array<struct<kind, text, name>>: its first text part, else a marker of its first tool call."""
    first = lambda kind: F.get(F.filter(parts, lambda p: p["kind"] == kind), F.lit(0))
    text, call = first("text"), first("tool_call")
    return F.coalesce(text["text"], F.concat(F.lit("[tool call: "), call["name"], F.lit("]")), F.lit(""))


def storage_key(namespace: Column, name: Column, version: Column) -> Column:
    return F.concat_ws(":", namespace, name, F.concat(F.lit("v"), version.cast("string")))


def bumped(version: Column, changed: Column) -> Column:
    return F.when(changed, F.least(version + 1, F.lit(VERSION_MAX))).otherwise(version)


def display(kind: Column, node: Column, step: Column, stream: Column, message: Column) -> Column:
    """[id@step] msg, [id] msg, [step n] msg, [LLM stream] chunk."""
    head = F.when(node.isNotNull() & step.isNotNull(), F.concat(F.lit("["), node, F.lit("@"), step.cast("string"), F.lit("] ")))
    head = head.when(node.isNotNull(), F.concat(F.lit("["), node, F.lit("] "))).when(step.isNotNull(), F.concat(F.lit("[step "), step.cast("string"), F.lit("] "))).otherwise(F.lit(""))
    return F.when(kind == "llm", F.concat(F.lit("[LLM "), F.coalesce(stream, F.lit("default")), F.lit("] "), message)).otherwise(F.concat(head, message))

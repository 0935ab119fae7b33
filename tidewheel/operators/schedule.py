"""Gate and routing: who runs in this superstep, and where each session goes next."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.model import END, is_virtual


def gate(frontier: DataFrame, versions: DataFrame, seen: DataFrame) -> DataFrame:
    """frontier(session_id, pos, node) with `run` and, for those that run, run_ord in frontier order.

    A custom node runs if it never did, or if messages or extra have a higher version than it last saw."""
    s = seen.select("session_id", "node", F.col("mv").alias("seen_m"), F.col("ev").alias("seen_e"))
    g = frontier.join(versions, "session_id").join(s, ["session_id", "node"], "left")
    run = ~is_virtual(F.col("node")) & (F.col("seen_m").isNull() | (F.col("mv") > F.col("seen_m")) | (F.col("ev") > F.col("seen_e")))
    g = g.withColumn("run", run)
    return g.withColumn("run_ord", F.when(F.col("run"), F.row_number().over(Window.partitionBy("session_id", "run").orderBy("pos")))).drop("seen_m", "seen_e")


def unregistered(ran: DataFrame, nodes: DataFrame) -> DataFrame:
    return ran.join(nodes.select("node").distinct(), "node", "left_anti")


def remember(seen: DataFrame, ran: DataFrame) -> DataFrame:
    """seen with the versions before the barrier for each node that ran."""
    new = ran.select("session_id", "node", "mv", "ev")
    return seen.select("session_id", "node", "mv", "ev").join(new.select("session_id", "node"), ["session_id", "node"], "left_anti").unionByName(new)


def commands_in_force(commands: DataFrame) -> DataFrame:
    """Of each node's commands the first Replace counts, with the Appends after it; without Replace all Appends do.

    Adds `replaced`: whether the node has a Replace at all."""
    w = Window.partitionBy("session_id", "node")
    c = commands.withColumn("first__", F.min(F.when(F.col("kind") == "replace", F.col("cmd_pos"))).over(w))
    keep = F.col("first__").isNull() | (F.col("cmd_pos") == F.col("first__")) | ((F.col("kind") == "append") & (F.col("cmd_pos") > F.col("first__")))
    return c.where(keep).withColumn("replaced", F.col("first__").isNotNull()).drop("first__")


def next_frontier(ran: DataFrame, edges: DataFrame, commands: DataFrame, routed: DataFrame, nodes: DataFrame) -> DataFrame:
    """(session_id, pos, node): per ran node static edges, then command targets, then predicate targets; kept first.

    ran(session_id, run_ord, node); commands(session_id, node, cmd_pos, kind, targets); routed(session_id, node, idx,
    targets) holds each predicate's targets on the state after the barrier. A Replace suppresses static and predicate
    targets of its node. Unknown targets are dropped, Start and End stay."""
    r = ran.select("session_id", "run_ord", "node")
    c = commands_in_force(commands)
    replaced = c.where("replaced").select("session_id", "node").distinct()
    free = r.join(replaced, ["session_id", "node"], "left_anti")
    static = free.join(edges.select(F.col("src").alias("node"), "dst", F.col("pos").alias("edge_pos")), "node").select("session_id", "run_ord", F.lit(0).alias("class"), F.col("edge_pos").cast("int").alias("a"), F.lit(0).alias("b"), F.col("dst").alias("target"))
    by_command = r.join(c.select("session_id", "node", "cmd_pos", "targets"), ["session_id", "node"]).select("session_id", "run_ord", F.lit(1).alias("class"), F.col("cmd_pos").cast("int").alias("a"), F.posexplode("targets").alias("b", "target"))
    by_state = free.join(routed, ["session_id", "node"]).select("session_id", "run_ord", F.lit(2).alias("class"), F.col("idx").cast("int").alias("a"), F.posexplode("targets").alias("b", "target"))
    every = static.unionByName(by_command).unionByName(by_state)
    registry = nodes.select(F.col("node").alias("target")).distinct().withColumn("known", F.lit(True))  # as large as the workflow's definition
    known = every.join(registry, "target", "left").where(is_virtual(F.col("target")) | F.col("known"))
    first = known.groupBy("session_id", "target").agg(F.min(F.struct("run_ord", "class", "a", "b")).alias("at"))
    return first.select("session_id", (F.row_number().over(Window.partitionBy("session_id").orderBy("at")) - 1).alias("pos"), F.col("target").alias("node"))


def complete(sessions: DataFrame, frontier: DataFrame) -> DataFrame:
    """sessions(session_id) with `done`: no frontier, or End alone."""
    f = frontier.groupBy("session_id").agg(F.bool_and(F.col("node") == END).alias("ends"))
    return sessions.select("session_id").distinct().join(f, "session_id", "left").select("session_id", F.coalesce("ends", F.lit(True)).alias("done"))


def interrupted(frontier: DataFrame, nodes: list[str]) -> DataFrame:
    """The first frontier node of each session that is to pause it, in frontier order."""
    return frontier.where(F.col("node").isin(nodes)).groupBy("session_id").agg(F.min_by("node", "pos").alias("node"))

"""Connected components of a link table, with alternating stars; labels never leave the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.shared import stash, unstash


def _is_settled(edges: DataFrame) -> bool:
    """Whether edges(u, v) with u > v are stars: each u has one v, and no v is a u."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up + down > 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for each node of edges(u, v): comp is the smallest node that links reach.

    Each round moves every node's larger neighbours, then its smaller ones, to the smallest node known, until nothing
    moves; long chains shrink geometrically. Nulls and self-links are ignored, repeated links count once."""
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()
    e = stash(e, "edges")
    while not _is_settled(e):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(near, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            near.where("u > m").select("u", F.col("m").alias("v"))
        ).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, e = e, stash(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        unstash(last)
    out = e.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(e.select("v", "v").distinct())
    out._stash_path = e._stash_path  # for unstash, once nothing reads the labels any more
    return out

"""Cutting lineage with tables in the folder that the session's spark.checkpoint.dir names."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A session without one works on a single machine only: it gets a local one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "/tmp/checkpoints/tidewheel"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again; it survives the loss of any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_all(*frames: DataFrame | None) -> list[DataFrame | None]:
    """Each cut, the jobs of all side by side; None stays."""
    some = [f for f in frames if f is not None]
    if len(some) < 2:
        return [None if f is None else cut(f) for f in frames]
    with ThreadPoolExecutor(len(some)) as pool:
        made = iter(list(pool.map(inheritable_thread_target(some[0].sparkSession)(cut), some)))
    return [None if f is None else next(made) for f in frames]

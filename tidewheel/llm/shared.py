"""Helpers that the operators of this package share: tables in the shared folder and byte-exact word rules."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only where the session names none and runs on one machine, as in tests, is a
    local one set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "/tmp/checkpoints/tidewheel"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Spark deletes the shuffle files of a written plan as soon as it is written.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: cuts lineage, and survives the loss of any executor."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    before = spark.conf.get(TIDY, "false")
    spark.conf.set(TIDY, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(TIDY, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stash_path = path
    return out


def unstash(df: DataFrame) -> None:
    """Deletes a stashed table that no later plan reads."""
    spark, path = df.sparkSession, df._stash_path
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def helper(df: DataFrame, name: str) -> str:
    """A column name for intermediate results that no column of df has, in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, f"{name}__"
    while out in taken:
        out += "_"
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids fall into fold 0."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % n, F.lit(0)).cast("int")


def to_bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2^64
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE)) | np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 ... base^(n-1) or more of them, modulo 2^64."""
    out = _powers.get(base)
    if out is None or len(out) < n:
        out, step = np.ones(1, np.uint64), base
        while len(out) < max(n, 1 << 16):
            out, step = np.concatenate([out, out * np.uint64(step)]), step * step % (1 << 64)
        if len(out) <= 1 << 20:  # larger ones go again with their text
            _powers[base] = out
    return out


_APART = np.ones(256, bool)
_APART[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False


def word_hashes(data: bytes, apart: np.ndarray = _SPACE, heads: tuple[int, ...] = ()) -> np.ndarray:
    """64-bit hashes of the words [^\\x20\\x09-\\x0D]+ in order, A-Z as a-z: polynomials over the bytes from one running sum.

    For each of `heads`, the first so many bytes of longer words follow as further members."""
    b = np.frombuffer(data, np.uint8)
    space = np.ones(len(b) + 2, bool)
    np.take(apart, b, out=space[1:-1])
    edge = np.flatnonzero(space[1:] != space[:-1])
    start, end = edge[::2], edge[1::2]
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTE[b] * powers(BASE, len(b))[: len(b)], out=total[1:])
    back = powers(pow(BASE, -1, 1 << 64), len(b) + 1)
    out = [mix((total[end] - total[start]) * back[start])]
    for k in heads:
        at = start[end - start > k]
        out.append(mix((total[at + k] - total[at]) * back[at] + np.uint64(k)))
    return np.concatenate(out) if heads else out[0]


def letter_hashes(data: bytes, heads: tuple[int, ...] = ()) -> np.ndarray:
    """As word_hashes, with words of letters and of all beyond ASCII."""
    return word_hashes(data, _APART, heads)


def letter_places(data: bytes, heads: tuple[int, ...] = ()) -> np.ndarray:
    """The number of the word that each member of letter_hashes comes from."""
    space = np.ones(len(data) + 2, bool)
    np.take(_APART, np.frombuffer(data, np.uint8), out=space[1:-1])
    edge = np.flatnonzero(space[1:] != space[:-1])
    size = edge[1::2] - edge[::2]
    return np.concatenate([np.arange(len(size)), *(np.flatnonzero(size > k) for k in heads)])

"""Deterministic hashes and ids as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: FNV-1a, 64 bits (fixed values).
OFFSET, PRIME = 14695981039346656037, 1099511628211


def fnv_parts(parts: Column) -> Column:
    """16 hex digits of FNV-1a over the UTF-8 bytes of each part and 0xFF after it, in two 32-bit halves.

    PRIME is 2^40 + 435, so h * PRIME mod 2^64 takes the low half's product with 435, its carry, and the low half
    shifted by 40; everything stays within 64-bit integers, also in ANSI mode."""
    each = F.transform(parts, lambda p: F.concat(F.hex(F.encode(p, "UTF-8")), F.lit("FF")))
    pairs = F.regexp_extract_all(F.array_join(each, ""), F.lit("(..)"), F.lit(1))
    values = F.transform(pairs, lambda x: F.conv(x, 16, 10).cast("bigint"))
    low32 = F.lit((1 << 32) - 1).cast("bigint")
    small = F.lit(PRIME - (1 << 40)).cast("bigint")

    def step(h: Column, b: Column) -> Column:
        low = h["low"].bitwiseXOR(b)
        product = low * small
        high = h["high"] * small + F.shiftright(product, 32) + F.shiftleft(low.bitwiseAND(F.lit((1 << 24) - 1).cast("bigint")), 8)
        return F.struct(high.bitwiseAND(low32).alias("high"), product.bitwiseAND(low32).alias("low"))

    start = F.struct(F.lit(OFFSET >> 32).cast("bigint").alias("high"), F.lit(OFFSET & ((1 << 32) - 1)).cast("bigint").alias("low"))
    h = F.aggregate(values, start, step)
    return F.lower(F.concat(F.lpad(F.hex(h["high"]), 8, "0"), F.lpad(F.hex(h["low"]), 8, "0")))


def fnv_text(parts: list[str]) -> str:
    """The same of a list on the driver, for configurations."""
    h = OFFSET
    for b in b"".join(p.encode() + b"\xff" for p in parts):
        h = (h ^ b) * PRIME % (1 << 64)
    return f"{h:016x}"


def name_seed(name: Column, base: int = 0) -> Column:
    """h * 31 + byte over the name's bytes from the base, modulo 2^64, as decimal."""
    pairs = F.regexp_extract_all(F.hex(F.encode(name, "UTF-8")), F.lit("(..)"), F.lit(1))
    whole = F.lit(str(1 << 64)).cast("decimal(38,0)")
    poly = F.aggregate(F.transform(pairs, lambda x: F.conv(x, 16, 10).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"), lambda h, b: F.pmod((h.cast("decimal(20,0)") * F.lit(31).cast("decimal(3,0)") + b).cast("decimal(38,0)"), whole).cast("decimal(38,0)"))
    return F.pmod((poly + F.lit(str(base)).cast("decimal(20,0)")).cast("decimal(38,0)"), whole).cast("decimal(20,0)")


def generated_id(n: Column, prefix: str | None = None, seed: int | None = None, counter: bool = False, timestamp: Column | None = None) -> Column:
    """[prefix-] seeded-S[-N], counter-N or a random id, [-tT]; n is the number of the id, from 0."""
    if seed is not None:
        base = F.concat(F.lit(f"seeded-{seed}"), *([F.lit("-"), n.cast("string")] if counter else []))
    else:
        base = F.concat(F.lit("counter-"), n.cast("string")) if counter else F.uuid()
    return F.concat_ws("-", *([F.lit(prefix)] if prefix else []), base, *([F.concat(F.lit("t"), timestamp.cast("string"))] if timestamp is not None else []))


def kind_id(kind: str, n: Column, seed: int | None = None, counter: bool = False) -> Column:
    """Ids of runs, steps, nodes and sessions: the kind is the prefix, without a configured one and without a time."""
    if kind not in ("run", "step", "node", "session"):
        raise ValueError(kind)
    return generated_id(n, kind, seed, counter)


def seeded_id(prefix: str, seed: int, n: Column) -> Column:
    return generated_id(n, prefix, seed, True)


def is_valid_id(c: Column, prefix: str | None = None) -> Column:
    """Whether an id has a part before and after a dash, and the prefix if one is asked for."""
    valid = F.coalesce(F.instr(c, "-") > 0, F.lit(False))
    return valid & (F.substring_index(c, "-", 1) == prefix) if prefix is not None else valid


def id_type(c: Column) -> Column:
    """What stands before the first dash."""
    return F.substring_index(c, "-", 1)


def parse_id(c: Column) -> tuple[Column, Column, Column]:
    """(prefix, rest, timestamp), null for an id that is not valid: split at the first dash; the timestamp is the number of
    the first segment that begins with t."""
    ok = is_valid_id(c)
    rest = F.regexp_replace(c, "^[^-]*-", "")
    stamp = F.get(F.filter(F.split(rest, "-"), lambda p: p.startswith("t")), F.lit(0))
    number = F.when(stamp.rlike(r"^t[+-]?\d+$"), F.substring(stamp, 2, 30)).try_cast("bigint")
    return F.when(ok, F.substring_index(c, "-", 1)), F.when(ok, rest), F.when(ok, number)


def random_fraction(seed: int, *keys: Column) -> Column:
    """Uniform in [0, 1) from the seed and keys, whatever the order of rows."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 53)) / float(1 << 53)

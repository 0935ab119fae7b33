"""Seeded random numbers as columns: each is a function of seed, row key and number of the draw, so that neither the order
of rows nor a task that runs again changes it. They are not the bit stream of any sequential generator."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewheel.functions.hashing import name_seed

LETTERS = "abcdefghijklmnopqrstuvwxyz"
ALPHANUMERIC = LETTERS.upper() + LETTERS + "0123456789"


@dataclass(frozen=True)
class Seeded:
    """seed: a number as text or column; key: what tells rows apart; draw: how many were drawn before."""

    seed: Column
    key: Column
    draw: int = 0

    @staticmethod
    def of(seed: int, key: Column) -> "Seeded":
        return Seeded(F.lit(str(seed)), key)

    def next(self) -> "Seeded":
        return Seeded(self.seed, self.key, self.draw + 1)

    def reset(self) -> "Seeded":
        return Seeded(self.seed, self.key)

    def fork(self) -> "Seeded":
        """A generator whose seed is this one's next number."""
        return Seeded(self.u64().cast("string"), self.key)

    def _hex(self, *more: Column) -> Column:
        return F.md5(F.concat_ws(":", self.seed, F.lit(str(self.draw)), self.key.cast("string"), *more).cast("binary"))

    def u64(self) -> Column:
        """decimal(20, 0) below 2^64."""
        return F.conv(F.substring(self._hex(), 1, 16), 16, 10).cast("decimal(20,0)")

    def u32(self, *more: Column) -> Column:
        return F.conv(F.substring(self._hex(*more), 1, 8), 16, 10).cast("bigint")

    def bool_(self) -> Column:
        return self.u32() % 2 == 1

    def f64(self) -> Column:
        """In [0, 1), a multiple of 2^-52."""
        return F.conv(F.substring(self._hex(), 1, 13), 16, 10).cast("bigint").cast("double") / float(1 << 52)

    def range_(self, least: int, below: int, *more: Column) -> Column:
        """least where the range is empty; by remainder, as small ranges allow."""
        return F.lit(least).cast("bigint") if least >= below else self.u32(*more) % (below - least) + least

    def _text(self, n: int, letters: str) -> Column:
        if n < 1:
            return F.lit("")
        each = lambda i: F.substring(F.lit(letters), (self.range_(0, len(letters), i.cast("string")) + 1).cast("int"), F.lit(1))
        return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), each), "")

    def string(self, n: int) -> Column:
        return self._text(n, LETTERS)

    def alphanumeric(self, n: int) -> Column:
        return self._text(n, ALPHANUMERIC)

    def choose(self, choices: Column) -> Column:
        """One of an array's elements, null without any."""
        return F.when(F.size(choices) > 0, F.get(choices, (self.u32() % F.greatest(F.size(choices), F.lit(1))).cast("int")))


class Registry:
    """Generators by name: the seed is the base plus a polynomial of the name's bytes."""

    def __init__(self, base: int):
        self.base, self.names = base, {}

    def named(self, name: str, key: Column) -> Seeded:
        self.names.setdefault(name, 0)
        return Seeded(name_seed(F.lit(name), self.base).cast("string"), key, self.names[name])

    def advance(self, name: str) -> None:
        self.names[name] = self.names.get(name, 0) + 1

    def reset_all(self) -> None:
        self.names = dict.fromkeys(self.names, 0)

    def __len__(self) -> int:
        return len(self.names)

"""Keyed randomness: the same keys give the same draw on every retry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def order_key(seed, *keys: Column) -> Column:
    """Hex text whose order is a shuffle; other engines can compute it too."""
    parts = [F.lit(str(seed))] + [k.cast("string") for k in keys]
    return F.md5(F.concat_ws(":", *parts))


class Draws:
    """Draws from a 64-bit hash: a few nanoseconds each, all in the JVM."""

    def order(self, seed, *keys: Column) -> Column:
        """Hex text of fixed length whose order is a shuffle of the keys."""
        return F.lpad(F.hex(F.xxhash64(F.lit(str(seed)), *keys)), 16, "0")

    def uniform(self, seed: int, *keys: Column) -> Column:
        """A draw from [0, 1)."""
        bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11)
        return bits.cast("double") / F.lit(float(1 << 53))

    def pick(self, seed: int, n: Column, *keys: Column) -> Column:
        """An index from 0 to n-1."""
        return F.pmod(F.xxhash64(F.lit(seed), *keys), n.cast("bigint")).cast("int")


class PortableDraws(Draws):
    """The same from MD5, for results that other engines must reproduce."""

    def order(self, seed, *keys: Column) -> Column:
        return order_key(seed, *keys)

    def _number(self, digits: int, seed: int, *keys: Column) -> Column:
        return F.conv(F.substring(order_key(seed, *keys), 1, digits), 16, 10).cast("bigint")

    def uniform(self, seed: int, *keys: Column) -> Column:
        return self._number(13, seed, *keys).cast("double") / F.lit(float(1 << 52))

    def pick(self, seed: int, n: Column, *keys: Column) -> Column:
        return (self._number(15, seed, *keys) % n.cast("bigint")).cast("int")


FAST = Draws()
PORTABLE = PortableDraws()

"""Seeded, partition-independent randomness.

`rand(seed)` depends on how rows are partitioned, so it is never used. Every random order and
draw comes from `md5(seed:key)` and gives the same rows whatever the cluster layout is.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEX_DIGITS = 32


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def order_hash(seed: int | str | Column, key: Column | str) -> Column:
    """32 lower-case hex digits that order rows at random but reproducibly; a null key comes first."""
    seed_text = seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed))
    return F.coalesce(F.md5(F.concat(seed_text, F.lit(":"), as_column(key).cast("string"))), F.lit(""))


def hash_prefix(h: Column, digits: int) -> Column:
    """The leading hex digits: evenly filled buckets that sort as the hash does."""
    return F.substring(h, 1, digits)


def uniform(seed: int | str | Column, key: Column | str) -> Column:
    """A double in [0, 1) from the first 32 bits of the hash."""
    bits = F.conv(F.substring(order_hash(seed, key), 1, 8), 16, 10).cast("bigint")
    return bits / F.lit(4294967296.0)


def uniform_int(seed: int | str | Column, key: Column | str, low: int, high: int) -> Column:
    """An integer in [low, high], both ends included."""
    return (F.floor(uniform(seed, key) * F.lit(high - low + 1)) + F.lit(low)).cast("int")

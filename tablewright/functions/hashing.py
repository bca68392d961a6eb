"""Reproducible pseudo-random columns: they depend on the key and a seed, never on partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_order(key: Column, seed: str | int | Column) -> Column:
    """Hex digest of ``key:seed``; sorting by it is a shuffle of the rows."""
    tail = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat(key.cast("string"), F.lit(":"), tail))


def hash_uniform(key: Column, seed: str | int) -> Column:
    """A number in [0, 1) drawn from the first 32 bits of the digest."""
    return F.conv(F.substring(hash_order(key, seed), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def hash_uniform_pair(key: Column, seed: str | int) -> tuple[Column, Column]:
    """Two independent numbers in [0, 1) of 52 bits each, from the first 26 digits of the digest."""
    digest = hash_order(key, seed)
    first, second = (F.conv(F.substring(digest, at, 13), 16, 10).cast("double") / F.lit(2.0**52) for at in (1, 14))
    return first, second

"""Scalar column expressions. A null input gives a null result unless stated."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
SEASONS = ["Winter", "Spring", "Summer", "Fall"]


def clip(c: Column, lower=None, upper=None) -> Column:
    """``least``/``greatest`` would turn a null into the bound."""
    out = c
    if lower is not None:
        out = F.when(c < lower, F.lit(lower)).otherwise(out)
    if upper is not None:
        out = F.when(c > upper, F.lit(upper)).otherwise(out)
    return out


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def holds(condition: Column) -> Column:
    """True or false, never null."""
    return F.coalesce(condition, F.lit(False))


def micros(c: Column) -> Column:
    """Microseconds since the epoch of a date or timestamp."""
    return F.unix_micros(c.cast("timestamp"))


def days_between(start: Column, end: Column) -> Column:
    """Whole days from start to end, rounded down also when negative."""
    return F.floor((micros(end) - micros(start)) / F.lit(86_400_000_000)).cast("int")


def shifted_log(c: Column, base: float = math.e, offset: float = 1.0) -> Column:
    """Logarithm of ``c + offset + 1``, with negative values taken as zero."""
    floored = F.when(c < 0, F.lit(0.0)).otherwise(c)
    value = F.ln(floored + F.lit(offset + 1.0))
    return value if base == math.e else value / F.lit(math.log(base))


def season_number(date: Column) -> Column:
    """1 for December to February, then 2, 3 and 4."""
    return (F.floor(F.pmod(F.month(date), F.lit(12)) / 3) + 1).cast("int")


def season_name(date: Column) -> Column:
    # Not element_at: it yields a non-null column, and a null date would get some season.
    number = season_number(date)
    out = F.lit(None).cast("string")
    for i, name in enumerate(SEASONS, start=1):
        out = F.when(number == i, F.lit(name)).otherwise(out)
    return out


def binned(c: Column, edges: list[float], labels: list[str]) -> Column:
    """Right-closed bins; a value outside them is null."""
    out = F.lit(None).cast("string")
    for low, high, label in zip(edges, edges[1:], labels):
        out = F.when((c > low) & (c <= high), F.lit(label)).otherwise(out)
    return out


def lookup_literal(c: Column, mapping: dict) -> Column:
    """Small fixed dictionary; a missing key is null."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.create_map(*pairs)[c]




def digamma(x: Column) -> Column:
    """Derivative of the logarithm of the gamma function, for numbers above 0, within 1e-13.

    The series for large numbers, taken ten steps higher.
    """
    high = x + 10
    square = 1 / (high * high)
    series = F.ln(high) - 1 / (2 * high) - square * (1 / 12 - square * (1 / 120 - square * (1 / 252 - square * (1 / 240 - square / 132))))
    return series - sum((1 / (x + i) for i in range(1, 10)), 1 / x)

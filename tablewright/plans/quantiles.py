"""Exact, linearly interpolated quantiles of any number of columns.

The built-in ``percentile`` brings a counter per distinct value of every task into one
task. Here values are counted with a shuffle by value, and only when a column has few
distinct values are the counts put in order. For a column with more, a mergeable
sketch gives a bracket around each wanted rank; the rows below and inside the bracket
are counted, which proves that the rank is in it, and the bracket is narrowed until
few distinct values are left. Every pass covers all columns and returns a few numbers.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.plans.prefix import running_sums

MAX_DISTINCT = 1_000_000
# A sketch has some thousand entries per task at this accuracy; two passes narrow a
# column to one row in 60 000, three to one in 15 million.
ACCURACY = 1_000


@dataclass
class _Rank:
    """Row number ``rank`` (from 0) of column ``col``; known to lie in [low, high]."""

    col: str
    rank: int
    inside: int
    low: float | None = None
    high: float | None = None
    below: int = 0
    value: float | None = None
    #: The bracket cannot be narrowed although it has many distinct values.
    wide: bool = False

    def values(self) -> Column:
        c = F.col(self.col)
        return c if self.low is None else F.when((c >= self.low) & (c <= self.high), c)

    def share(self) -> float:
        return (self.rank - self.below) / max(self.inside - 1, 1)


def exact_quantiles(
    df: DataFrame, wanted: dict[str, tuple[Column, list[float]]], max_distinct: int | None = None, accuracy: int = ACCURACY
) -> dict[str, list[float | None]]:
    """Quantiles per name; a column without values gives ``None`` throughout."""
    limit = MAX_DISTINCT if max_distinct is None else max_distinct
    source = df.select(*[expr.cast("double").alias(n) for n, (expr, _) in wanted.items()])
    sizes = source.agg(
        *[F.count(n).alias(f"n_{n}") for n in wanted], *[F.approx_count_distinct(n).alias(f"d_{n}") for n in wanted]
    ).first()

    ranks: dict[tuple[str, int], _Rank] = {}
    for n, (_, qs) in wanted.items():
        count = sizes[f"n_{n}"]
        for q in qs if count else []:
            spot = (count - 1) * q
            for r in (math.floor(spot), math.ceil(spot)):
                ranks.setdefault((n, r), _Rank(n, r, count))
    ready = [r for r in ranks.values() if sizes[f"d_{r.col}"] <= limit]
    wide = [r for r in ranks.values() if sizes[f"d_{r.col}"] > limit]
    if wide:
        ready += _narrow(source, wide, limit, accuracy)
    for wide_bracket in (False, True):
        picked = [r for r in ready if r.wide == wide_bracket]
        if picked:
            _pick(source, picked, by_ranges=wide_bracket)

    def quantile(n: str, q: float) -> float | None:
        count = sizes[f"n_{n}"]
        if not count:
            return None
        spot = (count - 1) * q
        low, high = ranks[n, math.floor(spot)].value, ranks[n, math.ceil(spot)].value
        return low + (spot - math.floor(spot)) * (high - low)

    return {n: [quantile(n, q) for q in qs] for n, (_, qs) in wanted.items()}


def _narrow(source: DataFrame, ranks: list[_Rank], limit: int, accuracy: int) -> list[_Rank]:
    """Shrink the brackets; returns the ranks whose bracket is small, others get their value."""
    margin, done, active = 2.0 / accuracy, [], list(ranks)
    while active:
        # Two sketch errors on either side of the rank.
        probes = []
        for i, r in enumerate(active):
            edges = [max(r.share() - margin, 0.0), min(r.share() + margin, 1.0)]
            probes += [
                F.percentile_approx(r.values(), edges, accuracy).alias(f"p{i}"),
                F.min(r.values()).alias(f"lo{i}"),
                F.max(r.values()).alias(f"hi{i}"),
            ]
        row = source.agg(*probes).first()
        trial = []
        for i, r in enumerate(active):
            low = row[f"lo{i}"] if r.share() <= margin else row[f"p{i}"][0]
            high = row[f"hi{i}"] if r.share() >= 1 - margin else row[f"p{i}"][1]
            trial.append(_Rank(r.col, r.rank, r.inside, low, high))
        counts = []
        for i, t in enumerate(trial):
            counts += [
                F.count_if(F.col(t.col) < t.low).alias(f"b{i}"),
                F.count(t.values()).alias(f"n{i}"),
                F.approx_count_distinct(t.values()).alias(f"d{i}"),
            ]
        row = source.agg(*counts).first()
        again = []
        for i, (r, t) in enumerate(zip(active, trial)):
            below, inside = row[f"b{i}"], row[f"n{i}"]
            held = below <= r.rank < below + inside
            if held and t.low == t.high:
                r.value = t.low
                continue
            narrowed = held and inside < r.inside
            if held:
                r.low, r.high, r.below, r.inside = t.low, t.high, below, inside
            if narrowed and row[f"d{i}"] > limit:
                again.append(r)
            else:
                r.wide = row[f"d{i}"] > limit
                done.append(r)
        active = again
    return done


def _pick(source: DataFrame, ranks: list[_Rank], by_ranges: bool = False) -> None:
    """Read the wanted ranks off ordered value counts, one bracket per group.

    ``by_ranges`` orders them in many tasks; else a bracket is ordered in one, which its bound allows.
    """
    brackets = {(r.col, r.low, r.high): r for r in ranks}
    ids = {key: i for i, key in enumerate(brackets)}
    entries = [F.struct(F.lit(ids[key]).alias("id"), r.values().alias("value")) for key, r in brackets.items()]
    long = source.select(F.inline(F.array(*entries))).filter("value is not null")
    counts = long.groupBy("id", "value").agg(F.count("*").alias("n"))
    if by_ranges:
        totals = {r["id"]: r["n"] for r in counts.groupBy("id").agg(F.sum("n").alias("n")).collect()}
        before = F.lit(0)
        for i in totals:
            before = F.when(F.col("id") == i, F.lit(sum(n for j, n in totals.items() if j < i))).otherwise(before)
        ordered = running_sums(counts, [F.asc("id"), F.asc("value")], ["n"]).withColumn("upto", F.col("n_upto") - before)
    else:
        ordered = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("id").orderBy("value")))
    places = {i: sorted({r.rank - r.below for r in ranks if ids[r.col, r.low, r.high] == i}) for i in ids.values()}
    hit = F.lit(False)
    for i, spots in places.items():
        for s in spots:
            hit = hit | ((F.col("id") == i) & (F.col("upto") > s) & (F.col("upto") - F.col("n") <= s))
    rows = ordered.filter(hit).collect()
    for r in ranks:
        spot, i = r.rank - r.below, ids[r.col, r.low, r.high]
        r.value = next(x["value"] for x in rows if x["id"] == i and x["upto"] - x["n"] <= spot < x["upto"])

"""Splits and samples. Rows are ordered by a hash of their key, so a sample does not
depend on partitioning, and sizes are exact. A class is never sorted in one task:
``hash_cut`` finds one cut value per class and rows are chosen by comparison."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.expressions import lookup_literal
from tablewright.plans.rank_cut import hash_cut


def _share(fraction: float) -> Column:
    # Decimal arithmetic: 0.7 of 45 is 31.5 and not a little less.
    return F.round(F.col("n_rows") * F.lit(Decimal(str(fraction))))


def stratified_split(df: DataFrame, label: str, key: str, fractions: dict[str, float], rest: str, seed: str | int = 0) -> DataFrame:
    """Add ``split``: the same fractions of every class, the remaining rows in ``rest``."""
    upto, wants = 0.0, {}
    for name, fraction in fractions.items():
        upto = round(upto + fraction, 12)
        wants[name] = _share(upto)
    marks = hash_cut(df, key, wants, by=[label], seed=seed)
    split = F.lit(rest)
    for name in reversed(list(fractions)):
        split = F.when(marks[name], F.lit(name)).otherwise(split)
    return df.withColumn("split", split)


def random_sample(df: DataFrame, key: str, n: int | None = None, fraction: float | None = None, seed: str | int = 0) -> DataFrame:
    """Exactly ``n`` rows, or the rounded fraction of all rows."""
    want = F.lit(n) if n is not None else _share(fraction)
    return df.filter(hash_cut(df, key, {"take": want}, seed=seed)["take"])


def stratified_sample(df: DataFrame, label: str, key: str, fraction: float, seed: str | int = 0) -> DataFrame:
    """The whole part of ``fraction`` times the size of every class."""
    want = F.floor(F.col("n_rows") * F.lit(Decimal(str(fraction))))
    return df.filter(hash_cut(df, key, {"take": want}, by=[label], seed=seed)["take"])


def undersample(df: DataFrame, label: str, key: str, targets: dict[str, int], seed: str | int = 0) -> DataFrame:
    """At most the target number of rows for each listed class; other classes stay whole."""
    want = F.coalesce(lookup_literal(F.col("class_key"), {str(k): v for k, v in targets.items()}), F.col("n_rows"))
    return df.filter(hash_cut(df, key, {"take": want}, by=[label], seed=seed)["take"])


def balanced_bags(
    df: DataFrame, label: str, key: str, minority: str, n_bags: int = 3, relative_size: float = 1.0, seed: str | int = 0
) -> DataFrame:
    """``n_bags`` samples, each with as many majority as minority rows; column ``bag_id``.

    Every bag takes ``relative_size`` of the minority class without replacement, and a
    majority sample of the same size.
    """
    side = df.withColumn("is_minority", F.coalesce((F.col(label) == minority), F.lit(False)))
    n_minority = side.filter("is_minority").count()
    bags = side.withColumn("bag_id", F.explode(F.array(*[F.lit(b) for b in range(n_bags)])))
    order = F.concat(F.lit(f"{seed}:"), F.col("bag_id").cast("string"))
    want = F.lit(int(n_minority * relative_size))
    return bags.filter(hash_cut(bags, key, {"take": want}, by=["bag_id", "is_minority"], seed=order)["take"]).drop("is_minority")


def class_weights(df: DataFrame, label: str, weights: dict[str, float], name: str = "weight") -> DataFrame:
    """Weight 1 for classes that are not listed."""
    return df.withColumn(name, F.coalesce(lookup_literal(F.col(label), {k: float(v) for k, v in weights.items()}), F.lit(1.0)))

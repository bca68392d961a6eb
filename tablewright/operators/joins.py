"""Joins and alignments on the row key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.plans.lookup import WEIGHT, FittedTable, attach


def keep_keys(df: DataFrame, survivors: DataFrame, key: str) -> DataFrame:
    """Rows whose key is still present in another frame."""
    return df.join(survivors.select(key), key, "left_semi")


def align_columns(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Columns of both frames side by side; a key missing on one side gives nulls."""
    return left.join(right, key, "full")


def dictionary_lookup(df: DataFrame, column: str, dictionary: DataFrame, key: str) -> DataFrame:
    """Add the dictionary's columns; a missing key gives nulls. Keys must be unique."""
    counted = dictionary
    if not df.isStreaming:
        # How often the rows use each key, so that frequent keys are spread.
        used = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("used_key")).agg(F.count("*").alias(WEIGHT))
        counted = dictionary.join(used, F.col(key) == F.col("used_key"), "left").drop("used_key").fillna(0, [WEIGHT])
    return attach(df, FittedTable.of(counted), {column: key})


def group_statistic(df: DataFrame, group: str, statistic: Column, name: str, train: DataFrame | None = None) -> DataFrame:
    """Add a statistic of the row's group, computed on ``train`` (or on ``df``).

    Aggregating first keeps a frequent group small; a window over the group would not.
    """
    source = df if train is None else train
    stats = source.filter(F.col(group).isNotNull()).groupBy(group).agg(statistic.alias(name), F.count("*").alias(WEIGHT))
    return attach(df, FittedTable.of(stats), {group: group})


def scatter(df: DataFrame, predictions: DataFrame, key: str, column: str, default) -> DataFrame:
    """Put predictions of some rows onto all rows; the others get the default."""
    side = predictions.select(key, F.col(column).alias("scattered"))
    return df.join(side, key, "left").withColumn(column, F.coalesce("scattered", F.lit(default))).drop("scattered")


def stack(first: DataFrame, *more: DataFrame) -> DataFrame:
    for df in more:
        first = first.unionByName(df)
    return first

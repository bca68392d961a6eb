"""Profiling reports. Each is one aggregation over the table, reshaped afterwards."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.expressions import any_of, micros
from tablewright.plans.lookup import WEIGHT, FittedTable, attach
from tablewright.plans.quantiles import exact_quantiles
from tablewright.session import cut_lineage

LISTED_BELOW = 100


def _melt(row: DataFrame, ids: list[str], columns: list[str], name: str, value: str) -> DataFrame:
    """Turn a one-row frame of aggregates into one row per column."""
    return row.unpivot(ids, columns, name, value)


def missing_report(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Null count and percent of every column that has nulls, most first."""
    columns = columns or df.columns
    counts = df.agg(F.count("*").alias("n_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return (
        _melt(counts, ["n_rows"], columns, "column_name", "n_missing")
        .filter("n_missing > 0")
        .select("column_name", "n_missing", F.round(F.try_divide(100 * F.col("n_missing"), F.col("n_rows")), 2).alias("pct_missing"))
        .orderBy(F.desc("n_missing"), "column_name")
    )


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    rows = df.agg(*[F.count(c).alias(c) for c in columns], F.count("*").alias("n_rows"))
    return _melt(rows, ["n_rows"], columns, "column_name", "n_known").select(
        "column_name", (F.col("n_rows") - F.col("n_known")).alias("n_missing"), "n_known"
    )


def comissing_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows in which both columns of a pair are null."""
    pairs = list(combinations(columns, 2))
    counts = df.agg(*[F.count_if(F.col(a).isNull() & F.col(b).isNull()).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    rows = [F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.col(f"p{i}").alias("n_both_missing")) for i, (a, b) in enumerate(pairs)]
    return counts.select(F.inline(F.array(*rows)))


def incomplete_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with a null in any of the columns."""
    return df.filter(any_of([F.col(c).isNull() for c in columns]))


def incomplete_by_class(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """How many incomplete rows each class has; the null class is counted too."""
    return incomplete_rows(df, columns).groupBy(label).agg(F.count("*").alias("n_rows"))


def nullity_correlation(df: DataFrame, columns: list[str]) -> DataFrame:
    """Correlation of the null indicators of every pair, from counts alone."""
    pairs = list(combinations(columns, 2))
    counts = df.agg(
        F.count("*").alias("n"),
        *[F.count_if(F.col(c).isNull()).alias(f"n_{c}") for c in columns],
        *[F.count_if(F.col(a).isNull() & F.col(b).isNull()).alias(f"p{i}") for i, (a, b) in enumerate(pairs)],
    )
    rows = [
        F.struct(
            F.lit(a).alias("column_a"), F.lit(b).alias("column_b"),
            F.col(f"n_{a}").alias("n_a"), F.col(f"n_{b}").alias("n_b"), F.col(f"p{i}").alias("n_ab"), F.col("n"),
        )
        for i, (a, b) in enumerate(pairs)
    ]
    n, na, nb, nab = (F.col(c).cast("double") for c in ("n", "n_a", "n_b", "n_ab"))
    spread = na * (n - na) * nb * (n - nb)
    return (
        counts.select(F.inline(F.array(*rows)))
        .filter(spread > 0)
        .select("column_a", "column_b", ((n * nab - na * nb) / (F.sqrt(na * (n - na)) * F.sqrt(nb * (n - nb)))).alias("correlation"))
    )


def numeric_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact quartiles of each column."""
    quartiles = exact_quantiles(df, {c: (F.col(c), [0.25, 0.5, 0.75]) for c in columns})
    stats = df.agg(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.count(c).alias("n_known"),
                F.avg(c).alias("mean"),
                F.stddev_samp(c).alias("std"),
                F.min(c).cast("double").alias("minimum"),
                *[F.lit(q).cast("double").alias(name) for q, name in zip(quartiles[c], ("q25", "median", "q75"))],
                F.max(c).cast("double").alias("maximum"),
            ).alias(c)
            for c in columns
        ]
    )
    return stats.select(F.inline(F.array(*columns)))


def _long_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n) for all columns in one shuffle; nulls are left out."""
    text = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    long = text.unpivot([], columns, "column_name", "value").filter("value is not null")
    return long.groupBy("column_name", "value").agg(F.count("*").alias("n"))


def categorical_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """Non-null count, distinct count, commonest value (smallest on a tie), its frequency."""
    return _long_counts(df, columns).groupBy("column_name").agg(
        F.sum("n").alias("n_known"),
        F.count("*").alias("n_distinct"),
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("top"),
        F.max("n").alias("top_count"),
    )


def distinct_report(df: DataFrame, columns: list[str], listed_below: int = LISTED_BELOW) -> DataFrame:
    """Distinct count per column, with the sorted values where there are few."""
    counts = _long_counts(df, columns)
    sizes = FittedTable.of(counts.groupBy("column_name").agg(F.count("*").alias("n_distinct")))
    short = attach(counts, sizes, {"column_name": "column_name"}).filter(F.col("n_distinct") < listed_below)
    lists = FittedTable.of(short.groupBy("column_name").agg(F.array_join(F.array_sort(F.collect_list("value")), "|").alias("values_listed")))
    return attach(sizes.df, lists, {"column_name": "column_name"})


def value_counts(df: DataFrame, column: str, shares: bool = False, keep_null: bool = False) -> DataFrame:
    """Frequency of each value, most first; shares are of the counted rows."""
    rows = df if keep_null else df.filter(F.col(column).isNotNull())
    counts = rows.groupBy(column).agg(F.count("*").alias("n"))
    if shares:
        counts = cut_lineage(counts)
        total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        counts = counts.withColumn("share", F.try_divide(F.col("n"), F.lit(float(total))))
    return counts.orderBy(F.desc("n"), F.asc_nulls_last(column))


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    """Count and percent per class; the total is taken over the few class counts."""
    counts = value_counts(df, label, keep_null=True)
    return counts.withColumn("pct", 100 * (F.col("n") / F.sum("n").over(Window.partitionBy())))


def dependency_violations(df: DataFrame, group: str, target: str) -> DataFrame:
    """Values of ``target`` in groups where it is not unique, one row per (group, value)."""
    pairs = df.select(group, target).filter(F.col(target).isNotNull() & F.col(group).isNotNull()).distinct()
    sizes = FittedTable.of(pairs.groupBy(group).agg(F.count("*").alias("n_values"), F.count("*").alias(WEIGHT)).filter("n_values > 1"))
    return attach(pairs, sizes, {group: group}).filter("n_values is not null")


def code_dictionary(df: DataFrame, code: str, description: str) -> DataFrame:
    """Distinct (code, description) pairs with the number of descriptions of the code."""
    pairs = df.select(code, description).distinct()
    sizes = FittedTable.of(pairs.filter(F.col(code).isNotNull()).groupBy(code).agg(F.count("*").alias("n_for_code"), F.count("*").alias(WEIGHT)))
    return attach(pairs, sizes, {code: code}).orderBy(F.asc_nulls_last(code), F.asc_nulls_last(description))


def ambiguous_codes(df: DataFrame, code: str, description: str) -> DataFrame:
    """Number of repeated codes among the distinct pairs."""
    pairs = df.select(code, description).distinct()
    return pairs.groupBy(code).agg(F.count("*").alias("n")).agg(F.sum(F.col("n") - 1).alias("n_repeats"))


def rule_hits(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows for which each rule holds, and their percent, in one pass."""
    counts = df.agg(F.count("*").alias("n_rows"), *[F.count_if(r).alias(n) for n, r in rules.items()])
    return _melt(counts, ["n_rows"], list(rules), "rule", "n_hits").select(
        "rule", "n_hits", F.try_divide(100.0 * F.col("n_hits"), F.col("n_rows")).alias("pct_hits")
    )


def location_scale(df: DataFrame, columns: list[str], q: list[float]) -> DataFrame:
    """Mean, sample deviation and any exact quantiles, one row per (column, statistic)."""
    exact = exact_quantiles(df, {c: (F.col(c), q) for c in columns})
    stats = df.agg(*[x for c in columns for x in (F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"))])
    rows = []
    for c in columns:
        parts = [("mean", F.col(f"{c}_mean")), ("std", F.col(f"{c}_std"))]
        parts += [(f"q{p:g}", F.lit(v).cast("double")) for p, v in zip(q, exact[c])]
        rows += [F.struct(F.lit(c).alias("column_name"), F.lit(s).alias("statistic"), v.alias("value")) for s, v in parts]
    return stats.select(F.inline(F.array(*rows)))


def date_quantiles(df: DataFrame, columns: list[str], q: list[float]) -> dict[str, list[float | None]]:
    """Quantiles of dates or timestamps, in microseconds since the epoch."""
    return exact_quantiles(df, {c: (micros(F.col(c)), q) for c in columns})


def ranges_by(df: DataFrame, columns: list[str], by: str) -> DataFrame:
    aggregates = [x for c in columns for x in (F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"))]
    return df.groupBy(by).agg(*aggregates)


def sentinel_columns(df: DataFrame, columns: list[str], sentinels: list[str]) -> DataFrame:
    """Columns in which a sentinel occurs, with the number of rows."""
    counts = df.agg(*[F.count_if(F.col(c).isin(*sentinels)).alias(c) for c in columns])
    return _melt(counts, [], columns, "column_name", "n_sentinel").filter("n_sentinel > 0")


def rows_with_sentinel(df: DataFrame, columns: list[str], sentinels: list[str]) -> DataFrame:
    return df.filter(any_of([F.col(c).isin(*sentinels) for c in columns]))


def group_mean(df: DataFrame, group: str, measure: str) -> DataFrame:
    return df.groupBy(group).agg(F.avg(measure).alias("mean_value"))


def unmapped_codes(df: DataFrame, column: str, taxonomy: DataFrame, key: str) -> DataFrame:
    """Distinct non-null codes without an entry in the taxonomy."""
    codes = df.select(F.col(column).alias("code")).filter("code is not null").distinct()
    return codes.join(taxonomy.select(F.col(key).alias("code")), "code", "left_anti")


def smallest_distinct(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    return df.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column).limit(n)


def commonest(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    return value_counts(df, column).limit(n)

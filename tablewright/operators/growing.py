"""Profiles of a table that grows: partial states by period, merged into the reports of ``profile``.

A refresh reads the rows of the named periods only and writes their states: per column the moments (one row)
and the counts of its values. A period that is refreshed again replaces itself, also when it has no rows any more.
Reports add the states up and never read the table. Reports of moments read only the files of moments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewright.plans.prefix import running_sums
from tablewright.session import cut_lineage

STATE = (
    "column_name string, value string, n long, n_rows long, n_known long, mean double, squares double, minimum double, maximum double, "
    "period string, kind string"
)


def refresh(df: DataFrame, path: str, period: Column, periods: list[str], numeric: list[str], text: list[str]) -> None:
    """Write the states of the periods (their texts, a short list of new ones) from the rows whose ``period`` they are.

    Nulls count as missing; a NaN makes the moments of its column NaN, as it does in ``numeric_summary``.
    """
    spark = df.sparkSession
    columns = [*numeric, *[c for c in text if c not in numeric]]
    rows = df.select(period.cast("string").alias("period"), *columns).filter(F.col("period").isin(*periods))
    known = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.count("*").alias("n_rows"),
            F.count(c).alias("n_known"),
            *([F.avg(c), F.var_pop(c) * F.count(c), F.min(c), F.max(c)] if c in numeric else [F.lit(None)] * 4),
        ).cast("struct<column_name:string,n_rows:bigint,n_known:bigint,mean:double,squares:double,minimum:double,maximum:double>").alias(f"state_{i}")
        for i, c in enumerate(columns)
    ]
    by_period = rows.groupBy("period").agg(*known)
    moments = by_period.select("period", F.inline(F.array(*[F.col(f"state_{i}") for i in range(len(columns))]))).withColumn("kind", F.lit("moments"))
    texts = rows.select("period", *[F.col(c).cast("string").alias(c) for c in columns])
    long = texts.unpivot(["period"], columns, "column_name", "value").filter("value is not null")
    values = long.groupBy("period", "column_name", "value").agg(F.count("*").alias("n")).withColumn("kind", F.lit("values"))
    # A row without a column in every folder, so that a period without rows replaces itself too.
    marks = spark.createDataFrame([(p, k) for p in periods for k in ("moments", "values")], "period string, kind string")
    states = moments.unionByName(values, allowMissingColumns=True).unionByName(marks, allowMissingColumns=True)
    named = states.select(*[F.col(f.strip().split(" ")[0]) for f in STATE.split(",")])
    # Rows of a folder meet before the write: few files a period, values of a large one spread over several tasks.
    spread = named.repartition("period", "kind", F.pmod(F.xxhash64("column_name", "value"), F.lit(8)))
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("period", "kind").parquet(path)


def _states(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.schema(STATE).parquet(path).filter((F.col("kind") == kind) & F.col("column_name").isNotNull())


def merged_moments(spark: SparkSession, path: str) -> DataFrame:
    """``column_name, n_rows, n_known, mean, squares, minimum, maximum`` over all periods; squares are about the common mean."""
    states = _states(spark, path, "moments")
    # One row per column and period.
    column = Window.partitionBy("column_name")
    n, mean = F.col("n_known"), F.col("mean")
    common = F.try_divide(F.sum(n * mean).over(column), F.sum(F.when(mean.isNotNull(), n)).over(column))
    return (
        states.withColumn("common", common)
        .groupBy("column_name")
        .agg(
            F.sum("n_rows").alias("n_rows"),
            F.sum("n_known").alias("n_known"),
            F.max("common").alias("mean"),
            F.sum(F.col("squares") + n * (mean - F.col("common")) * (mean - F.col("common"))).alias("squares"),
            F.min("minimum").alias("minimum"),
            F.max("maximum").alias("maximum"),
        )
    )


def merged_counts(spark: SparkSession, path: str) -> DataFrame:
    """``column_name, value, n`` over all periods."""
    return _states(spark, path, "values").groupBy("column_name", "value").agg(F.sum("n").alias("n"))


def merged_missing(spark: SparkSession, path: str) -> DataFrame:
    """As ``profile.missing_report``."""
    missing = F.col("n_rows") - F.col("n_known")
    report = merged_moments(spark, path).select("column_name", missing.alias("n_missing"), F.round(F.try_divide(100 * missing, F.col("n_rows")), 2).alias("pct_missing"))
    return report.filter("n_missing > 0").orderBy(F.desc("n_missing"), "column_name")


def merged_numeric(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """As ``profile.numeric_summary``, quartiles included: they are read off running sums of the counts."""
    moments = cut_lineage(merged_moments(spark, path).filter(F.col("column_name").isin(*columns)))
    counts = merged_counts(spark, path).filter(F.col("column_name").isin(*columns))
    # Values that are one number (0 and -0) are added up once more; order and sums are of numbers.
    numbers = counts.groupBy("column_name", (F.col("value").cast("double") + F.lit(0.0)).alias("x")).agg(F.sum("n").alias("n"))
    placed = running_sums(numbers, [F.col("column_name"), F.col("x")], ["n"])
    # The columns follow each other in the order; each starts after the known values of those before it.
    before = Window.orderBy("column_name").rowsBetween(Window.unboundedPreceding, -1)
    starts = moments.select("column_name", "n_known", F.coalesce(F.sum("n_known").over(before), F.lit(0)).alias("start"))  # one row per column
    ranked = placed.join(F.broadcast(starts), "column_name")
    first, after = F.col("n_upto") - F.col("n") - F.col("start"), F.col("n_upto") - F.col("start")
    picks = []
    for q, name in ((0.25, "q25"), (0.5, "median"), (0.75, "q75")):
        at = (F.col("n_known") - 1) * q
        for rank, end in ((F.floor(at), "low"), (F.ceil(at), "high")):
            picks.append(F.max(F.when((first <= rank) & (rank < after), F.col("x"))).alias(f"{name}_{end}"))
        picks.append(F.max(at - F.floor(at)).alias(f"{name}_part"))
    quartiles = ranked.groupBy("column_name").agg(*picks)
    between = [(F.col(f"{n}_low") + (F.col(f"{n}_high") - F.col(f"{n}_low")) * F.col(f"{n}_part")).alias(n) for n in ("q25", "median", "q75")]
    deviation = F.when(F.col("n_known") > 1, F.sqrt(F.col("squares") / (F.col("n_known") - 1)))
    return moments.join(F.broadcast(quartiles), "column_name", "left").select("column_name", "n_known", "mean", deviation.alias("std"), "minimum", *between, "maximum")


def merged_categorical(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """As ``profile.categorical_summary``."""
    return merged_counts(spark, path).filter(F.col("column_name").isin(*columns)).groupBy("column_name").agg(
        F.sum("n").alias("n_known"),
        F.count("*").alias("n_distinct"),
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("top"),
        F.max("n").alias("top_count"),
    )


def merged_value_counts(spark: SparkSession, path: str, column: str) -> DataFrame:
    """``value, n`` of one column, most first."""
    return merged_counts(spark, path).filter(F.col("column_name") == column).select("value", "n").orderBy(F.desc("n"), "value")

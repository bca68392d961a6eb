"""Outliers. Bounds come from the training rows; training rows outside them are
dropped, rows of the other splits are capped (``split`` column, train = 'train').
Bounds are a handful of numbers and enter the plan as literals."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.expressions import clip, holds, micros
from tablewright.operators.base import FittedOperator, step
from tablewright.plans.quantiles import exact_quantiles

# Fixed values.
IQR_FACTOR = 1.5
AGE_RANGE = (14, 83)
VISIT_LIMIT = 20


def is_train() -> Column:
    return F.col("split") == "train"


def _bounds(df: DataFrame, expr: Column, factor: float) -> tuple[float, float]:
    q1, q3 = exact_quantiles(df, {"x": (expr, [0.25, 0.75])})["x"]
    if q1 is None:
        raise ValueError("no values to take quartiles of")
    return q1 - factor * (q3 - q1), q3 + factor * (q3 - q1)


class EarlyDates(FittedOperator):
    """Dates before a low percentile of the training dates.

    Training rows before it, and those without a date, are dropped. In other rows the
    companion date is set to null and the date is raised to the bound; the result is a
    timestamp because an interpolated percentile may fall inside a day.
    """

    defaults = {"date": "accident_date", "companion": "c2_date", "q": 0.01}

    def learn(self, train, args):
        bound = exact_quantiles(train, {"d": (micros(F.col(args["date"])), [args["q"]])})["d"][0]
        if bound is None:
            raise ValueError(f"{args['date']} has no training values")
        return {"bound_micros": math.floor(bound)}, {}

    @staticmethod
    def apply(df, args, scalars, tables):
        date, companion = args["date"], args["companion"]
        bound = F.timestamp_micros(F.lit(scalars["bound_micros"]))
        early = F.col(date).cast("timestamp") < bound
        capped = F.when(early, bound).otherwise(F.col(date).cast("timestamp"))
        return df.filter(~is_train() | holds(~early)).withColumns(
            {
                companion: F.when(early & ~is_train(), F.lit(None)).otherwise(F.col(companion)),
                date: capped.cast("timestamp_ntz"),
            }
        )


class ImplausibleAge(FittedOperator):
    """Age far above the training mean or under the legal age: age and birth year become null."""

    defaults = {"age": "age", "birth_year": "birth_year", "minimum": 14, "z_limit": 3.0}

    def learn(self, train, args):
        row = train.agg(F.avg(args["age"]).alias("mean"), F.stddev_samp(args["age"]).alias("std")).first()
        return {"mean": row["mean"], "std": row["std"]}, {}

    @staticmethod
    def apply(df, args, scalars, tables):
        age = F.col(args["age"])
        # No deviation, as of equal ages, is no z-score.
        z = F.try_divide(age - F.lit(scalars["mean"]).cast("double"), F.lit(scalars["std"]).cast("double"))
        out = holds((z > args["z_limit"]) | (age < args["minimum"]))
        return df.withColumns({c: F.when(out, F.lit(None)).otherwise(F.col(c)) for c in (args["age"], args["birth_year"])})


@step
def null_implausible_birth_year(df: DataFrame, date: str, birth_year: str, low: int = AGE_RANGE[0], high: int = AGE_RANGE[1]) -> DataFrame:
    """Birth year becomes null where it makes the age at the date fall outside the range."""
    derived = F.year(date) - F.col(birth_year)
    return df.withColumn(birth_year, F.when(holds(~derived.between(low, high)), F.lit(None)).otherwise(F.col(birth_year)))


@step
def keep_up_to(df: DataFrame, column: str, limit: float = VISIT_LIMIT) -> DataFrame:
    return df.filter((F.col(column) <= limit) | F.col(column).isNull())


@step
def cap(df: DataFrame, column: str, limit: float = VISIT_LIMIT) -> DataFrame:
    return df.withColumn(column, clip(F.col(column), upper=limit))


@step
def limit_by_split(df: DataFrame, column: str, limit: float = VISIT_LIMIT) -> DataFrame:
    """Training rows above the limit are dropped, other rows are capped."""
    above = holds(F.col(column) > limit)
    return df.filter(~(is_train() & above)).withColumn(column, F.when(above, F.lit(limit)).otherwise(F.col(column)))


class LogIqr(FittedOperator):
    """Quartile fences of the logarithm of the positive training values.

    Training rows are kept when null, zero or within the fences; other rows have
    their positive values moved to the fences.
    """

    defaults = {"column": "wage", "factor": IQR_FACTOR}

    def learn(self, train, args):
        c = F.col(args["column"])
        low, high = _bounds(train, F.when(c > 0, F.ln(c)), args["factor"])
        return {"low": math.exp(low), "high": math.exp(high)}, {}

    @staticmethod
    def apply(df, args, scalars, tables):
        c = F.col(args["column"])
        low, high = scalars["low"], scalars["high"]
        kept = c.isNull() | (c == 0) | c.between(low, high)
        capped = F.when(c > 0, clip(c, low, high)).otherwise(c)
        return df.filter(~is_train() | kept).withColumn(args["column"], F.when(is_train(), c).otherwise(capped))


class IqrTrim(FittedOperator):
    """Keep rows within the quartile fences of the training values; nulls are dropped.

    With ``log`` the fences are those of ``ln(1 + x)``; ``state()`` then also has them
    on the original scale. ``only_train`` leaves the other splits untouched.
    """

    defaults = {"column": None, "factor": IQR_FACTOR, "log": False, "only_train": False}

    def learn(self, train, args):
        c = F.col(args["column"])
        low, high = _bounds(train, F.log1p(c) if args["log"] else c, args["factor"])
        if args["log"]:
            return {"low": low, "high": high, "low_value": math.expm1(low), "high_value": math.expm1(high)}, {}
        return {"low": low, "high": high}, {}

    @staticmethod
    def apply(df, args, scalars, tables):
        c = F.log1p(F.col(args["column"])) if args["log"] else F.col(args["column"])
        kept = c.between(scalars["low"], scalars["high"])
        if args["only_train"]:
            kept = kept | ~is_train()
        return df.filter(kept)


def date_fences(df: DataFrame, date: str, factor: float = IQR_FACTOR) -> DataFrame:
    """Quartile fences of a date in epoch seconds, as timestamps, with the rows outside."""
    low, high = _bounds(df, micros(F.col(date)) / F.lit(1_000_000.0), factor)
    seconds = micros(F.col(date)) / F.lit(1_000_000.0)
    return df.agg(F.count_if((seconds < low) | (seconds > high)).alias("n_outside")).select(
        F.timestamp_micros(F.lit(math.floor(low * 1_000_000))).cast("timestamp_ntz").alias("low_date"),
        F.timestamp_micros(F.lit(math.floor(high * 1_000_000))).cast("timestamp_ntz").alias("high_date"),
        "n_outside",
    )


class BelowQuantile(FittedOperator):
    """Keep rows strictly under a high training quantile; nulls are dropped."""

    defaults = {"column": None, "q": 0.9999}

    def learn(self, train, args):
        return {"bound": exact_quantiles(train, {"x": (F.col(args["column"]), [args["q"]])})["x"][0]}, {}

    @staticmethod
    def apply(df, args, scalars, tables):
        return df.filter(F.col(args["column"]) < scalars["bound"])


@step
def keep_between(df: DataFrame, column: str, at_least: float | None = None, below: float | None = None) -> DataFrame:
    """Threshold filter with known bounds; nulls are dropped."""
    if at_least is not None:
        df = df.filter(F.col(column) >= at_least)
    if below is not None:
        df = df.filter(F.col(column) < below)
    return df

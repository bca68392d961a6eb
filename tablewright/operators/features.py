"""Derived features as pipeline steps."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.expressions import binned, clip, days_between, season_name, season_number, shifted_log
from tablewright.operators.base import FittedOperator, step
from tablewright.plans.quantiles import exact_quantiles


@step
def add_days_between(df: DataFrame, start: str, end: str, into: str | None = None) -> DataFrame:
    return df.withColumn(into or f"days_between_{end}_{start}", days_between(F.col(start), F.col(end)))


@step
def add_log(df: DataFrame, column: str, base: float = math.e, offset: float = 1.0) -> DataFrame:
    """``<c>_log``; the source column keeps its value but negatives become zero."""
    c = F.col(column)
    floored = F.when(c < 0, F.lit(0).cast(df.schema[column].dataType)).otherwise(c)
    return df.withColumns({f"{column}_log": shifted_log(c, base, offset), column: floored})


@step
def add_season(df: DataFrame, date: str, named: bool = True) -> DataFrame:
    return df.withColumn(f"{date}_season", season_name(F.col(date)) if named else season_number(F.col(date)))


@step
def add_date_parts(df: DataFrame, date: str) -> DataFrame:
    """Weekday (Monday = 0), month and year."""
    return df.withColumns({f"{date}_day_of_week": F.weekday(date), f"{date}month": F.month(date), f"{date}year": F.year(date)})


class IncomeClass(FittedOperator):
    """Low Income up to the 25 % quantile, Middle Class up to the 85 % quantile, Wealthy above, Unknown if null."""

    defaults = {"column": "wage", "into": "income_class", "q": [0.25, 0.85]}

    def learn(self, train, args):
        low, high = exact_quantiles(train, {"x": (F.col(args["column"]), args["q"])})["x"]
        return {"low": low, "high": high}, {}

    @staticmethod
    def apply(df, args, scalars, tables):
        c = F.col(args["column"])
        # Without training values both bounds are null, and every class is unknown.
        low, high = (F.lit(scalars[q]).cast("double") for q in ("low", "high"))
        named = F.when(c <= low, "Low Income").when(c <= high, "Middle Class").when(c > high, "Wealthy").otherwise("Unknown")
        return df.withColumn(args["into"], named)


@step
def add_bins(df: DataFrame, column: str, into: str, edges: list[float], labels: list[str]) -> DataFrame:
    return df.withColumn(into, binned(F.col(column), edges, labels))


@step
def add_row_minimum(df: DataFrame, columns: list[str], into: str) -> DataFrame:
    """Smallest value of the row; nulls are skipped."""
    return df.withColumn(into, F.least(*columns))


@step
def clip_column(df: DataFrame, column: str, lower=None, upper=None) -> DataFrame:
    return df.withColumn(column, clip(F.col(column), lower, upper))

"""Row-wise consistency rules: each is a pipeline step that looks at one row only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.expressions import any_of, holds
from tablewright.operators.base import step

# Fixed values.
MERGED_CODE = 90
MERGED_DESCRIPTION = "MULTIPLE BODY PARTS"
COVID_START = "2020-03-01"
LEGAL_AGE = 14


@step
def set_when(df: DataFrame, column: str, value, where: str, equals) -> DataFrame:
    """Overwrite ``column`` in rows whose ``where`` column has a given value."""
    return df.withColumn(column, F.when(F.col(where) == F.lit(equals), F.lit(value)).otherwise(F.col(column)))


@step
def merge_codes(
    df: DataFrame, code: str, description: str, old: int = -9, new: int = MERGED_CODE, text: str = MERGED_DESCRIPTION
) -> DataFrame:
    """Recode ``old`` to ``new`` and give every row with ``new`` the same description."""
    merged = F.when(F.col(code) == old, F.lit(new)).otherwise(F.col(code))
    return df.withColumns({code: merged, description: F.when(merged == new, F.lit(text)).otherwise(F.col(description))})


@step
def zero_to_null(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.when(F.col(column) == 0, F.lit(None)).otherwise(F.col(column)))


@step
def value_to_null(df: DataFrame, column: str, value) -> DataFrame:
    return df.withColumn(column, F.when(F.col(column) == F.lit(value), F.lit(None)).otherwise(F.col(column)))


@step
def keep_legal_age(df: DataFrame, age: str, minimum: int = LEGAL_AGE) -> DataFrame:
    return df.filter((F.col(age) >= minimum) | F.col(age).isNull())


@step
def reset_child_dependents(df: DataFrame, dependents: str, age: str, low: int = 1, high: int = 15) -> DataFrame:
    """Nobody aged ``low`` to ``high`` has dependents."""
    child = (F.col(dependents) > 0) & F.col(age).between(low, high)
    return df.withColumn(dependents, F.when(child, F.lit(0)).otherwise(F.col(dependents)))


def age_mismatch(age: str, birth_year: str, date: str, years_after: int = 0) -> Column:
    """Age and birth year do not add up to the year of the date or the year before.

    ``years_after=1`` also accepts the year after. False when any of them is null.
    """
    total, year = F.col(age) + F.col(birth_year), F.year(date)
    return holds((total < year - 1) | (total > year + years_after))


@step
def lower_mismatched_age(df: DataFrame, age: str, birth_year: str, date: str) -> DataFrame:
    """Take one year off the age wherever it contradicts the birth year."""
    return df.withColumn(age, F.when(age_mismatch(age, birth_year, date), F.col(age) - 1).otherwise(F.col(age)))


@step
def earliest_date(df: DataFrame, target: str, others: list[str]) -> DataFrame:
    """Set ``target`` to the earliest of itself and the others; nulls are skipped."""
    return df.withColumn(target, F.least(target, *others))


@step
def swap_dates(df: DataFrame, first: str, second: str) -> DataFrame:
    """Exchange two dates that are in the wrong order."""
    wrong = holds(F.col(first) > F.col(second))
    return df.withColumns(
        {
            first: F.when(wrong, F.col(second)).otherwise(F.col(first)),
            second: F.when(wrong, F.col(first)).otherwise(F.col(second)),
        }
    )


@step
def reset_flag_before(df: DataFrame, flag: str, date: str, start: str = COVID_START, yes: str = "Y", no: str = "N") -> DataFrame:
    early = (F.col(flag) == yes) & (F.col(date) < F.lit(start).cast("date"))
    return df.withColumn(flag, F.when(early, F.lit(no)).otherwise(F.col(flag)))


def order_violations(df: DataFrame, first: str, second: str) -> DataFrame:
    """Rows whose first date is later than the second; a null is no violation."""
    return df.filter(F.col(first) > F.col(second))


def order_violation_counts(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    names = [f"{a} > {b}" for a, b in pairs]
    counts = df.agg(*[F.count_if(F.col(a) > F.col(b)).alias(n) for n, (a, b) in zip(names, pairs)])
    return counts.unpivot([], names, "date_order", "n_rows")


@step
def validate_record(
    df: DataFrame,
    dates: list[str],
    not_after: str | None = None,
    unknown_text: str = "Unknown",
    text_columns: list[str] | None = None,
    sentinels: dict[str, list] | None = None,
    sentinel_to_value: dict[str, list] | None = None,
    birth_year: str | None = None,
    age: str | None = None,
    accident_date: str | None = None,
) -> DataFrame:
    """Checks for a record that arrives for scoring.

    Dates after ``not_after`` (today by default), the text "Unknown" and sentinels
    become null; ``sentinel_to_value`` maps a column to [sentinel, replacement]; the
    birth year is the accident year less the age.
    """
    limit = F.current_date() if not_after is None else F.lit(not_after).cast("date")
    out = {c: F.when(F.col(c) > limit, F.lit(None)).otherwise(F.col(c)) for c in dates}
    for c in text_columns or []:
        out[c] = F.when(F.col(c) == unknown_text, F.lit(None)).otherwise(F.col(c))
    for c, (sentinel, value) in (sentinel_to_value or {}).items():
        out[c] = F.when(F.col(c) == sentinel, F.lit(value)).otherwise(out.get(c, F.col(c)))
    for c, values in (sentinels or {}).items():
        out[c] = F.when(F.col(c).isin(*values), F.lit(None)).otherwise(out.get(c, F.col(c)))
    df = df.withColumns(out)
    if birth_year:
        df = df.withColumn(birth_year, F.year(accident_date) - F.col(age))
    return df


@step
def flag_illegal(df: DataFrame, domains: dict[str, list], name: str = "illegal_value") -> DataFrame:
    """True where any column holds a value outside its domain; null is legal."""
    return df.withColumn(name, any_of([holds(~F.col(c).isin(*v)) for c, v in domains.items()]))

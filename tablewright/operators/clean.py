"""Projection, filters, duplicates, typing and label maps."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.expressions import lookup_literal
from tablewright.operators.base import FittedOperator, step
from tablewright.session import cut_lineage

MAX_CLASSES = 10_000
PASSES_PER_CHECKPOINT = 3


@dataclass
class ColumnRoles:
    """Which columns are the key, the label, numbers and categories."""

    key: str
    label: str
    numeric: list[str] = field(default_factory=list)
    categorical: list[str] = field(default_factory=list)

    @property
    def features(self) -> list[str]:
        return self.numeric + self.categorical

    def features_of(self, df: DataFrame) -> DataFrame:
        return df.select(self.key, *self.features)

    def label_of(self, df: DataFrame) -> DataFrame:
        return df.select(self.key, self.label)


@step
def drop_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Names may repeat or be absent."""
    return df.drop(*set(columns))


@step
def drop_columns_like(df: DataFrame, pattern: str) -> DataFrame:
    """Drop every column whose name contains the text, in any case."""
    return df.select(*[c for c in df.columns if pattern.lower() not in c.lower()])


@step
def drop_incomplete(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.na.drop(subset=columns)


def drop_repeated_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """Keep only rows whose key occurs once; of repeated keys no row is kept.

    Grouping combines the copies of a key before the shuffle, so a frequent key
    costs one row per task.
    """
    rest = [c for c in df.columns if c not in key]
    grouped = df.groupBy(*key).agg(F.count("*").alias("n_copies"), F.any_value(F.struct(*rest)).alias("row"))
    return grouped.filter("n_copies = 1").select(*key, "row.*").select(*df.columns)


def drop_duplicate_rows(df: DataFrame, key: str) -> DataFrame:
    """Of rows equal in all columns but the key keep the one with the smallest key."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(*rest).agg(F.min(key).alias(key)).select(*df.columns)


def drop_near_duplicates(df: DataFrame, key: str, columns: list[str] | None = None) -> DataFrame:
    """For each column in turn: of rows equal in all *other* columns keep the smallest key.

    Every pass sees the result of the pass before it.
    """
    columns = columns or [c for c in df.columns if c != key]
    out = df.select(key, *columns)
    for i, left_out in enumerate(columns, start=1):
        others = [c for c in columns if c != left_out]
        first = F.min(F.struct(F.col(key), F.col(left_out))).alias("first")
        out = out.groupBy(*others).agg(first).select(*others, "first.*").select(key, *columns)
        if i % PASSES_PER_CHECKPOINT == 0 and i < len(columns):
            out = cut_lineage(out)
    return out


@step
def parse_dates(df: DataFrame, columns: list[str], pattern: str = "yyyy-MM-dd") -> DataFrame:
    """Text to date; text that is no date becomes null."""
    return df.withColumns({c: F.try_to_date(F.col(c), pattern) for c in columns})


def unparsable_dates(df: DataFrame, columns: list[str], pattern: str = "yyyy-MM-dd") -> DataFrame:
    """How many values of each column are text but no date."""
    bad = df.agg(*[F.count_if(F.col(c).isNotNull() & F.try_to_date(F.col(c), pattern).isNull()).alias(c) for c in columns])
    return bad.unpivot([], columns, "column_name", "n_unparsable")


@step
def null_sentinels(df: DataFrame, sentinels: dict[str, list]) -> DataFrame:
    """Replace each column's sentinel values by null."""
    return df.withColumns({c: F.when(F.col(c).isin(*v), F.lit(None)).otherwise(F.col(c)) for c, v in sentinels.items()})


@step
def nan_to_null(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.when(F.isnan(c), F.lit(None)).otherwise(F.col(c)) for c in columns})


@step
def keep_from_or_null(df: DataFrame, cutoffs: dict[str, str]) -> DataFrame:
    """Keep rows where every listed column is null or not before its cutoff."""
    for c, cutoff in cutoffs.items():
        df = df.filter((F.col(c) >= F.lit(cutoff).cast(df.schema[c].dataType)) | F.col(c).isNull())
    return df


@step
def binary_target(df: DataFrame, label: str, positive: list[str], name: str = "binary_target") -> DataFrame:
    if not positive:
        raise ValueError("at least one positive class is needed")
    return df.withColumn(name, F.when(F.col(label).isin(*positive), 1).otherwise(0))


def class_list(df: DataFrame, label: str) -> list[str]:
    """Sorted classes without null; refuses a column that is no class label."""
    found = df.select(label).filter(F.col(label).isNotNull()).distinct().limit(MAX_CLASSES + 1).collect()
    if len(found) > MAX_CLASSES:
        raise ValueError(f"{label} has more than {MAX_CLASSES} classes")
    return sorted(r[0] for r in found)


class LabelIndex(FittedOperator):
    """Classes in ascending order get 0, 1, 2, …; an unknown class gets null."""

    defaults = {"label": None, "name": None}

    def learn(self, train, args):
        return {"classes": class_list(train, args["label"])}, {}

    @staticmethod
    def apply(df, args, scalars, tables):
        mapping = {c: i for i, c in enumerate(scalars["classes"])}
        return df.withColumn(args["name"] or f"{args['label']}_index", lookup_literal(F.col(args["label"]), mapping))


@step
def map_labels(df: DataFrame, column: str, pairs: list[list], name: str, default=None) -> DataFrame:
    """Dictionary map with a default for values that have no entry."""
    mapped = lookup_literal(F.col(column), {k: v for k, v in pairs})
    return df.withColumn(name, mapped if default is None else F.coalesce(mapped, F.lit(default)))


@step
def keep_classes(df: DataFrame, label: str, classes: list[str]) -> DataFrame:
    return df.filter(F.col(label).isin(*classes))


@step
def remove_classes(df: DataFrame, label: str, classes: list[str]) -> DataFrame:
    """A row without a class is kept."""
    return df.filter(~F.coalesce(F.col(label).isin(*classes), F.lit(False)))


@step
def cast_columns(df: DataFrame, types: dict[str, str]) -> DataFrame:
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in types.items()})


@step
def rename_columns(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def constant_prediction(df: DataFrame, key: str, label: str, value: str | None = None) -> DataFrame:
    """Key and one class for all rows; by default the commonest class of the frame."""
    if value is None:
        value = majority_class(df, label)
    return df.select(key, F.lit(value).alias(label))


def majority_class(df: DataFrame, label: str) -> str:
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), label).first()[label]

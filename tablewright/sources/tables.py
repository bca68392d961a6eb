"""Reading and writing tables, column lists and record contracts."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, delimiter: str = ",") -> DataFrame:
    """Header CSV with a given schema: no inference pass over the files."""
    return spark.read.schema(schema).option("header", True).option("sep", delimiter).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def column_list(spark: SparkSession, path: str) -> DataFrame:
    """Names in a text file, one per line; repeats and blank lines are ignored."""
    return spark.read.text(path).select(F.trim("value").alias("column_name")).filter("column_name <> ''").distinct()


def drop_columns_in_file(df: DataFrame, path: str) -> DataFrame:
    # A table has few columns, so its drop list is short.
    names = [r["column_name"] for r in column_list(df.sparkSession, path).collect()]
    return df.drop(*names)


def schema_report(df: DataFrame) -> DataFrame:
    """One row per column: position, name, type, nullability, non-null count."""
    fields = df.schema.fields
    counts = df.agg(*[F.count(F.col(f.name)).alias(f.name) for f in fields])
    rows = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("column_type"),
            F.lit(f.nullable).alias("nullable"),
            F.col(f.name).alias("non_null"),
        )
        for i, f in enumerate(fields)
    ]
    return counts.select(F.inline(F.array(*rows)))


@dataclass
class RecordContract:
    """Expected type of every column and the legal values of some of them."""

    types: dict[str, str]
    domains: dict[str, list] = field(default_factory=dict)

    def missing_columns(self, df: DataFrame) -> list[str]:
        return [c for c in self.types if c not in df.columns]

    def enforce(self, df: DataFrame) -> DataFrame:
        """Select the contract's columns, cast; a value that cannot be cast is null."""
        return df.select(*[F.col(c).try_cast(t).alias(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in self.types.items()])

    def breaches(self, df: DataFrame) -> DataFrame:
        """``illegal_<column>`` flags for every column with a domain."""
        return df.select("*", *[self.illegal(c).alias(f"illegal_{c}") for c in self.domains])

    def illegal(self, column: str) -> Column:
        c = F.col(column)
        return F.coalesce(~c.isin(*self.domains[column]), F.lit(False))


def columns_absent(spark: SparkSession, required: list[str], df: DataFrame) -> DataFrame:
    """Required names that the frame does not have."""
    absent = [(c,) for c in required if c not in df.columns]
    return spark.createDataFrame(absent, "column_name string")

"""Joining a fitted table back to the rows: one left join, of the same shape at any size.

The table is written once under the shared folder, so Spark knows its bytes and broadcasts it
where they are few. Otherwise the join shuffles both sides on the key and a salt. The salt is 0
but for rows without a key, which match nothing, and for rows of keys that the fit has found to
be frequent; the table's rows of those keys are repeated once per salt. Nothing is collected when
rows are joined, and the rows occur once in the plan, so a stream can be joined as well.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.session import cut_lineage, stored_bytes

#: A key is frequent if it has more than one row in so many; there can be no more such keys.
HOT_ONE_IN = 1_000
SALTS = 64
#: A fitted table may carry in this column how many rows each of its keys had; it is not joined.
WEIGHT = "lookup_rows"


class FittedTable:
    """A table produced by a fit, and its rows of frequent keys."""

    def __init__(self, df: DataFrame, hot: list[Row] | None = None, part: str | None = None):
        self.df = df
        self.hot = hot or []
        self.part = part

    @classmethod
    def of(cls, stats: DataFrame, part: str | None = None) -> "FittedTable":
        """Run ``stats`` once and keep it. ``part`` names a column that ``of_part`` picks by."""
        return cls._measured(cut_lineage(stats, part), part)

    @classmethod
    def load(cls, spark: SparkSession, path: str, part: str | None = None) -> "FittedTable":
        return cls._measured(spark.read.parquet(path), part)

    @classmethod
    def _measured(cls, kept: DataFrame, part: str | None) -> "FittedTable":
        if WEIGHT not in kept.columns or stored_bytes(kept) <= _broadcast_bytes(kept.sparkSession):
            return cls(kept, part=part)
        group = [part] if part else []
        totals = kept.groupBy(*group).agg(F.sum(WEIGHT).alias("lookup_total"))
        totals = F.broadcast(totals)  # one row per encoded column
        weighed = kept.join(totals, part) if part else kept.crossJoin(totals)
        # At most HOT_ONE_IN rows per encoded column.
        return cls(kept, weighed.where(F.col(WEIGHT) * HOT_ONE_IN > F.col("lookup_total")).drop("lookup_total").collect(), part)

    def of_part(self, value: str) -> "FittedTable":
        return FittedTable(self.df.where(F.col(self.part) == value).drop(self.part), [r for r in self.hot if r[self.part] == value])


def _broadcast_bytes(spark: SparkSession) -> int:
    return int(spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())


def _spread(df: DataFrame) -> Column:
    """A salt for each row from its own values."""
    plain = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    return F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in plain]), F.lit(SALTS)).cast("int")


def attach(df: DataFrame, table: FittedTable, on: dict[str, str]) -> DataFrame:
    """Left join ``df`` to ``table``; ``on`` maps a column of ``df`` to a key of the table.

    The table's keys are dropped from the result, and its other columns must not
    occur in ``df``. Rows with a null key get nulls.
    """
    keys = list(on.values())
    side = table.df.drop(WEIGHT)
    if not table.hot:
        unsalted = side.withColumn("lookup_salt", F.lit(0))
        frequent = F.lit(False)
    else:
        values = [tuple(r[k] for k in keys) for r in table.hot]

        def among(columns: list[str]) -> Column:
            if len(columns) == 1:
                return F.col(columns[0]).isin([v[0] for v in values])
            return reduce(lambda a, b: a | b, [reduce(lambda x, y: x & y, [F.col(c) == F.lit(x) for c, x in zip(columns, v)]) for v in values])

        repeated = F.when(among(keys), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
        unsalted = side.withColumn("lookup_salt", F.explode(repeated))
        frequent = F.coalesce(among(list(on)), F.lit(False))
    unknown = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in on])
    salted = df.withColumn("lookup_own_salt", F.when(unknown | frequent, _spread(df)).otherwise(F.lit(0)))
    renamed = unsalted.withColumnsRenamed({k: f"lookup_{k}" for k in keys})
    match = reduce(lambda a, b: a & b, [salted[left] == renamed[f"lookup_{key}"] for left, key in on.items()])
    joined = salted.join(renamed, match & (salted["lookup_own_salt"] == renamed["lookup_salt"]), "left")
    return joined.drop("lookup_own_salt", "lookup_salt", *[f"lookup_{k}" for k in keys])

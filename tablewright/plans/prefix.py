"""Running sums over a global order, computed range by range.

``sum() over (order by x)`` without a partition runs in one task. Here the rows are
range-partitioned on the order columns and written to the shared folder together
with their range number; the range totals (one row per range) give each range its
offset, and the running sum restarts inside every range.

Give it rows that are unique on the order columns (pre-aggregate by value first):
then no value, however frequent, can fill a range by itself.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.session import cut_lineage, shuffle_width

ROWS_PER_RANGE = 2_000_000


def running_sums(df: DataFrame, order: list[Column], sums: list[str], ranges: int | None = None) -> DataFrame:
    """Add ``<name>_upto`` (inclusive running sum) for every column in ``sums``."""
    if ranges is None:
        df = cut_lineage(df)
        ranges = max(shuffle_width(df.sparkSession), math.ceil(df.count() / ROWS_PER_RANGE))
    placed = cut_lineage(df.repartitionByRange(ranges, *order).withColumn("range_no", F.spark_partition_id()))
    before = Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("range_no").agg(*[F.sum(s).alias(s) for s in sums])
    offsets = offsets.select("range_no", *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"{s}_offset") for s in sums])
    within = Window.partitionBy("range_no").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # One row per range, so the broadcast side is small.
    joined = placed.join(F.broadcast(offsets), "range_no")
    for s in sums:
        joined = joined.withColumn(f"{s}_upto", F.sum(s).over(within) + F.col(f"{s}_offset"))
    return joined.drop("range_no", *[f"{s}_offset" for s in sums])

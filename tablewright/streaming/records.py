"""Arriving records parted into accepted and rejected ones, each rejected one with its reasons.

Every micro-batch writes both sinks under its batch number and is then published with one empty file. After a
failure Spark repeats the batch with the same records under the same number: it overwrites what the broken attempt
left, so a restart neither loses nor doubles a record, and readers see a batch in both sinks or in none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tablewright.plans.versions import publish, published
from tablewright.sources.tables import RecordContract

REASONS = "reasons"


def with_reasons(records: DataFrame, contract: RecordContract, rules: dict[str, Column] | None = None) -> DataFrame:
    """The contract's columns and the sorted ``reasons`` against a record, none if it is in order.

    ``unreadable <column>``: the value does not cast to the contract's type; ``illegal <column>``: it is not
    in the column's domain; the name of a rule: its condition, on the cast columns, is true. Nulls give no reason.
    """
    raw = F.struct(*[F.col(c).alias(c) for c in contract.types if c in records.columns])
    cast = [F.col(c).try_cast(t).alias(c) if c in records.columns else F.lit(None).cast(t).alias(c) for c, t in contract.types.items()]
    read = records.select(*cast, raw.alias("_raw"))
    found = [F.when(F.col(f"_raw.`{c}`").isNotNull() & F.col(c).isNull(), f"unreadable {c}") for c in contract.types if c in records.columns]
    found += [F.when(contract.illegal(c), f"illegal {c}") for c in contract.domains]
    found += [F.when(condition, name) for name, condition in (rules or {}).items()]
    reasons = F.array_sort(F.array_compact(F.array(*found))) if found else F.array().cast("array<string>")
    return read.withColumn(REASONS, reasons).drop("_raw")


def write_parted(
    records: DataFrame, path: str, checkpoint: str, available_now: bool = True, every: str = "1 minute"
) -> StreamingQuery:
    """Write a stream of records ``with_reasons`` to ``path/accepted`` and ``path/rejected``."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        # Kept, so that both sinks are filled from one reading of the batch.
        batch.persist()
        try:
            for sink, chosen in (("accepted", F.size(REASONS) == 0), ("rejected", F.size(REASONS) > 0)):
                rows = batch.filter(chosen)
                (rows.drop(REASONS) if sink == "accepted" else rows).write.mode("overwrite").parquet(f"{path}/{sink}/batch-{number:010d}")
            publish(spark, path, f"batch-{number:010d}")
        finally:
            batch.unpersist()

    writer = records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)
    return writer.start()


def read_sink(spark: SparkSession, path: str, sink: str, contract: RecordContract) -> DataFrame:
    """All published batches of ``accepted`` or ``rejected``; an empty frame before the first."""
    schema = ", ".join(f"`{c}` {t}" for c, t in contract.types.items()) + ("" if sink == "accepted" else f", {REASONS} array<string>")
    folders = [f"{path}/{sink}/{name}" for name in published(spark, path)]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)

"""Scoring records as they arrive with the models fitted in batch.

All fitted state is literals or small static tables, so the stream needs no state and
no watermark. A record is scored once: the sink's checkpoint remembers the files read.
"""

from __future__ import annotations

from pyspark.ml import Transformer
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def score(records: DataFrame, *stages: Transformer) -> DataFrame:
    """Apply fitted pipelines and models in order, to a stream or a table."""
    for stage in stages:
        records = stage.transform(records)
    return records


def write_scores(scored: DataFrame, path: str, checkpoint: str, available_now: bool = True, every: str = "1 minute") -> StreamingQuery:
    """Append scored records as parquet; stop when the input is read, or keep running."""
    writer = scored.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)
    return writer.start()

"""Stored rows and the queries that meet them, streamed through tasks group by group."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Stored rows of a shard, and queries of a block: what one task holds, and what it works on, stay bounded.
SHARD_ROWS = 65_536
BLOCK_QUERIES = 65_536
#: More shards than needed, one per core, as long as each holds so many rows.
SHARD_LEAST = 2_048
#: The largest whole number up to which doubles count without gaps.
DOUBLE_EXACT = 2.0**53
LONG_LEAST = -(2**63)


def scaled_vectors(df: DataFrame, factor: int, id_col: str, vec_col: str, *extra: Column) -> DataFrame:
    """(id, vec, extra…): each component x becomes floor(factor * x), kept as a double.

    Rows without id or vector, with a null or non-finite component, or with one whose product leaves the
    range of doubles, are left out.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"), *extra)
    rows = rows.where(F.col("id").isNotNull() & F.col("vec").isNotNull())
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x * factor) == math.inf))
    # A double from 2**53 on is whole, and would not fit the long that floor gives.
    whole = F.transform("vec", lambda x: F.when(F.abs(x * factor) < DOUBLE_EXACT, F.floor(x * factor).cast("double")).otherwise(x * factor))
    return rows.where(~F.coalesce(bad, F.lit(False))).withColumn("vec", whole)


def collapse(rows: DataFrame, keep: int, by: list[str]) -> DataFrame:
    """One row per distinct ``by`` with its ``keep`` smallest ids, which are picked before the shuffle."""
    # dense_rank: repeated rows of one id count once; rank limits are pushed below the exchange.
    ranked = rows.withColumn("place", F.dense_rank().over(Window.partitionBy(*by).orderBy("id"))).where(F.col("place") <= keep)
    return ranked.groupBy(*by).agg(F.array_sort(F.collect_set("id")).alias("ids"))


def shard_count(n: int, parallelism: int) -> int:
    return max(1, math.ceil(n / SHARD_ROWS), min(parallelism, n // SHARD_LEAST))


def meet(rows: DataFrame, asked: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Both frames by ``keys``: in every group first its rows, ordered, then its queries."""
    both = rows.withColumn("is_query", F.lit(False)).unionByName(asked.withColumn("is_query", F.lit(True)), allowMissingColumns=True)
    return both.repartition(*keys).sortWithinPartitions(*keys, "is_query", *order)


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, bool, pa.RecordBatch]]:
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in [*keys, "is_query"]]
        changes = np.zeros(batch.num_rows - 1, bool)
        for values in columns:
            changes |= values[1:] != values[:-1]
        cuts = [0, *(np.flatnonzero(changes) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield tuple(int(c[a]) for c in columns[:-1]), bool(columns[-1][a]), batch.slice(a, b - a)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[list[pa.RecordBatch], Iterator[pa.RecordBatch]]]:
    """For each group of ``meet``: the batches of its rows (perhaps none), and a stream of its queries."""
    runs = _runs(batches, keys)
    waiting = next(runs, None)
    while waiting is not None:
        key, rows = waiting[0], []
        while waiting is not None and waiting[0] == key and not waiting[1]:
            rows.append(waiting[2])
            waiting = next(runs, None)

        def queries() -> Iterator[pa.RecordBatch]:
            nonlocal waiting
            while waiting is not None and waiting[0] == key:
                yield waiting[2]
                waiting = next(runs, None)

        stream = queries()
        yield rows, stream
        for _ in stream:
            pass


def vectors(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows of an array."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(flat) else np.zeros((len(column), 0))


def stacked(rows: list[pa.RecordBatch], name: str) -> np.ndarray:
    return np.concatenate([vectors(b.column(name)) for b in rows])


def values(rows: list[pa.RecordBatch], name: str) -> np.ndarray:
    return np.concatenate([b.column(name).to_numpy(zero_copy_only=False) for b in rows])


def whole_numbers(array: np.ndarray) -> np.ndarray:
    """Doubles without a fraction as Python integers, for sums that leave the exact range."""
    return np.array([int(x) for x in array.ravel()], dtype=object).reshape(array.shape)


def within_long(numbers: np.ndarray) -> np.ndarray:
    """Python integers cut to the range of a long; only vectors with enormous components reach its ends."""
    return np.minimum(np.maximum(numbers, LONG_LEAST), -LONG_LEAST - 1)

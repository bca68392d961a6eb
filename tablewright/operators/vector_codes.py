"""Approximations of vectors by a few bits per dimension, with bounds on distances.

The range of every dimension is cut at quantiles; a vector's code is the number of its interval in each
dimension. From codes alone, a distance to the vector is bounded from below by the gaps to the intervals and from
above by their far ends. Codes take a byte per dimension, an eighth of the vector.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Of the sketch behind the quantiles; a coarse one only loosens bounds.
ACCURACY = 1_000


def finite(vec: str = "vec") -> Column:
    """Every component is a number and not infinite."""
    return F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def edges(rows: DataFrame, bits: int) -> np.ndarray:
    """Ends of the intervals, one row per dimension: 2^bits of about as many values each; the outer ones are the extremes.

    Rows with a component that is null or not finite are left out. Two aggregations; the driver gets
    2^bits + 1 numbers per dimension.
    """
    if not 1 <= bits <= 8:
        raise ValueError("codes have 1 to 8 bits")
    known = rows.filter(finite())
    first = known.select(F.size("vec").alias("n")).first()
    if first is None:
        return np.zeros((0, 2**bits + 1))
    inner = [i / 2**bits for i in range(1, 2**bits)]
    x = [F.get("vec", F.lit(d)) for d in range(first["n"])]
    row = known.agg(*[a for c in x for a in (F.min(c), F.percentile_approx(c, inner, ACCURACY), F.max(c))]).first()
    out = np.array([[row[3 * d], *row[3 * d + 1], row[3 * d + 2]] for d in range(first["n"])], dtype="float64")
    return np.maximum.accumulate(out, axis=1)


def encode(rows: DataFrame, ends: np.ndarray) -> DataFrame:
    """Rows with their ``codes``; those with a component that is null or not finite are left out."""

    @F.pandas_udf("binary")
    def code(vec: pd.Series) -> pd.Series:
        if not len(vec):
            return pd.Series([], dtype="object")
        x = np.array(vec.tolist(), dtype="float64").reshape(len(vec), -1)
        out = np.empty(x.shape, np.uint8)
        for d in range(x.shape[1]):
            out[:, d] = np.searchsorted(ends[d, 1:-1], x[:, d], side="right")
        return pd.Series([r.tobytes() for r in out])

    return rows.filter(finite()).withColumn("codes", code("vec"))


def unpack(codes: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(bytes(c) for c in codes), np.uint8).reshape(len(codes), -1)


def bounds(queries: np.ndarray, codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest distance of every query to every coded vector."""
    lower, upper = np.zeros((len(queries), len(codes))), np.zeros((len(queries), len(codes)))
    for d in range(queries.shape[1]):
        low, high = ends[d, codes[:, d]], ends[d, codes[:, d].astype(np.int64) + 1]
        under, over = low[None, :] - queries[:, d, None], queries[:, d, None] - high[None, :]
        gap = np.maximum(np.maximum(under, over), 0)
        lower += gap * gap
        far = np.maximum(-under, -over)
        upper += far * far
    return np.sqrt(lower), np.sqrt(upper)

"""Search by approximations of vectors: equal to brute force, bounds hold, few vectors are fetched."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewright.operators import neighbors, vector_codes

SCHEMA = "row_key long, vec array<double>"


def brute(points, k):
    """Distances summed dimension by dimension, ties to the smaller key."""
    out = {}
    for key, vec in points:
        some = []
        for other, v in points:
            if other != key:
                total = 0.0
                for a, b in zip(vec, v):
                    total += (a - b) * (a - b)
                some.append((math.sqrt(total), other))
        out[key] = [o for d, o in sorted(s for s in some if math.isfinite(s[0]))[:k]]
    return out


def found(df, k, **options):
    got = {}
    for r in neighbors.nearest(df, df, k, **options).orderBy("row_key", "rank").collect():
        got.setdefault(r["row_key"], []).append(r["neighbor_key"])
    return got


@pytest.mark.parametrize("dims,bits", [(8, 3), (16, 6), (42, 8)])
def test_equals_brute_force(spark, dims, bits):
    rng = np.random.default_rng(dims)
    centres = rng.normal(size=(6, dims)) * 3
    points = [(i, (centres[i % 6] + rng.normal(size=dims)).tolist()) for i in range(300)]
    points += [(1000 + i, list(points[i % 3][1])) for i in range(40)]  # copies
    df = spark.createDataFrame(points, SCHEMA)
    assert found(df, 4, cell_rows=30, bits=bits) == brute(points, 4)


def test_ties_and_constant_dimensions(spark):
    # A coarse grid: nearly all distances are tied, one dimension never changes.
    points = [(i, [float(i % 5), float(i // 5 % 5), 7.0, float(i // 25 % 2)]) for i in range(150)]
    df = spark.createDataFrame(points, SCHEMA)
    assert found(df, 6, cell_rows=20, bits=2) == brute(points, 6)
    assert found(df, 6, cell_rows=20, bits=1) == found(df, 6, cell_rows=20)


def test_vectors_that_are_not_finite_are_nobodys_neighbours(spark):
    points = [(i, [float(i * 17 % 29), float(i * 5 % 31), float(i % 3)]) for i in range(90)]
    points += [(500, [math.inf, 1.0, 1.0])]
    df = spark.createDataFrame(points, SCHEMA)
    got = found(df, 3, cell_rows=15, bits=4)
    assert got == {key: near for key, near in brute(points, 3).items() if near}
    assert all(500 not in near for near in got.values())


def test_fewer_rows_than_neighbours(spark):
    df = spark.createDataFrame([(1, [0.0] * 9), (2, [1.0] * 9)], SCHEMA)
    assert found(df, 5, bits=4) == {1: [2], 2: [1]}
    with pytest.raises(ValueError):
        vector_codes.edges(df, 9)


def test_bounds_hold():
    rng = np.random.default_rng(3)
    base, queries = rng.normal(size=(200, 12)), rng.normal(size=(50, 12)) * 2
    ends = np.quantile(base, np.linspace(0, 1, 9), axis=0).T
    codes = np.stack([np.searchsorted(ends[d, 1:-1], base[:, d], side="right") for d in range(12)], axis=1).astype(np.uint8)
    assert (vector_codes.unpack(pd.Series([r.tobytes() for r in codes])) == codes).all()
    lower, upper = vector_codes.bounds(queries, codes, ends)
    exact = neighbors._distances(queries, base)
    assert (lower <= exact + 1e-12).all() and (exact <= upper + 1e-12).all() and (lower < upper).all()


@pytest.mark.parametrize("dims", [16, 42])
def test_few_vectors_are_fetched(spark, dims):
    n, k = 2_000, 5
    rng = np.random.default_rng(dims)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(n, dims)))], SCHEMA)
    tree, placed, blocks = neighbors.cell_tree(df, n, 100)
    home = neighbors._in_cells(df, tree)
    kind = df.schema["row_key"].dataType
    first = neighbors._candidates(home, placed, blocks, k, kind, kind)
    bounds = first.groupBy("row_key").agg(F.max(F.when(F.col("rank") == k, F.col("distance"))).alias("bound"))
    sent = neighbors.cells_to_search(home.join(bounds, "row_key", "left"), tree)
    ends = vector_codes.edges(placed, 6)
    pairs = neighbors.coded_candidates(sent, vector_codes.encode(placed, ends).drop("vec"), blocks, k, ends)
    met = sent.join(placed.groupBy("cell").count(), "cell").agg(F.sum("count")).first()[0]
    # Boxes exclude little here, codes nearly everything.
    assert met > 0.5 * n * n and pairs.count() < 0.03 * met

"""Mutual information by nearest neighbours against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tablewright.functions.expressions import digamma
from tablewright.operators import select

SCHEMA = "x double, z double, flat double, y string"


def psi(n):
    return sum(1 / i for i in range(1, n)) - 0.5772156649015329


def brute(pairs, k):
    known = [(x, c) for x, c in pairs if x is not None and x == x and c is not None]
    sizes = {c: sum(d == c for _, d in known) for _, c in known}
    known = [(x, c) for x, c in known if sizes[c] > 1]
    if not known:
        return None
    total = 0.0
    for i, (x, c) in enumerate(known):
        fewest = min(k, sizes[c] - 1)
        r = sorted(abs(v - x) for j, (v, d) in enumerate(known) if d == c and j != i)[fewest - 1]
        m = sum(x - r < v < x + r if r > 0 else v == x for v, _ in known)
        total += psi(fewest) - psi(sizes[c]) - psi(m)
    return max(0.0, psi(len(known)) + total / len(known))


def cases(seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(150):
        y = rng.choice(["a", "a", "a", "b", "b", "c", None])
        x = rng.gauss({"a": 0, "b": 2}.get(y, 5), 1)
        rows.append((rng.choice([x, float(round(x)), None, math.nan]) if rng.random() < 0.5 else x, float(rng.randrange(4)), 7.0, y))
    return rows + [(0.5, 1.0, 7.0, "alone"), (3.25, 100.0, 7.0, "two"), (9.0, -100.0, 7.0, "two")]


@pytest.mark.parametrize("block,k", [(8_192, 3), (4, 3), (2, 5)])
def test_equals_brute_force(spark, monkeypatch, block, k):
    # Blocks smaller than k: neighbours lie some blocks away.
    monkeypatch.setattr(select, "NEIGHBOUR_BLOCK", block)
    rows = cases(block + k)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {r["feature"]: r["mutual_information"] for r in select.neighbour_mutual_information(df, ["x", "z", "flat"], "y", k).collect()}
    for i, c in enumerate(["x", "z", "flat"]):
        assert got[c] == pytest.approx(brute([(r[i], r[3]) for r in rows], k), abs=1e-9)
    assert got["flat"] < 1e-9 < got["x"]


def test_one_class_and_no_rows(spark):
    one = spark.createDataFrame([(float(i), 1.0, 1.0, "a") for i in range(30)], SCHEMA)
    assert [r[1] for r in select.neighbour_mutual_information(one, ["x", "z"], "y").collect()] == pytest.approx([0.0, 0.0], abs=0.2)
    assert [r[1] for r in select.neighbour_mutual_information(one.limit(0), ["x", "z"], "y").collect()] == [None, None]


def test_digamma(spark):
    got = [r[0] for r in spark.range(1, 200).select(digamma(F.col("id").cast("double"))).collect()]
    assert got == pytest.approx([psi(n) for n in range(1, 200)], abs=1e-12)

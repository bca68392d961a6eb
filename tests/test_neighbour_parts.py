"""Rows move once per part of the space, floats stay floats on the way, and the neighbours are those of brute force."""

import numpy as np
import pytest

from tablewright.operators import neighbors

N, DIMS = 1_600, 24


def vectors():
    return np.random.default_rng(5).normal(size=(N, DIMS)).astype(np.float32)


def brute(x, k):
    """Distances in doubles, summed dimension by dimension."""
    d = neighbors._distances(x.astype("float64"), x.astype("float64"))
    np.fill_diagonal(d, np.inf)
    return {i: sorted(range(len(x)), key=lambda j: (d[i, j], j))[:k] for i in range(len(x))}


@pytest.mark.parametrize("bits", [None, 6])
def test_rows_move_once_per_part(spark, monkeypatch, bits):
    moved = []
    meet = neighbors._meetings

    def counted(sent, placed, *rest):
        moved.append(sent.count())
        return meet(sent, placed, *rest)

    monkeypatch.setattr(neighbors, "_meetings", counted)
    x = vectors()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_key long, vec array<float>")
    got = {}
    for r in neighbors.nearest(df, df, 3, cell_rows=25, bits=bits).orderBy("row_key", "rank").collect():
        got.setdefault(r["row_key"], []).append(r["neighbor_key"])
    assert got == brute(x, 3)
    # There are 64 cells, and boxes exclude few of them in so many dimensions.
    assert moved[0] == N and sum(moved) <= N * (neighbors.PARTS + 2)


@pytest.mark.parametrize("dims", [3, 20])
def test_products_leave_no_neighbour_out(dims):
    rng = np.random.default_rng(dims)
    # Far from 0, on a grid with ties, and with copies.
    base = np.round(rng.normal(size=(900, dims)) * 2) / 4 + 1e4
    rows = np.concatenate([base[:60], base[:40] + 1e-7, rng.normal(size=(20, dims)) * 1e5])
    keys = np.arange(900)
    leaf = (base[:, 0] > 1e4).astype(int) + 2 * (base[:, 1] > 1e4)
    ready = neighbors._Base(base, leaf)
    q_at, b_at, distance = neighbors._nearest_in_block(rows, np.arange(120), np.full(120, np.inf), ready, keys, 4)
    d = neighbors._distances(rows, base)
    for i in range(120):
        expected = sorted((d[i, j], j) for j in range(900) if j != i)[:4]
        assert list(zip(distance[q_at == i], b_at[q_at == i])) == expected


def test_rows_that_come_twice_meet_k_others():
    rng = np.random.default_rng(9)
    x = np.repeat(rng.normal(size=(40, 5)), 3, axis=0)
    keys = np.repeat(np.arange(40), 3)
    q_at, b_at, distance = neighbors._nearest_in_block(x, keys, np.full(120, np.inf), neighbors._Base(x, np.zeros(120, int)), keys, 2)
    d = neighbors._distances(x, x)
    for i in range(120):
        assert list(zip(distance[q_at == i], b_at[q_at == i])) == sorted((d[i, j], j) for j in range(120) if keys[j] != keys[i])[:2]


def test_entries_that_are_not_above_are_found_at_once():
    squares = np.array([[1.0, 5.0, np.nan], [4.0, 2.0, 9.0]])
    rows, columns = neighbors._not_above(squares, np.array([[1.0], [4.0]]))
    assert list(zip(rows.tolist(), columns.tolist())) == [(0, 0), (0, 2), (1, 0), (1, 1)]
    assert [len(x) for x in neighbors._not_above(np.zeros((3, 2)), np.full((3, 1), -1.0))] == [0, 0]

"""The claims view is worked out once, rows are compared in one shuffle, and ranks are joined to whole rows."""

from itertools import combinations

import numpy as np
import pytest

from tablewright.catalog import model_queries
from tablewright.operators import select


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["prepared_claims", "saved_pipelines", "streaming_scores"])
def test_preparation_reads_a_written_view(spark, sf_dir, monkeypatch, name):
    class Seen(Exception):
        pass

    def fit(view, *args):
        assert "Join" not in plan(view)
        raise Seen

    monkeypatch.setattr(model_queries.Preparation, "fit", staticmethod(fit))
    with pytest.raises(Seen):
        getattr(model_queries, name)(spark, sf_dir)


def test_rows_in_one_table_only_are_counted_as_except_all_counts_them(spark):
    first = spark.createDataFrame([(1, "a"), (1, "a"), (1, "a"), (2, None), (None, None), (3, "c")], "x int, y string")
    second = spark.createDataFrame([(1, "a"), (2, None), (2, None), (4, "d"), (5, "e")], "x int, y string")
    for a, b in ((first, second), (second, first), (first, first), (first.limit(0), second), (first.limit(0), first.limit(0))):
        assert model_queries.only_in_one(a, b) == (a.exceptAll(b).count(), b.exceptAll(a).count())


def test_rank_correlation_keeps_rows_whole(spark):
    rng = np.random.default_rng(4)
    values = [(float(rng.integers(3)), float(a), float(a // 4), None if i % 9 == 0 else float(rng.normal())) for i, a in enumerate(rng.permutation(60))]
    df = spark.createDataFrame(values, "w double, x double, y double, z double").repartition(3)
    found = select.spearman_matrix(df, ["w", "x", "y", "z"])
    # No shuffle that puts the columns of a row together again.
    assert "Aggregate [row_no" not in plan(found)
    known = np.array([v for v in values if None not in v])
    ranks = {c: (known[:, [i]] > known[:, i]).sum(1) + ((known[:, [i]] == known[:, i]).sum(1) + 1) / 2 for i, c in enumerate("wxyz")}
    want = {(a, b): np.corrcoef(ranks[a], ranks[b])[0, 1] for a, b in combinations("wxyz", 2)}
    got = {(r["feature_a"], r["feature_b"]): r["correlation"] for r in found.collect()}
    assert got == pytest.approx(want)

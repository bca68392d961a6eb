"""The fits of an elimination step run beside each other on few partitions."""

import pytest

from tablewright.operators import models


def test_fits_of_a_step_run_side_by_side_on_few_partitions(spark, monkeypatch):
    begun, seen = [], []
    run, kept = models.side_by_side, models.kept

    def counted(session, tasks, *most):
        begun.append(len(tasks))
        return run(session, tasks, *most)

    def watched(df):
        seen.append(df.rdd.getNumPartitions())
        return kept(df)

    monkeypatch.setattr(models, "side_by_side", counted)
    monkeypatch.setattr(models, "kept", watched)
    rows = [(i, float(i * 37 % 19), float(i % 2) + 0.01 * (i % 7), "a" if i % 2 else "b") for i in range(120)]
    df = spark.createDataFrame(rows, "claim_id long, noise double, x double, y string").repartition(16)
    path = models.recursive_elimination(df, ["noise", "x"], "y", "claim_id", maxIter=5).collect()
    assert [r["n_features"] for r in path] == [2, 1] and path[1]["dropped"] == "x" and path[1]["accuracy"] == 1.0
    # Five folds and the fit on all rows.
    assert begun == [models.FOLDS + 1] * 2 and set(seen) == {1}
    with pytest.raises(ValueError):
        models.recursive_elimination(df.limit(1), ["x"], "y", "claim_id", maxIter=5)

"""Boosted trees whose parts grow together: MLlib's trees, with a job per level."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tablewright.operators import boosting, models

SETTINGS = {"maxIter": 4, "maxDepth": 3, "stepSize": 0.3, "subsamplingRate": 1.0}


def table(spark, n=400):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(n):
        x, z, w = float(rng.integers(0, 20)), float(rng.integers(0, 7)), float(rng.integers(0, 2))
        rows.append((i, x, z, w, 1.0, "abc"[int(x + 2 * z + rng.integers(0, 3)) % 11 // 4], 1.0 + i % 3))
    return spark.createDataFrame(rows, "claim_id long, x double, z double, w double, same double, y string, weight double").repartition(3, "claim_id").cache()


FEATURES = ["x", "z", "w", "same"]


def vectors(df, classes, *extra):
    return models.assembled(models.with_target(df, "y", classes), FEATURES, "claim_id", models.TARGET, *extra)


def positive(scored):
    return {r["claim_id"]: r["p"] for r in scored.select("claim_id", vector_to_array("probability")[1].alias("p")).collect()}


@pytest.mark.parametrize("weight", [None, "weight"])
def test_two_classes_as_mllib(spark, weight):
    rows = vectors(table(spark).filter("y <> 'c'"), ["a", "b"], "weight")
    own = models.classifier("boosted", 2, weight=weight, **SETTINGS).fit(rows)
    mllib = GBTClassifier(featuresCol=models.VECTOR, labelCol=models.TARGET, seed=42, **({"weightCol": weight} if weight else {}), **SETTINGS).fit(rows)
    got, want = positive(own.transform(rows)), positive(mllib.transform(rows))
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-9
    assert np.allclose(own.featureImportances.toArray(), mllib.featureImportances.toArray())
    right = own.transform(rows).join(mllib.transform(rows).select("claim_id", F.col("prediction").alias("other")), "claim_id")
    assert right.filter("prediction <> other").count() == 0


def test_more_classes_as_each_against_the_rest(spark):
    rows = vectors(table(spark), ["a", "b", "c"])
    model = models.classifier("boosted", 3, **SETTINGS).fit(rows)
    scored = model.transform(rows).select("claim_id", "prediction", vector_to_array("probability").alias("p")).collect()
    parts = []
    for c in range(3):
        one = rows.withColumn(models.TARGET, (F.col(models.TARGET) == c).cast("double"))
        parts.append(positive(GBTClassifier(featuresCol=models.VECTOR, labelCol=models.TARGET, seed=42, **SETTINGS).fit(one).transform(one)))
    for r in scored:
        own = np.array([p[r["claim_id"]] for p in parts])
        assert np.allclose(r["p"], own / own.sum(), atol=1e-9)
        assert r["prediction"] == own.argmax()
    assert model.featureImportances.toArray()[3] == 0 and sum(model.featureImportances.toArray()) == pytest.approx(1)


def test_one_job_a_level(spark):
    """One-against-rest models of MLlib took several jobs per level, class and step."""
    rows = vectors(table(spark), ["a", "b", "c"]).cache()
    rows.count()
    sc = spark.sparkContext
    sc.setJobGroup("boosted", "boosted")
    try:
        models.classifier("boosted", 3, maxIter=30, maxDepth=3).fit(rows)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        sc.setLocalProperty("spark.job.description", None)
    assert len(sc.statusTracker().getJobIdsForGroup("boosted")) <= 30 * 3 + 8


def test_scores_worked_out_anew_are_the_same(spark, monkeypatch):
    rows = vectors(table(spark), ["a", "b", "c"])
    settings = {"maxIter": 7, "maxDepth": 2}
    once = models.classifier("boosted", 3, **settings).fit(rows).transform(rows)
    monkeypatch.setattr(boosting, "STEPS_OF_LINEAGE", 2)
    monkeypatch.setattr(boosting, "TASKS_TO_DRIVER", 1)
    again = models.classifier("boosted", 3, **settings).fit(rows).transform(rows)
    a, b = positive(once), positive(again)
    assert max(abs(a[k] - b[k]) for k in a) < 1e-9


def test_saved_and_loaded(spark, tmp_path):
    rows = vectors(table(spark), ["a", "b", "c"])
    model = models.classifier("boosted", 3, **SETTINGS).fit(rows)
    model.save(str(tmp_path / "boosted"))
    again = boosting.BoostedTreesModel.load(str(tmp_path / "boosted"))
    assert positive(model.transform(rows)) == positive(again.transform(rows))


def test_cuts_lie_between_values():
    assert boosting.cuts_of(np.array([1.0, 3.0, 3.0, 2.0, np.nan]), 31).tolist() == [1.5, 2.5]
    assert boosting.cuts_of(np.array([4.0, 4.0]), 31).tolist() == []
    many = boosting.cuts_of(np.arange(1000.0), 31)
    assert len(many) == 31 and abs(np.diff(many) - 1000 / 32).max() <= 1


def test_other_settings_and_empty_tables(spark):
    assert isinstance(models.classifier("boosted", 2, maxIter=2, checkpointInterval=5), GBTClassifier)
    with pytest.raises(ValueError):
        models.classifier("boosted", 2, **SETTINGS).fit(vectors(table(spark).limit(0), ["a", "b"]))


def test_only_the_smaller_side_of_a_split_is_counted():
    rng = np.random.default_rng(7)
    n, parts, n_bins = 500, 3, 8
    bins = rng.integers(0, n_bins, (4, n)).astype(np.uint8)
    target = ((bins[0] + bins[1]) // 6).astype(np.int32)
    for weight in (None, rng.uniform(0.5, 2, n)):
        block = boosting.Block((0, 0), bins, target, weight, np.zeros((parts, n)))
        grown = boosting.Trees(np.zeros((parts, 7), np.int64), np.full((parts, 7), n_bins, np.int64), np.zeros((parts, 8)), 1.0)
        sums = np.zeros(0)
        for level in range(3):
            counted = boosting._smaller_sides(sums, grown, level, n_bins) if level else np.zeros((parts, 1), np.int64)
            found = next(boosting._level_sums(grown, counted, 1, list(range(parts)), n_bins, 1.0, 1, [block]))
            if level:
                sums = boosting._both_sides(sums, found, counted, n_bins)
                assert (found[0, :, 0].sum(1) <= (n if weight is None else weight.sum()) / 2 + 1e-9).all()
            else:
                sums = found
            whole = np.zeros_like(sums)
            for part in range(parts):
                residual = boosting._residuals(block, part, part, np.arange(n), False) * (1.0 if weight is None else weight)
                for f in range(4):
                    cell = grown.leaves(bins, part, level) * n_bins + bins[f]
                    whole[0, part, f], whole[1, part, f] = np.bincount(cell, weight, 2**level * n_bins), np.bincount(cell, residual, 2**level * n_bins)
            assert np.allclose(sums, whole, atol=1e-9)
            boosting._split(grown, level, sums, n_bins, 1, 0.0, level == 2)

"""Forests whose trees grow together: MLlib's trees, with a job per level."""

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tablewright.operators import forest, models

FEATURES = ["x", "z", "w", "same"]


def table(spark, n=600):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(n):
        x, z, w = float(rng.integers(0, 20)), float(rng.normal()), float(rng.integers(0, 2))
        rows.append((i, x, z, w, 1.0, "abc"[int(x + 2 * z + rng.integers(0, 4)) % 11 // 4]))
    return spark.createDataFrame(rows, "claim_id long, x double, z double, w double, same double, y string").repartition(3, "claim_id").cache()


def vectors(df, classes):
    return models.assembled(models.with_target(df, "y", classes), FEATURES, "claim_id", models.TARGET)


def scored(model, rows):
    return {r["claim_id"]: (r["prediction"], np.array(r["p"])) for r in model.transform(rows).select("claim_id", "prediction", vector_to_array("probability").alias("p")).collect()}


def mllib(rows, **settings):
    return RandomForestClassifier(featuresCol=models.VECTOR, labelCol=models.TARGET, seed=42, **settings).fit(rows)


@pytest.mark.parametrize("classes", [["a", "b"], ["a", "b", "c"]])
@pytest.mark.parametrize("settings", [{}, {"minInstancesPerNode": 20}, {"minInfoGain": 0.02}])
def test_a_tree_of_all_rows_and_features_as_mllib(spark, classes, settings):
    rows = vectors(table(spark).filter(F.col("y").isin(classes)), classes)
    settings = {"numTrees": 1, "maxDepth": 6, "bootstrap": False, "featureSubsetStrategy": "all", **settings}
    own = models.classifier("forest", len(classes), **settings).fit(rows)
    assert isinstance(own, forest.ForestTreesModel)
    other = mllib(rows, **settings)
    got, want = scored(own, rows), scored(other, rows)
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and np.allclose(got[k][1], want[k][1], atol=1e-9) for k in want)
    assert np.allclose(own.featureImportances.toArray(), other.featureImportances.toArray())


def test_a_forest_is_as_good_as_mllibs(spark):
    rows = vectors(table(spark, 2000), ["a", "b", "c"])
    train, val = rows.filter("claim_id % 3 > 0").cache(), rows.filter("claim_id % 3 = 0").cache()
    settings = {"numTrees": 30, "maxDepth": 6}
    own, other = models.classifier("forest", 3, **settings).fit(train), mllib(train, **settings)
    right = [m.transform(val).filter(F.col("prediction") == F.col(models.TARGET)).count() for m in (own, other)]
    assert abs(right[0] - right[1]) < 0.06 * val.count()
    assert np.abs(own.featureImportances.toArray() - other.featureImportances.toArray()).max() < 0.08
    assert own.featureImportances.toArray()[3] == 0
    assert all(p.sum() == pytest.approx(1) for _, p in scored(own, val).values())


def test_one_job_a_level_and_some_trees_at_a_time(spark, monkeypatch):
    rows = vectors(table(spark), ["a", "b", "c"]).cache()
    rows.count()
    sc = spark.sparkContext

    def fitted(group):
        sc.setJobGroup(group, group)
        try:
            model = models.classifier("forest", 3, numTrees=12, maxDepth=4).fit(rows)
        finally:
            sc.setLocalProperty("spark.jobGroup.id", None)
            sc.setLocalProperty("spark.job.description", None)
        return model, len(sc.statusTracker().getJobIdsForGroup(group))

    whole, jobs = fitted("forest")
    assert jobs <= 4 + 6
    # Counts of one tree at a time: the same trees.
    monkeypatch.setattr(forest, "COUNT_BYTES", 1)
    single, more = fitted("forest by trees")
    assert more > jobs
    a, b = scored(whole, rows), scored(single, rows)
    assert all(np.array_equal(a[k][1], b[k][1]) for k in a)


def test_tasks_hold_few_bytes_a_row():
    """MLlib keeps a number per row and tree."""
    block = forest.Block((0, 0), np.zeros((4, 50), np.uint8), np.zeros(50, np.int32), None, np.zeros((0, 50)))
    assert block.bins.nbytes + block.target.nbytes + block.scores.nbytes == 8 * 50
    times = np.concatenate([forest.drawn(1, t, block, True) for t in range(400)])
    assert abs(times.mean() - 1) < 0.05 and abs((times == 0).mean() - np.exp(-1)) < 0.02
    assert np.array_equal(forest.drawn(1, 3, block, True), forest.drawn(1, 3, block, True))
    assert not np.array_equal(forest.drawn(1, 3, block, True), forest.drawn(1, 4, block, True))


def test_saved_and_loaded(spark, tmp_path):
    rows = vectors(table(spark), ["a", "b", "c"])
    model = models.classifier("forest", 3, numTrees=5, maxDepth=4).fit(rows)
    model.save(str(tmp_path / "forest"))
    a, b = scored(model, rows), scored(forest.ForestTreesModel.load(str(tmp_path / "forest")), rows)
    assert all(np.array_equal(a[k][1], b[k][1]) for k in a)


def test_other_settings_and_odd_tables(spark):
    assert isinstance(models.classifier("forest", 2, subsamplingRate=0.5), RandomForestClassifier)
    assert isinstance(models.classifier("forest", 2, weight="w"), RandomForestClassifier)
    with pytest.raises(ValueError):
        models.classifier("forest", 2).fit(vectors(table(spark).limit(0), ["a", "b"]))
    # Nothing to split on, and one class only.
    rows = vectors(table(spark).withColumns({f: F.lit(1.0) for f in FEATURES}), ["a", "b", "c"])
    model = models.classifier("forest", 3, numTrees=3).fit(rows)
    assert model.featureImportances.toArray().tolist() == [0.0] * 4
    assert len({p for p, _ in scored(model, rows).values()}) == 1
    one = vectors(table(spark).filter("y = 'b'"), ["a", "b", "c"])
    assert {p for p, _ in scored(models.classifier("forest", 3, numTrees=3).fit(one), one).values()} == {1.0}

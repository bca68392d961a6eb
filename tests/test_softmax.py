"""Logistic regressions over folds find MLlib's optimum in fewer passes."""

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from tablewright.operators import models
from tablewright.operators.softmax import FoldedSoftmax


def table(spark, n=900):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(n, 3)) * [1, 40, 0.1] + [0, 1000, 3]
    z = np.stack([x[:, 0], (x[:, 1] - 1000) / 40 - x[:, 0], 0.3 * (x[:, 2] - 3) / 0.1], axis=1) + rng.gumbel(size=(n, 3))
    rows = [(i, *map(float, v), 5.0, int(c), i % 5) for i, (v, c) in enumerate(zip(x, z.argmax(1)))]
    return spark.createDataFrame(rows, "claim_id long, a double, b double, c double, same double, y int, fold int").repartition(3, "claim_id").cache()


FEATURES = ["a", "b", "c", "same"]


def softmax(df):
    rows = df.withColumn(models.TARGET, F.col("y").cast("double"))
    return FoldedSoftmax(rows, FEATURES, models.TARGET, "fold", 3, models.fold_sums(rows, [*FEATURES, models.TARGET], "fold"), tol=1e-12)


def test_coefficients_are_mllibs(spark):
    df = table(spark)
    with softmax(df) as fits:
        for used, skip in (([0, 1, 2, 3], None), ([0, 1, 2, 3], 2), ([1, 2], 4)):
            rows = models.assembled(df.filter(F.lit(skip is None) | (F.col("fold") != (skip or 0))).withColumn(models.TARGET, F.col("y").cast("double")), [FEATURES[i] for i in used], models.TARGET)
            want = LogisticRegression(featuresCol=models.VECTOR, labelCol=models.TARGET, family="multinomial", tol=1e-12, maxIter=500).fit(rows)
            weights = fits.fit(used, skip)
            assert np.allclose(fits.coefficients(used, weights), want.coefficientMatrix.toArray(), rtol=1e-3, atol=1e-4)
            # Begun where another fit ended.
            again = fits.fit(used, skip, weights + 0.1 * np.arange(3))
            assert np.allclose(np.diff(fits.coefficients(used, again), axis=0), np.diff(fits.coefficients(used, weights), axis=0), atol=1e-3)
        hits = sum(fits.hits([0, 1, 2, 3], fits.fit([0, 1, 2, 3], None), fold) for fold in range(5))
        assert 0.6 * 900 < hits < 900


def test_few_jobs_a_fit(spark):
    sc = spark.sparkContext
    with softmax(table(spark)) as fits:
        sc.setJobGroup("softmax", "softmax")
        try:
            fits.fit([0, 1, 2, 3], None)
        finally:
            sc.setLocalProperty("spark.jobGroup.id", None)
            sc.setLocalProperty("spark.job.description", None)
        assert len(sc.statusTracker().getJobIdsForGroup("softmax")) <= 25


def test_an_elimination_is_mllibs(spark):
    df = table(spark).withColumn("label", F.col("y").cast("string"))
    own = models.recursive_elimination(df, FEATURES, "label", "claim_id").collect()
    other = models.recursive_elimination(df, FEATURES, "label", "claim_id", maxIter=200, tol=1e-9, aggregationDepth=2).collect()
    assert [r["dropped"] for r in own] == [r["dropped"] for r in other]
    assert all(abs(a["accuracy"] - b["accuracy"]) < 0.01 for a, b in zip(own, other))

"""Penalised regressions from sums equal MLlib's fits on the rows."""

import numpy as np
import pytest
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.regression import LinearRegression
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import functions as F

from tablewright.operators import models

ALPHAS = [0.0001, 0.01, 0.1]
COLUMNS = ["x", "far", "flat", "z"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    x, z = rng.standard_normal(400), rng.standard_normal(400)
    far = 100 + 3 * x + rng.standard_normal(400)
    label = np.digitize(x - 0.5 * z + rng.standard_normal(400) * 0.5, [-1, 0, 1.2])
    data = [(i, float(x[i]), float(far[i]), 7.0, float(z[i]) if i % 50 else None, "abcd"[label[i]] if i % 37 else None) for i in range(400)]
    return spark.createDataFrame(data, "claim_id long, x double, far double, flat double, z double, y string").repartition(5).cache()


@pytest.mark.parametrize("l1", [False, True])
def test_search_equals_cross_validation(rows, l1):
    found = models.linear_search(rows, COLUMNS, "y", "claim_id", ALPHAS, l1)
    folded = models._folds(models.with_target(rows, "y", ["a", "b", "c", "d"]), "claim_id")
    regression = LinearRegression(featuresCol=models.VECTOR, labelCol=models.TARGET, elasticNetParam=float(l1), maxIter=1000, tol=1e-13)
    search = CrossValidator(
        estimator=regression, estimatorParamMaps=ParamGridBuilder().addGrid(regression.regParam, ALPHAS).build(), evaluator=RegressionEvaluator(labelCol=models.TARGET, metricName="mse"), numFolds=5, foldCol="fold"
    ).fit(models.assembled(folded, COLUMNS, models.TARGET, "fold"))
    assert found.errors == pytest.approx(search.avgMetrics, rel=1e-6)
    assert found.alpha == search.bestModel.getOrDefault("regParam")
    assert found.coefficients == pytest.approx(search.bestModel.coefficients.toArray(), abs=1e-6)
    assert found.coefficients[2] == 0
    assert models.linear_search(rows, ["x", "z"], "y", "claim_id", [0.05], l1).intercept == pytest.approx(_fit(rows, ["x", "z"], 0.05, l1).intercept, abs=1e-6)


def _fit(rows, columns, alpha, l1):
    data = models.assembled(models.with_target(rows, "y", ["a", "b", "c", "d"]), columns, models.TARGET)
    return LinearRegression(featuresCol=models.VECTOR, labelCol=models.TARGET, regParam=alpha, elasticNetParam=float(l1), maxIter=1000, tol=1e-13).fit(data)


def test_a_column_far_from_zero_keeps_its_digits(rows):
    near = models.linear_search(rows, ["x", "far"], "y", "claim_id", [0.01], False)
    # 2**30 is added without rounding more than the last digits of a value.
    own = models.linear_search(rows.withColumn("far", F.col("far") + 2.0**30), ["x", "far"], "y", "claim_id", [0.01], False)
    assert own.coefficients == pytest.approx(near.coefficients, rel=1e-5)
    assert own.errors == pytest.approx(near.errors, rel=1e-5)


def test_ridge_classes_equal_a_regression_per_class(rows):
    fitted = models.RidgeClassifier(features=["x", "far", "z"], label="y", alpha=0.3).fit(rows)
    data = models.assembled(rows.filter("y is not null"), ["x", "far", "z"], "y")
    for c, (intercept, *coefficients) in zip(fitted.state()["classes"], fitted.state()["fits"]):
        signed = data.withColumn(models.TARGET, F.when(F.col("y") == c, 1.0).otherwise(-1.0))
        want = LinearRegression(featuresCol=models.VECTOR, labelCol=models.TARGET, regParam=0.3, solver="normal").fit(signed)
        assert coefficients == pytest.approx(want.coefficients.toArray(), abs=1e-6)
        assert intercept == pytest.approx(want.intercept, abs=1e-5)


def test_a_search_reads_the_rows_in_one_aggregation(spark, rows):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("one-search", "")
    models.linear_search(rows, COLUMNS, "y", "claim_id", [10.0**-i for i in range(9)], True)
    jobs = tracker.getJobIdsForGroup("one-search")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # The classes, the row to count from and the sums; adaptive execution runs a shuffle's map side as a job of its own.
    assert len(jobs) <= 6


def test_rows_without_a_label_or_variance(spark):
    schema = "claim_id long, x double, y string"
    with pytest.raises(ValueError):
        models.linear_search(spark.createDataFrame([(1, None, "a"), (2, 1.0, None)], schema), ["x"], "y", "claim_id", [0.1], False)
    flat = models.linear_search(spark.createDataFrame([(i, 2.0, "ab"[i % 2]) for i in range(20)], schema), ["x"], "y", "claim_id", [0.1], True)
    assert flat.coefficients.tolist() == [0.0] and flat.intercept == 0.5
    one = models.linear_search(spark.createDataFrame([(i, float(i), "a") for i in range(20)], schema), ["x"], "y", "claim_id", [0.1], False)
    assert one.coefficients.tolist() == [0.0] and one.errors == [0.0]

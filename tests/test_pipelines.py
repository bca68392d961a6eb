"""Fitted pipelines: saving and loading, streaming, a cascade end to end."""

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from tablewright.catalog.claims import claims
from tablewright.catalog.model_queries import CASCADE_GROUPS, COVID_START, FEATURES, train_val
from tablewright.operators import cascade, impute, metrics
from tablewright.operators.base import Step
from tablewright.operators.encode import TargetEncoder
from tablewright.plans.preparation import Preparation, numeric_features
from tablewright.session import scratch_path
from tablewright.streaming.scoring import score, write_scores

# Small forests: these tests are about the pipelines around them.
FAST = {"numTrees": 20, "maxDepth": 6}


@pytest.fixture(scope="module")
def prepared(spark, sf_dir):
    return Preparation.fit(claims(spark, sf_dir), "claim_type", "claim_id", COVID_START)


def test_preparation_leaves_no_null_features(prepared):
    fitted, rows = prepared
    names = numeric_features(fitted.classes)
    left = rows.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in names]).first().asDict()
    # Codes without a known partner stay unknown, as do their encodings' inputs; encodings have a prior.
    assert {c: n for c, n in left.items() if n} == {}


def test_filling_never_changes_known_values(prepared, spark, sf_dir):
    _, rows = prepared
    before = claims(spark, sf_dir).select("claim_id", F.col("industry").alias("was")).filter("was is not null")
    assert rows.join(before, "claim_id").filter("industry <> was").count() == 0


def test_saved_pipeline_gives_the_same_rows(spark, sf_dir):
    df = claims(spark, sf_dir).filter("claim_type is not null").withColumn("split", F.lit("train"))
    pipeline = Pipeline(
        stages=[
            Step("zero_to_null", column="age"),
            impute.ProportionalFill(column="industry"),
            impute.GroupModeFill(group="carrier_name", column="cause_code"),
            TargetEncoder(columns=["industry"], label="claim_type", prefix="te_"),
        ]
    )
    path = scratch_path(spark, "pipeline")
    model = pipeline.fit(df)
    model.write().overwrite().save(path)
    loaded = PipelineModel.load(path)
    first, second = model.transform(df), loaded.transform(df)
    assert first.columns == second.columns
    assert first.exceptAll(second).count() == 0 and first.count() == second.count()
    again = scratch_path(spark, "unfitted")
    pipeline.write().overwrite().save(again)
    assert Pipeline.load(again).fit(df).transform(df).exceptAll(first).count() == 0


def test_cascade_saves_and_scores_alike(spark, sf_dir):
    train, val = train_val(spark, sf_dir)
    model = cascade.CascadeClassifier(
        groups=CASCADE_GROUPS, features=FEATURES, label="claim_type", model_args=FAST, importance_args=FAST, rest_model="forest", rest_args=FAST
    ).fit(train)
    assert [s["label"] for s in model.stages] == ["2. NON-COMP", "8. DEATH", None]
    path = scratch_path(spark, "cascade")
    model.write().overwrite().save(path)
    first = model.transform(val).select("claim_id", "prediction")
    second = cascade.CascadeModel.load(path).transform(val).select("claim_id", "prediction")
    assert first.exceptAll(second).count() == 0
    assert {r["prediction"] for r in first.distinct().collect()} <= {r["claim_type"] for r in train.select("claim_type").distinct().collect()}
    strict = model.with_thresholds([1.1, 1.1]).transform(val)
    assert strict.filter(F.col("prediction").isin("2. NON-COMP", "8. DEATH")).count() == 0
    assert metrics.classification_report(first.join(val.select("claim_id", "claim_type"), "claim_id"), "claim_type", "prediction").count() >= 4


def test_stream_equals_batch(spark, sf_dir, prepared):
    fitted, _ = prepared
    names = numeric_features(fitted.classes)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    stream = spark.readStream.schema(orders.schema).parquet(f"{sf_dir}/orders*.parquet")
    arriving = claims(spark, sf_dir, orders=stream).withColumn("split", F.lit("test"))
    path = scratch_path(spark, "stream")
    write_scores(score(arriving, *fitted.models).select("claim_id", *names), path, scratch_path(spark, "progress")).awaitTermination()
    batch = fitted.transform(claims(spark, sf_dir)).select("claim_id", *names)
    received = spark.read.schema(batch.schema).parquet(path)
    assert received.count() == batch.count() > 0
    assert received.exceptAll(batch).count() == 0


def test_scratch_is_deleted_when_asked(spark, monkeypatch):
    from tablewright import session

    monkeypatch.setattr(session, "_scratch", {})
    kept = session.cut_lineage(spark.range(5))
    assert kept.count() == 5
    (path,) = session._scratch[spark.sparkContext.applicationId]
    assert session.clear_scratch(spark) == 1 and session.clear_scratch(spark) == 0
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    assert not files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(files)


@pytest.mark.parametrize("model", ["knn", "ridge"])
def test_cascade_with_own_models_saves_and_loads(spark, tmp_path, model):
    rows = [(i, float(i % 10), float(i % 7), "a" if i % 10 > 6 else "b" if i % 7 > 3 else "c", "train" if i % 4 else "val") for i in range(300)]
    df = spark.createDataFrame(rows, "claim_id long, x double, z double, y string, split string")
    fitted = cascade.CascadeClassifier(groups=[["a"]], features=["x", "z"], label="y", model=model, importance_args=FAST, rest_model="tree").fit(df)
    val = df.filter("split = 'val'")
    out = fitted.transform(val).cache()
    assert out.filter("stage_1 not between 0 and 1").count() == 0
    assert out.filter("(prediction = 'a') <> (stage_1 > 0.5)").count() == 0
    assert out.filter("prediction = y").count() > 0.7 * out.count()
    fitted.write().save(str(tmp_path / "cascade"))
    again = cascade.CascadeModel.load(str(tmp_path / "cascade")).transform(val)
    assert out.select("claim_id", "prediction").exceptAll(again.select("claim_id", "prediction")).count() == 0


def test_boosted_probabilities_sum_to_one(spark):
    from tablewright.operators import models

    rows = [(i, float(i % 9), float(i % 5), "abc"[i % 3]) for i in range(90)]
    df = spark.createDataFrame(rows, "claim_id long, x double, z double, y string")
    model = models.fit_classifier(df, "boosted", ["x", "z"], "y", ["a", "b", "c"], maxIter=2, maxDepth=2)
    sums = models.probability_table(model, df, ["x", "z"], "claim_id", ["a", "b", "c"]).groupBy("claim_id").agg(F.sum("probability").alias("s")).collect()
    assert len(sums) == 90 and all(r["s"] == pytest.approx(1) for r in sums)


def test_a_perceptron_refuses_weights():
    from tablewright.operators import models

    with pytest.raises(ValueError):
        models.classifier("mlp", 2, 3, weight="w")

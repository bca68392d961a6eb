"""Empty, constant and one-class input: every report, fit and metric gives a result, with nulls where a ratio has no value."""

import pytest
from pyspark.sql import functions as F

from tablewright.operators import encode, features, impute, metrics, outliers, profile, scale, select

SCHEMA = "claim_id long, split string, y string, flag int, score double, age double, birth_year double, code string, day date"


def frame(spark, kind):
    rows = {
        "empty": [],
        "constant": [(i, "train", "a", 1, 0.5, 30.0, 1990.0, "k", None) for i in range(6)],
        "nulls": [(i, "train", None, None, None, None, None, None, None) for i in range(4)],
        "one_row": [(1, "train", "a", 0, 0.1, 20.0, 2000.0, "k", None)],
    }[kind]
    return spark.createDataFrame(rows, SCHEMA)


KINDS = ["empty", "constant", "nulls", "one_row"]


@pytest.mark.parametrize("kind", KINDS)
def test_reports(spark, kind):
    df = frame(spark, kind)
    numbers, texts = ["age", "birth_year", "score"], ["y", "code"]
    for report in (
        profile.missing_report(df, numbers + texts),
        profile.nullity_correlation(df, numbers),
        profile.numeric_summary(df, numbers),
        profile.categorical_summary(df, texts),
        profile.distinct_report(df, texts),
        profile.value_counts(df, "code", shares=True),
        profile.class_distribution(df, "y"),
        profile.rule_hits(df, {"old": F.col("age") > 60}),
        profile.location_scale(df, numbers, [0.5]),
        metrics.class_scores(df, "y", "code"),
        metrics.classification_report(df, "y", "code"),
        metrics.macro_f1(df, "y", "code"),
        metrics.binary_scores(df, "flag", "flag"),
        metrics.roc_curve(df, "flag", "score"),
        metrics.roc_auc(df, "flag", "score"),
        metrics.threshold_sweep(df, "flag", "score", [0.5]),
        select.association_report(df, texts, "y"),
        select.feature_chi2(df, numbers, "y"),
        select.spearman_matrix(df, numbers),
        scale.variance_ranking(df, numbers),
    ):
        report.collect()


@pytest.mark.parametrize("kind", KINDS)
def test_fits(spark, kind):
    df = frame(spark, kind)
    n = df.count()
    for operator in (
        outliers.ImplausibleAge(),
        scale.MinMaxScaler(columns=["age"]),
        scale.StandardScaler(columns=["age"]),
        features.IncomeClass(column="age"),
        encode.FrequencyEncoder(columns=["code"]),
        encode.TargetEncoder(columns=["code"], label="y"),
        impute.ProportionalFill(column="code"),
        impute.GroupModeFill(group="y", column="code"),
        impute.GroupStatisticFill(group="y", column="age", metric="mean"),
        impute.GroupStatisticFill(group="y", column="age", metric="median"),
        impute.RepairDateOrder(target="day", reference="day", condition="day"),
    ):
        assert operator.fit(df).transform(df).count() == n


def test_values_without_a_ratio(spark):
    constant, empty = frame(spark, "constant"), frame(spark, "empty")
    assert metrics.roc_auc(constant, "flag", "score").first()["auc"] is None
    assert profile.rule_hits(empty, {"old": F.col("age") > 60}).first()["pct_hits"] is None
    kept = outliers.ImplausibleAge().fit(constant).transform(constant)
    assert {r["age"] for r in kept.collect()} == {30.0}
    assert {r["income_class"] for r in features.IncomeClass(column="age").fit(empty).transform(constant).collect()} == {"Unknown"}


def test_date_repair_keeps_what_it_cannot_derive(spark):
    rows = [(1, "2020-01-10", "2020-01-01", "2020-01-05"), (2, "2020-01-03", None, "2020-01-05"), (3, "2020-01-03", "2020-01-01", "2020-01-05"), (4, None, "2020-01-01", "2020-01-05")]
    df = spark.createDataFrame(rows, "claim_id long, target string, reference string, condition string")
    df = df.select("claim_id", *[F.to_date(c).alias(c) for c in ("target", "reference", "condition")], F.lit("train").alias("split"))
    out = impute.RepairDateOrder(target="target", reference="reference", condition="condition").fit(df).transform(df).orderBy("claim_id").collect()
    assert [str(r["target"]) for r in out] == ["2020-01-10", "2020-01-03", "2020-01-06", "None"]

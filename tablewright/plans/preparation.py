"""The preparation of claims as ``pyspark.ml`` pipelines.

Order matters: a stage is fitted on the output of the stage before it. Fits read the
training rows only; all four pipelines can be saved and used on a stream.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.operators import clean, encode, features, impute, outliers, rules, scale  # noqa: F401  (registers the steps)
from tablewright.operators.base import Step
from tablewright.operators.encode import BinaryEncoder, DummyEncoder, FrequencyEncoder, TargetEncoder
from tablewright.operators.impute import (
    BirthYearByMedians,
    DateByMeanGap,
    DateByMedianGap,
    DescriptionFromCode,
    GroupModeFill,
    ProportionalFill,
)
from tablewright.operators.outliers import EarlyDates, ImplausibleAge, LogIqr
from tablewright.operators.sample import stratified_split
from tablewright.plans.versions import current, next_version, publish
from tablewright.session import cut_lineage

# Fixed values.
STATE_MEAN_WAGE = 1757.19

CODES, TEXTS = ["body_code", "cause_code"], ["body_desc", "cause_desc"]


def consistency_pipeline(covid_start: str = rules.COVID_START) -> Pipeline:
    """Row rules only, so it may run before the split."""
    return Pipeline(
        stages=[
            Step("parse_dates", columns=["hearing_date_raw"]),
            Step("null_sentinels", sentinels={"adr_flag": ["U"], "carrier_type": ["UNKNOWN"], "gender": ["U"]}),
            Step("merge_codes", code="body_code", description="body_desc"),
            Step("zero_to_null", column="birth_year"),
            Step("zero_to_null", column="age"),
            Step("reset_child_dependents", dependents="dependents", age="age"),
            Step("lower_mismatched_age", age="age", birth_year="birth_year", date="accident_date"),
            Step("earliest_date", target="accident_date", others=["assembly_date", "c2_date", "c3_date"]),
            Step("reset_flag_before", flag="covid_flag", date="accident_date", start=covid_start),
            Step("value_to_null", column="gender", value="X"),
        ]
    )


def outlier_pipeline() -> Pipeline:
    return Pipeline(
        stages=[
            EarlyDates(date="accident_date", companion="c2_date"),
            ImplausibleAge(),
            Step("null_implausible_birth_year", date="accident_date", birth_year="birth_year"),
            Step("limit_by_split", column="ime4_count"),
            LogIqr(column="wage"),
        ]
    )


def missing_pipeline() -> Pipeline:
    return Pipeline(
        stages=[
            Step("fill_constant", column="ime4_count", value=0),
            Step("derive_birth_year", birth_year="birth_year", date="accident_date", age="age"),
            BirthYearByMedians(),
            ProportionalFill(column="industry"),
            DateByMedianGap(),
            Step("derive_age", age="age", birth_year="birth_year", date="accident_date"),
            ProportionalFill(column="adr_flag"),
            Step("fill_block", codes=CODES, descriptions=TEXTS),
            GroupModeFill(group="cause_code", column="body_code"),
            DescriptionFromCode(code="body_code", description="body_desc"),
            GroupModeFill(group="body_code", column="cause_code"),
            DescriptionFromCode(code="cause_code", description="cause_desc"),
            ProportionalFill(column="gender"),
            ProportionalFill(column="carrier_type"),
            Step("fill_constant", column="wage", value=STATE_MEAN_WAGE, into="wage_imputed"),
            DateByMeanGap(),
        ]
    )


TARGET_ENCODED = ["industry", "cause_code", "body_code"]


def encoding_pipeline(label: str) -> Pipeline:
    """``te_<column>_<i>`` for class i of the sorted classes."""
    return Pipeline(
        stages=[
            BinaryEncoder(columns=["gender", "covid_flag", "attorney_flag", "adr_flag"]),
            TargetEncoder(columns=TARGET_ENCODED, label=label, prefix="te_"),
            FrequencyEncoder(columns=["industry", "cause_code", "body_code", "carrier_type", "carrier_name"]),
            DummyEncoder(column="district"),
            Step("null_flags", columns=["c3_date", "wage", "hearing_date_raw"], include_zero=["wage"]),
        ]
    )


def feature_pipeline() -> Pipeline:
    return Pipeline(
        stages=[
            Step("add_days_between", start="accident_date", end="assembly_date", into="days_to_assembly"),
            Step("add_days_between", start="accident_date", end="c2_date_imputed", into="days_to_c2"),
            Step("add_log", column="wage_imputed"),
            Step("add_log", column="days_to_assembly"),
            Step("add_log", column="days_to_c2"),
            Step("add_season", date="accident_date"),
            Step("add_date_parts", date="accident_date"),
            DummyEncoder(column="accident_date_season"),
        ]
    )


def numeric_features(classes: list[str]) -> list[str]:
    """Numeric columns that the pipelines leave for a model."""
    return [
        "age", "birth_year", "ime4_count", "dependents", "gender_binary", "covid_flag_binary", "attorney_flag_binary", "adr_flag_binary",
        *[f"te_{c}_{i}" for c in TARGET_ENCODED for i in range(len(classes))],
        "industry_freq", "cause_code_freq", "body_code_freq", "carrier_type_freq", "carrier_name_freq",
        "c3_date_nabinary", "wage_nabinary", "hearing_date_raw_nabinary",
        "wage_imputed_log", "days_to_assembly_log", "days_to_c2_log", "accident_datemonth",
    ]


class Preparation:
    """The fitted pipelines in order, and the classes they were fitted for."""

    def __init__(self, models: list[PipelineModel], classes: list[str]):
        self.models = models
        self.classes = classes

    @classmethod
    def fit(cls, claims: DataFrame, label: str, key: str, covid_start: str = rules.COVID_START) -> tuple["Preparation", DataFrame]:
        """Fit all pipelines; returns them with the prepared rows.

        The rows are written between the pipelines: the fits of one pipeline then read
        a few columns of a table and do not repeat the work of the pipelines before.
        """
        consistency = consistency_pipeline(covid_start).fit(claims)
        rows = cut_lineage(consistency.transform(claims.filter(claims[label].isNotNull())))
        rows = stratified_split(rows, label, key, {"train": 0.7}, rest="val")
        classes = clean.class_list(rows, label)
        models = [consistency]
        for pipeline in (outlier_pipeline(), missing_pipeline(), encoding_pipeline(label), feature_pipeline()):
            model = pipeline.fit(rows)
            rows = cut_lineage(model.transform(rows))
            models.append(model)
        return cls(models, classes), rows

    def transform(self, claims: DataFrame, split: str = "test") -> DataFrame:
        """Prepare rows that were not part of the fit; they are capped, never dropped."""
        rows = claims.withColumn("split", F.lit(split))
        for model in self.models:
            rows = model.transform(rows)
        return rows

    def save(self, path: str, spark: SparkSession | None = None) -> None:
        """The pipelines, and the classes in their order, as a new version under the path.

        ``load`` sees the version when all of it is written; until then, and if the save breaks, the version before.
        """
        spark = spark or SparkSession.builder.getOrCreate()
        version = next_version(spark, path)
        for i, model in enumerate(self.models):
            model.write().save(f"{path}/{version}/pipeline_{i}")
        about = spark.createDataFrame([(len(self.models), self.classes)], "n_pipelines int, classes array<string>")
        about.write.parquet(f"{path}/{version}/classes")
        publish(spark, path, version)

    @classmethod
    def load(cls, path: str, spark: SparkSession | None = None) -> "Preparation":
        spark = spark or SparkSession.builder.getOrCreate()
        place = current(spark, path)
        about = spark.read.parquet(f"{place}/classes").first()
        return cls([PipelineModel.load(f"{place}/pipeline_{i}") for i in range(about["n_pipelines"])], list(about["classes"]))

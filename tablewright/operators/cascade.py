"""N-stage cascade: every stage separates one group of classes from the classes that
remain, and rows no stage claims go to a last model.

Prediction scores all stages on one frame and takes the first stage over its
threshold; rows are not split and joined again stage by stage.
"""

from __future__ import annotations

import functools
from typing import Any

from pyspark.ml import Estimator, Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param
from pyspark.ml.util import (
    DefaultParamsReadable,
    DefaultParamsReader,
    DefaultParamsWritable,
    DefaultParamsWriter,
    MLReadable,
    MLReader,
    MLWritable,
    MLWriter,
)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.operators import metrics
from tablewright.operators.clean import class_list
from tablewright.operators.base import FittedModel
from tablewright.operators.models import VECTOR, KnnClassifier, RidgeClassifier, fit_classifier, kept, top_features
from tablewright.operators.neighbors import as_vectors, smote_tomek
from tablewright.plans.side_by_side import PARALLEL, side_by_side

# Fixed values.
PLACEHOLDER = "pred_placeholder"
RARE_BELOW = 0.05
SMOTE_RATIO = 0.05
FEATURES_RARE = 5
FEATURES_COMMON = 10


def stage_plan(groups: list[list[str]], classes: list[str]) -> list[tuple[list[str], list[str]]]:
    """(positive classes, classes that remain) per stage; positives leave for good."""
    left, plan = list(classes), []
    for group in groups:
        left = [c for c in left if c not in group]
        plan.append((list(group), list(left)))
    return plan


def stage_plan_table(spark: SparkSession, groups: list[list[str]], classes: list[str]) -> DataFrame:
    rows = []
    for i, (positive, rest) in enumerate(stage_plan(groups, classes), start=1):
        rows += [(i, c, "positive") for c in positive] + [(i, c, "rest") for c in rest]
    return spark.createDataFrame(rows, "stage int, class string, role string")


def binary_relabel(label: str, positive: list[str]) -> Column:
    if not positive:
        raise ValueError("a stage needs at least one positive class")
    return F.coalesce(F.col(label).isin(*positive), F.lit(False)).cast("int")


def stage_rows(df: DataFrame, label: str, positive: list[str], rest: list[str], name: str = "binary_target") -> DataFrame:
    """Rows of the stage's classes with a 0/1 target."""
    return df.filter(F.col(label).isin(*positive, *rest)).withColumn(name, binary_relabel(label, positive))


def decide(stages: list[tuple[Column, float, str]], rest: Column | None = None, placeholder: str = PLACEHOLDER) -> Column:
    """Label of the first stage whose score is over its threshold, else the rest model's."""
    arms = [F.when(score > threshold, F.lit(name)) for score, threshold, name in stages]
    last = [] if rest is None else [rest]
    return F.coalesce(*arms, *last, F.lit(placeholder))


def broadcast_thresholds(thresholds: list[float], n_stages: int) -> list[float]:
    """One threshold serves all stages; otherwise there is one per stage."""
    if len(thresholds) == 1:
        return thresholds * n_stages
    if len(thresholds) != n_stages:
        raise ValueError(f"{len(thresholds)} thresholds for {n_stages} stages")
    return list(thresholds)


class CascadeClassifier(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Fit one binary model per stage and, with ``rest_model``, a model for what is left.

    A stage whose positives are rarer than ``rare_below`` is trained on its ``features_rare`` most
    important features after oversampling to ``smote_ratio``; any other stage on its
    ``features_common`` most important. Stages may be any model of ``MODEL_NAMES``; of ``knn`` and
    ``ridge`` the share or scaled value of the positive class is the score.
    A stage emits the name of its first positive class, or with ``emit='group'`` the
    names joined by ``|``. ``thresholds`` may be changed on the fitted model. At most ``parallelism``
    stages are fitted at the same time; the models do not depend on it.
    """

    defaults: dict[str, Any] = {
        "groups": [], "features": [], "label": None, "key": "claim_id", "model": "forest", "model_args": {}, "thresholds": [0.5],
        "rest_model": None, "rest_args": {}, "emit": "first", "importance_args": {}, "seed": 42,
        "rare_below": RARE_BELOW, "smote_ratio": SMOTE_RATIO, "features_rare": FEATURES_RARE, "features_common": FEATURES_COMMON,
        "parallelism": PARALLEL,
    }

    def __init__(self, **args: Any):
        super().__init__()
        unknown = set(args) - set(self.defaults)
        if unknown:
            raise TypeError(f"no argument {sorted(unknown)}")
        self.args = Param(self, "args", "keyword arguments")
        self._set(args={**self.defaults, **args})

    def _fit(self, dataset: DataFrame) -> "CascadeModel":
        """The plan is known before any fit, so the stages and the last model are fitted side by side."""
        a = self.getOrDefault(self.args)
        label, key, spark = a["label"], a["key"], dataset.sparkSession
        train = dataset.filter("split = 'train'") if "split" in dataset.columns else dataset
        classes = class_list(train, label)
        plan = stage_plan(a["groups"], classes)
        taken = {c for g in a["groups"] for c in g}
        rest_classes = [c for c in classes if c not in taken]
        with kept(train.select(key, label, *[f for f in a["features"] if f not in (key, label)]).na.drop(subset=a["features"])) as rows:
            shares = _positive_shares(rows, label, plan)
            for (positive, _), share in zip(plan, shares):
                if not share or share == 1:
                    raise ValueError(f"stage {positive} needs rows on both sides")
            tasks = [functools.partial(_train_stage, rows, positive, rest, share < a["rare_below"], a) for (positive, rest), share in zip(plan, shares)]
            if a["rest_model"]:
                left = rows.filter(F.col(label).isin(*rest_classes))
                tasks.append(lambda: fit_classifier(left, a["rest_model"], a["features"], label, rest_classes, **a["rest_args"]))
            fitted = side_by_side(spark, tasks, a["parallelism"])
        stages, models = [], []
        for (positive, rest), share, (chosen, model) in zip(plan, shares, fitted):
            name = positive[0] if a["emit"] == "first" else "|".join(positive)
            stages.append({"label": name, "positive": positive, "rest": rest, "features": chosen, "resampled": share < a["rare_below"]})
            models.append(model)
        if a["rest_model"]:
            models.append(fitted[-1])
            stages.append({"label": None, "positive": rest_classes, "rest": [], "features": a["features"], "resampled": False})
        state = {"stages": stages, "thresholds": broadcast_thresholds(a["thresholds"], len(a["groups"])), "has_rest": bool(a["rest_model"])}
        return CascadeModel(state, models)


def _positive_shares(rows: DataFrame, label: str, plan: list[tuple[list[str], list[str]]]) -> list[float | None]:
    """Share of the positive classes among the rows of each stage, from one pass."""
    counted = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count("*").alias("n")).collect()}
    shares: list[float | None] = []
    for positive, rest in plan:
        own, others = (sum(counted.get(c, 0) for c in of) for of in (set(positive), set(rest) - set(positive)))
        shares.append(own / (own + others) if own + others else None)
    return shares


def _train_stage(train: DataFrame, positive: list[str], rest: list[str], rare: bool, a: dict[str, Any]) -> tuple[list[str], Model]:
    """The features of a stage and its model."""
    key = a["key"]
    rows = stage_rows(train, a["label"], positive, rest)
    chosen = top_features(rows, a["features"], "binary_target", a["features_rare"] if rare else a["features_common"], key=key, **a["importance_args"])
    if rare:
        grown = smote_tomek(as_vectors(rows, key, chosen, "binary_target"), "binary_target", 1, a["smote_ratio"], seed=a["seed"])
        rows = grown.select(F.col("row_key").alias(key), "binary_target", *[F.col("vec")[i].alias(f) for i, f in enumerate(chosen)])
    return chosen, _fit_stage(rows, a["model"], chosen, key, a["model_args"])


def _fit_stage(rows: DataFrame, name: str, features: list[str], key: str, args: dict[str, Any]) -> Model:
    """A binary stage: an MLlib model, or an own one that writes ``own_stage_share``."""
    own = {"ridge": RidgeClassifier, "knn": KnnClassifier}.get(name)
    if own is None:
        return fit_classifier(rows, name, features, "binary_target", [0, 1], **args)
    named = {"key": key} if name == "knn" else {}
    # Stages of a fit share their columns' names with the rows they score.
    return own(features=features, label="binary_target", prediction="own_stage", share_of=1, **named, **args).fit(rows.drop("split"))


class CascadeModel(Model, MLReadable, MLWritable):
    """Fitted cascade: ``stage_<i>`` probabilities and ``prediction``."""

    def __init__(self, state: dict | None = None, models: list[Model] | None = None):
        super().__init__()
        self.state = Param(self, "state", "stages and thresholds")
        self._set(state=state or {})
        self.models = models or []

    @property
    def stages(self) -> list[dict]:
        return self.getOrDefault(self.state)["stages"]

    def with_thresholds(self, thresholds: list[float]) -> "CascadeModel":
        state = dict(self.getOrDefault(self.state))
        state["thresholds"] = broadcast_thresholds(thresholds, len(state["thresholds"]))
        return CascadeModel(state, self.models)

    def copy(self, extra: dict | None = None) -> "CascadeModel":
        return self

    def scores(self, dataset: DataFrame) -> DataFrame:
        """The rows with ``stage_1``, ``stage_2``, … and, with a last model, ``rest_label``."""
        out = dataset
        n_binary = len(self.getOrDefault(self.state)["thresholds"])
        for i, (stage, model) in enumerate(zip(self.stages, self.models), start=1):
            kept = out.columns
            doubles = [F.col(f).cast("double").alias(f"input_{j}") for j, f in enumerate(stage["features"])]
            names = [f"input_{j}" for j in range(len(doubles))]
            wide = VectorAssembler(inputCols=names, outputCol=VECTOR, handleInvalid="keep").transform(out.select("*", *doubles))
            if i <= n_binary and isinstance(model, FittedModel):
                wide = model.transform(wide)
                # Rows with a missing feature have no neighbours and count as negative.
                result = F.coalesce("own_stage_share", F.lit(0.0)).alias(f"stage_{i}")
            elif i <= n_binary:
                wide = model.transform(wide)
                result = vector_to_array("probability")[1].alias(f"stage_{i}")
            else:
                wide = model.transform(wide)
                labels = F.array(*[F.lit(c) for c in stage["positive"]])
                result = F.element_at(labels, F.col("prediction").cast("int") + 1).alias("rest_label")
            out = wide.select(*kept, result)
        return out

    def _transform(self, dataset: DataFrame) -> DataFrame:
        state = self.getOrDefault(self.state)
        scored = self.scores(dataset)
        stages = [(F.col(f"stage_{i}"), t, s["label"]) for i, (t, s) in enumerate(zip(state["thresholds"], self.stages), start=1)]
        rest = F.col("rest_label") if state["has_rest"] else None
        return scored.withColumn("prediction", decide(stages, rest))

    def write(self) -> MLWriter:
        return _CascadeWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _CascadeReader()


class _CascadeWriter(MLWriter):
    def __init__(self, instance: CascadeModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession, extraMetadata={"n_models": len(self.instance.models)})
        for i, model in enumerate(self.instance.models):
            model.save(f"{path}/model_{i}")


class _CascadeReader(MLReader):
    def load(self, path: str) -> CascadeModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = CascadeModel()
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        model.models = [DefaultParamsReader.loadParamsInstance(f"{path}/model_{i}", self.sparkSession) for i in range(metadata["n_models"])]
        return model


def stage_loss(df: DataFrame, label: str, plan: list[tuple[list[str], list[str]]], thresholds: list[float], score: str = "stage_{}", normalize: bool = False) -> DataFrame:
    """Error distribution per stage and true class, each stage with its own threshold.

    All stages are read in one pass: a row is counted in every stage that has its class.
    """
    return metrics.error_distribution(_stage_predictions(df, label, plan, thresholds, score), "class", "target", "predicted", normalize, by=["stage"])


def stage_report(df: DataFrame, label: str, plan: list[tuple[list[str], list[str]]], thresholds: list[float], score: str = "stage_{}") -> DataFrame:
    """Classification report of every stage's 0/1 decision."""
    return metrics.classification_report(_stage_predictions(df, label, plan, thresholds, score), "target", "predicted", by=["stage"])


def _stage_predictions(df: DataFrame, label: str, plan, thresholds: list[float], score: str) -> DataFrame:
    parts = []
    for i, ((positive, rest), t) in enumerate(zip(plan, broadcast_thresholds(thresholds, len(plan))), start=1):
        entry = F.struct(
            F.lit(i).alias("stage"),
            F.col(label).alias("class"),
            binary_relabel(label, positive).alias("target"),
            (F.col(score.format(i)) > t).cast("int").alias("predicted"),
        )
        parts.append(F.when(F.col(label).isin(*positive, *rest), entry))
    return df.select(F.inline(F.filter(F.array(*parts), lambda x: x.isNotNull())))

"""Classifiers by name, model-based feature selection and model sweeps (MLlib)."""

from __future__ import annotations

import contextlib
import functools
import math
import operator
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark import StorageLevel
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    NaiveBayes,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import PolynomialExpansion, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.hashing import hash_order
from tablewright.operators import metrics
from tablewright.operators.base import FittedOperator
from tablewright.operators.boosting import BoostedTrees
from tablewright.operators.clean import class_list
from tablewright.operators.forest import ForestTrees
from tablewright.operators.neighbors import as_vectors, knn_vote
from tablewright.operators.sample import stratified_sample
from tablewright.operators.select import cumulative_cut
from tablewright.operators.softmax import FoldedSoftmax
from tablewright.plans.lookup import FittedTable
from tablewright.plans.side_by_side import PARALLEL, side_by_side

VECTOR = "features"
TARGET = "target"
FOLDS = 5
#: The many short passes of an elimination have tasks of about so many rows at least: starting tasks takes longer than fewer rows do.
ROWS_OF_TASK = 25_000
#: The most rows of a training partition. A forest keeps a number per row and tree beside them, about 600 MB for so many rows and 100 trees.
ROWS_OF_PART = 1_000_000


@contextlib.contextmanager
def kept(df: DataFrame) -> Iterator[DataFrame]:
    """Training reads its rows many times; lost blocks are recomputed."""
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield df
    finally:
        df.unpersist()


def gathered(df: DataFrame) -> DataFrame:
    """The rows in no more partitions than ``ROWS_OF_TASK`` asks for; a large table keeps its own."""
    return df.coalesce(max(1, math.ceil(df.count() / ROWS_OF_TASK)))


@contextlib.contextmanager
def dealt(df: DataFrame) -> Iterator[DataFrame]:
    """The rows kept, in partitions of about ``ROWS_OF_PART`` at most however large the files are; smaller ones stay as they are."""
    with kept(df) as data:
        sizes = data.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n"))
        parts, rows, largest = sizes.agg(F.count("*"), F.sum("n"), F.max("n")).first()
        if not parts or largest <= ROWS_OF_PART:
            yield data
        else:
            with kept(data.repartition(max(parts, math.ceil(rows / ROWS_OF_PART)))) as evenly:
                yield evenly


def assembled(df: DataFrame, features: list[str], *extra: str) -> DataFrame:
    """A vector column of the features; rows with nulls are left out."""
    doubles = df.na.drop(subset=features).select(*extra, *[F.col(c).cast("double").alias(c) for c in features])
    return VectorAssembler(inputCols=features, outputCol=VECTOR).transform(doubles)


def with_target(df: DataFrame, label: str, classes: list) -> DataFrame:
    """``target``: position of the class in the sorted list, as MLlib wants it."""
    pairs = [F.lit(x) for i, c in enumerate(classes) for x in (c, float(i))]
    return df.withColumn(TARGET, F.create_map(*pairs)[F.col(label)]).filter(F.col(TARGET).isNotNull())


class RidgeClassifier(FittedOperator):
    """One ridge regression per class on +1 / -1 targets; the largest value wins.

    ``share_of`` adds ``<prediction>_share``: that class's value brought from [-1, 1] to [0, 1], so the
    class of two with the larger value is over one half.
    """

    defaults = {"features": [], "label": None, "alpha": 1.0, "prediction": "prediction", "share_of": None}

    def learn(self, train, args):
        # The sums of each class give the targets of all regressions.
        classes = class_list(train, args["label"])
        by_class = fold_sums(train.filter(F.col(args["label"]).isNotNull()), args["features"], args["label"])
        if not by_class:
            raise ValueError("no row has a label and all features")
        total = functools.reduce(operator.add, by_class.values())
        fits = []
        for c in classes:
            own = by_class.get(c, total - total)
            target = 2 * own.first - total.first
            products = np.block([[total.products, target[:, None]], [target[None, :], np.array([[total.n]])]])
            signed = Sums(total.n, np.append(total.first, 2 * own.n - total.n), products, np.append(total.start, 0.0))
            coefficients, intercept = penalised_fit(signed, args["alpha"], l1=False)
            fits.append([intercept, *[float(x) for x in coefficients]])
        return {"classes": classes, "fits": fits}, {}

    @staticmethod
    def apply(df, args, scalars, tables):
        scores = []
        for c, (intercept, *coefficients) in zip(scalars["classes"], scalars["fits"]):
            score = F.lit(intercept)
            for f, w in zip(args["features"], coefficients):
                score = score + F.lit(w) * F.col(f).cast("double")
            scores.append(F.struct(score.alias("score"), F.lit(c).alias("class")))
        out = df.withColumn(args["prediction"], F.array_max(F.array(*scores))["class"])
        if args["share_of"] is not None:
            own = scores[scalars["classes"].index(args["share_of"])]["score"]
            out = out.withColumn(f"{args['prediction']}_share", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (own + 1) / 2)))
        return out


class KnnClassifier(FittedOperator):
    """Majority class of the nearest training rows; the training rows are the model.

    ``share_of`` adds ``<prediction>_share``: the share of the neighbours that have this class.
    """

    defaults = {"features": [], "label": None, "key": "claim_id", "k": 5, "prediction": "prediction", "share_of": None}

    def learn(self, train, args):
        rows = train.filter(F.col(args["label"]).isNotNull()).select(args["key"], args["label"], *args["features"])
        return {}, {"train": FittedTable.of(rows)}

    @staticmethod
    def apply(df, args, scalars, tables):
        base = as_vectors(tables["train"].df, args["key"], args["features"], args["label"])
        votes = knn_vote(as_vectors(df, args["key"], args["features"]), base, args["label"], args["k"], share_of=args["share_of"])
        shares = [] if args["share_of"] is None else [F.col("share").alias(f"{args['prediction']}_share")]
        named = votes.select(F.col("row_key").alias(args["key"]), F.col("prediction").alias(args["prediction"]), *shares)
        return df.join(named, args["key"], "left")


def classifier(name: str, n_classes: int = 2, n_features: int = 0, weight: str | None = None, seed: int = 42, **args: Any) -> Estimator:
    """An MLlib estimator on ``features`` / ``target``; ``ridge`` and ``knn`` are own classes."""
    common: dict[str, Any] = {"featuresCol": VECTOR, "labelCol": TARGET}
    if weight and name == "mlp":
        raise ValueError("a multilayer perceptron takes no weights")
    if weight:
        common["weightCol"] = weight
    if name == "logistic":
        return LogisticRegression(**common, **{"maxIter": 100, **args})
    if name == "forest":
        settings = {"numTrees": 100, "maxDepth": 10, **args}
        if not weight and ForestTrees.takes(settings):
            return ForestTrees(n_classes=n_classes, features=VECTOR, target=TARGET, seed=seed, **settings)
        return RandomForestClassifier(**common, seed=seed, **settings)
    if name == "boosted":
        settings = {"maxIter": 100, "stepSize": 0.05, "maxDepth": 6, "subsamplingRate": 0.8, **args}
        if BoostedTrees.takes({"weight": weight, **settings}):
            return BoostedTrees(n_classes=n_classes, features=VECTOR, target=TARGET, weight=weight, seed=seed, **settings)
        boosted = GBTClassifier(**common, seed=seed, **settings)
        if n_classes == 2:
            return boosted
        rest = {"weightCol": weight} if weight else {}
        return OneVsRest(classifier=boosted, featuresCol=VECTOR, labelCol=TARGET, parallelism=min(n_classes, 8), **rest)
    if name == "tree":
        return DecisionTreeClassifier(**common, seed=seed, **args)
    if name == "naive_bayes":
        return NaiveBayes(**common, **{"modelType": "gaussian", **args})
    if name == "mlp":
        hidden = args.pop("hidden", [16])
        return MultilayerPerceptronClassifier(**common, seed=seed, layers=[n_features, *hidden, n_classes], **args)
    raise ValueError(f"no classifier named {name!r}")


MODEL_NAMES = ["logistic", "forest", "boosted", "tree", "naive_bayes", "mlp", "ridge", "knn"]


def fit_predict(
    train: DataFrame, rows: DataFrame, name: str, features: list[str], label: str, key: str, weight: str | None = None, **args: Any
) -> DataFrame:
    """Fit on ``train`` and return ``key, label, prediction`` (a class) for ``rows``."""
    if name in ("ridge", "knn"):
        own = RidgeClassifier(features=features, label=label, **args) if name == "ridge" else KnnClassifier(features=features, label=label, key=key, **args)
        return own.fit(train).transform(rows.na.drop(subset=features)).select(key, label, "prediction")
    classes = class_list(train, label)
    model = fit_classifier(train, name, features, label, classes, weight, **args)
    scored = model.transform(assembled(rows, features, key, label))
    return scored.select(key, label, F.element_at(F.array(*[F.lit(c) for c in classes]), F.col("prediction").cast("int") + 1).alias("prediction"))


def fit_classifier(train: DataFrame, name: str, features: list[str], label: str, classes: list, weight: str | None = None, **args: Any) -> Model:
    rows = assembled(with_target(train, label, classes), features, TARGET, *([weight] if weight else []))
    with dealt(rows) as data:
        return classifier(name, len(classes), len(features), weight, **args).fit(data)


def model_sweep(
    train: DataFrame, rows: DataFrame, models: dict[str, dict[str, Any]], features: list[str], label: str, key: str, parallelism: int = PARALLEL
) -> DataFrame:
    """Scored rows, accuracy and macro F1 of each model: one row per model. Models are fitted side by side."""
    with kept(train) as data:
        tasks = [functools.partial(fit_predict, data, rows, name, features, label, key, **args) for name, args in models.items()]
        predicted = side_by_side(train.sparkSession, tasks, parallelism)
    out = None
    for name, found in zip(models, predicted):
        scores = metrics.class_scores(found, label, "prediction")
        row = scores.agg(
            F.lit(name).alias("model"),
            F.sum("support").cast("long").alias("n_rows"),
            F.try_divide(F.sum("hits"), F.sum("support")).alias("accuracy"),
            F.avg("f1").alias("macro_f1"),
        )
        out = row if out is None else out.unionByName(row)
    return out


def with_probabilities(model: Model, rows: DataFrame, into: str = "probabilities") -> DataFrame:
    """Add an array of class probabilities that sum to 1.

    One-against-rest models have one binary model per class; their positive probabilities are
    divided by their sum (equal shares where all are 0).
    """
    if not hasattr(model, "models"):
        return model.transform(rows).withColumn(into, vector_to_array("probability"))
    out, own = rows, rows.columns
    for i, part in enumerate(model.models):
        # Only the positive probability of each part is carried on.
        out = part.transform(out).select(*own, *[f"against_{j}" for j in range(i)], vector_to_array("probability")[1].alias(f"against_{i}"))
    names = [f"against_{i}" for i in range(len(model.models))]
    total = sum((F.col(n) for n in names), F.lit(0.0))
    shares = F.array(*[F.coalesce(F.try_divide(F.col(n), total), F.lit(1.0 / len(names))) for n in names])
    return out.withColumn(into, shares).drop(*names)


def probability_table(model: Model, rows: DataFrame, features: list[str], key: str, classes: list) -> DataFrame:
    """One row per record and class with the model's probability."""
    scored = with_probabilities(model, assembled(rows, features, key))
    values = F.col("probabilities")
    pairs = F.array(*[F.struct(F.lit(c).alias("class"), values[i].alias("probability")) for i, c in enumerate(classes)])
    return scored.select(key, F.inline(pairs))


# Feature selection by models


def importance_table(spark, features: list[str], values) -> DataFrame:
    """One row per feature."""
    return spark.createDataFrame([(f, float(v)) for f, v in zip(features, values)], "feature string, importance double")


def forest_importance(train: DataFrame, features: list[str], label: str, **args: Any) -> DataFrame:
    model = fit_classifier(train, "forest", features, label, class_list(train, label), **args)
    return importance_table(train.sparkSession, features, model.featureImportances)


def boosted_importance(train: DataFrame, features: list[str], label: str, **args: Any) -> DataFrame:
    """Mean over the one-against-rest models."""
    model = fit_classifier(train, "boosted", features, label, class_list(train, label), **args)
    parts = model.models if hasattr(model, "models") else [model]
    means = sum(p.featureImportances.toArray() for p in parts) / len(parts)
    return importance_table(train.sparkSession, features, means)


def importance_selection(train: DataFrame, features: list[str], label: str, method: str = "forest", share: float = 0.9, **args: Any) -> DataFrame:
    table = {"forest": forest_importance, "boosted": boosted_importance}[method](train, features, label, **args)
    return cumulative_cut(table, share)


def top_features(
    train: DataFrame, features: list[str], label: str, n: int = 10, sample_fraction: float | None = None, key: str = "claim_id", **args: Any
) -> list[str]:
    """The ``n`` most important features, optionally from a fraction of every class."""
    rows = train if sample_fraction is None else stratified_sample(train, label, key, sample_fraction, seed="top")
    ranked = forest_importance(rows, features, label, **args).orderBy(F.desc("importance"), "feature").limit(n)
    return [r["feature"] for r in ranked.collect()]


def _folds(df: DataFrame, key: str) -> DataFrame:
    """Fold numbers by hash: the same on every run and cluster."""
    return df.withColumn("fold", F.conv(F.substring(hash_order(F.col(key), "fold"), 1, 8), 16, 10).cast("long") % FOLDS).withColumn(
        "fold", F.col("fold").cast("int")
    )


@dataclass
class Sums:
    """Sums over rows of 1, of each of the columns (the target last) and of the products of any two.

    Columns count from ``start``, which keeps the digits of columns far from 0.
    """

    n: float
    first: np.ndarray
    products: np.ndarray
    start: np.ndarray

    def __add__(self, other: "Sums") -> "Sums":
        return Sums(self.n + other.n, self.first + other.first, self.products + other.products, self.start)

    def __sub__(self, other: "Sums") -> "Sums":
        return Sums(self.n - other.n, self.first - other.first, self.products - other.products, self.start)

    @property
    def mean(self) -> np.ndarray:
        return self.first / self.n

    @property
    def covariance(self) -> np.ndarray:
        return self.products / self.n - np.outer(self.mean, self.mean)

    def squared_error(self, coefficients: np.ndarray, intercept: float) -> float:
        """Mean of (target - prediction)^2 over the rows."""
        turn = np.append(-coefficients, 1.0)
        shifted = intercept - turn @ self.start
        return float(turn @ self.products @ turn - 2 * shifted * (turn @ self.first) + self.n * shifted**2) / self.n


def fold_sums(rows: DataFrame, columns: list[str], fold: str) -> dict[Any, Sums]:
    """The sums of every fold in one aggregation with map-side combining; rows with nulls are left out.

    What comes to the driver is columns squared numbers per fold, and one row to count from.
    """
    known = rows.na.drop(subset=columns)
    origin = known.select(*[F.col(c).cast("double").alias(c) for c in columns]).first()
    if origin is None:
        return {}
    shifted = known.select(F.col(fold).alias("part"), *[(F.col(c).cast("double") - F.lit(x)).alias(f"x{i}") for i, (c, x) in enumerate(zip(columns, origin))])
    size, out = len(columns), {}
    wide = VectorAssembler(inputCols=[f"x{i}" for i in range(size)], outputCol=VECTOR).transform(shifted)
    # All products of two columns: x0, x0 x0, x1, x0 x1, x1 x1, x2, ...
    wide = PolynomialExpansion(degree=2, inputCol=VECTOR, outputCol="products").transform(wide)
    summed = wide.groupBy("part").agg(Summarizer.metrics("sum", "count").summary(F.col("products")).alias("s"))
    for r in summed.select("part", "s.sum", "s.count").collect():
        values, at = r["sum"].toArray(), 0
        first, products = np.zeros(size), np.zeros((size, size))
        for i in range(size):
            first[i] = values[at]
            products[i, : i + 1] = products[: i + 1, i] = values[at + 1 : at + 2 + i]
            at += 2 + i
        out[r["part"]] = Sums(float(r["count"]), first, products, np.array(origin, float))
    return out


def penalised_fit(sums: Sums, alpha: float, l1: bool) -> tuple[np.ndarray, float]:
    """Coefficients and intercept of the linear regression with a penalty on standardised coefficients, as MLlib has it.

    L2 by Cholesky, L1 by coordinate descent on the correlations. Columns without variance get 0.
    """
    cov, mean = sums.covariance, sums.mean
    scale = np.sqrt(np.maximum(np.diag(cov), 0.0))
    # What rounding leaves of a constant column.
    varies = scale > 1e-7 * np.sqrt(np.maximum(np.diag(sums.products) / sums.n, 0.0))
    out = np.zeros(len(cov) - 1)
    used = np.flatnonzero(varies[:-1])
    if varies[-1] and len(used):
        correlation = cov[np.ix_(used, used)] / np.outer(scale[used], scale[used])
        with_target = cov[used, -1] / (scale[used] * scale[-1])
        penalty = alpha / scale[-1]
        if l1:
            solved = _descend(correlation, with_target, penalty)
        else:
            ridge = correlation + penalty * np.eye(len(used))
            try:
                lower = np.linalg.cholesky(ridge)
                solved = np.linalg.solve(lower.T, np.linalg.solve(lower, with_target))
            except np.linalg.LinAlgError:
                # Without a penalty, columns that follow from others: the solution of least length.
                solved = np.linalg.lstsq(ridge, with_target, rcond=None)[0]
        out[used] = solved * scale[-1] / scale[used]
    level = mean + sums.start
    return out, float(level[-1] - out @ level[:-1])


def _descend(correlation: np.ndarray, with_target: np.ndarray, penalty: float, most: int = 100_000) -> np.ndarray:
    """Minimum of w C w / 2 - c w + penalty |w|, one coordinate after the other until none moves."""
    w = np.zeros(len(with_target))
    for _ in range(most):
        moved = 0.0
        for i in range(len(w)):
            pull = with_target[i] - correlation[i] @ w + correlation[i, i] * w[i]
            new = math.copysign(max(abs(pull) - penalty, 0.0), pull) / correlation[i, i]
            moved, w[i] = max(moved, abs(new - w[i])), new
        if moved < 1e-13:
            break
    return w


@dataclass
class LinearSearch:
    """Mean squared error of each penalty over the folds, and the fit on all rows with the best one."""

    alphas: list[float]
    errors: list[float]
    alpha: float
    coefficients: np.ndarray
    intercept: float


def linear_search(train: DataFrame, features: list[str], label: str, key: str, alphas: list[float], l1: bool) -> LinearSearch:
    """Penalised linear regression on the class number, the penalty chosen by five folds.

    The rows are aggregated once: the sums of a fold's training rows are those of all rows less its own,
    and all fits and errors follow from the sums.
    """
    rows = _folds(with_target(train, label, class_list(train, label)), key)
    folds = fold_sums(rows, [*features, TARGET], "fold")
    if not folds:
        raise ValueError("no row has a label and all features")
    total = functools.reduce(operator.add, folds.values())
    errors = []
    for alpha in alphas:
        # A fold that holds all rows leaves none to fit on.
        tested = [own.squared_error(*penalised_fit(total - own, alpha, l1)) for own in folds.values() if total.n > own.n]
        errors.append(float(np.mean(tested)) if tested else math.nan)
    best = alphas[int(np.nanargmin(errors))] if any(e == e for e in errors) else alphas[0]
    return LinearSearch(alphas, errors, best, *penalised_fit(total, best, l1))


def _listed(train: DataFrame, found: list[tuple[str, float]]) -> DataFrame:
    return train.sparkSession.createDataFrame([(f, float(x)) for f, x in found], "feature string, coefficient double")


def lasso_selection(train: DataFrame, features: list[str], label: str, key: str, alphas: list[float]) -> DataFrame:
    """Features whose L1-penalised coefficient is not zero."""
    found = linear_search(train, features, label, key, alphas, l1=True).coefficients
    return _listed(train, [(f, x) for f, x in zip(features, found) if x != 0])


def ridge_selection(train: DataFrame, features: list[str], label: str, key: str, alphas: list[float], above: float = 0.01) -> DataFrame:
    """Features whose L2-penalised coefficient is larger than a bound."""
    found = linear_search(train, features, label, key, alphas, l1=False).coefficients
    return _listed(train, [(f, x) for f, x in zip(features, found) if abs(x) > above])


def grid_search(train: DataFrame, features: list[str], label: str, key: str, alphas: list[float]) -> DataFrame:
    """Mean squared error over the folds for every penalty."""
    found = linear_search(train, features, label, key, alphas, l1=False)
    return train.sparkSession.createDataFrame(list(zip(found.alphas, found.errors)), "alpha double, mse double")


def recursive_elimination(train: DataFrame, features: list[str], label: str, key: str, **args: Any) -> DataFrame:
    """Drop the feature with the smallest coefficients, step by step.

    One elimination path serves all sizes: every step gives the five-fold accuracy of
    its feature set. Result: ``n_features, accuracy, dropped`` (the feature dropped next).
    """
    classes = class_list(train, label)
    spark, remaining, steps = train.sparkSession, list(features), []
    source = _folds(with_target(train, label, classes), key).select(TARGET, "fold", *features).na.drop(subset=features)
    evaluator = MulticlassClassificationEvaluator(labelCol=TARGET, metricName="accuracy")

    def fitted(rows: DataFrame) -> Model:
        with kept(rows) as own:
            return classifier("logistic", len(classes), **args).fit(own)

    def tested(rows: DataFrame, fold: int) -> float:
        return evaluator.evaluate(fitted(rows.filter(F.col("fold") != fold)).transform(rows.filter(F.col("fold") == fold)))

    with kept(gathered(source)) as data:
        sizes = {r["fold"]: r["n"] for r in data.groupBy("fold").agg(F.count("*").alias("n")).collect()}
        if any(sizes.get(fold, 0) in (0, sum(sizes.values())) for fold in range(FOLDS)):
            raise ValueError("every fold needs rows within and without")
        if set(args) <= {"maxIter", "tol"}:
            sums = fold_sums(data, [*features, TARGET], "fold")
            with FoldedSoftmax(data, features, TARGET, "fold", len(classes), sums, **args) as fits:
                steps = _eliminated(spark, fits, features, sizes)
            return spark.createDataFrame(steps, "n_features int, accuracy double, dropped string")
        while remaining:
            rows = assembled(data, remaining, TARGET, "fold")
            # The fit on all rows runs beside those of the folds.
            tasks = [functools.partial(fitted, rows), *[functools.partial(tested, rows, fold) for fold in range(FOLDS)]]
            model, *accuracies = side_by_side(spark, tasks, FOLDS + 1)
            weights = abs(model.coefficientMatrix.toArray()).sum(axis=0)
            weakest = remaining[int(weights.argmin())]
            steps.append((len(remaining), float(np.mean(accuracies)), weakest))
            remaining = [f for f in remaining if f != weakest]
    return spark.createDataFrame(steps, "n_features int, accuracy double, dropped string")


def _eliminated(spark, fits: FoldedSoftmax, features: list[str], sizes: dict[int, int]) -> list[tuple[int, float, str]]:
    """The steps of an elimination; each fit begins where that of the step before ended."""
    used, steps = list(range(len(features))), []
    ended: dict[int | None, np.ndarray] = {}

    def fitted() -> np.ndarray:
        return fits.fit(used, None, ended.get(None))

    def tested(fold: int) -> tuple[np.ndarray, float]:
        weights = fits.fit(used, fold, ended.get(fold))
        return weights, fits.hits(used, weights, fold) / sizes[fold]

    while used:
        # The fit on all rows runs beside those of the folds.
        whole, *folds = side_by_side(spark, [fitted, *[functools.partial(tested, fold) for fold in range(FOLDS)]], FOLDS + 1)
        weakest = int(abs(fits.coefficients(used, whole)).sum(axis=0).argmin())
        steps.append((len(used), float(np.mean([accuracy for _, accuracy in folds])), features[used[weakest]]))
        ended = {fold: np.delete(weights, weakest, axis=0) for fold, weights in [(None, whole), *[(i, w) for i, (w, _) in enumerate(folds)]]}
        used = [i for i in used if i != used[weakest]]
    return steps


def best_size(path: DataFrame) -> int:
    """The number of features with the highest accuracy, the fewest of equals; 0 for an empty path."""
    best = path.orderBy(F.desc("accuracy"), "n_features").first()
    return best["n_features"] if best else 0


def eliminated_features(train: DataFrame, features: list[str], label: str, key: str, **args: Any) -> tuple[int, list[str]]:
    """The best number of features, and the features that an elimination down to it leaves."""
    path = recursive_elimination(train, features, label, key, **args)
    n = best_size(path)
    return n, features_after_elimination(path, n)


def features_after_elimination(path: DataFrame, n: int) -> list[str]:
    """The ``n`` features that stay longest; ``path`` has one row per feature."""
    return [r["dropped"] for r in path.filter(F.col("n_features") <= n).orderBy("n_features").collect()]

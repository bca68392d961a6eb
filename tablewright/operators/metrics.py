"""Evaluation of predictions. Each report starts from counts per (label, prediction)
or per distinct score, so the rows are read once and combined before any shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.plans.prefix import running_sums


def confusion(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.groupBy(label, prediction).agg(F.count("*").alias("n"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def class_scores(df: DataFrame, label: str, prediction: str, by: list[str] | None = None) -> DataFrame:
    """Precision, recall, F1 and support per class; 0 where nothing was predicted or true."""
    by = by or []
    cells = df.groupBy(*by, label, prediction).agg(F.count("*").cast("double").alias("n"))
    same = F.col(label).eqNullSafe(F.col(prediction))
    roles = F.array(
        F.struct(F.col(label).alias("class"), F.col("n").alias("support"), F.lit(0.0).alias("predicted"), F.when(same, F.col("n")).otherwise(0.0).alias("hits")),
        F.struct(F.col(prediction).alias("class"), F.lit(0.0).alias("support"), F.col("n").alias("predicted"), F.lit(0.0).alias("hits")),
    )
    sums = cells.select(*by, F.inline(roles)).groupBy(*by, "class").agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hits").alias("hits"))
    return sums.select(
        *by,
        "class",
        _ratio(F.col("hits"), F.col("predicted")).alias("precision"),
        _ratio(F.col("hits"), F.col("support")).alias("recall"),
        _ratio(2 * F.col("hits"), F.col("support") + F.col("predicted")).alias("f1"),
        F.col("support").cast("long").alias("support"),
        F.col("hits").cast("long").alias("hits"),
    )


def classification_report(df: DataFrame, label: str, prediction: str, by: list[str] | None = None) -> DataFrame:
    """Rows of ``class_scores`` with accuracy, macro and weighted means."""
    by = by or []
    scores = class_scores(df, label, prediction, by)
    values = [F.col("precision"), F.col("recall"), F.col("f1")]

    def entry(name: Column, weight: Column, p: Column, r: Column, f: Column) -> Column:
        return F.struct(
            name.alias("class"), weight.alias("w"), (p * weight).alias("p"), (r * weight).alias("r"), (f * weight).alias("f"),
            F.col("support").alias("support"),
        )

    one, support = F.lit(1.0), F.col("support").cast("double")
    hit_rate = _ratio(F.col("hits"), support)
    entries = F.array(
        entry(F.col("class").cast("string"), one, *values),
        entry(F.lit("macro avg"), one, *values),
        entry(F.lit("weighted avg"), support, *values),
        entry(F.lit("accuracy"), support, hit_rate, hit_rate, hit_rate),
    )
    long = scores.select(*by, F.inline(entries))
    sums = long.groupBy(*by, "class").agg(*[F.sum(c).alias(c) for c in ("w", "p", "r", "f", "support")])
    only_f1 = F.col("class") == "accuracy"
    return sums.select(
        *by,
        "class",
        F.when(~only_f1, _ratio(F.col("p"), F.col("w"))).alias("precision"),
        F.when(~only_f1, _ratio(F.col("r"), F.col("w"))).alias("recall"),
        _ratio(F.col("f"), F.col("w")).alias("f1"),
        "support",
    )


def macro_f1(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return class_scores(df, label, prediction).agg(F.avg("f1").alias("macro_f1"))


def binary_scores(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Accuracy, precision, recall, F1 and true rates of 0/1 columns, in one row."""
    y, p = F.col(label) == 1, F.col(prediction) == 1
    counts = df.agg(
        F.count_if(y & p).cast("double").alias("tp"),
        F.count_if(~y & p).cast("double").alias("fp"),
        F.count_if(y & ~p).cast("double").alias("fn"),
        F.count_if(~y & ~p).cast("double").alias("tn"),
    )
    return counts.select(*_binary_columns())


def _binary_columns() -> list[Column]:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return [
        *[F.col(c).cast("long").alias(c) for c in ("tp", "fp", "fn", "tn")],
        _ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(tn, tn + fp).alias("specificity"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    ]


def roc_points(df: DataFrame, label: str, score: str) -> DataFrame:
    """True and false positives for every distinct score taken as threshold."""
    counts = df.groupBy(F.col(score).alias("threshold")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg")
    )
    return running_sums(counts, [F.desc("threshold")], ["pos", "neg"])


def roc_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    points = roc_points(df, label, score)
    total = points.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).first()
    return points.select(
        "threshold",
        F.col("pos_upto").alias("tp"),
        F.col("neg_upto").alias("fp"),
        (F.col("pos_upto") / F.lit(float(total["p"] or 1))).alias("tpr"),
        (F.col("neg_upto") / F.lit(float(total["n"] or 1))).alias("fpr"),
    )


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the curve: of all (positive, negative) pairs the share ranked right, ties half; null with one class."""
    points = roc_points(df, label, score)
    right = F.col("neg").cast("double") * (F.col("pos_upto") - F.col("pos") / 2)
    sums = points.agg(F.sum(right).alias("right"), F.sum("pos").cast("double").alias("p"), F.sum("neg").cast("double").alias("n"))
    return sums.select(F.try_divide("right", F.col("p") * F.col("n")).alias("auc"))


def threshold_sweep(df: DataFrame, label: str, score: str, thresholds: list[float], inclusive: bool = False) -> DataFrame:
    """Binary scores at every threshold, from one pass over the rows."""
    y = F.col(label) == 1
    parts = []
    for i, t in enumerate(thresholds):
        p = F.col(score) >= t if inclusive else F.col(score) > t
        parts.append(
            F.struct(
                F.lit(float(t)).alias("threshold"),
                F.count_if(y & p).cast("double").alias("tp"),
                F.count_if(~y & p).cast("double").alias("fp"),
                F.count_if(y & ~p).cast("double").alias("fn"),
                F.count_if(~y & ~p).cast("double").alias("tn"),
            ).alias(f"t{i}")
        )
    row = df.agg(*parts)
    return row.select(F.inline(F.array(*[f"t{i}" for i in range(len(thresholds))]))).select("threshold", *_binary_columns())


def error_distribution(df: DataFrame, true_class: str, target: str, prediction: str, normalize: bool = False, by: list[str] | None = None) -> DataFrame:
    """False positives, true negatives and false negatives per true class.

    ``normalize`` divides by the class's negatives (or positives); a class that has
    none keeps 0.
    """
    y, p = F.col(target) == 1, F.col(prediction) == 1
    counts = df.groupBy(*(by or []), true_class).agg(
        F.count_if(~y & p).alias("false_positive"),
        F.count_if(~y & ~p).alias("true_negative"),
        F.count_if(y & ~p).alias("false_negative"),
        F.count_if(~y).alias("negatives"),
        F.count_if(y).alias("positives"),
    )
    if normalize:
        counts = counts.withColumns(
            {
                "false_positive": _ratio(F.col("false_positive"), F.col("negatives")),
                "true_negative": _ratio(F.col("true_negative"), F.col("negatives")),
                "false_negative": _ratio(F.col("false_negative"), F.col("positives")),
            }
        )
    return counts.drop("negatives", "positives")


def f1_difference(first: DataFrame, second: DataFrame) -> DataFrame:
    """Per-class F1 of the second report less that of the first; an absent class counts 0."""
    a = first.select("class", F.col("f1").alias("f1_first"))
    b = second.select("class", F.col("f1").alias("f1_second"))
    both = a.join(b, "class", "full").na.fill(0.0, ["f1_first", "f1_second"])
    return both.withColumn("f1_gain", F.col("f1_second") - F.col("f1_first"))


def predicted_shares(df: DataFrame, prediction: str) -> DataFrame:
    """Rows are scored once: the total is taken over the few class counts."""
    counts = df.groupBy(prediction).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))

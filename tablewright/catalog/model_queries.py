"""Whole preparation, models, cascade and streaming."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.catalog.claims import claims, on_claims, on_split, split_claims, split_of
from tablewright.catalog.prepare_queries import FENCES, modes_sql, target_encoding_sql
from tablewright.catalog.registry import query
from tablewright.operators import cascade, features, impute, metrics, models, outliers, rules, sample, scale
from tablewright.operators.clean import class_list, null_sentinels
from tablewright.operators.encode import FrequencyEncoder, TargetEncoder
from tablewright.plans.preparation import Preparation, numeric_features
from tablewright.session import cut_lineage, scratch_path
from tablewright.sources.tables import RecordContract
from tablewright.streaming.records import read_sink, with_reasons, write_parted
from tablewright.streaming.scoring import score, write_scores

COVID_START = "2000-03-01"

# Flagship: the main preparation steps and a summary per split and class


@query(
    "prepared_class_summary",
    on_split(
        "SELECT split, claim_type, count(*) AS n_rows, round(avg(wage), 4) AS mean_wage, round(avg(birth_year), 6) AS mean_birth_year, count(body_code) AS n_body_code, "
        "round(avg(coalesce(e0, p0)), 6) AS mean_te_first, round(avg(coalesce(n, 0)), 6) AS mean_freq, round(avg(ln(CASE WHEN gap < 0 THEN 0 ELSE gap END + 2)), 6) AS mean_gap_log "
        "FROM (SELECT *, datediff('day', accident_date, assembly_date) AS gap FROM filled) LEFT JOIN e ON industry = e.g LEFT JOIN fr USING (body_code), p GROUP BY split, claim_type",
        **{
            "tidy": "SELECT claim_id, split, claim_type, nullif(age, 0) AS age, nullif(birth_year, 0) AS birth_year, least(accident_date, assembly_date, c2_date, c3_date) AS accident_date, "
            "assembly_date, wage, industry, CASE WHEN body_code = -9 THEN 90 ELSE body_code END AS body_code, cause_code, nullif(gender, 'U') AS gender FROM split_claims",
            "fence": FENCES.format(x="ln(wage)", t="tidy", w="split = 'train' AND wage > 0"),
            "cut": "SELECT * REPLACE (CASE WHEN split = 'train' OR wage IS NULL OR wage <= 0 THEN wage WHEN wage < lo THEN lo WHEN wage > hi THEN hi ELSE wage END AS wage) "
            "FROM tidy, (SELECT exp(low) AS lo, exp(high) AS hi FROM fence) WHERE split <> 'train' OR wage IS NULL OR wage = 0 OR wage BETWEEN lo AND hi",
            "med": "SELECT median(age::DOUBLE) AS ma, median(birth_year::DOUBLE) AS mb FROM cut WHERE split = 'train'",
            "m": modes_sql("cause_code", "body_code", "(SELECT * FROM cut WHERE split = 'train')"),
            "filled": "SELECT * REPLACE (coalesce(birth_year::DOUBLE, year(accident_date) - ma, mb) AS birth_year, coalesce(body_code, v) AS body_code) FROM cut LEFT JOIN m ON cause_code = g, med",
            "fr": "SELECT body_code, count(*) AS n FROM filled WHERE split = 'train' AND body_code IS NOT NULL GROUP BY body_code",
            **{k: v.replace("FROM train", "FROM (SELECT * FROM filled WHERE split = 'train')") for k, v in target_encoding_sql("industry").items()},
        },
    ),
)
def prepared_class_summary(spark: SparkSession, sf: str) -> DataFrame:
    df = null_sentinels(split_claims(spark, sf), {"gender": ["U"]})
    df = rules.zero_to_null(rules.zero_to_null(df, "age"), "birth_year")
    df = rules.merge_codes(df, "body_code", "body_desc")
    df = rules.earliest_date(df, "accident_date", ["assembly_date", "c2_date", "c3_date"])
    for operator in (
        outliers.LogIqr(column="wage"),
        impute.BirthYearByMedians(),
        impute.GroupModeFill(group="cause_code", column="body_code"),
        TargetEncoder(columns=["industry"], label="claim_type", prefix="te_"),
        FrequencyEncoder(columns=["body_code"]),
    ):
        df = operator.fit(df).transform(df)
    df = features.add_log(features.add_days_between(df, "accident_date", "assembly_date", into="gap"), "gap")
    out = df.groupBy("split", "claim_type").agg(
        F.count("*").alias("n_rows"),
        F.round(F.avg("wage"), 4).alias("mean_wage"),
        F.round(F.avg("birth_year"), 6).alias("mean_birth_year"),
        F.count("body_code").alias("n_body_code"),
        F.round(F.avg("te_industry_0"), 6).alias("mean_te_first"),
        F.round(F.avg("body_code_freq"), 6).alias("mean_freq"),
        F.round(F.avg("gap_log"), 6).alias("mean_gap_log"),
    )
    return out


# What random fills, trees and cascades give has no SQL twin. These queries return what must hold of
# the results, next to the counts that SQL can state.


@query(
    "prepared_claims",
    on_split("SELECT count(*) AS n_val, 0::BIGINT AS n_repeated, 0::BIGINT AS n_foreign, 0::BIGINT AS n_moved, 0::BIGINT AS n_missing FROM split_claims WHERE split = 'val'"),
)
def prepared_claims(spark, sf):
    """All five pipelines: validation rows are never dropped, keys stay unique and in their split, and few cells stay empty."""
    # The view is worked out once, for the split and for the fit.
    view = cut_lineage(claims(spark, sf))
    raw = split_of(view).select("claim_id", F.col("split").alias("first_split"))
    fitted, rows = Preparation.fit(view, "claim_type", "claim_id", COVID_START)
    joined = rows.join(raw, "claim_id", "left")
    # Dates of claims without any date stay null; every other feature is filled.
    always = [c for c in numeric_features(fitted.classes) if not c.startswith(("days_to", "accident_date", "age"))]
    empty = F.exists(F.array(*[F.col(c).cast("double") for c in always]), lambda x: x.isNull())
    return joined.agg(
        F.count_if(F.col("split") == "val").alias("n_val"),
        (F.count("*") - F.count_distinct("claim_id")).alias("n_repeated"),
        F.count_if(F.col("first_split").isNull()).alias("n_foreign"),
        F.count_if(F.col("first_split") != F.col("split")).alias("n_moved"),
        F.count_if(empty).alias("n_missing"),
    )


def only_in_one(first: DataFrame, second: DataFrame) -> tuple[int, int]:
    """How many rows ``first.exceptAll(second)`` has, and ``second.exceptAll(first)``, from one shuffle of both."""
    both = first.withColumn("rows_over", F.lit(1)).unionByName(second.withColumn("rows_over", F.lit(-1)))
    over = both.groupBy(*first.columns).agg(F.sum("rows_over").alias("rows_over"))
    ends = over.agg(*[F.coalesce(F.sum(F.greatest(F.lit(0), sign * F.col("rows_over"))), F.lit(0)) for sign in (F.lit(1), F.lit(-1))])
    return tuple(ends.first())


@query("saved_pipelines", "SELECT CAST(0 AS BIGINT) AS n_lost, CAST(0 AS BIGINT) AS n_new, true AS same_classes")
def saved_pipelines(spark, sf):
    """Save, load, and count the rows on which the loaded pipelines differ, either way (none)."""
    path = scratch_path(spark, "pipelines")
    # Read by the fit and by both transforms.
    raw = cut_lineage(claims(spark, sf))
    fitted, _ = Preparation.fit(raw, "claim_type", "claim_id", COVID_START)
    fitted.save(path)
    loaded = Preparation.load(path)
    first = cut_lineage(fitted.transform(raw).select("claim_id", *numeric_features(fitted.classes)))
    second = cut_lineage(loaded.transform(raw).select("claim_id", *numeric_features(loaded.classes)))
    lost, new = only_in_one(first, second)
    return spark.createDataFrame([(lost, new, loaded.classes == fitted.classes)], "n_lost long, n_new long, same_classes boolean")


# Models. A plain numeric view of the claims keeps these queries about the models.

FEATURES = ["age_f", "wage_f", "dependents", "ime4_f", "covid_f", "attorney_f", "gap_f", "c2_missing", "serial_f"]


#: What the features are made of.
USED = ["dependents", "age", "wage", "ime4_count", "covid_flag", "attorney_flag", "assembly_date", "accident_date", "c2_date"]


def model_rows(spark, sf):
    df = split_claims(spark, sf, *USED)
    return df.select(
        "claim_id", "claim_type", "split", "dependents",
        F.coalesce("age", F.lit(45)).cast("double").alias("age_f"),
        F.ln(F.coalesce("wage", F.lit(0.0)) + 2).alias("wage_f"),
        F.coalesce("ime4_count", F.lit(0)).cast("double").alias("ime4_f"),
        (F.col("covid_flag") == "Y").cast("double").alias("covid_f"),
        (F.col("attorney_flag") == "Y").cast("double").alias("attorney_f"),
        F.coalesce(F.datediff("assembly_date", "accident_date"), F.lit(0)).cast("double").alias("gap_f"),
        F.col("c2_date").isNull().cast("double").alias("c2_missing"),
        # Place of the claim in its book of a hundred.
        ((F.col("claim_id") % 100).cast("double") / 100).alias("serial_f"),
    )


def train_val(spark, sf):
    rows = cut_lineage(model_rows(spark, sf))
    return rows.filter("split = 'train'"), rows.filter("split = 'val'")


def scaled_train_val(spark, sf):
    """Features of mean 0 and deviation 1, which perceptrons and comparisons of coefficients need."""
    train, val = train_val(spark, sf)
    scaler = scale.StandardScaler(columns=FEATURES).fit(train)
    return scaler.transform(train), scaler.transform(val)


MODELS = ["logistic", "forest", "tree", "naive_bayes", "mlp", "ridge", "boosted"]
N_VAL = "(SELECT count(*) FROM split_claims WHERE split = 'val')"


def values_sql(names: list[str], column: str) -> str:
    return "(VALUES " + ", ".join(f"('{n}')" for n in names) + f") t({column})"


MODEL_ROWS_SQL = (
    "SELECT claim_id, claim_type, split, [coalesce(age, 45)::DOUBLE, ln(coalesce(wage, 0.0) + 2), dependents::DOUBLE, coalesce(ime4_count, 0)::DOUBLE, "
    "(covid_flag = 'Y')::INT::DOUBLE, (attorney_flag = 'Y')::INT::DOUBLE, coalesce(datediff('day', accident_date, assembly_date), 0)::DOUBLE, (c2_date IS NULL)::INT::DOUBLE, (claim_id % 100)::DOUBLE / 100] AS x FROM split_claims"
)
#: One row per claim and feature.
CELLS_SQL = f"SELECT claim_id, claim_type, split, unnest(range(1, {len(FEATURES) + 1})) AS j, unnest(x) AS v FROM m"

# Whoever always answers the commonest class has MOST_HITS right and no more.
MOST_HITS = "(SELECT max(n) FROM (SELECT count(*) AS n FROM split_claims WHERE split = 'val' GROUP BY claim_type))"


def most_hits(rows: DataFrame) -> tuple[int, int, int]:
    """The number of rows, that of the commonest class, and that of classes."""
    counts = rows.groupBy("claim_type").agg(F.count("*").alias("n"))
    return tuple(counts.agg(F.sum("n"), F.max("n"), F.count("*")).first())


def hits_of(predicted: DataFrame) -> int:
    return predicted.filter(F.col("claim_type") == F.col("prediction")).count()


@query("model_sweep", on_split(f"SELECT model, {N_VAL} AS n_rows, {MOST_HITS} AS most, true AS above_most, true AS above_most_f1 FROM {values_sql(MODELS, 'model')}"))
def model_sweep(spark, sf):
    """Every model is right more often, and by macro F1 better, than an answer that is always the commonest class."""
    train, val = scaled_train_val(spark, sf)
    swept = models.model_sweep(train, val, {name: {} for name in MODELS}, FEATURES, "claim_type", "claim_id")
    n, most, n_classes = most_hits(val)
    f1 = 2 * most / (n + most) / n_classes
    return swept.select("model", "n_rows", F.lit(most).cast("long").alias("most"), (F.col("accuracy") > most / n).alias("above_most"), (F.col("macro_f1") > f1).alias("above_most_f1"))


@query(
    "naive_bayes_classifier",
    on_split(
        "SELECT claim_type AS class, count(*) AS support, count(*) FILTER (prediction = claim_type) AS hits, count(DISTINCT prediction) AS n_answers FROM picked GROUP BY claim_type",
        m=MODEL_ROWS_SQL,
        cells=CELLS_SQL,
        fitted="SELECT claim_type AS cls, j, avg(v) AS mu, var_pop(v) AS va, count(*) AS n FROM cells WHERE split = 'train' GROUP BY ALL",
        floored="SELECT 1e-9 * max(g) AS e FROM (SELECT var_pop(v) AS g FROM cells WHERE split = 'train' GROUP BY j)",
        scored="SELECT claim_id, c.claim_type, cls, ln(any_value(n)) - 0.5 * sum((v - mu) * (v - mu) / (va + e) + ln(va + e)) AS score "
        "FROM cells c JOIN fitted USING (j), floored WHERE split = 'val' GROUP BY claim_id, c.claim_type, cls",
        picked="SELECT claim_id, claim_type, cls AS prediction FROM scored QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY score DESC, cls) = 1",
    ),
)
def naive_bayes_classifier(spark, sf):
    """Normal distributions per class and feature; SQL finds every prediction again."""
    train, val = train_val(spark, sf)
    predicted = cut_lineage(models.fit_predict(train, val, "naive_bayes", FEATURES, "claim_type", "claim_id"))
    scores = metrics.class_scores(predicted, "claim_type", "prediction").filter("support > 0").select("class", "support", "hits")
    answers = predicted.groupBy(F.col("claim_type").alias("class")).agg(F.count_distinct("prediction").alias("n_answers"))
    return scores.join(answers, "class")


@query(
    "knn_classifier",
    on_split(
        "SELECT claim_type AS class, count(*) AS support, count(*) FILTER (prediction = claim_type) AS hits FROM picked GROUP BY claim_type",
        m=MODEL_ROWS_SQL,
        pairs="SELECT v.claim_id, v.claim_type, t.claim_id AS other, t.claim_type AS cls, "
        + " + ".join(f"(v.x[{i}] - t.x[{i}]) * (v.x[{i}] - t.x[{i}])" for i in range(1, len(FEATURES) + 1))
        + " AS d FROM m v JOIN m t ON v.split = 'val' AND t.split = 'train'",
        near="SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY sqrt(d), other) AS r FROM pairs QUALIFY r <= 5",
        picked="SELECT claim_id, claim_type, cls AS prediction FROM (SELECT claim_id, claim_type, cls, count(*) AS n FROM near GROUP BY ALL) "
        "QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY n DESC, cls) = 1",
    ),
)
def knn_classifier(spark, sf):
    train, val = train_val(spark, sf)
    predicted = models.fit_predict(train, val, "knn", FEATURES, "claim_type", "claim_id", k=5)
    return metrics.class_scores(predicted, "claim_type", "prediction").filter("support > 0").select("class", "support", "hits")


REPORT_SQL = on_split(f"SELECT claim_type AS class, count(*) AS support, true AS holds, {MOST_HITS} AS most, true AS above_most FROM split_claims WHERE split = 'val' GROUP BY claim_type")


def report_holds(predicted: DataFrame) -> DataFrame:
    """Classes with their support, whether precision, recall and F1 fit together, and whether more is right than by the commonest class."""
    predicted = cut_lineage(predicted.select("claim_type", "prediction"))
    _, most, _ = most_hits(predicted)
    above = hits_of(predicted) > most
    report = metrics.classification_report(predicted, "claim_type", "prediction").filter("class not in ('accuracy', 'macro avg', 'weighted avg') and support > 0")
    p, r = F.col("precision"), F.col("recall")
    f1 = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    fits = p.between(0, 1) & r.between(0, 1) & (F.abs(F.col("f1") - f1) < 1e-9)
    return report.select("class", F.col("support").cast("long").alias("support"), fits.alias("holds"), F.lit(most).cast("long").alias("most"), F.lit(above).alias("above_most"))


@query("weighted_multiclass", REPORT_SQL)
def weighted_multiclass(spark, sf):
    """Undersample, weight, fit, report on the validation rows."""
    train, val = train_val(spark, sf)
    smaller = sample.undersample(train, "claim_type", "claim_id", {"2. NON-COMP": 2000, "3. MED ONLY": 1500})
    weighted = sample.class_weights(smaller, "claim_type", {"2. NON-COMP": 10.0, "4. TEMPORARY": 5.0})
    return report_holds(models.fit_predict(weighted, val, "forest", FEATURES, "claim_type", "claim_id", weight="weight"))


PROBABILITIES_SQL = on_split(
    "SELECT claim_id, (SELECT count(DISTINCT claim_type) FROM train) AS n_classes, 1.0::DOUBLE AS total, true AS in_range FROM split_claims WHERE split = 'val'"
)


def probabilities_hold(spark, sf, model: str, **args) -> DataFrame:
    train, val = train_val(spark, sf)
    classes = class_list(train, "claim_type")
    fitted = models.fit_classifier(train, model, FEATURES, "claim_type", classes, **args)
    rows = models.probability_table(fitted, val, FEATURES, "claim_id", classes)
    return rows.groupBy("claim_id").agg(
        F.count_distinct("class").alias("n_classes"), F.round(F.sum("probability"), 6).alias("total"), F.every(F.col("probability").between(0, 1)).alias("in_range")
    )


@query("probability_table", PROBABILITIES_SQL)
def probability_table(spark, sf):
    return probabilities_hold(spark, sf, "forest")


@query("probability_table_boosted", PROBABILITIES_SQL)
def probability_table_boosted(spark, sf):
    return probabilities_hold(spark, sf, "boosted")


# The first split of one tree over all rows: the feature whose best threshold leaves the least Gini impurity.
STRONGEST = dict(
    m=MODEL_ROWS_SQL,
    cells=CELLS_SQL,
    held="SELECT j, v, claim_type, count(*) AS n FROM cells WHERE split = 'train' GROUP BY ALL",
    grid="SELECT * FROM (SELECT DISTINCT j, v FROM held), (SELECT DISTINCT claim_type FROM held)",
    below="SELECT j, v, sum(coalesce(n, 0)) OVER (PARTITION BY j, claim_type ORDER BY v) AS a, sum(coalesce(n, 0)) OVER (PARTITION BY j, claim_type) AS t FROM grid LEFT JOIN held USING (j, v, claim_type)",
    pure="SELECT j, sum(a * a) / sum(a) + sum((t - a) * (t - a)) / sum(t - a) AS p FROM below GROUP BY j, v HAVING sum(t - a) > 0",
    strongest=f"SELECT {FEATURES!r}[arg_max(j, p)] AS feature FROM pure",
)
SELECTION_SQL = on_split(
    "SELECT feature AS strongest, CAST(0 AS BIGINT) AS n_constant, true AS in_order, true AS reaches_share, true AS no_more_than_needed FROM strongest", **STRONGEST
)
#: A feature that no tree can split on, so its importance is 0.
CONSTANT = "constant_f"


def with_constant(train: DataFrame) -> DataFrame:
    return train.withColumn(CONSTANT, F.lit(1.0))


def selection_holds(selected: DataFrame, share: float = 0.9) -> DataFrame:
    """The feature chosen first, whether a constant got in, and the cut: descending, stopped at the first feature that reaches the share."""
    rows = selected.agg(
        F.min_by("feature", "position").alias("strongest"),
        F.count_if(F.col("feature") == CONSTANT).alias("n_constant"),
        F.array_sort(F.collect_list(F.struct("position", F.col("importance").alias("importance")))).alias("listed"),
        F.max("cumulative").alias("reached"),
        F.max(F.struct("position", (F.col("cumulative") - F.col("importance")).alias("before"))).alias("last"),
    )
    falling = F.aggregate(F.zip_with("listed", F.slice("listed", 2, F.greatest(F.size("listed") - 1, F.lit(1))), lambda a, b: F.coalesce(a["importance"] >= b["importance"], F.lit(True))), F.lit(True), lambda a, x: a & x)
    return rows.select(
        "strongest", "n_constant", falling.alias("in_order"), (F.col("reached") >= share - 1e-9).alias("reaches_share"), (F.col("last.before") < share).alias("no_more_than_needed")
    )


@query("forest_selection", SELECTION_SQL)
def forest_selection(spark, sf):
    return selection_holds(models.importance_selection(with_constant(train_val(spark, sf)[0]), [*FEATURES, CONSTANT], "claim_type", "forest"))


BOOSTED_SQL = on_split(f"SELECT CAST(0 AS BIGINT) AS n_constant, true AS in_order, true AS reaches_share, true AS no_more_than_needed, feature = '{FEATURES[-1]}' AS has_strongest FROM strongest", **STRONGEST)


@query("boosted_selection", BOOSTED_SQL)
def boosted_selection(spark, sf):
    """Importances of a boosted model say how often a feature is split on too, so the strongest one is only among those chosen."""
    selected = cut_lineage(models.importance_selection(with_constant(train_val(spark, sf)[0]), [*FEATURES, CONSTANT], "claim_type", "boosted"))
    chosen = selected.filter(F.col("feature") == FEATURES[-1]).count() > 0
    return selection_holds(selected).drop("strongest").withColumn("has_strongest", F.lit(chosen))


@query(
    "top_features",
    on_split(
        "SELECT CAST(position AS INT) AS position, CASE WHEN position = 1 THEN feature END AS strongest, false AS constant, true AS distinct_features FROM range(1, 6) t(position), strongest", **STRONGEST
    ),
)
def top_features(spark, sf):
    """The first is the feature of the best single split, and a constant is never among them."""
    train, _ = train_val(spark, sf)
    found = models.top_features(with_constant(train), [*FEATURES, CONSTANT], "claim_type", n=5, sample_fraction=0.5)
    rows = [(i, f if i == 1 else None, f == CONSTANT, len(set(found)) == len(found)) for i, f in enumerate(found, start=1)]
    return spark.createDataFrame(rows, "position int, strongest string, constant boolean, distinct_features boolean")


ALPHAS = [0.0001, 0.001, 0.01]


def _moments(train: DataFrame):
    """Means and covariances of the features and the class number over the training rows."""
    rows = models.with_target(train, "claim_type", class_list(train, "claim_type"))
    names = [*FEATURES, models.TARGET]
    row = rows.agg(*[F.covar_pop(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names)]).first()
    return np.array([[row[f"{i}_{j}"] for j in range(len(names))] for i in range(len(names))])


def optimal(train: DataFrame, alphas: list[float], l1: bool) -> list[tuple[str, bool]]:
    """Whether each coefficient of the chosen model meets the condition of the optimum.

    With deviations s of feature and target, the covariance c of feature and residual satisfies
    c = a * s_x^2 * b / s_y under an L2 penalty a, and under an L1 penalty c = a * s_x * sign(b), or
    at most a * s_x in size where b is 0.
    """
    search = models.linear_search(train, FEATURES, "claim_type", "claim_id", alphas, l1=l1)
    b = search.coefficients
    cov = _moments(train)
    s = np.sqrt(np.diag(cov))
    left = cov[:-1, -1] - cov[:-1, :-1] @ b
    a = search.alpha
    size = s[:-1] * s[-1]
    if l1:
        met = np.where(b != 0, np.abs(left - a * s[:-1] * np.sign(b)), np.maximum(np.abs(left) - a * s[:-1], 0)) <= 1e-6 * size
    else:
        met = np.abs(left - a * s[:-1] ** 2 * b / s[-1]) <= 1e-6 * size
    return list(zip(FEATURES, met.tolist()))


OPTIMAL_SQL = f"SELECT feature, true AS optimal, true AS listed_if_large FROM {values_sql(FEATURES, 'feature')}"


def _selection_optimal(spark, train, selected: DataFrame, l1: bool, above: float) -> DataFrame:
    listed = {r["feature"]: r["coefficient"] for r in selected.collect()}
    rows = [(f, met, abs(listed.get(f, above + 1)) > above) for f, met in optimal(train, ALPHAS, l1)]
    return spark.createDataFrame(rows, "feature string, optimal boolean, listed_if_large boolean")


@query("lasso_selection", OPTIMAL_SQL)
def lasso_selection(spark, sf):
    train = train_val(spark, sf)[0]
    return _selection_optimal(spark, train, models.lasso_selection(train, FEATURES, "claim_type", "claim_id", ALPHAS), True, 0.0)


@query("ridge_selection", OPTIMAL_SQL)
def ridge_selection(spark, sf):
    train = train_val(spark, sf)[0]
    return _selection_optimal(spark, train, models.ridge_selection(train, FEATURES, "claim_type", "claim_id", ALPHAS, above=0.01), False, 0.01)


NUMBERED = "SELECT claim_type, (row_number() OVER (ORDER BY claim_type) - 1)::DOUBLE AS target FROM (SELECT DISTINCT claim_type FROM train)"


@query(
    "grid_search",
    on_split(
        "SELECT alpha::DOUBLE AS alpha, (SELECT round(var_pop(target), 9) FROM train JOIN numbered USING (claim_type)) AS variance, true AS below FROM (VALUES (0.0001), (0.001), (0.01)) t(alpha)",
        numbered=NUMBERED,
    ),
)
def grid_search(spark, sf):
    """Errors over the folds are under the variance of the class number, which the mean alone would leave."""
    train = train_val(spark, sf)[0]
    variance = float(_moments(train)[-1, -1])
    found = models.grid_search(train, FEATURES, "claim_type", "claim_id", ALPHAS)
    return found.select("alpha", F.round(F.lit(variance), 9).alias("variance"), F.col("mse").between(0.1 * variance, 0.99 * variance).alias("below"))


@query(
    "recursive_elimination",
    on_split(
        f"SELECT CAST(n AS INT) AS n_features, true AS above_most, true AS dropped_once, CASE WHEN n = 1 THEN feature END AS left_last, true AS best_kept FROM range(1, {len(FEATURES) + 1}) t(n), strongest",
        **STRONGEST,
    ),
)
def recursive_elimination(spark, sf):
    """Accuracies over the folds beat the commonest class, the strongest feature stays longest, and the best size keeps that many features."""
    train, _ = scaled_train_val(spark, sf)
    path = models.recursive_elimination(train, FEATURES, "claim_type", "claim_id")
    rows = path.collect()
    size = models.best_size(path)
    kept = models.features_after_elimination(path, size)
    n, most, _ = most_hits(train)
    share = most / n
    best = max(rows, key=lambda r: (r["accuracy"], -r["n_features"]))["n_features"]
    once = sorted(r["dropped"] for r in rows) == sorted(FEATURES)
    kept_best = size == best and len(set(kept)) == size and FEATURES[-1] in kept
    return spark.createDataFrame(
        [(r["n_features"], r["accuracy"] > share, once, r["dropped"] if r["n_features"] == 1 else None, kept_best) for r in rows],
        "n_features int, above_most boolean, dropped_once boolean, left_last string, best_kept boolean",
    )


# Cascade

CASCADE_GROUPS = [["2. NON-COMP"], ["8. DEATH"]]


def _cascade(features_used: list[str], **args) -> cascade.CascadeClassifier:
    chosen = {"model": "forest", "rest_model": "forest", **args}
    return cascade.CascadeClassifier(groups=CASCADE_GROUPS, features=features_used, label="claim_type", key="claim_id", thresholds=[0.5, 0.5], **chosen)


@query("cascade_classifier", REPORT_SQL)
def cascade_classifier(spark, sf):
    train, val = train_val(spark, sf)
    return report_holds(_cascade(FEATURES).fit(train).transform(val))


@query(
    "cascade_with_neighbours",
    on_split("SELECT claim_id, true AS decided_by_scores, true AS in_range FROM split_claims WHERE split = 'val'"),
)
def cascade_with_neighbours(spark, sf):
    """Stages by nearest neighbours; the decision is recomputed from the scores."""
    train, val = train_val(spark, sf)
    scored = _cascade(FEATURES, model="knn", smote_ratio=0.05).fit(train).transform(val)
    again = F.when(F.col("stage_1") > 0.5, "2. NON-COMP").when(F.col("stage_2") > 0.5, "8. DEATH").otherwise(F.col("rest_label"))
    return scored.select(
        "claim_id", (F.col("prediction") == again).alias("decided_by_scores"), (F.col("stage_1").between(0, 1) & F.col("stage_2").between(0, 1)).alias("in_range")
    )


@query("two_stage_classifier", on_split(f"SELECT {N_VAL} AS n_rows, 1.0::DOUBLE AS total_share, true AS known, {MOST_HITS} AS most, true AS above_most"))
def two_stage_classifier(spark, sf):
    """One binary stage, a multiclass model for its negatives."""
    train, val = train_val(spark, sf)
    stage = cascade.CascadeClassifier(groups=[["2. NON-COMP"]], features=FEATURES, label="claim_type", model="forest", rest_model="forest")
    predicted = cut_lineage(stage.fit(train).with_thresholds([0.7]).transform(val).select("claim_type", "prediction"))
    shares = metrics.predicted_shares(predicted, "prediction")
    known = F.every(F.col("prediction").isin(class_list(train, "claim_type")))
    _, most, _ = most_hits(predicted)
    totals = shares.agg(F.sum("n").alias("n_rows"), F.round(F.sum("share"), 6).alias("total_share"), known.alias("known"))
    return totals.withColumn("most", F.lit(most).cast("long")).withColumn("above_most", F.lit(hits_of(predicted) > most))


@query(
    "cascade_stage_report",
    on_split(
        "SELECT stage, class, support, true AS in_range, true AS above_constant FROM ("
        "SELECT 1 AS stage, CASE WHEN claim_type = '2. NON-COMP' THEN '1' ELSE '0' END AS class, count(*) AS support FROM split_claims WHERE split = 'val' GROUP BY ALL UNION ALL "
        "SELECT 2, CASE WHEN claim_type = '8. DEATH' THEN '1' ELSE '0' END, count(*) FROM split_claims WHERE split = 'val' AND claim_type <> '2. NON-COMP' GROUP BY ALL)"
    ),
)
def cascade_stage_report(spark, sf):
    train, val = train_val(spark, sf)
    model = _cascade(FEATURES).fit(train)
    plan = cascade.stage_plan(CASCADE_GROUPS, class_list(train, "claim_type"))
    report = cascade.stage_report(model.scores(val), "claim_type", plan, [0.5, 0.5]).filter("class in ('0', '1') and support > 0")
    report = cut_lineage(report)
    # Whoever gives all rows of a stage one answer has recalls of 1 and 0.
    recalls = report.groupBy("stage").agg((F.avg("recall") > 0.5).alias("above_constant"))
    in_range = F.col("precision").between(0, 1) & F.col("recall").between(0, 1)
    return report.join(F.broadcast(recalls), "stage").select("stage", "class", F.col("support").cast("long").alias("support"), in_range.alias("in_range"), "above_constant")


# Streaming


ARRIVING = dict(
    dates=["accident_date", "c2_date"], not_after="2001-12-31", sentinels={"carrier_type": ["UNKNOWN"]}, sentinel_to_value={"adr_flag": ["U", "N"]},
)


@query("streaming_scores", on_claims("SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_lost, CAST(0 AS BIGINT) AS n_new FROM claims"))
def streaming_scores(spark, sf):
    """Score the claims as they arrive; what the sink received is what a batch gives, either way."""
    # The view is worked out once, for the fit and the batch; the stream reads it as files.
    arrived = scratch_path(spark, "arriving")
    claims(spark, sf).withColumn("split", F.lit("test")).write.parquet(arrived)
    table_rows = spark.read.parquet(arrived)
    fitted, rows = Preparation.fit(table_rows.drop("split"), "claim_type", "claim_id", COVID_START)
    used = numeric_features(fitted.classes)
    model = _cascade(used).fit(rows.filter("split = 'train'"))
    stream = spark.readStream.schema(table_rows.schema).parquet(arrived)

    def scores_of(records: DataFrame) -> DataFrame:
        checked = rules.validate_record(records, **ARRIVING)
        return score(checked, *fitted.models, model).select("claim_id", "stage_1", "stage_2", "prediction")

    scored = scores_of(stream)
    path = scratch_path(spark, "scores")
    write_scores(scored, path, scratch_path(spark, "scores-progress")).awaitTermination()
    received = spark.read.schema(scored.schema).parquet(path)
    batch = cut_lineage(scores_of(table_rows))
    counts = [(received.count(), *only_in_one(batch, received))]
    return spark.createDataFrame(counts, "n_rows long, n_lost long, n_new long")


ARRIVALS = RecordContract(
    {"claim_id": "bigint", "accident_date": "date", "c2_date": "date", "age": "int", "gender": "string", "adr_flag": "string", "hearing_date_raw": "date"},
    {"gender": ["M", "F"], "adr_flag": ["N", "Y"]},
)


@query(
    "parted_records",
    on_claims(
        "SELECT claim_id, list_count(r) = 0 AS accepted, array_to_string(list_filter(list_sort(r), lambda x: x IS NOT NULL), '|') AS reasons FROM ("
        "SELECT claim_id, [CASE WHEN gender NOT IN ('M', 'F') THEN 'illegal gender' END, CASE WHEN adr_flag NOT IN ('N', 'Y') THEN 'illegal adr_flag' END, "
        "CASE WHEN hearing_date_raw IS NOT NULL AND try_cast(hearing_date_raw AS DATE) IS NULL THEN 'unreadable hearing_date_raw' END, "
        "CASE WHEN age < 14 THEN 'under age' END, CASE WHEN c2_date < accident_date THEN 'notice before accident' END] AS r FROM claims)"
    ),
)
def parted_records(spark, sf):
    """Claims arrive as text; accepted and rejected ones go to two sinks, with the reasons of each rejected one."""
    arrived = scratch_path(spark, "arriving-text")
    as_text = claims(spark, sf)
    as_text.select(*[F.col(c).cast("string").alias(c) for c in ARRIVALS.types]).write.parquet(arrived)
    stream = spark.readStream.schema(", ".join(f"{c} string" for c in ARRIVALS.types)).parquet(arrived)
    checked = with_reasons(stream, ARRIVALS, {"under age": F.col("age") < 14, "notice before accident": F.col("c2_date") < F.col("accident_date")})
    path = scratch_path(spark, "parted")
    write_parted(checked, path, scratch_path(spark, "parted-progress")).awaitTermination()
    accepted = read_sink(spark, path, "accepted", ARRIVALS).select("claim_id", F.lit(True).alias("accepted"), F.lit("").alias("reasons"))
    rejected = read_sink(spark, path, "rejected", ARRIVALS).select("claim_id", F.lit(False).alias("accepted"), F.array_join("reasons", "|").alias("reasons"))
    return accepted.unionByName(rejected)

"""Feature filters, nearest neighbours, cascade decisions and evaluation reports."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from tablewright.catalog.claims import claims, on_claims, on_split, split_claims
from tablewright.catalog.clean_queries import CLASSES
from tablewright.catalog.registry import query, table
from tablewright.functions.hashing import hash_uniform
from tablewright.operators import cascade, metrics, neighbors, profile, select


def rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def union_all(parts):
    return "\nUNION ALL ".join(parts)


# Contingency and association

CATEGORIES = ["gender", "covid_flag", "industry", "carrier_type", "body_code", "dependents"]


@query("contingency", on_claims("SELECT industry, claim_type, count(*) AS n FROM claims WHERE industry IS NOT NULL AND claim_type IS NOT NULL GROUP BY ALL"))
def contingency(spark, sf):
    return select.contingency(claims(spark, sf), "industry", "claim_type")


@query(
    "contingency_wide",
    on_claims(
        "SELECT industry, count(*) FILTER (district = 'F') AS \"F\", count(*) FILTER (district = 'O') AS \"O\", count(*) FILTER (district = 'P') AS \"P\" "
        "FROM claims WHERE industry IS NOT NULL GROUP BY industry"
    ),
)
def contingency_wide(spark, sf):
    return select.contingency_wide(claims(spark, sf), "industry", "district")


def association_ctes(features: list[str], label: str, source: str) -> dict[str, str]:
    """Textbook form: observed against expected over the full grid of levels and classes."""
    return {
        "longform": union_all([f"SELECT '{f}' AS feature, CAST({f} AS VARCHAR) AS level, {label} AS cls FROM {source} WHERE {f} IS NOT NULL AND {label} IS NOT NULL" for f in features]),
        "lv": "SELECT feature, level, count(*)::DOUBLE AS r FROM longform GROUP BY ALL",
        "cl": "SELECT feature, cls, count(*)::DOUBLE AS c FROM longform GROUP BY ALL",
        "tot": "SELECT feature, count(*)::DOUBLE AS n, count(DISTINCT level) AS n_levels, count(DISTINCT cls) AS n_classes FROM longform GROUP BY ALL",
        "cells": "SELECT feature, level, cls, count(*)::DOUBLE AS o FROM longform GROUP BY ALL",
        "grid": "SELECT lv.feature, r, c, n, n_levels, n_classes, coalesce(o, 0) AS o, r * c / n AS e FROM lv JOIN cl USING (feature) JOIN tot USING (feature) "
        "LEFT JOIN cells ON cells.feature = lv.feature AND cells.level = lv.level AND cells.cls = cl.cls",
        "assoc": "SELECT feature, any_value(n) AS n, any_value(n_levels) AS n_levels, any_value(n_classes) AS n_classes, "
        "CAST((any_value(n_levels) - 1) * (any_value(n_classes) - 1) AS INT) AS dof, "
        "CASE WHEN (any_value(n_levels) - 1) * (any_value(n_classes) - 1) = 1 THEN sum((abs(o - e) - least(0.5::DOUBLE, abs(o - e))) ** 2 / e) ELSE sum((o - e) ** 2 / e) END AS chi2, "
        "sum(CASE WHEN o > 0 THEN o / n * ln(o * n / (r * c)) ELSE 0 END) AS mutual_information FROM grid GROUP BY feature",
    }


@query(
    "association_report",
    on_claims(
        "SELECT feature, CAST(n AS BIGINT) AS n, n_levels, CAST(n_classes AS INT) AS n_classes, dof, round(chi2, 4) AS chi2, "
        "round(sqrt(chi2 / (n * (least(n_levels, n_classes) - 1))), 6) AS cramers_v, round(mutual_information, 6) AS mutual_information FROM assoc",
        **association_ctes(CATEGORIES, "claim_type", "claims"),
    ),
)
def association_report(spark, sf):
    out = rounded(select.association_report(claims(spark, sf), CATEGORIES, "claim_type"), "cramers_v", "mutual_information")
    return out.withColumn("chi2", F.round("chi2", 4))


@query(
    "chi2_independence_2x2",
    on_claims(
        "SELECT feature, dof, round(chi2, 4) AS chi2, round(sqrt(chi2 / n), 6) AS cramers_v FROM assoc",
        **association_ctes(["covid_flag", "late"], "attorney_flag", "(SELECT *, coalesce(accident_date > assembly_date, false) AS late FROM claims)"),
    ),
)
def chi2_independence_2x2(spark, sf):
    df = claims(spark, sf).withColumn("late", F.coalesce(F.expr("accident_date > assembly_date"), F.lit(False)))
    out = select.association_report(df, ["covid_flag", "late"], "attorney_flag")
    return out.select("feature", "dof", F.round("chi2", 4).alias("chi2"), F.round("cramers_v", 6).alias("cramers_v"))


COUNTS = ["age", "dependents", "ime4_count", "wage"]


def feature_chi2_sql(features: list[str], source: str) -> str:
    return union_all(
        [
            f"SELECT '{f}' AS feature, CAST(count(*) - 1 AS INT) AS dof, sum((o - n_class / n * t) ** 2 / (n_class / n * t)) AS chi2 FROM "
            f"(SELECT claim_type, count(*)::DOUBLE AS n_class, sum({f})::DOUBLE AS o, sum(count(*)) OVER ()::DOUBLE AS n, sum(sum({f})) OVER ()::DOUBLE AS t "
            f"FROM {source} WHERE claim_type IS NOT NULL GROUP BY claim_type)"
            for f in features
        ]
    )


@query("feature_chi2", on_claims(f"SELECT feature, dof, round(chi2, 2) AS chi2 FROM ({feature_chi2_sql(COUNTS, 'claims')})"))
def feature_chi2(spark, sf):
    return rounded(select.feature_chi2(claims(spark, sf), COUNTS, "claim_type"), "chi2", digits=2)


# 11.0705 is the 95 % point of chi-square with 5 degrees of freedom (six classes).
@query(
    "chi2_and_v_filter",
    on_claims(
        "SELECT feature, round(s.chi2, 2) AS chi2, round(sqrt(a.chi2 / (a.n * (least(a.n_levels, a.n_classes) - 1))), 6) AS cramers_v "
        "FROM s JOIN assoc a USING (feature) WHERE s.chi2 > 11.070497693516351 AND sqrt(a.chi2 / (a.n * (least(a.n_levels, a.n_classes) - 1))) >= 0.02",
        **association_ctes(COUNTS, "claim_type", "claims"),
        s=feature_chi2_sql(COUNTS, "claims"),
    ),
)
def chi2_and_v_filter(spark, sf):
    out = select.chi2_and_v_filter(claims(spark, sf), COUNTS, "claim_type", v_from=0.02)
    return out.select("feature", F.round("chi2", 2).alias("chi2"), F.round("cramers_v", 6).alias("cramers_v"))


@query(
    "mutual_information_filter",
    on_claims(
        "SELECT feature, round(mutual_information, 6) AS mutual_information FROM assoc WHERE mutual_information > 0.0005",
        **association_ctes(CATEGORIES, "claim_type", "claims"),
    ),
)
def mutual_information_filter(spark, sf):
    return rounded(select.mutual_information_filter(claims(spark, sf), CATEGORIES, "claim_type", above=0.0005), "mutual_information")


def _bin_sql(c: str, n: int = 10) -> str:
    cuts = ", ".join(f"{i / n}" for i in range(1, n))
    cut_list = f"(SELECT list_distinct(quantile_cont({c}::DOUBLE, [{cuts}])) FROM train)"
    return f"CASE WHEN {c} IS NOT NULL THEN len(list_filter({cut_list}, lambda x: {c}::DOUBLE >= x)) END AS {c}"


@query(
    "binned_mutual_information",
    on_split(
        "SELECT feature, round(mutual_information, 6) AS mutual_information FROM assoc",
        binned=f"SELECT claim_type, {_bin_sql('age')}, {_bin_sql('wage')}, {_bin_sql('ime4_count')} FROM train",
        **association_ctes(["age", "wage", "ime4_count"], "claim_type", "binned"),
    ),
)
def binned_mutual_information(spark, sf):
    train = split_claims(spark, sf).filter("split = 'train'")
    return rounded(select.binned_mutual_information(train, ["age", "wage", "ime4_count"], "claim_type"), "mutual_information")


RANKED = ["age", "wage", "dependents", "birth_year"]


def rank_ctes(source: str, columns: list[str]) -> dict[str, str]:
    """Average ranks over the rows without nulls."""
    known = " AND ".join(f"{c} IS NOT NULL" for c in columns)
    ranks = ", ".join(
        f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE AS r_{c}" for c in columns
    )
    return {"ranked": f"SELECT {ranks} FROM {source} WHERE {known}"}


def _psi(x: str) -> str:
    """Digamma of a whole number: harmonic numbers less Euler's constant."""
    return f"(CASE WHEN {x} > 1 THEN list_sum(list_transform(range(1, {x}::BIGINT), lambda i: 1.0::DOUBLE / i)) ELSE 0 END - 0.5772156649015329)"


@query(
    "neighbour_mutual_information",
    on_split(
        f"SELECT feature, round(greatest(0, {_psi('max(total)')} + avg({_psi('least(3, size - 1)')} - {_psi('size')} - {_psi('m')})), 6) AS mutual_information FROM met GROUP BY feature",
        long="SELECT claim_id, claim_type AS c, unnest(['age', 'wage', 'ime4_count']) AS feature, unnest([age::DOUBLE, wage::DOUBLE, ime4_count::DOUBLE]) AS x FROM train WHERE claim_type IS NOT NULL",
        known="SELECT *, count(*) OVER (PARTITION BY feature, c) AS size FROM long WHERE x IS NOT NULL QUALIFY size > 1",
        pairs="SELECT a.feature, a.claim_id, abs(b.x - a.x) AS d, row_number() OVER (PARTITION BY a.feature, a.claim_id ORDER BY abs(b.x - a.x)) AS i, a.size "
        "FROM known a JOIN known b ON a.feature = b.feature AND a.c = b.c AND a.claim_id <> b.claim_id",
        radius="SELECT feature, claim_id, d AS r FROM pairs WHERE i = least(3, size - 1)",
        met="SELECT a.feature, a.claim_id, any_value(a.size) AS size, count(*) AS m, any_value(t.total) AS total FROM known a JOIN radius r USING (feature, claim_id) "
        "JOIN known b ON b.feature = a.feature AND (CASE WHEN r.r > 0 THEN b.x > a.x - r.r AND b.x < a.x + r.r ELSE b.x = a.x END) "
        "JOIN (SELECT feature, count(*) AS total FROM known GROUP BY feature) t ON t.feature = a.feature GROUP BY a.feature, a.claim_id",
    ),
)
def neighbour_mutual_information(spark, sf):
    train = split_claims(spark, sf).filter("split = 'train'")
    return rounded(select.neighbour_mutual_information(train, ["age", "wage", "ime4_count"], "claim_type"), "mutual_information")


@query(
    "spearman_matrix",
    on_split(
        union_all([f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(corr(r_{a}, r_{b}), 6) AS correlation FROM ranked" for a, b in combinations(sorted(RANKED), 2)]),
        **rank_ctes("train", RANKED),
    ),
)
def spearman_matrix(spark, sf):
    return rounded(select.spearman_matrix(split_claims(spark, sf).filter("split = 'train'"), RANKED), "correlation")


PRICES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "paid"]


@query(
    "strong_pairs",
    f"WITH priced AS (SELECT *, l_extendedprice * (1 - l_discount) AS paid FROM lineitem), ranked AS ({rank_ctes('priced', PRICES)['ranked']}) SELECT * FROM ("
    + union_all([f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(corr(r_{a}, r_{b}), 6) AS correlation FROM ranked" for a, b in combinations(sorted(PRICES), 2)])
    + ") WHERE abs(correlation) > 0.5",
)
def strong_pairs(spark, sf):
    priced = table(spark, sf, "lineitem").withColumn("paid", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return rounded(select.strong_pairs(priced, PRICES, above=0.5), "correlation")


@query(
    "average_ranks",
    on_split(
        "SELECT DISTINCT 'age' AS feature, age::DOUBLE AS value, count(*) OVER (PARTITION BY age) AS n, "
        "rank() OVER (ORDER BY age) + (count(*) OVER (PARTITION BY age) - 1) / 2.0::DOUBLE AS avg_rank FROM train WHERE age IS NOT NULL"
    ),
)
def average_ranks(spark, sf):
    return select.average_ranks(split_claims(spark, sf).filter("split = 'train'"), ["age"])


# Votes and cuts. Methods are districts, features are injuries of older people there.

VOTES = "SELECT district AS method, body_desc AS feature FROM claims WHERE body_desc IS NOT NULL GROUP BY ALL HAVING avg(age) > 49"


def votes(spark, sf):
    counts = claims(spark, sf).filter("body_desc is not null").groupBy("district", "body_desc").agg(F.avg("age").alias("w"))
    return counts.filter("w > 49").select(F.col("district").alias("method"), F.col("body_desc").alias("feature"))


@query("method_vote", on_claims("SELECT feature, count(*) AS n_votes FROM v GROUP BY feature HAVING count(*) >= 2", v=VOTES))
def method_vote(spark, sf):
    return select.vote(votes(spark, sf), at_least=2)


@query(
    "selection_matrix",
    on_claims(
        "SELECT feature, bool_or(method = 'F') AS \"F\", bool_or(method = 'O') AS \"O\", bool_or(method = 'P') AS \"P\", count(*) AS n_votes, count(*) >= 3 AS selected FROM v GROUP BY feature",
        v=VOTES,
    ),
)
def selection_matrix(spark, sf):
    return select.selection_matrix(votes(spark, sf), ["F", "O", "P"], at_least=3)


@query(
    "combine_filters",
    on_claims("SELECT feature FROM v WHERE method IN ('F', 'O') EXCEPT SELECT feature FROM v WHERE method = 'P'", v=VOTES),
)
def combine_filters(spark, sf):
    v = votes(spark, sf)
    return select.combine_filters(v.filter("method = 'F'"), v.filter("method = 'O'"), dropped=[v.filter("method = 'P'")])


@query(
    "cumulative_cut",
    on_claims(
        "SELECT feature, round(importance, 6) AS importance, CAST(position AS INT) AS position, round(cumulative, 6) AS cumulative FROM (SELECT *, "
        "row_number() OVER (ORDER BY importance DESC, feature) AS position, "
        "sum(importance) OVER (ORDER BY importance DESC, feature ROWS UNBOUNDED PRECEDING) AS cumulative FROM "
        "(SELECT body_desc AS feature, count(*) / (SELECT count(body_desc) FROM claims) AS importance FROM claims WHERE body_desc IS NOT NULL GROUP BY body_desc)) "
        "WHERE cumulative - importance < 0.9"
    ),
)
def cumulative_cut(spark, sf):
    shares = profile.value_counts(claims(spark, sf), "body_desc", shares=True)
    importance = shares.select(F.col("body_desc").alias("feature"), F.col("share").alias("importance"))
    return rounded(select.cumulative_cut(importance, 0.9), "importance", "cumulative")


# Nearest neighbours

DISTANCE = "sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))))"


def nearest_sql(k: int) -> dict[str, str]:
    return {
        "pairs": f"SELECT a.vec_id AS row_key, b.vec_id AS neighbor_key, a.label AS own_label, b.label AS neighbor_label, {DISTANCE} AS distance "
        "FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id",
        "nn": f"SELECT *, row_number() OVER (PARTITION BY row_key ORDER BY distance, neighbor_key) AS rank FROM pairs QUALIFY rank <= {k}",
    }


def with_sql(select_sql: str, **ctes: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({q})" for n, q in ctes.items()) + " " + select_sql


def vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("row_key"), F.col("embedding").alias("vec"), "label")


@query(
    "nearest_neighbors",
    with_sql("SELECT row_key, CAST(rank AS INT) AS rank, neighbor_key, neighbor_label, round(distance, 6) AS distance FROM nn", **nearest_sql(3)),
)
def nearest_neighbors(spark, sf):
    rows = vectors(spark, sf)
    out = neighbors.nearest(rows, rows, 3, ["label"])
    return out.select("row_key", "rank", "neighbor_key", "neighbor_label", F.round("distance", 6).alias("distance"))


@query(
    "nearest_by_codes",
    with_sql("SELECT row_key, CAST(rank AS INT) AS rank, neighbor_key, neighbor_label, round(distance, 6) AS distance FROM nn", **nearest_sql(5)),
)
def nearest_by_codes(spark, sf):
    """All 64 dimensions, cells of a few hundred rows: other cells are scanned as codes of six bits a dimension."""
    rows = vectors(spark, sf)
    out = neighbors.nearest(rows, rows, 5, ["label"], cell_rows=256, bits=6)
    return out.select("row_key", "rank", "neighbor_key", "neighbor_label", F.round("distance", 6).alias("distance"))


@query(
    "tomek_links",
    with_sql(
        "SELECT x.row_key, x.neighbor_key, x.own_label, x.neighbor_label AS other_label FROM nn x JOIN nn y ON x.row_key = y.neighbor_key AND x.neighbor_key = y.row_key "
        "WHERE x.own_label <> x.neighbor_label AND x.row_key < x.neighbor_key",
        **nearest_sql(1),
    ),
)
def tomek_links(spark, sf):
    return neighbors.tomek_links(vectors(spark, sf), "label")


@query(
    "remove_tomek_links",
    with_sql(
        "SELECT vec_id AS row_key, label FROM embeddings WHERE vec_id NOT IN (SELECT x.row_key FROM nn x JOIN nn y ON x.row_key = y.neighbor_key AND x.neighbor_key = y.row_key "
        "WHERE x.own_label <> x.neighbor_label)",
        **nearest_sql(1),
    ),
)
def remove_tomek_links(spark, sf):
    return neighbors.remove_tomek_links(vectors(spark, sf), "label").select("row_key", "label")


@query(
    "knn_vote",
    with_sql(
        "SELECT row_key, prediction FROM (SELECT row_key, neighbor_label AS prediction, count(*) AS n FROM nn GROUP BY ALL) "
        "QUALIFY row_number() OVER (PARTITION BY row_key ORDER BY n DESC, prediction) = 1",
        **nearest_sql(5),
    ),
)
def knn_vote(spark, sf):
    rows = vectors(spark, sf)
    return neighbors.knn_vote(rows, rows, "label", 5)


def u_sql(key: str, seed: str) -> str:
    return f"('0x' || substr(md5({key} || ':{seed}'), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


SMOTE_CTES = dict(
    pairs=f"SELECT a.vec_id AS row_key, b.vec_id AS neighbor_key, b.embedding::DOUBLE[] AS nv, {DISTANCE} AS distance "
    "FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND a.label = 3 AND b.label = 3",
    nn="SELECT row_key, list(nv ORDER BY rank) AS others FROM (SELECT *, row_number() OVER (PARTITION BY row_key ORDER BY distance, neighbor_key) AS rank FROM pairs "
    "QUALIFY rank <= 5) GROUP BY row_key",
    sizes="SELECT count(*) FILTER (label = 3) AS n_minor, CAST(floor(count(*) FILTER (label <> 3) * 0.5) AS BIGINT) - count(*) FILTER (label = 3) AS n_new FROM embeddings",
    counted="SELECT vec_id, embedding::DOUBLE[] AS v, n_new // n_minor + CASE WHEN row_number() OVER (ORDER BY md5(CAST(vec_id AS VARCHAR) || ':0:extra'), vec_id) <= n_new % n_minor "
    "THEN 1 ELSE 0 END AS n_copies FROM embeddings, sizes WHERE label = 3",
    copies="SELECT v, others, CAST(vec_id AS VARCHAR) || '#' || CAST(c AS VARCHAR) AS new_key FROM (SELECT *, unnest(range(1, n_copies + 1)) AS c FROM counted) JOIN nn ON row_key = vec_id",
    drawn=f"SELECT new_key, v, {u_sql('new_key', '0:gap')} AS gap, others[1 + CAST(floor({u_sql('new_key', '0:pick')} * len(others)) AS INT)] AS o FROM copies",
)


@query(
    "smote",
    with_sql(
        "SELECT CAST(vec_id AS VARCHAR) AS row_key, label, round(embedding[1]::DOUBLE, 6) AS x0, round(embedding[2]::DOUBLE, 6) AS x1 FROM embeddings UNION ALL "
        "SELECT new_key, CAST(3 AS INT), round(v[1] + gap * (o[1] - v[1]), 6), round(v[2] + gap * (o[2] - v[2]), 6) FROM drawn",
        **SMOTE_CTES,
    ),
)
def smote(spark, sf):
    out = neighbors.smote(vectors(spark, sf), "label", 3, ratio=0.5, k=5, seed=0)
    return out.select("row_key", "label", F.round(F.col("vec")[0], 6).alias("x0"), F.round(F.col("vec")[1], 6).alias("x1"))


@query(
    "smote_tomek",
    with_sql(
        "SELECT label, count(*) AS n FROM grown WHERE row_key NOT IN (SELECT x.row_key FROM one x JOIN one y ON x.row_key = y.other AND x.other = y.row_key WHERE x.label <> x.other_label) GROUP BY label",
        **{
            **SMOTE_CTES,
            "grown": "SELECT CAST(vec_id AS VARCHAR) AS row_key, label, embedding::DOUBLE[] AS v FROM embeddings UNION ALL "
            "SELECT new_key, CAST(3 AS INT), list_transform(list_zip(v, o), lambda p: p[1] + gap * (p[2] - p[1])) FROM drawn",
            "grown_pairs": "SELECT a.row_key, b.row_key AS other, a.label, b.label AS other_label, "
            "list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM grown a JOIN grown b ON a.row_key <> b.row_key",
            "one": "SELECT * FROM grown_pairs QUALIFY row_number() OVER (PARTITION BY row_key ORDER BY sqrt(d), other) = 1",
        },
    ),
)
def smote_tomek(spark, sf):
    out = neighbors.smote_tomek(vectors(spark, sf), "label", 3, ratio=0.5)
    return out.groupBy("label").agg(F.count("*").alias("n"))


# Cascade decisions over given scores

GROUPS = [["2. NON-COMP"], ["3. MED ONLY", "4. TEMPORARY"], ["8. DEATH"]]
THRESHOLDS = [0.8, 0.8, 0.5]
REST = "5. PPD SCH LOSS"


def scores(spark, sf):
    labelled = claims(spark, sf).filter("claim_type is not null").select("claim_id", "claim_type")
    return labelled.withColumns({f"stage_{k}": hash_uniform(F.col("claim_id"), k) for k in (1, 2, 3)})


SCORES = "SELECT claim_id, claim_type, " + ", ".join(f"{u_sql('CAST(claim_id AS VARCHAR)', str(k))} AS stage_{k}" for k in (1, 2, 3)) + " FROM claims WHERE claim_type IS NOT NULL"
DECIDED = (
    "SELECT *, CASE WHEN stage_1 > 0.8 THEN '2. NON-COMP' WHEN stage_2 > 0.8 THEN '3. MED ONLY' WHEN stage_3 > 0.5 THEN '8. DEATH' ELSE '5. PPD SCH LOSS' END AS prediction FROM scores"
)


def on_scores(select_sql: str, **ctes: str) -> str:
    return on_claims(select_sql, scores=SCORES, decided=DECIDED, **ctes)


def decided(spark, sf):
    stages = [(F.col(f"stage_{i}"), t, g[0]) for i, (t, g) in enumerate(zip(THRESHOLDS, GROUPS), start=1)]
    return scores(spark, sf).withColumn("prediction", cascade.decide(stages, F.lit(REST)))


@query(
    "stage_plan",
    on_claims(
        "SELECT CAST(s AS INT) AS stage, c AS class, CASE WHEN g = s THEN 'positive' ELSE 'rest' END AS role FROM "
        "(SELECT claim_type AS c, CASE WHEN claim_type = '2. NON-COMP' THEN 1 WHEN claim_type IN ('3. MED ONLY', '4. TEMPORARY') THEN 2 WHEN claim_type = '8. DEATH' THEN 3 ELSE 4 END AS g "
        "FROM (SELECT DISTINCT claim_type FROM claims WHERE claim_type IS NOT NULL)), (SELECT unnest([1, 2, 3]) AS s) WHERE g >= s"
    ),
)
def stage_plan(spark, sf):
    from tablewright.operators.clean import class_list

    return cascade.stage_plan_table(spark, GROUPS, class_list(claims(spark, sf), "claim_type"))


@query("binary_relabel", on_claims("SELECT claim_id, CAST(coalesce(claim_type IN ('3. MED ONLY', '4. TEMPORARY'), false) AS INT) AS binary_target FROM claims"))
def binary_relabel(spark, sf):
    return claims(spark, sf).select("claim_id", cascade.binary_relabel("claim_type", GROUPS[1]).alias("binary_target"))


@query(
    "stage_rows",
    on_claims(
        "SELECT claim_id, claim_type, CAST(claim_type IN ('3. MED ONLY', '4. TEMPORARY') AS INT) AS binary_target FROM claims WHERE claim_type IS NOT NULL AND claim_type <> '2. NON-COMP'"
    ),
)
def stage_rows(spark, sf):
    positive, rest = cascade.stage_plan(GROUPS, CLASSES)[1]
    return cascade.stage_rows(claims(spark, sf).select("claim_id", "claim_type"), "claim_type", positive, rest)


@query(
    "cascade_decision",
    on_scores("SELECT claim_id, CASE WHEN stage_1 > 0.85 THEN '2. NON-COMP' WHEN stage_2 > 0.85 THEN '3. MED ONLY' WHEN stage_3 > 0.85 THEN '8. DEATH' ELSE 'pred_placeholder' END AS prediction FROM scores"),
)
def cascade_decision(spark, sf):
    limits = cascade.broadcast_thresholds([0.85], 3)
    stages = [(F.col(f"stage_{i}"), t, g[0]) for i, (t, g) in enumerate(zip(limits, GROUPS), start=1)]
    return scores(spark, sf).select("claim_id", cascade.decide(stages).alias("prediction"))


@query("cascade_decision_with_rest", on_scores("SELECT claim_id, prediction FROM decided"))
def cascade_decision_with_rest(spark, sf):
    return decided(spark, sf).select("claim_id", "prediction")


@query(
    "stage_loss",
    on_scores(
        union_all(
            [
                f"SELECT CAST({i} AS INT) AS stage, claim_type AS class, count(*) FILTER (NOT y AND p) AS false_positive, count(*) FILTER (NOT y AND NOT p) AS true_negative, "
                f"count(*) FILTER (y AND NOT p) AS false_negative FROM (SELECT claim_type, claim_type IN ({', '.join(repr(c) for c in g)}) AS y, stage_{i} > {t} AS p FROM scores "
                f"WHERE claim_type NOT IN ({', '.join(repr(c) for h in GROUPS[: i - 1] for c in h) or repr('')})) GROUP BY claim_type"
                for i, (g, t) in enumerate(zip(GROUPS, THRESHOLDS), start=1)
            ]
        )
    ),
)
def stage_loss(spark, sf):
    return cascade.stage_loss(scores(spark, sf), "claim_type", cascade.stage_plan(GROUPS, CLASSES), THRESHOLDS)


# Evaluation reports


def class_scores_sql(label: str, prediction: str, source: str) -> dict[str, str]:
    return {
        "cls": f"SELECT {label} AS class FROM {source} UNION SELECT {prediction} FROM {source}",
        "per_class": f"SELECT class, (SELECT count(*) FROM {source} WHERE {label} = class) AS support, (SELECT count(*) FROM {source} WHERE {prediction} = class) AS predicted, "
        f"(SELECT count(*) FROM {source} WHERE {label} = class AND {prediction} = class) AS hits FROM cls",
        "prf": "SELECT class, support, hits, CASE WHEN predicted > 0 THEN hits / predicted ELSE 0 END AS precision, CASE WHEN support > 0 THEN hits / support ELSE 0 END AS recall, "
        "2 * hits / (support + predicted) AS f1 FROM per_class",
    }


REPORT = (
    "SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM prf UNION ALL "
    "SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM prf UNION ALL "
    "SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM prf UNION ALL "
    "SELECT 'accuracy', NULL, NULL, round(sum(hits) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM prf"
)


@query("classification_report", on_scores(REPORT, **class_scores_sql("claim_type", "prediction", "decided")))
def classification_report(spark, sf):
    return rounded(metrics.classification_report(decided(spark, sf), "claim_type", "prediction"), "precision", "recall", "f1")


@query("macro_f1", on_scores("SELECT round(avg(f1), 6) AS macro_f1 FROM prf", **class_scores_sql("claim_type", "prediction", "decided")))
def macro_f1(spark, sf):
    return rounded(metrics.macro_f1(decided(spark, sf), "claim_type", "prediction"), "macro_f1")


@query("confusion_matrix", on_scores("SELECT claim_type, prediction, count(*) AS n FROM decided GROUP BY ALL"))
def confusion_matrix(spark, sf):
    return metrics.confusion(decided(spark, sf), "claim_type", "prediction")


BINARY = "SELECT CAST(claim_type = '2. NON-COMP' AS INT) AS y, stage_1, CAST(stage_1 > 0.5 AS INT) AS p FROM scores"


def binary(spark, sf):
    return scores(spark, sf).select(F.expr("cast(claim_type = '2. NON-COMP' as int)").alias("y"), "stage_1", F.expr("cast(stage_1 > 0.5 as int)").alias("p"))


def binary_scores_sql(prefix: str = "") -> str:
    return (
        f"SELECT {prefix}tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 6) ELSE 0 END AS precision, "
        "round(tp / (tp + fn), 6) AS recall, round(tn / (tn + fp), 6) AS specificity, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM "
    )


SCORE_COLUMNS = ["accuracy", "precision", "recall", "specificity", "f1"]


@query(
    "binary_scores",
    on_scores(
        binary_scores_sql() + "(SELECT count(*) FILTER (y = 1 AND p = 1) AS tp, count(*) FILTER (y = 0 AND p = 1) AS fp, count(*) FILTER (y = 1 AND p = 0) AS fn, count(*) FILTER (y = 0 AND p = 0) AS tn FROM b)",
        b=BINARY,
    ),
)
def binary_scores(spark, sf):
    return rounded(metrics.binary_scores(binary(spark, sf), "y", "p"), *SCORE_COLUMNS)


SWEEP = [i / 10 for i in range(1, 10)]


def _sweep_sql(op: str) -> str:
    return on_scores(
        binary_scores_sql("threshold, ")
        + f"(SELECT threshold, count(*) FILTER (y = 1 AND stage_1 {op} threshold) AS tp, count(*) FILTER (y = 0 AND stage_1 {op} threshold) AS fp, "
        f"count(*) FILTER (y = 1 AND NOT stage_1 {op} threshold) AS fn, count(*) FILTER (y = 0 AND NOT stage_1 {op} threshold) AS tn "
        f"FROM b, (SELECT unnest([{', '.join(map(str, SWEEP))}]::DOUBLE[]) AS threshold) GROUP BY threshold)",
        b=BINARY,
    )


@query("threshold_sweep", _sweep_sql(">"))
def threshold_sweep(spark, sf):
    return rounded(metrics.threshold_sweep(binary(spark, sf), "y", "stage_1", SWEEP), *SCORE_COLUMNS)


@query("threshold_sweep_inclusive", _sweep_sql(">="))
def threshold_sweep_inclusive(spark, sf):
    return rounded(metrics.threshold_sweep(binary(spark, sf), "y", "stage_1", SWEEP, inclusive=True), *SCORE_COLUMNS)


ROC = "SELECT stage_1 AS threshold, CAST(sum(count(*) FILTER (y = 1)) OVER w AS BIGINT) AS tp, CAST(sum(count(*) FILTER (y = 0)) OVER w AS BIGINT) AS fp, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM b GROUP BY stage_1 WINDOW w AS (ORDER BY stage_1 DESC)"


@query(
    "roc_curve",
    on_scores("SELECT threshold, tp, fp, round(tp / (SELECT sum(y) FROM b), 6) AS tpr, round(fp / (SELECT sum(1 - y) FROM b), 6) AS fpr FROM roc", b=BINARY, roc=ROC),
)
def roc_curve(spark, sf):
    return rounded(metrics.roc_curve(binary(spark, sf), "y", "stage_1"), "tpr", "fpr")


@query(
    "roc_auc",
    on_scores("SELECT round(sum(neg * (tp - pos / 2.0::DOUBLE)) / (sum(pos)::DOUBLE * sum(neg)::DOUBLE), 6) AS auc FROM roc", b=BINARY, roc=ROC),
)
def roc_auc(spark, sf):
    return rounded(metrics.roc_auc(binary(spark, sf), "y", "stage_1"), "auc")


@query(
    "roc_auc_hard_labels",
    on_scores("SELECT round(sum(neg * (tp - pos / 2.0::DOUBLE)) / (sum(pos)::DOUBLE * sum(neg)::DOUBLE), 6) AS auc FROM roc", b=BINARY, roc=ROC.replace("stage_1", "p")),
)
def roc_auc_hard_labels(spark, sf):
    return rounded(metrics.roc_auc(binary(spark, sf), "y", "p"), "auc")


ERRORS = (
    "SELECT claim_type, count(*) FILTER (y = 0 AND p = 1) AS false_positive, count(*) FILTER (y = 0 AND p = 0) AS true_negative, count(*) FILTER (y = 1 AND p = 0) AS false_negative, "
    "count(*) FILTER (y = 0) AS negatives, count(*) FILTER (y = 1) AS positives FROM "
    "(SELECT claim_type, CAST(claim_type = '2. NON-COMP' AS INT) AS y, CAST(stage_1 > 0.5 AS INT) AS p FROM scores) GROUP BY claim_type"
)


def errors_source(spark, sf):
    return scores(spark, sf).withColumns({"y": F.expr("cast(claim_type = '2. NON-COMP' as int)"), "p": F.expr("cast(stage_1 > 0.5 as int)")})


@query("error_distribution", on_scores("SELECT * EXCLUDE (negatives, positives) FROM e", e=ERRORS))
def error_distribution(spark, sf):
    return metrics.error_distribution(errors_source(spark, sf), "claim_type", "y", "p")


@query(
    "error_distribution_normalized",
    on_scores(
        "SELECT claim_type, round(coalesce(false_positive / nullif(negatives, 0), 0), 6) AS false_positive, round(coalesce(true_negative / nullif(negatives, 0), 0), 6) AS true_negative, "
        "round(coalesce(false_negative / nullif(positives, 0), 0), 6) AS false_negative FROM e",
        e=ERRORS,
    ),
)
def error_distribution_normalized(spark, sf):
    out = metrics.error_distribution(errors_source(spark, sf), "claim_type", "y", "p", normalize=True)
    return rounded(out, "false_positive", "true_negative", "false_negative")


@query(
    "f1_difference",
    on_scores(
        "SELECT coalesce(a.class, b.class) AS class, round(coalesce(a.f1, 0), 6) AS f1_first, round(coalesce(b.f1, 0), 6) AS f1_second, round(coalesce(b.f1, 0) - coalesce(a.f1, 0), 6) AS f1_gain "
        "FROM first_prf a FULL JOIN second_prf b ON a.class = b.class",
        **{f"first_{n}": q.replace("FROM per_class", "FROM first_per_class").replace("FROM cls", "FROM first_cls") for n, q in class_scores_sql("claim_type", "prediction", "decided").items()},
        baseline="SELECT claim_type, '2. NON-COMP' AS prediction FROM scores",
        **{f"second_{n}": q.replace("FROM per_class", "FROM second_per_class").replace("FROM cls", "FROM second_cls") for n, q in class_scores_sql("claim_type", "prediction", "baseline").items()},
    ),
)
def f1_difference(spark, sf):
    df = decided(spark, sf)
    first = metrics.class_scores(df, "claim_type", "prediction")
    second = metrics.class_scores(df.withColumn("prediction", F.lit("2. NON-COMP")), "claim_type", "prediction")
    return rounded(metrics.f1_difference(first, second), "f1_first", "f1_second", "f1_gain")


@query("predicted_shares", on_scores("SELECT prediction, count(*) AS n, round(count(*) / (SELECT count(*) FROM decided), 6) AS share FROM decided GROUP BY prediction"))
def predicted_shares(spark, sf):
    return rounded(metrics.predicted_shares(decided(spark, sf), "prediction"), "share")

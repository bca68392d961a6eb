"""Projection, duplicates, typing, label maps, joins and consistency rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.catalog.claims import claims, on_claims, on_split, split_claims
from tablewright.catalog.registry import query, table
from tablewright.operators import clean, joins, rules, sample

CLASSES = ["1. CANCELLED", "2. NON-COMP", "3. MED ONLY", "4. TEMPORARY", "5. PPD SCH LOSS", "8. DEATH"]

# Projection and filters


@query("drop_columns", on_claims("SELECT * EXCLUDE (hearing_date_raw, district) FROM claims"))
def drop_columns(spark, sf):
    return clean.drop_columns(claims(spark, sf), ["hearing_date_raw", "district", "hearing_date_raw", "not_there"])


@query("drop_columns_like", on_claims("SELECT * EXCLUDE (accident_date, assembly_date, c2_date, c3_date, hearing_date_raw) FROM claims"))
def drop_columns_like(spark, sf):
    return clean.drop_columns_like(claims(spark, sf), "DATE")


@query("drop_incomplete", on_claims("SELECT * FROM claims WHERE claim_type IS NOT NULL AND accident_date IS NOT NULL"))
def drop_incomplete(spark, sf):
    return clean.drop_incomplete(claims(spark, sf), ["claim_type", "accident_date"])


@query("keep_from_or_null", on_claims("SELECT * FROM claims WHERE (accident_date >= DATE '1996-01-01' OR accident_date IS NULL) AND (c2_date >= DATE '1995-06-01' OR c2_date IS NULL)"))
def keep_from_or_null(spark, sf):
    return clean.keep_from_or_null(claims(spark, sf), {"accident_date": "1996-01-01", "c2_date": "1995-06-01"})


@query("feature_label_projection", on_claims("SELECT claim_id, age, wage, gender FROM claims"))
def feature_label_projection(spark, sf):
    roles = clean.ColumnRoles("claim_id", "claim_type", ["age", "wage"], ["gender"])
    return roles.features_of(claims(spark, sf))


# Duplicates


@query("drop_repeated_keys", "SELECT * FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey) = 1")
def drop_repeated_keys(spark, sf):
    return clean.drop_repeated_keys(table(spark, sf, "lineitem"), ["l_orderkey"])


@query(
    "drop_repeated_keys_events",
    "SELECT *, CAST(ts AS DATE) AS day FROM events QUALIFY count(*) OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE)) = 1",
)
def drop_repeated_keys_events(spark, sf):
    events = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    return clean.drop_repeated_keys(events, ["user_id", "event_type", "day"])


@query("drop_duplicate_rows", "SELECT min(doc_id) AS doc_id, text, lang, source, n_chars FROM documents GROUP BY text, lang, source, n_chars")
def drop_duplicate_rows(spark, sf):
    return clean.drop_duplicate_rows(table(spark, sf, "documents"), "doc_id")


@query(
    "drop_duplicate_rows_claims",
    on_claims(
        "SELECT min(claim_id) AS claim_id, age, gender, industry, body_code, claim_type FROM claims GROUP BY age, gender, industry, body_code, claim_type"
    ),
)
def drop_duplicate_rows_claims(spark, sf):
    part = claims(spark, sf).select("claim_id", "age", "gender", "industry", "body_code", "claim_type")
    return clean.drop_duplicate_rows(part, "claim_id")


NEAR = ["age", "industry", "body_code", "claim_type"]


def _leave_one_out_sql() -> str:
    ctes, source = {}, "claims"
    for i, c in enumerate(NEAR):
        others = ", ".join(x for x in NEAR if x != c)
        ctes[f"pass{i}"] = (
            f"SELECT claim_id, {', '.join(NEAR)} FROM {source} QUALIFY row_number() OVER (PARTITION BY {others} ORDER BY claim_id) = 1"
        )
        source = f"pass{i}"
    return on_claims(f"SELECT * FROM {source}", **ctes)


@query("drop_near_duplicates", _leave_one_out_sql())
def drop_near_duplicates(spark, sf):
    return clean.drop_near_duplicates(claims(spark, sf).select("claim_id", *NEAR), "claim_id")


# Typing and sentinels


@query("parse_dates", on_claims("SELECT claim_id, TRY_CAST(hearing_date_raw AS DATE) AS hearing_date_raw FROM claims"))
def parse_dates(spark, sf):
    return clean.parse_dates(claims(spark, sf).select("claim_id", "hearing_date_raw"), ["hearing_date_raw"])


@query(
    "unparsable_dates",
    on_claims(
        "SELECT 'hearing_date_raw' AS column_name, count(*) AS n_unparsable FROM claims WHERE hearing_date_raw IS NOT NULL AND TRY_CAST(hearing_date_raw AS DATE) IS NULL"
    ),
)
def unparsable_dates(spark, sf):
    return clean.unparsable_dates(claims(spark, sf), ["hearing_date_raw"])


@query(
    "null_sentinels",
    on_claims(
        "SELECT claim_id, nullif(adr_flag, 'U') AS adr_flag, nullif(carrier_type, 'UNKNOWN') AS carrier_type, "
        "CASE WHEN gender IN ('U', 'X') THEN NULL ELSE gender END AS gender FROM claims"
    ),
)
def null_sentinels(spark, sf):
    part = claims(spark, sf).select("claim_id", "adr_flag", "carrier_type", "gender")
    return clean.null_sentinels(part, {"adr_flag": ["U"], "carrier_type": ["UNKNOWN"], "gender": ["U", "X"]})


@query("nan_to_null", on_claims("SELECT claim_id, CASE WHEN wage = 0 THEN NULL ELSE wage END AS wage FROM claims"))
def nan_to_null(spark, sf):
    dirty = claims(spark, sf).select("claim_id", F.when(F.col("wage") == 0, F.lit(float("nan"))).otherwise(F.col("wage")).alias("wage"))
    return clean.nan_to_null(dirty, ["wage"])


@query("cast_codes", on_claims("SELECT claim_id, body_code, TRY_CAST(hearing_date_raw AS INT) AS hearing_date_raw FROM claims"))
def cast_codes(spark, sf):
    part = claims(spark, sf).select("claim_id", F.col("body_code").cast("double").alias("body_code"), "hearing_date_raw")
    return clean.cast_columns(part, {"body_code": "int", "hearing_date_raw": "int"})


@query("rename_columns", on_claims("SELECT claim_id, claim_type AS prediction FROM claims"))
def rename_columns(spark, sf):
    return clean.rename_columns(claims(spark, sf).select("claim_id", "claim_type"), {"claim_type": "prediction"})


# Labels


@query("binary_target", on_claims("SELECT claim_id, claim_type, CAST(CASE WHEN claim_type = '2. NON-COMP' THEN 1 ELSE 0 END AS INT) AS binary_target FROM claims"))
def binary_target(spark, sf):
    return clean.binary_target(claims(spark, sf).select("claim_id", "claim_type"), "claim_type", ["2. NON-COMP"])


@query(
    "label_index",
    on_split(
        "SELECT claim_id, claim_type, CAST(i AS INT) AS claim_type_index FROM split_claims LEFT JOIN "
        "(SELECT claim_type AS c, row_number() OVER (ORDER BY claim_type) - 1 AS i FROM (SELECT DISTINCT claim_type FROM train)) ON c = claim_type"
    ),
)
def label_index(spark, sf):
    # The label alone: the other columns of the claims are neither worked out nor written.
    df = split_claims(spark, sf, "claim_id")
    return clean.LabelIndex(label="claim_type").fit(df).transform(df).select("claim_id", "claim_type", "claim_type_index")


@query(
    "label_map_with_default",
    on_claims(
        "SELECT claim_id, coalesce(CASE claim_type WHEN '1. CANCELLED' THEN 0 WHEN '2. NON-COMP' THEN 1 WHEN '3. MED ONLY' THEN 2 END, 9) AS label_code, "
        "coalesce(CASE claim_type WHEN '1. CANCELLED' THEN claim_type WHEN '2. NON-COMP' THEN claim_type WHEN '3. MED ONLY' THEN claim_type END, 'other') AS label_back FROM claims"
    ),
)
def label_map_with_default(spark, sf):
    pairs = [["1. CANCELLED", 0], ["2. NON-COMP", 1], ["3. MED ONLY", 2]]
    coded = clean.map_labels(claims(spark, sf).select("claim_id", "claim_type"), "claim_type", pairs, "label_code", default=9)
    back = clean.map_labels(coded, "label_code", [[b, a] for a, b in pairs], "label_back", default="other")
    return back.select("claim_id", "label_code", "label_back")


@query("keep_classes", on_claims("SELECT * FROM claims WHERE claim_type IN ('3. MED ONLY', '8. DEATH')"))
def keep_classes(spark, sf):
    return clean.keep_classes(claims(spark, sf), "claim_type", ["3. MED ONLY", "8. DEATH"])


@query("remove_classes", on_claims("SELECT * FROM claims WHERE claim_type IS NULL OR claim_type NOT IN ('2. NON-COMP')"))
def remove_classes(spark, sf):
    return clean.remove_classes(claims(spark, sf), "claim_type", ["2. NON-COMP"])


@query(
    "constant_prediction",
    on_split(
        "SELECT claim_id, (SELECT claim_type FROM train GROUP BY claim_type ORDER BY count(*) DESC, claim_type LIMIT 1) AS claim_type FROM split_claims WHERE split = 'val'"
    ),
)
def constant_prediction(spark, sf):
    df = split_claims(spark, sf)
    common = clean.majority_class(df.filter("split = 'train'"), "claim_type")
    return clean.constant_prediction(df.filter("split = 'val'"), "claim_id", "claim_type", common)


# Joins on the key


@query("keep_keys", on_claims("SELECT claim_id, claim_type FROM claims WHERE claim_id IN (SELECT claim_id FROM claims WHERE age >= 14)"))
def keep_keys(spark, sf):
    df = claims(spark, sf)
    return joins.keep_keys(df.select("claim_id", "claim_type"), df.filter("age >= 14"), "claim_id")


@query(
    "align_columns",
    on_claims(
        "SELECT claim_id, a.wage, b.gender FROM (SELECT claim_id, wage FROM claims WHERE wage > 0) a FULL JOIN "
        "(SELECT claim_id, gender FROM claims WHERE gender <> 'X') b USING (claim_id)"
    ),
)
def align_columns(spark, sf):
    df = claims(spark, sf)
    return joins.align_columns(df.filter("wage > 0").select("claim_id", "wage"), df.filter("gender <> 'X'").select("claim_id", "gender"), "claim_id")


@query("dictionary_lookup", on_claims("SELECT claim_id, body_code, n_name AS nation_name FROM claims LEFT JOIN nation ON body_code = n_nationkey"))
def dictionary_lookup(spark, sf):
    names = table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("nation_name"))
    return joins.dictionary_lookup(claims(spark, sf).select("claim_id", "body_code"), "body_code", names, "n_nationkey")


@query(
    "group_statistic",
    on_split(
        "SELECT claim_id, industry, split, round(m, 6) AS mean_wage FROM split_claims LEFT JOIN "
        "(SELECT industry, avg(wage) AS m FROM train WHERE industry IS NOT NULL GROUP BY industry) USING (industry)"
    ),
)
def group_statistic(spark, sf):
    df = split_claims(spark, sf).select("claim_id", "industry", "wage", "split")
    out = joins.group_statistic(df, "industry", F.avg("wage"), "mean_wage", train=df.filter("split = 'train'"))
    return out.select("claim_id", "industry", "split", F.round("mean_wage", 6).alias("mean_wage"))


@query("scatter_predictions", on_claims("SELECT claim_id, CASE WHEN wage > 1000 THEN claim_type ELSE '2. NON-COMP' END AS claim_type FROM claims WHERE claim_type IS NOT NULL"))
def scatter_predictions(spark, sf):
    df = claims(spark, sf).filter("claim_type is not null")
    return joins.scatter(df.select("claim_id", "claim_type"), df.filter("wage > 1000"), "claim_id", "claim_type", "2. NON-COMP")


@query("stack_samples", on_claims("SELECT claim_id, gender FROM claims WHERE gender = 'F' UNION ALL SELECT claim_id, gender FROM claims WHERE age > 60"))
def stack_samples(spark, sf):
    df = claims(spark, sf).select("claim_id", "gender", "age")
    return joins.stack(df.filter("gender = 'F'"), df.filter("age > 60")).drop("age")


# Splits and samples


def ranked(source: str, by: str, seed: str) -> str:
    part = f"PARTITION BY {by} " if by else ""
    size = f"count(*) OVER ({f'PARTITION BY {by}' if by else ''})"
    return f"SELECT *, row_number() OVER ({part}ORDER BY md5(CAST(claim_id AS VARCHAR) || ':{seed}'), claim_id) AS pos, {size} AS n_rows FROM {source}"


@query("stratified_split", on_split("SELECT claim_id, claim_type, split FROM split_claims"))
def stratified_split(spark, sf):
    return split_claims(spark, sf).select("claim_id", "claim_type", "split")


@query(
    "three_way_split",
    on_claims(
        "SELECT claim_id, CASE WHEN pos <= round(0.6 * n_rows) THEN 'train' WHEN pos <= round(0.8 * n_rows) THEN 'val' ELSE 'test' END AS split FROM r",
        r=ranked("claims", "claim_type", "7"),
    ),
)
def three_way_split(spark, sf):
    out = sample.stratified_split(claims(spark, sf), "claim_type", "claim_id", {"train": 0.6, "val": 0.2}, rest="test", seed=7)
    return out.select("claim_id", "split")


@query("random_sample", on_claims("SELECT claim_id, claim_type FROM r WHERE pos <= 1000", r=ranked("claims", "", "1")))
def random_sample(spark, sf):
    return sample.random_sample(claims(spark, sf), "claim_id", n=1000, seed=1).select("claim_id", "claim_type")


@query("random_sample_half", on_claims("SELECT claim_id, claim_type FROM r WHERE pos <= round(0.5 * n_rows)", r=ranked("claims", "", "2")))
def random_sample_half(spark, sf):
    return sample.random_sample(claims(spark, sf), "claim_id", fraction=0.5, seed=2).select("claim_id", "claim_type")


@query("stratified_sample", on_claims("SELECT claim_id, claim_type FROM r WHERE pos <= floor(0.25 * n_rows)", r=ranked("claims", "claim_type", "3")))
def stratified_sample(spark, sf):
    return sample.stratified_sample(claims(spark, sf), "claim_type", "claim_id", 0.25, seed=3).select("claim_id", "claim_type")


TARGETS = {"2. NON-COMP": 1500, "3. MED ONLY": 900, "1. CANCELLED": 100_000}


@query(
    "undersample",
    on_claims(
        "SELECT claim_id, claim_type FROM r WHERE pos <= CASE claim_type WHEN '2. NON-COMP' THEN 1500 WHEN '3. MED ONLY' THEN 900 ELSE n_rows END",
        r=ranked("claims", "claim_type", "4"),
    ),
)
def undersample(spark, sf):
    return sample.undersample(claims(spark, sf), "claim_type", "claim_id", TARGETS, seed=4).select("claim_id", "claim_type")


@query(
    "balanced_bags",
    on_claims(
        "\nUNION ALL ".join(
            f"SELECT claim_id, claim_type, CAST({b} AS INT) AS bag_id FROM r{b} WHERE pos <= (SELECT count(*) FROM claims WHERE claim_type = '8. DEATH')"
            for b in range(3)
        ),
        sides="SELECT *, coalesce(claim_type = '8. DEATH', false) AS is_minority FROM claims",
        **{f"r{b}": ranked("sides", "is_minority", f"5:{b}") for b in range(3)},
    ),
)
def balanced_bags(spark, sf):
    out = sample.balanced_bags(claims(spark, sf), "claim_type", "claim_id", "8. DEATH", n_bags=3, seed=5)
    return out.select("claim_id", "claim_type", "bag_id")


@query(
    "class_weights",
    on_claims("SELECT claim_id, CASE claim_type WHEN '2. NON-COMP' THEN 10.0 WHEN '4. TEMPORARY' THEN 5.0 ELSE 1.0 END::DOUBLE AS weight FROM claims"),
)
def class_weights(spark, sf):
    return sample.class_weights(claims(spark, sf), "claim_type", {"2. NON-COMP": 10, "4. TEMPORARY": 5}).select("claim_id", "weight")


# Consistency rules


@query("set_when", on_claims("SELECT claim_id, CASE WHEN industry = 'BUILDING' THEN '1A. PRIVATE' ELSE carrier_type END AS carrier_type FROM claims"))
def set_when(spark, sf):
    return rules.set_when(claims(spark, sf), "carrier_type", "1A. PRIVATE", "industry", "BUILDING").select("claim_id", "carrier_type")


@query(
    "merge_codes",
    on_claims(
        "SELECT claim_id, CASE WHEN body_code = -9 THEN 90 ELSE body_code END AS body_code, "
        "CASE WHEN body_code IN (-9, 90) THEN 'MULTIPLE BODY PARTS' ELSE body_desc END AS body_desc FROM claims"
    ),
)
def merge_codes(spark, sf):
    return rules.merge_codes(claims(spark, sf), "body_code", "body_desc").select("claim_id", "body_code", "body_desc")


@query("zero_to_null", on_claims("SELECT claim_id, nullif(birth_year, 0) AS birth_year, nullif(age, 0) AS age FROM claims"))
def zero_to_null(spark, sf):
    out = rules.zero_to_null(rules.zero_to_null(claims(spark, sf), "birth_year"), "age")
    return out.select("claim_id", "birth_year", "age")


@query("value_to_null", on_claims("SELECT claim_id, nullif(gender, 'X') AS gender FROM claims"))
def value_to_null(spark, sf):
    return rules.value_to_null(claims(spark, sf), "gender", "X").select("claim_id", "gender")


@query("keep_legal_age", on_claims("SELECT * FROM claims WHERE age >= 14 OR age IS NULL"))
def keep_legal_age(spark, sf):
    return rules.keep_legal_age(claims(spark, sf), "age")


@query("reset_child_dependents", on_claims("SELECT claim_id, CASE WHEN dependents > 0 AND age BETWEEN 1 AND 15 THEN 0 ELSE dependents END AS dependents FROM claims"))
def reset_child_dependents(spark, sf):
    return rules.reset_child_dependents(claims(spark, sf), "dependents", "age").select("claim_id", "dependents")


@query(
    "lower_mismatched_age",
    on_claims(
        "SELECT claim_id, CASE WHEN age + birth_year NOT IN (year(accident_date), year(accident_date) - 1) THEN age - 1 ELSE age END::INT AS age FROM claims"
    ),
)
def lower_mismatched_age(spark, sf):
    return rules.lower_mismatched_age(claims(spark, sf), "age", "birth_year", "accident_date").select("claim_id", "age")


@query(
    "age_mismatch_report",
    on_claims("SELECT claim_id, age, birth_year, accident_date FROM claims WHERE age + birth_year NOT IN (year(accident_date) - 1, year(accident_date), year(accident_date) + 1)"),
)
def age_mismatch_report(spark, sf):
    wrong = rules.age_mismatch("age", "birth_year", "accident_date", years_after=1)
    return claims(spark, sf).filter(wrong).select("claim_id", "age", "birth_year", "accident_date")


@query("earliest_date", on_claims("SELECT claim_id, least(accident_date, assembly_date, c2_date, c3_date) AS accident_date, assembly_date FROM claims"))
def earliest_date(spark, sf):
    out = rules.earliest_date(claims(spark, sf), "accident_date", ["assembly_date", "c2_date", "c3_date"])
    return out.select("claim_id", "accident_date", "assembly_date")


@query(
    "swap_dates",
    on_claims(
        "SELECT claim_id, CASE WHEN accident_date > assembly_date THEN assembly_date ELSE accident_date END AS accident_date, "
        "CASE WHEN accident_date > assembly_date THEN accident_date ELSE assembly_date END AS assembly_date FROM claims"
    ),
)
def swap_dates(spark, sf):
    return rules.swap_dates(claims(spark, sf), "accident_date", "assembly_date").select("claim_id", "accident_date", "assembly_date")


@query("reset_flag_before", on_claims("SELECT claim_id, CASE WHEN covid_flag = 'Y' AND accident_date < DATE '2000-03-01' THEN 'N' ELSE covid_flag END AS covid_flag FROM claims"))
def reset_flag_before(spark, sf):
    return rules.reset_flag_before(claims(spark, sf), "covid_flag", "accident_date", start="2000-03-01").select("claim_id", "covid_flag")


@query("order_violations", on_claims("SELECT claim_id, accident_date, assembly_date FROM claims WHERE accident_date > assembly_date"))
def order_violations(spark, sf):
    return rules.order_violations(claims(spark, sf), "accident_date", "assembly_date").select("claim_id", "accident_date", "assembly_date")


DATE_PAIRS = [("accident_date", "assembly_date"), ("accident_date", "c2_date"), ("assembly_date", "c3_date")]


@query(
    "order_violation_counts",
    on_claims("\nUNION ALL ".join(f"SELECT '{a} > {b}' AS date_order, count(*) FILTER ({a} > {b}) AS n_rows FROM claims" for a, b in DATE_PAIRS)),
)
def order_violation_counts(spark, sf):
    return rules.order_violation_counts(claims(spark, sf), DATE_PAIRS)


VALIDATION = dict(
    dates=["accident_date", "c2_date"],
    not_after="2000-12-31",
    text_columns=["industry"],
    sentinels={"carrier_type": ["UNKNOWN"], "gender": ["U"]},
    sentinel_to_value={"adr_flag": ["U", "N"]},
    birth_year="birth_year",
    age="age",
    accident_date="accident_date",
)


@query(
    "validate_record",
    on_claims(
        "SELECT claim_id, accident_date, CASE WHEN c2_date > DATE '2000-12-31' THEN NULL ELSE c2_date END AS c2_date, "
        "nullif(industry, 'Unknown') AS industry, nullif(carrier_type, 'UNKNOWN') AS carrier_type, nullif(gender, 'U') AS gender, "
        "CASE WHEN adr_flag = 'U' THEN 'N' ELSE adr_flag END AS adr_flag, CAST(year(accident_date) - age AS INT) AS birth_year, "
        "coalesce(nullif(gender, 'U') NOT IN ('M', 'F'), false) AS illegal_value "
        "FROM (SELECT * REPLACE (CASE WHEN accident_date > DATE '2000-12-31' THEN NULL ELSE accident_date END AS accident_date) FROM claims)"
    ),
)
def validate_record(spark, sf):
    out = rules.flag_illegal(rules.validate_record(claims(spark, sf), **VALIDATION), {"gender": ["M", "F"]})
    return out.select("claim_id", "accident_date", "c2_date", "industry", "carrier_type", "gender", "adr_flag", "birth_year", "illegal_value")

"""Sources, profiling reports, sorts and limits."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from tablewright.catalog.claims import CLAIMS_SQL, claims, on_claims, on_split, split_claims
from tablewright.catalog.registry import ORACLES, query, table
from tablewright.operators import growing, profile
from tablewright.session import scratch_path
from tablewright.sources import tables as src

ALL = [
    "claim_id", "accident_date", "assembly_date", "c2_date", "c3_date", "hearing_date_raw", "age", "birth_year", "wage", "ime4_count",
    "dependents", "gender", "covid_flag", "adr_flag", "attorney_flag", "industry", "carrier_type", "carrier_name", "body_code",
    "body_desc", "cause_code", "cause_desc", "district", "claim_type",
]
NULLABLE = ["accident_date", "c2_date", "c3_date", "hearing_date_raw", "age", "birth_year", "wage", "ime4_count"]
NUMERIC = ["age", "birth_year", "wage", "ime4_count", "dependents"]
TEXT = ["gender", "covid_flag", "adr_flag", "attorney_flag", "industry", "carrier_type", "district", "claim_type"]
SPARK_TYPES = dict(
    claim_id="bigint", accident_date="date", assembly_date="date", c2_date="date", c3_date="date", hearing_date_raw="string", age="int",
    birth_year="int", wage="double", ime4_count="int", dependents="int", gender="string", covid_flag="string", adr_flag="string",
    attorney_flag="string", industry="string", carrier_type="string", carrier_name="string", body_code="int", body_desc="string",
    cause_code="int", cause_desc="string", district="string", claim_type="string",
)
COLUMNS_TO_DROP = ["hearing_date_raw", "carrier_name", "c3_date", "hearing_date_raw", "industry", "c3_date"]


def union_all(parts: list[str]) -> str:
    return "\nUNION ALL ".join(parts)


# Sources and sinks


@query("csv_scan", CLAIMS_SQL)
def csv_scan(spark, sf):
    path = scratch_path(spark, "claims-csv")
    source = claims(spark, sf)
    src.write_csv(source, path)
    return src.read_csv(spark, path, source.schema)


@query("csv_scan_typed", on_claims("SELECT CAST(claim_id AS VARCHAR) AS claim_id, CAST(age AS DOUBLE) AS age, CAST(body_code AS VARCHAR) AS body_code FROM claims"))
def csv_scan_typed(spark, sf):
    """Codes forced to text while the other columns keep their type."""
    path = scratch_path(spark, "claims-csv")
    src.write_csv(claims(spark, sf).select("claim_id", "age", "body_code"), path)
    return src.read_csv(spark, path, "claim_id string, age double, body_code string")


@query("csv_sink", on_claims("SELECT claim_type, CAST(count(*) AS BIGINT) AS n_rows FROM claims GROUP BY claim_type"))
def csv_sink(spark, sf):
    path = scratch_path(spark, "predictions-csv")
    src.write_csv(claims(spark, sf).select("claim_id", "claim_type"), path)
    back = src.read_csv(spark, path, "claim_id bigint, claim_type string")
    return back.groupBy("claim_type").agg(F.count("*").alias("n_rows"))


@query("parquet_sink_by_split", on_split("SELECT split, claim_type, CAST(count(*) AS BIGINT) AS n_rows FROM split_claims GROUP BY split, claim_type"))
def parquet_sink_by_split(spark, sf):
    path = scratch_path(spark, "claims-parquet")
    src.write_parquet(split_claims(spark, sf), path, partition_by=["split"])
    return spark.read.parquet(path).groupBy("split", "claim_type").agg(F.count("*").alias("n_rows"))


@query("drop_listed_columns", on_claims("SELECT * EXCLUDE (hearing_date_raw, carrier_name, c3_date, industry) FROM claims"))
def drop_listed_columns(spark, sf):
    path = scratch_path(spark, "column-list")
    spark.createDataFrame([(c,) for c in COLUMNS_TO_DROP], "value string").write.text(path)
    return src.drop_columns_in_file(claims(spark, sf), path)


@query(
    "schema_report",
    on_claims(
        union_all(
            [
                f"SELECT CAST({i} AS INT) AS position, '{c}' AS column_name, '{SPARK_TYPES[c]}' AS column_type, count({c}) AS non_null FROM claims"
                for i, c in enumerate(ALL)
            ]
        )
    ),
)
def schema_report(spark, sf):
    return src.schema_report(claims(spark, sf)).drop("nullable")


CONTRACT = src.RecordContract(
    types={"claim_id": "bigint", "age": "double", "gender": "string", "adr_flag": "string", "carrier_type": "string", "zip_code": "string"},
    domains={"gender": ["M", "F"], "adr_flag": ["N", "Y"]},
)


@query(
    "record_contract",
    on_claims(
        "SELECT claim_id, CAST(age AS DOUBLE) AS age, gender, adr_flag, carrier_type, CAST(NULL AS VARCHAR) AS zip_code, "
        "coalesce(gender NOT IN ('M', 'F'), false) AS illegal_gender, coalesce(adr_flag NOT IN ('N', 'Y'), false) AS illegal_adr_flag FROM claims"
    ),
)
def record_contract(spark, sf):
    return CONTRACT.breaches(CONTRACT.enforce(claims(spark, sf)))


@query(
    "columns_absent",
    "SELECT c AS column_name FROM (VALUES ('zip_code'), ('claim_id'), ('county')) v(c) WHERE c NOT IN "
    "(SELECT column_name FROM (DESCRIBE (" + CLAIMS_SQL + ")))",
)
def columns_absent(spark, sf):
    return src.columns_absent(spark, ["zip_code", "claim_id", "county"], claims(spark, sf))


# Missing data


@query(
    "missing_report",
    on_claims(
        "SELECT column_name, n_missing, round(100.0 * n_missing / n_rows, 2) AS pct_missing FROM ("
        + union_all([f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS n_missing, count(*)::DOUBLE AS n_rows FROM claims" for c in ALL])
        + ") WHERE n_missing > 0"
    ),
)
def missing_report(spark, sf):
    return profile.missing_report(claims(spark, sf))


@query(
    "null_counts",
    on_claims(union_all([f"SELECT '{c}' AS column_name, count(*) - count({c}) AS n_missing, count({c}) AS n_known FROM claims" for c in NULLABLE])),
)
def null_counts(spark, sf):
    return profile.null_counts(claims(spark, sf), NULLABLE)


@query(
    "comissing_report",
    on_claims(
        union_all(
            [
                f"SELECT '{a}' AS column_a, '{b}' AS column_b, count(*) FILTER ({a} IS NULL AND {b} IS NULL) AS n_both_missing FROM claims"
                for a, b in combinations(NULLABLE, 2)
            ]
        )
    ),
)
def comissing_report(spark, sf):
    return profile.comissing_report(claims(spark, sf), NULLABLE)


@query(
    "incomplete_by_class",
    on_claims(
        "SELECT claim_type, count(*) AS n_rows FROM claims WHERE age IS NULL OR birth_year IS NULL OR industry IS NULL OR body_code IS NULL GROUP BY claim_type"
    ),
)
def incomplete_by_class(spark, sf):
    return profile.incomplete_by_class(claims(spark, sf), ["age", "birth_year", "industry", "body_code"], "claim_type")


@query("incomplete_rows", on_claims("SELECT * FROM claims WHERE body_code IS NULL OR cause_code IS NULL OR body_desc IS NULL OR cause_desc IS NULL"))
def incomplete_rows(spark, sf):
    return profile.incomplete_rows(claims(spark, sf), ["body_code", "cause_code", "body_desc", "cause_desc"])


@query(
    "nullity_correlation",
    on_claims(
        "SELECT column_a, column_b, round((n * n_ab - n_a * n_b) / (sqrt(n_a * (n - n_a)) * sqrt(n_b * (n - n_b))), 6) AS correlation FROM ("
        + union_all(
            [
                f"SELECT '{a}' AS column_a, '{b}' AS column_b, count(*)::DOUBLE AS n, (count(*) - count({a}))::DOUBLE AS n_a, "
                f"(count(*) - count({b}))::DOUBLE AS n_b, (count(*) FILTER ({a} IS NULL AND {b} IS NULL))::DOUBLE AS n_ab FROM claims"
                for a, b in combinations(NULLABLE, 2)
            ]
        )
        + ") WHERE n_a > 0 AND n_a < n AND n_b > 0 AND n_b < n"
    ),
)
def nullity_correlation(spark, sf):
    return profile.nullity_correlation(claims(spark, sf), NULLABLE).withColumn("correlation", F.round("correlation", 6))


# Summaries


@query(
    "numeric_summary",
    on_claims(
        union_all(
            [
                f"SELECT '{c}' AS column_name, count({c}) AS n_known, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, "
                f"min({c})::DOUBLE AS minimum, round(quantile_cont({c}::DOUBLE, 0.25), 6) AS q25, round(median({c}::DOUBLE), 6) AS median, "
                f"round(quantile_cont({c}::DOUBLE, 0.75), 6) AS q75, max({c})::DOUBLE AS maximum FROM claims"
                for c in NUMERIC
            ]
        )
    ),
)
def numeric_summary(spark, sf):
    out = profile.numeric_summary(claims(spark, sf), NUMERIC)
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "std", "q25", "median", "q75")})


@query(
    "numeric_summary_lineitem",
    union_all(
        [
            f"SELECT '{c}' AS column_name, count({c}) AS n_known, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, "
            f"min({c})::DOUBLE AS minimum, round(quantile_cont({c}::DOUBLE, 0.25), 6) AS q25, round(median({c}::DOUBLE), 6) AS median, "
            f"round(quantile_cont({c}::DOUBLE, 0.75), 6) AS q75, max({c})::DOUBLE AS maximum FROM lineitem"
            for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
        ]
    ),
)
def numeric_summary_lineitem(spark, sf):
    out = profile.numeric_summary(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "std", "q25", "median", "q75")})


@query(
    "categorical_summary",
    on_claims(
        union_all(
            [
                f"SELECT '{c}' AS column_name, CAST(sum(n) AS BIGINT) AS n_known, count(*) AS n_distinct, "
                f"first(v ORDER BY n DESC, v) AS top, max(n) AS top_count FROM (SELECT {c} AS v, count(*) AS n FROM claims WHERE {c} IS NOT NULL GROUP BY {c})"
                for c in TEXT + ["carrier_name"]
            ]
        )
    ),
)
def categorical_summary(spark, sf):
    return profile.categorical_summary(claims(spark, sf), TEXT + ["carrier_name"])


@query(
    "distinct_report",
    on_claims(
        union_all(
            [
                f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_distinct, CASE WHEN count(DISTINCT {c}) < 100 THEN "
                f"string_agg(DISTINCT {c}, '|' ORDER BY {c}) END AS values_listed FROM claims"
                for c in TEXT + ["carrier_name"]
            ]
        )
    ),
)
def distinct_report(spark, sf):
    return profile.distinct_report(claims(spark, sf), TEXT + ["carrier_name"])


@query("value_counts", on_claims("SELECT industry, count(*) AS n FROM claims WHERE industry IS NOT NULL GROUP BY industry"))
def value_counts(spark, sf):
    return profile.value_counts(claims(spark, sf), "industry")


@query(
    "value_counts_with_null",
    on_claims("SELECT industry, count(*) AS n, round(count(*) / (SELECT count(*) FROM claims), 6) AS share FROM claims GROUP BY industry"),
)
def value_counts_with_null(spark, sf):
    return profile.value_counts(claims(spark, sf), "industry", shares=True, keep_null=True).withColumn("share", F.round("share", 6))


@query(
    "known_shares",
    on_claims(
        "SELECT body_code, count(*) AS n, round(count(*) / (SELECT count(body_code) FROM claims), 6) AS share FROM claims WHERE body_code IS NOT NULL GROUP BY body_code"
    ),
)
def known_shares(spark, sf):
    return profile.value_counts(claims(spark, sf), "body_code", shares=True).withColumn("share", F.round("share", 6))


@query(
    "dependency_violations",
    "WITH pairs AS (SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem) "
    "SELECT l_returnflag, l_linestatus, count(*) OVER (PARTITION BY l_returnflag) AS n_values FROM pairs QUALIFY n_values > 1",
)
def dependency_violations(spark, sf):
    return profile.dependency_violations(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus")


@query(
    "dependency_violations_code",
    on_claims(
        "SELECT cause_code, body_desc, count(*) OVER (PARTITION BY cause_code) AS n_values FROM "
        "(SELECT DISTINCT cause_code, body_desc FROM claims WHERE cause_code IS NOT NULL AND body_desc IS NOT NULL) QUALIFY n_values > 1"
    ),
)
def dependency_violations_code(spark, sf):
    return profile.dependency_violations(claims(spark, sf), "cause_code", "body_desc")


@query(
    "code_dictionary",
    on_claims(
        "SELECT body_code, body_desc, CASE WHEN body_code IS NOT NULL THEN count(*) OVER (PARTITION BY body_code) END AS n_for_code "
        "FROM (SELECT DISTINCT body_code, body_desc FROM claims)"
    ),
)
def code_dictionary(spark, sf):
    return profile.code_dictionary(claims(spark, sf), "body_code", "body_desc")


@query(
    "ambiguous_codes",
    on_claims(
        "SELECT CAST(sum(n - 1) AS BIGINT) AS n_repeats FROM (SELECT count(*) AS n FROM (SELECT DISTINCT body_code, body_desc FROM claims) GROUP BY body_code)"
    ),
)
def ambiguous_codes(spark, sf):
    return profile.ambiguous_codes(claims(spark, sf), "body_code", "body_desc")


@query(
    "class_distribution",
    on_claims("SELECT claim_type, count(*) AS n, round(100 * (count(*) / (SELECT count(*) FROM claims)), 6) AS pct FROM claims GROUP BY claim_type"),
)
def class_distribution(spark, sf):
    return profile.class_distribution(claims(spark, sf), "claim_type").withColumn("pct", F.round("pct", 6))


RULES = {
    "under_age": "age < 14",
    "child_with_dependents": "dependents > 0 AND age BETWEEN 1 AND 15",
    "late_accident": "accident_date > assembly_date",
    "early_covid": "covid_flag = 'Y' AND accident_date < DATE '2000-03-01'",
    "zero_wage": "wage = 0",
}


@query(
    "rule_hits",
    on_claims(
        union_all(
            [
                f"SELECT '{n}' AS rule, count(*) FILTER ({r}) AS n_hits, round(100.0 * (count(*) FILTER ({r}))::DOUBLE / count(*), 6) AS pct_hits FROM claims"
                for n, r in RULES.items()
            ]
        )
    ),
)
def rule_hits(spark, sf):
    out = profile.rule_hits(claims(spark, sf), {n: F.expr(r) for n, r in RULES.items()})
    return out.withColumn("pct_hits", F.round("pct_hits", 6))


@query(
    "location_scale",
    on_split(
        union_all(
            [
                f"SELECT '{c}' AS column_name, '{s}' AS statistic, round({e}, 6) AS value FROM train"
                for c in ("age", "wage")
                for s, e in (
                    ("mean", f"avg({c})"),
                    ("std", f"stddev_samp({c})"),
                    ("q0.01", f"quantile_cont({c}::DOUBLE, 0.01)"),
                    ("q0.5", f"median({c}::DOUBLE)"),
                    ("q0.99", f"quantile_cont({c}::DOUBLE, 0.99)"),
                )
            ]
        )
    ),
)
def location_scale(spark, sf):
    train = split_claims(spark, sf).filter("split = 'train'")
    return profile.location_scale(train, ["age", "wage"], [0.01, 0.5, 0.99]).withColumn("value", F.round("value", 6))


@query(
    "ranges_by_split",
    on_split(
        "SELECT split, min(accident_date) AS accident_date_min, max(accident_date) AS accident_date_max, min(assembly_date) AS assembly_date_min, "
        "max(assembly_date) AS assembly_date_max FROM split_claims GROUP BY split"
    ),
)
def ranges_by_split(spark, sf):
    return profile.ranges_by(split_claims(spark, sf), ["accident_date", "assembly_date"], "split")


SENTINELS = ["U", "UNKNOWN", "UK", "X"]
SENTINEL_SQL = "('U', 'UNKNOWN', 'UK', 'X')"


@query(
    "sentinel_columns",
    on_claims(
        "SELECT * FROM ("
        + union_all([f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IN {SENTINEL_SQL}) AS n_sentinel FROM claims" for c in TEXT])
        + ") WHERE n_sentinel > 0"
    ),
)
def sentinel_columns(spark, sf):
    return profile.sentinel_columns(claims(spark, sf), TEXT, SENTINELS)


@query(
    "rows_with_sentinel",
    on_claims(f"SELECT count(*) AS n_rows FROM claims WHERE {' OR '.join(f'{c} IN {SENTINEL_SQL}' for c in TEXT)}"),
)
def rows_with_sentinel(spark, sf):
    return profile.rows_with_sentinel(claims(spark, sf), TEXT, SENTINELS).agg(F.count("*").alias("n_rows"))


@query("group_mean", on_claims("SELECT industry, round(avg(wage), 6) AS mean_value FROM claims GROUP BY industry"))
def group_mean(spark, sf):
    return profile.group_mean(claims(spark, sf), "industry", "wage").withColumn("mean_value", F.round("mean_value", 6))


@query(
    "unmapped_codes",
    on_claims("SELECT DISTINCT body_code AS code FROM claims WHERE body_code IS NOT NULL AND body_code NOT IN (SELECT n_nationkey FROM nation)"),
)
def unmapped_codes(spark, sf):
    return profile.unmapped_codes(claims(spark, sf), "body_code", table(spark, sf, "nation"), "n_nationkey")


# Sorts and limits


@query("smallest_distinct", on_claims("SELECT DISTINCT birth_year FROM claims WHERE birth_year IS NOT NULL ORDER BY birth_year LIMIT 10"))
def smallest_distinct(spark, sf):
    return profile.smallest_distinct(claims(spark, sf), "birth_year")


@query(
    "commonest_values",
    on_claims("SELECT carrier_name, count(*) AS n FROM claims WHERE carrier_name IS NOT NULL GROUP BY carrier_name ORDER BY n DESC, carrier_name LIMIT 10"),
)
def commonest_values(spark, sf):
    return profile.commonest(claims(spark, sf), "carrier_name")


@query("first_rows", on_claims("SELECT claim_id, age, wage FROM claims ORDER BY claim_id LIMIT 5"))
def first_rows(spark, sf):
    return claims(spark, sf).select("claim_id", "age", "wage").orderBy("claim_id").limit(5)


# Profiles of a growing table


def grown_state(spark, sf):
    """States of the claims by year of assembly: the earlier years first, then the later ones, then the last year again."""
    path = scratch_path(spark, "profile-state")
    rows = claims(spark, sf)
    year = F.coalesce(F.year("assembly_date").cast("string"), F.lit("none"))
    years = sorted(r["y"] for r in rows.select(year.alias("y")).distinct().collect())
    half = len(years) // 2
    for some in (years[:half], years[half:], years[-1:]):
        if some:
            growing.refresh(rows, path, year, some, NUMERIC, TEXT + ["carrier_name"])
    return path


@query("growing_numeric_summary", ORACLES["numeric_summary"])
def growing_numeric_summary(spark, sf):
    out = growing.merged_numeric(spark, grown_state(spark, sf), NUMERIC)
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "std", "q25", "median", "q75")})


@query("growing_categorical_summary", ORACLES["categorical_summary"])
def growing_categorical_summary(spark, sf):
    return growing.merged_categorical(spark, grown_state(spark, sf), TEXT + ["carrier_name"])

"""Outliers, missing values, encoders, derived features and scalers, fitted on the training rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.catalog.claims import claims, on_claims, on_split, split_claims
from tablewright.catalog.clean_queries import CLASSES
from tablewright.catalog.registry import query
from tablewright.operators import encode, features, impute, outliers, scale


def _fitted(operator, spark, sf, *columns):
    """Fit on the training rows, apply to all, and keep some columns."""
    df = split_claims(spark, sf)
    out = operator.fit(df).transform(df)
    return out.select(*columns) if columns else out


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def micros_sql(c: str) -> str:
    return f"epoch_us(CAST({c} AS TIMESTAMP))"


# Outliers


@query(
    "early_dates",
    on_split(
        "SELECT claim_id, split, CASE WHEN us < bound AND split <> 'train' THEN NULL ELSE c2_date END AS c2_date, "
        "make_timestamp(CASE WHEN us < bound THEN bound ELSE us END) AS accident_date "
        f"FROM (SELECT *, {micros_sql('accident_date')} AS us FROM split_claims), b WHERE split <> 'train' OR us >= bound",
        b=f"SELECT CAST(floor(quantile_cont({micros_sql('accident_date')}::DOUBLE, 0.01)) AS BIGINT) AS bound FROM train",
    ),
)
def early_dates(spark, sf):
    return _fitted(outliers.EarlyDates(), spark, sf, "claim_id", "split", "c2_date", "accident_date")


@query(
    "implausible_age",
    on_split(
        "SELECT claim_id, CASE WHEN (age - m) / s > 3 OR age < 14 THEN NULL ELSE age END AS age, "
        "CASE WHEN (age - m) / s > 3 OR age < 14 THEN NULL ELSE birth_year END AS birth_year FROM split_claims, f",
        f="SELECT avg(age) AS m, stddev_samp(age) AS s FROM train",
    ),
)
def implausible_age(spark, sf):
    return _fitted(outliers.ImplausibleAge(), spark, sf, "claim_id", "age", "birth_year")


@query(
    "null_implausible_birth_year",
    on_claims("SELECT claim_id, CASE WHEN year(accident_date) - birth_year NOT BETWEEN 14 AND 83 THEN NULL ELSE birth_year END AS birth_year FROM claims"),
)
def null_implausible_birth_year(spark, sf):
    return outliers.null_implausible_birth_year(claims(spark, sf), "accident_date", "birth_year").select("claim_id", "birth_year")


@query("keep_up_to", on_claims("SELECT * FROM claims WHERE ime4_count <= 20 OR ime4_count IS NULL"))
def keep_up_to(spark, sf):
    return outliers.keep_up_to(claims(spark, sf), "ime4_count")


@query("cap_values", on_claims("SELECT claim_id, CAST(CASE WHEN ime4_count > 20 THEN 20 ELSE ime4_count END AS INT) AS ime4_count FROM claims"))
def cap_values(spark, sf):
    return outliers.cap(claims(spark, sf), "ime4_count").select("claim_id", "ime4_count")


@query(
    "limit_by_split",
    on_split(
        "SELECT claim_id, split, CAST(CASE WHEN ime4_count > 20 THEN 20 ELSE ime4_count END AS INT) AS ime4_count FROM split_claims "
        "WHERE split <> 'train' OR ime4_count <= 20 OR ime4_count IS NULL"
    ),
)
def limit_by_split(spark, sf):
    return outliers.limit_by_split(split_claims(spark, sf), "ime4_count").select("claim_id", "split", "ime4_count")


FENCES = "SELECT q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high FROM (SELECT quantile_cont({x}, 0.25) AS q1, quantile_cont({x}, 0.75) AS q3 FROM {t} WHERE {w})"


@query(
    "log_iqr",
    on_split(
        "SELECT claim_id, split, round(CASE WHEN split = 'train' OR wage IS NULL OR wage <= 0 THEN wage WHEN wage < lo THEN lo WHEN wage > hi THEN hi ELSE wage END, 6) AS wage "
        "FROM split_claims, (SELECT exp(low) AS lo, exp(high) AS hi FROM f) WHERE split <> 'train' OR wage IS NULL OR wage = 0 OR wage BETWEEN lo AND hi",
        f=FENCES.format(x="ln(wage)", t="train", w="wage > 0"),
    ),
)
def log_iqr(spark, sf):
    return _rounded(_fitted(outliers.LogIqr(), spark, sf, "claim_id", "split", "wage"), "wage")


@query(
    "iqr_trim",
    on_split("SELECT claim_id, age FROM split_claims, f WHERE age BETWEEN low AND high", f=FENCES.format(x="age::DOUBLE", t="train", w="true")),
)
def iqr_trim(spark, sf):
    return _fitted(outliers.IqrTrim(column="age"), spark, sf, "claim_id", "age")


@query(
    "iqr_trim_log",
    on_split(
        "SELECT claim_id, wage FROM split_claims, f WHERE split <> 'train' OR ln(1 + wage) BETWEEN low AND high",
        f=FENCES.format(x="ln(1 + wage)", t="train", w="true"),
    ),
)
def iqr_trim_log(spark, sf):
    return _fitted(outliers.IqrTrim(column="wage", log=True, only_train=True), spark, sf, "claim_id", "wage")


@query(
    "date_fences",
    on_claims(
        "SELECT make_timestamp(CAST(floor(low * 1000000) AS BIGINT)) AS low_date, make_timestamp(CAST(floor(high * 1000000) AS BIGINT)) AS high_date, "
        f"count(*) FILTER ({micros_sql('assembly_date')} / 1000000.0::DOUBLE < low OR {micros_sql('assembly_date')} / 1000000.0::DOUBLE > high) AS n_outside "
        "FROM claims, f GROUP BY ALL",
        f=FENCES.format(x=f"{micros_sql('assembly_date')} / 1000000.0::DOUBLE", t="claims", w="true"),
    ),
)
def date_fences(spark, sf):
    return outliers.date_fences(claims(spark, sf), "assembly_date")


@query("below_quantile", on_split("SELECT claim_id, wage FROM split_claims WHERE wage < (SELECT quantile_cont(wage, 0.9999) FROM train)"))
def below_quantile(spark, sf):
    return _fitted(outliers.BelowQuantile(column="wage"), spark, sf, "claim_id", "wage")


@query("keep_between", on_claims("SELECT claim_id, age, wage FROM claims WHERE age >= 14 AND age < 83 AND wage < 3000"))
def keep_between(spark, sf):
    out = outliers.keep_between(claims(spark, sf), "age", at_least=14, below=83)
    return outliers.keep_between(out, "wage", below=3000).select("claim_id", "age", "wage")


# Missing values


@query("fill_constant", on_claims("SELECT claim_id, coalesce(ime4_count, 0) AS ime4_count, coalesce(hearing_date_raw, 'UNKNOWN') AS hearing_date_raw FROM claims"))
def fill_constant(spark, sf):
    out = impute.fill_constant(claims(spark, sf), "ime4_count", 0)
    return impute.fill_constant(out, "hearing_date_raw", "UNKNOWN").select("claim_id", "ime4_count", "hearing_date_raw")


@query("fill_constant_new_column", on_claims("SELECT claim_id, wage, coalesce(wage, 1757.19::DOUBLE) AS wage_imputed FROM claims"))
def fill_constant_new_column(spark, sf):
    return impute.fill_constant(claims(spark, sf), "wage", 1757.19, into="wage_imputed").select("claim_id", "wage", "wage_imputed")


@query("derive_birth_year", on_claims("SELECT claim_id, CAST(coalesce(birth_year, year(accident_date) - age) AS INT) AS birth_year FROM claims"))
def derive_birth_year(spark, sf):
    return impute.derive_birth_year(claims(spark, sf), "birth_year", "accident_date", "age").select("claim_id", "birth_year")


@query(
    "birth_year_by_medians",
    on_split(
        "SELECT claim_id, coalesce(birth_year::DOUBLE, year(accident_date) - ma, mb) AS birth_year FROM split_claims, f",
        f="SELECT median(age::DOUBLE) AS ma, median(birth_year::DOUBLE) AS mb FROM train",
    ),
)
def birth_year_by_medians(spark, sf):
    return _fitted(impute.BirthYearByMedians(), spark, sf, "claim_id", "birth_year")


def alias_sql(column: str, top: int | None = None) -> dict[str, str]:
    """Equal cells of at most two values: light values are filled up from what heavy ones have over."""
    counts = f"SELECT {column} AS v, count(*) AS n FROM train WHERE {column} IS NOT NULL GROUP BY {column}"
    if top:
        counts += f" ORDER BY n DESC, v LIMIT {top}"
    return {
        "counts": counts,
        "sized": "SELECT v, n * (SELECT count(*) FROM counts) AS w, (SELECT sum(n) FROM counts) AS t FROM counts",
        "light": "SELECT v, w, t, row_number() OVER (ORDER BY v) AS i, sum(t - w) OVER (ORDER BY v) AS d FROM sized WHERE w < t",
        "heavy": "SELECT v, w, t, row_number() OVER (ORDER BY v) AS j, sum(w - t) OVER (ORDER BY v) AS s FROM sized WHERE w >= t",
        "cells": "SELECT i - 1 AS cell, v, (SELECT arg_min(h.v, h.j) FROM heavy h WHERE h.s >= l.d - (l.t - l.w)) AS other, w / t::DOUBLE AS share FROM light l UNION ALL "
        "SELECT (SELECT count(*) FROM light) + j - 1, v, coalesce((SELECT arg_min(x.v, x.j) FROM heavy x WHERE x.j > h.j), v), "
        "(t - coalesce((SELECT min(l.d) FROM light l WHERE l.d > h.s) - h.s, 0)) / t::DOUBLE FROM heavy h",
    }


def draw_sql(column: str, into: str, seed: str = "0") -> str:
    def part(at: int) -> str:
        return f"('0x' || substr(md5(CAST(claim_id AS VARCHAR) || ':{column}:{seed}'), {at}, 13))::BIGINT / 4503599627370496.0::DOUBLE"

    return (
        f"SELECT claim_id, coalesce({column}, CASE WHEN p < share THEN v ELSE other END) AS {into} FROM (SELECT *, floor({part(1)} * (SELECT count(*) FROM counts)) AS c, {part(14)} AS p "
        "FROM split_claims) LEFT JOIN cells ON c = cell"
    )


@query("proportional_fill", on_split(draw_sql("industry", "industry"), **alias_sql("industry")))
def proportional_fill(spark, sf):
    return _fitted(impute.ProportionalFill(column="industry"), spark, sf, "claim_id", "industry")


@query("proportional_fill_code", on_split(draw_sql("body_code", "body_code_imputed", "3"), **alias_sql("body_code")))
def proportional_fill_code(spark, sf):
    return _fitted(impute.ProportionalFill(column="body_code", into="body_code_imputed", seed=3), spark, sf, "claim_id", "body_code_imputed")


@query("proportional_fill_top", on_split(draw_sql("body_code", "body_code", "0"), **alias_sql("body_code", 10)))
def proportional_fill_top(spark, sf):
    return _fitted(impute.ProportionalFill(column="body_code", top=10), spark, sf, "claim_id", "body_code")


@query("proportional_fill_many_values", on_split(draw_sql("birth_year", "birth_year", "0"), **alias_sql("birth_year")))
def proportional_fill_many_values(spark, sf):
    return _fitted(impute.ProportionalFill(column="birth_year"), spark, sf, "claim_id", "birth_year")


EMPTY = "body_code IS NULL AND cause_code IS NULL AND body_desc IS NULL AND cause_desc IS NULL"


@query(
    "fill_block",
    on_claims(
        f"SELECT claim_id, CASE WHEN {EMPTY} THEN 100 ELSE body_code END AS body_code, CASE WHEN {EMPTY} THEN 100 ELSE cause_code END AS cause_code, "
        f"CASE WHEN {EMPTY} THEN 'Unknown' ELSE body_desc END AS body_desc, CASE WHEN {EMPTY} THEN 'Unknown' ELSE cause_desc END AS cause_desc FROM claims"
    ),
)
def fill_block(spark, sf):
    out = impute.fill_block(claims(spark, sf), ["body_code", "cause_code"], ["body_desc", "cause_desc"])
    return out.select("claim_id", "body_code", "cause_code", "body_desc", "cause_desc")


def modes_sql(group: str, column: str, source: str = "train") -> str:
    return (
        f"SELECT g, v FROM (SELECT {group} AS g, {column} AS v, count(*) AS n FROM {source} WHERE {group} IS NOT NULL AND {column} IS NOT NULL GROUP BY ALL) "
        "QUALIFY row_number() OVER (PARTITION BY g ORDER BY n DESC, v) = 1"
    )


@query(
    "group_mode_fill",
    on_split("SELECT claim_id, coalesce(body_code, v) AS body_code FROM split_claims LEFT JOIN m ON cause_code = g", m=modes_sql("cause_code", "body_code")),
)
def group_mode_fill(spark, sf):
    return _fitted(impute.GroupModeFill(group="cause_code", column="body_code"), spark, sf, "claim_id", "body_code")


@query(
    "group_mode_fill_new_column",
    on_split(
        "SELECT claim_id, cause_code, coalesce(cause_code, v) AS cause_code_imputed FROM split_claims LEFT JOIN m ON carrier_name = g",
        m=modes_sql("carrier_name", "cause_code"),
    ),
)
def group_mode_fill_new_column(spark, sf):
    operator = impute.GroupModeFill(group="carrier_name", column="cause_code", into="cause_code_imputed")
    return _fitted(operator, spark, sf, "claim_id", "cause_code", "cause_code_imputed")


@query(
    "group_mode_fill_fallback",
    on_split(
        "SELECT claim_id, coalesce(industry, v, (SELECT industry FROM train WHERE industry IS NOT NULL GROUP BY industry ORDER BY count(*) DESC, industry LIMIT 1)) AS industry "
        "FROM split_claims LEFT JOIN m ON body_desc = g",
        m=modes_sql("body_desc", "industry"),
    ),
)
def group_mode_fill_fallback(spark, sf):
    return _fitted(impute.GroupStatisticFill(column="industry", group="body_desc"), spark, sf, "claim_id", "industry")


@query(
    "sentinel_mode_fill",
    on_split(
        "SELECT claim_id, coalesce(nullif(carrier_type, 'UNKNOWN'), (SELECT carrier_type FROM train WHERE carrier_type <> 'UNKNOWN' "
        "GROUP BY carrier_type ORDER BY count(*) DESC, carrier_type LIMIT 1)) AS carrier_type FROM split_claims"
    ),
)
def sentinel_mode_fill(spark, sf):
    return _fitted(impute.GroupStatisticFill(column="carrier_type", sentinels=["UNKNOWN"]), spark, sf, "claim_id", "carrier_type")


def _group_fill_sql(stat: str, group: str) -> str:
    return on_split(
        f"SELECT claim_id, round(coalesce(wage, v, (SELECT {stat} FROM train)), 6) AS wage FROM split_claims LEFT JOIN s ON {group} = g",
        s=f"SELECT {group} AS g, {stat} AS v FROM train WHERE {group} IS NOT NULL AND wage IS NOT NULL GROUP BY {group}",
    )


@query("group_mean_fill_fallback", _group_fill_sql("avg(wage)", "industry"))
def group_mean_fill_fallback(spark, sf):
    return _rounded(_fitted(impute.GroupStatisticFill(column="wage", group="industry", metric="mean"), spark, sf, "claim_id", "wage"), "wage")


@query("group_median_fill_fallback", _group_fill_sql("median(wage)", "carrier_name"))
def group_median_fill_fallback(spark, sf):
    return _rounded(_fitted(impute.GroupStatisticFill(column="wage", group="carrier_name", metric="median"), spark, sf, "claim_id", "wage"), "wage")


@query(
    "group_mean_fill",
    on_split(
        "SELECT claim_id, round(coalesce(wage, v), 6) AS wage FROM split_claims LEFT JOIN s ON industry = g",
        s="SELECT industry AS g, avg(wage) AS v FROM train WHERE industry IS NOT NULL GROUP BY industry",
    ),
)
def group_mean_fill(spark, sf):
    operator = impute.GroupStatisticFill(column="wage", group="industry", metric="mean", fallback=False)
    return _rounded(_fitted(operator, spark, sf, "claim_id", "wage"), "wage")


@query(
    "description_from_code",
    on_split(
        "SELECT claim_id, body_code, coalesce(body_desc, v) AS body_desc FROM split_claims LEFT JOIN d ON body_code = g",
        d="SELECT body_code AS g, max_by(body_desc, claim_id) AS v FROM train WHERE body_code IS NOT NULL AND body_desc IS NOT NULL GROUP BY body_code",
    ),
)
def description_from_code(spark, sf):
    return _fitted(impute.DescriptionFromCode(code="body_code", description="body_desc"), spark, sf, "claim_id", "body_code", "body_desc")


@query(
    "date_by_mean_gap",
    on_split(
        f"SELECT claim_id, coalesce(CAST(c2_date AS TIMESTAMP), make_timestamp({micros_sql('accident_date')} + gap)) AS c2_date_imputed FROM split_claims, f",
        f="SELECT CAST((s - ((s % n + n) % n)) // n AS BIGINT) AS gap FROM (SELECT sum(us) AS s, count(us)::HUGEINT AS n FROM "
        f"(SELECT {micros_sql('c2_date')} - {micros_sql('accident_date')} AS us FROM train))",
    ),
)
def date_by_mean_gap(spark, sf):
    return _fitted(impute.DateByMeanGap(), spark, sf, "claim_id", "c2_date_imputed")


@query(
    "date_by_median_gap",
    on_split(
        f"SELECT claim_id, coalesce(CAST(accident_date AS TIMESTAMP), make_timestamp({micros_sql('assembly_date')} - gap)) AS accident_date FROM split_claims, f",
        f="SELECT CAST(median(datediff('day', accident_date, assembly_date)::DOUBLE) * 86400000000 AS BIGINT) AS gap FROM train WHERE assembly_date > accident_date",
    ),
)
def date_by_median_gap(spark, sf):
    return _fitted(impute.DateByMedianGap(), spark, sf, "claim_id", "accident_date")


@query(
    "repair_date_order",
    on_split(
        "SELECT claim_id, CASE WHEN accident_date > assembly_date AND c2_date IS NOT NULL THEN c2_date - CAST(claim_id % 40 AS INT) + k ELSE assembly_date END AS assembly_date FROM split_claims, f",
        f="SELECT CAST(trunc(median(datediff('day', c2_date, assembly_date)::DOUBLE)) AS INT) AS k FROM "
        "(SELECT c2_date - CAST(claim_id % 40 AS INT) AS c2_date, assembly_date FROM train) WHERE assembly_date > c2_date",
    ),
)
def repair_date_order(spark, sf):
    # A third date as reference, moved about so that it lies before the target in some rows; it has nulls.
    rows = split_claims(spark, sf).withColumn("c2_date", F.date_sub("c2_date", (F.col("claim_id") % 40).cast("int")))
    operator = impute.RepairDateOrder(target="assembly_date", reference="c2_date", condition="accident_date")
    return operator.fit(rows).transform(rows).select("claim_id", "assembly_date")


@query("derive_age", on_claims("SELECT claim_id, CAST(coalesce(age, year(accident_date) - birth_year, year(assembly_date) - birth_year) AS INT) AS age FROM claims"))
def derive_age(spark, sf):
    return impute.derive_age(claims(spark, sf), "age", "birth_year", "accident_date", "assembly_date").select("claim_id", "age")


@query("vector_to_columns", "SELECT vec_id, embedding[1] AS x0, embedding[2] AS x1, embedding[3] AS x2 FROM embeddings")
def vector_to_columns(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    return impute.vector_to_columns(vectors, "embedding", ["x0", "x1", "x2"])


# Encoders


@query(
    "binary_encoder",
    on_split(
        "SELECT claim_id, CAST(CASE covid_flag WHEN 'N' THEN 0 WHEN 'Y' THEN 1 END AS INT) AS covid_flag_binary, "
        "CAST(CASE attorney_flag WHEN 'N' THEN 0 WHEN 'Y' THEN 1 END AS INT) AS attorney_flag_binary FROM split_claims"
    ),
)
def binary_encoder(spark, sf):
    return _fitted(encode.BinaryEncoder(columns=["covid_flag", "attorney_flag"]), spark, sf, "claim_id", "covid_flag_binary", "attorney_flag_binary")


def target_encoding_sql(column: str) -> dict[str, str]:
    w = "1 / (1 + exp(-(count(*) - 20::DOUBLE) / 10::DOUBLE))"
    return {
        "p": "SELECT " + ", ".join(f"count(*) FILTER (claim_type = '{c}') / count(*)::DOUBLE AS p{i}" for i, c in enumerate(CLASSES)) + " FROM train",
        "e": f"SELECT {column} AS g, "
        + ", ".join(f"{w} * count(*) FILTER (claim_type = '{c}') / count(*) + (1 - {w}) * any_value(p{i}) AS e{i}" for i, c in enumerate(CLASSES))
        + f" FROM train, p WHERE {column} IS NOT NULL GROUP BY {column}",
    }


def _target_encoder_sql(column: str) -> str:
    cols = ", ".join(f"round(coalesce(e{i}, p{i}), 6) AS te_{column}_{i}" for i in range(len(CLASSES)))
    return on_split(f"SELECT claim_id, {cols} FROM split_claims LEFT JOIN e ON {column} = g, p", **target_encoding_sql(column))


def _target_encoded(column: str, spark, sf):
    names = [f"te_{column}_{i}" for i in range(len(CLASSES))]
    return _rounded(_fitted(encode.TargetEncoder(columns=[column], label="claim_type", prefix="te_"), spark, sf, "claim_id", *names), *names)


@query("target_encoder", _target_encoder_sql("industry"))
def target_encoder(spark, sf):
    return _target_encoded("industry", spark, sf)


@query("target_encoder_high_cardinality", _target_encoder_sql("carrier_name"))
def target_encoder_high_cardinality(spark, sf):
    return _target_encoded("carrier_name", spark, sf)


@query(
    "frequency_encoder",
    on_split(
        "SELECT claim_id, coalesce(a.n, 0) AS industry_freq, coalesce(b.n, 0) AS carrier_name_freq, coalesce(c.n, 0) AS body_code_freq FROM split_claims "
        "LEFT JOIN (SELECT industry, count(*) AS n FROM train GROUP BY 1) a USING (industry) "
        "LEFT JOIN (SELECT carrier_name, count(*) AS n FROM train GROUP BY 1) b USING (carrier_name) "
        "LEFT JOIN (SELECT body_code, count(*) AS n FROM train GROUP BY 1) c USING (body_code)"
    ),
)
def frequency_encoder(spark, sf):
    operator = encode.FrequencyEncoder(columns=["industry", "carrier_name", "body_code"])
    return _fitted(operator, spark, sf, "claim_id", "industry_freq", "carrier_name_freq", "body_code_freq")


@query(
    "dummy_encoder",
    on_split("SELECT claim_id, (district = 'O')::INT::DOUBLE AS district_o, (district = 'P')::INT::DOUBLE AS district_p FROM split_claims"),
)
def dummy_encoder(spark, sf):
    return _fitted(encode.DummyEncoder(column="district", names=["district_o", "district_p"]), spark, sf, "claim_id", "district_o", "district_p")


@query(
    "dummy_encoder_lenient",
    on_split(
        "SELECT claim_id, "
        + ", ".join(f"coalesce((gender = '{g}')::INT::DOUBLE, 0.0::DOUBLE) AS gender_{g.lower()}" for g in "MUX")
        + " FROM split_claims"
    ),
)
def dummy_encoder_lenient(spark, sf):
    names = ["gender_m", "gender_u", "gender_x"]
    return _fitted(encode.DummyEncoder(column="gender", unseen="zero", names=names), spark, sf, "claim_id", *names)


SEGMENTS = {"AUTOMOBILE": "vehicles", "BUILDING": "trades", "MACHINERY": "trades"}


@query(
    "map_values",
    on_claims("SELECT claim_id, CASE industry WHEN 'AUTOMOBILE' THEN 'vehicles' WHEN 'BUILDING' THEN 'trades' WHEN 'MACHINERY' THEN 'trades' END AS industry_mapped FROM claims"),
)
def map_values(spark, sf):
    return encode.map_values(claims(spark, sf), "industry", SEGMENTS, replace=False).select("claim_id", "industry_mapped")


CARRIERS = ["1A. PRIVATE", "2A. SIF", "3A. SELF PUBLIC", "4A. SELF PRIVATE", "5A. SPECIAL FUND - CONS. COMM. (SECT. 25-A)", "5C. SPECIAL FUND - POI CARRIER WCB MENANDS", "5D. SPECIAL FUND - UNKNOWN", "UNKNOWN", "9Z. NEW"]


@query(
    "map_values_default",
    on_claims(
        "SELECT claim_id, CASE claim_id % 9 WHEN 0 THEN 'Private Insurance Carrier' WHEN 1 THEN 'State Insurance Fund' WHEN 2 THEN 'Self-insured Public Entity' "
        "WHEN 3 THEN 'Self-insured Private Entity' WHEN 4 THEN 'Special Funds' WHEN 5 THEN 'Special Funds' WHEN 6 THEN 'Special Funds' WHEN 7 THEN 'Unknown' ELSE 'Other' END AS carrier_type FROM claims"
    ),
)
def map_values_default(spark, sf):
    named = F.get(F.array(*[F.lit(c) for c in CARRIERS]), (F.col("claim_id") % 9).cast("int"))
    rows = claims(spark, sf).select("claim_id", named.alias("carrier_type"))
    return encode.map_values(rows, "carrier_type", encode.CARRIER_GROUPS, default="Other").select("claim_id", "carrier_type")


# Fixed values, written apart from the operator's own tables.
CAUSE_SQL = """
CASE WHEN k BETWEEN 1 AND 9 OR k IN (11, 14, 84) THEN 'Burn_or_Scald' WHEN k IN (10, 12, 13, 20) THEN 'Caught_In'
 WHEN k BETWEEN 15 AND 19 THEN 'Cut_Puncture_Scrape' WHEN k BETWEEN 25 AND 33 THEN 'Fall_Slip_or_Trip'
 WHEN k IN (40, 41, 50) OR k BETWEEN 45 AND 48 THEN 'Motor_Vehicle' WHEN k BETWEEN 52 AND 61 OR k = 97 THEN 'Strain_or_Injury'
 WHEN k BETWEEN 65 AND 70 THEN 'Striking_Against_or_Stepping_On' WHEN k BETWEEN 74 AND 81 OR k IN (85, 86) THEN 'Struck_or_Injured_By'
 WHEN k IN (82, 83, 98, 99) OR k BETWEEN 87 AND 91 OR k BETWEEN 93 AND 96 THEN 'Miscellaneous_Causes' WHEN k = 100 THEN 'Unknown' END"""
NATURE_SQL = """
CASE WHEN k IN (1, 2, 3, 4, 7, 10, 13, 16, 19, 22, 25, 28, 30, 31, 32, 34, 36, 37, 38, 40, 41, 42, 43, 46, 47, 49, 52, 53, 54, 55, 58, 59) THEN 'Specific'
 WHEN k BETWEEN 60 AND 80 OR k = 83 THEN 'Occupational' WHEN k IN (90, 91) THEN 'Multiple' WHEN k = 100 THEN 'Unknown' END"""
BODY_SQL = """
CASE WHEN k BETWEEN 10 AND 26 THEN 'Head_and_Neck' WHEN k BETWEEN 30 AND 39 THEN 'Upper_Extremities'
 WHEN k BETWEEN 40 AND 49 OR k BETWEEN 60 AND 63 THEN 'Trunk' WHEN k BETWEEN 50 AND 58 THEN 'Lower_Extremities'
 WHEN k IN (64, 65, 66, 90, 91, 99) THEN 'Multiple_Body Parts' WHEN k = 100 THEN 'Unknown' END"""


@query(
    "group_codes",
    on_claims(f"SELECT claim_id, {CAUSE_SQL} AS cause_group, {NATURE_SQL} AS nature_group, {BODY_SQL} AS body_group FROM (SELECT claim_id, 1 + claim_id % 100 AS k FROM claims)"),
)
def group_codes(spark, sf):
    # Every code from 1 to 100.
    out = claims(spark, sf).select("claim_id", (1 + F.col("claim_id") % 100).cast("int").alias("code"))
    for kind in ("cause", "nature", "body"):
        out = encode.group_codes(out, "code", kind, f"{kind}_group")
    return out.select("claim_id", "cause_group", "nature_group", "body_group")


@query(
    "null_flags",
    on_claims(
        "SELECT claim_id, CAST(c3_date IS NULL AS INT) AS c3_date_nabinary, CAST(wage IS NULL OR wage = 0 AS INT) AS wage_nabinary, "
        "CAST(hearing_date_raw IS NOT NULL AS INT) AS hearing_date_raw_nabinary FROM claims"
    ),
)
def null_flags(spark, sf):
    out = encode.null_flags(claims(spark, sf), ["c3_date", "wage"], include_zero=["wage"])
    out = encode.null_flags(out, ["hearing_date_raw"], present=True)
    return out.select("claim_id", "c3_date_nabinary", "wage_nabinary", "hearing_date_raw_nabinary")


@query("one_hot_label", on_split("SELECT claim_id, " + ", ".join(f"(claim_type = '{c}')::INT::DOUBLE AS class_{i}" for i, c in enumerate(CLASSES)) + " FROM split_claims"))
def one_hot_label(spark, sf):
    names = [f"class_{i}" for i in range(len(CLASSES))]
    return _fitted(encode.one_hot_label("claim_type", names), spark, sf, "claim_id", *names)


# Derived features


@query(
    "days_between",
    on_claims(
        "SELECT claim_id, CAST(datediff('day', accident_date, assembly_date) AS INT) AS days_between_assembly_date_accident_date, "
        "CAST(datediff('day', accident_date, c2_date) AS INT) AS days_to_c2 FROM claims"
    ),
)
def days_between(spark, sf):
    out = features.add_days_between(claims(spark, sf), "accident_date", "assembly_date")
    out = features.add_days_between(out, "accident_date", "c2_date", into="days_to_c2")
    return out.select("claim_id", "days_between_assembly_date_accident_date", "days_to_c2")


@query(
    "log_feature",
    on_claims(
        "SELECT claim_id, CASE WHEN gap < 0 THEN 0 ELSE gap END AS gap, round(ln(CASE WHEN gap < 0 THEN 0 ELSE gap END + 2), 6) AS gap_log, "
        "round(ln(wage + 2) / ln(10), 6) AS wage_log FROM (SELECT *, CAST(datediff('day', accident_date, assembly_date) AS INT) AS gap FROM claims)"
    ),
)
def log_feature(spark, sf):
    out = features.add_days_between(claims(spark, sf), "accident_date", "assembly_date", into="gap")
    out = features.add_log(features.add_log(out, "gap"), "wage", base=10.0)
    return _rounded(out.select("claim_id", "gap", "gap_log", "wage_log"), "gap_log", "wage_log")


@query(
    "numeric_functions",
    on_claims(
        "SELECT claim_id, round(ln(1 + wage), 6) AS wage_log1p, round(exp(ln(1 + wage)) - 1, 4) AS wage_back, round(sqrt(wage), 6) AS wage_sqrt, "
        "abs(age - 40) AS age_distance, round(exp(age / 100.0::DOUBLE), 6) AS age_exp, round(wage, 1) AS wage_rounded FROM claims"
    ),
)
def numeric_functions(spark, sf):
    return claims(spark, sf).select(
        "claim_id",
        F.round(F.log1p("wage"), 6).alias("wage_log1p"),
        F.round(F.expm1(F.log1p("wage")), 4).alias("wage_back"),
        F.round(F.sqrt("wage"), 6).alias("wage_sqrt"),
        F.abs(F.col("age") - 40).alias("age_distance"),
        F.round(F.exp(F.col("age") / 100.0), 6).alias("age_exp"),
        F.round("wage", 1).alias("wage_rounded"),
    )


SEASON = "CASE WHEN month(accident_date) IN (12, 1, 2) THEN {} WHEN month(accident_date) < 6 THEN {} WHEN month(accident_date) < 9 THEN {} WHEN month(accident_date) < 12 THEN {} END"


@query(
    "season",
    on_claims(f"SELECT claim_id, {SEASON.format(*map(repr, ('Winter', 'Spring', 'Summer', 'Fall')))} AS accident_date_season, CAST({SEASON.format(1, 2, 3, 4)} AS INT) AS season_no FROM claims"),
)
def season(spark, sf):
    df = claims(spark, sf)
    numbered = features.add_season(df, "accident_date", named=False).withColumnRenamed("accident_date_season", "season_no")
    return features.add_season(numbered, "accident_date").select("claim_id", "accident_date_season", "season_no")


@query(
    "date_parts",
    on_claims(
        "SELECT claim_id, CAST(isodow(accident_date) - 1 AS INT) AS accident_date_day_of_week, CAST(month(accident_date) AS INT) AS accident_datemonth, "
        "CAST(year(accident_date) AS INT) AS accident_dateyear FROM claims"
    ),
)
def date_parts(spark, sf):
    out = features.add_date_parts(claims(spark, sf), "accident_date")
    return out.select("claim_id", "accident_date_day_of_week", "accident_datemonth", "accident_dateyear")


@query(
    "income_class",
    on_split(
        "SELECT claim_id, CASE WHEN wage IS NULL THEN 'Unknown' WHEN wage <= a THEN 'Low Income' WHEN wage <= b THEN 'Middle Class' ELSE 'Wealthy' END AS income_class FROM split_claims, f",
        f="SELECT quantile_cont(wage, 0.25) AS a, quantile_cont(wage, 0.85) AS b FROM train",
    ),
)
def income_class(spark, sf):
    return _fitted(features.IncomeClass(), spark, sf, "claim_id", "income_class")


@query(
    "fixed_bins",
    on_claims("SELECT claim_id, CASE WHEN age > 0 AND age <= 29 THEN 'Young Workforce' WHEN age > 29 AND age <= 50 THEN 'Middle-Age' WHEN age > 50 AND age <= 1000 THEN 'Older' END AS age_group FROM claims"),
)
def fixed_bins(spark, sf):
    out = features.add_bins(claims(spark, sf), "age", "age_group", [0, 29, 50, 1000], ["Young Workforce", "Middle-Age", "Older"])
    return out.select("claim_id", "age_group")


@query("row_minimum", on_claims("SELECT claim_id, least(accident_date, assembly_date, c2_date) AS first_date FROM claims"))
def row_minimum(spark, sf):
    return features.add_row_minimum(claims(spark, sf), ["accident_date", "assembly_date", "c2_date"], "first_date").select("claim_id", "first_date")


@query(
    "clip_column",
    on_claims("SELECT claim_id, CAST(CASE WHEN age < 14 THEN 14 WHEN age > 83 THEN 83 ELSE age END AS INT) AS age FROM claims"),
)
def clip_column(spark, sf):
    return features.clip_column(claims(spark, sf), "age", 14, 83).select("claim_id", "age")


# Scaling


@query(
    "min_max_scaler",
    on_split(
        "SELECT claim_id, round((age - a0) / (a1 - a0)::DOUBLE, 6) AS age, round((wage - w0) / (w1 - w0), 6) AS wage FROM split_claims, f",
        f="SELECT min(age) AS a0, max(age) AS a1, min(wage) AS w0, max(wage) AS w1 FROM train",
    ),
)
def min_max_scaler(spark, sf):
    return _rounded(_fitted(scale.MinMaxScaler(columns=["age", "wage"]), spark, sf, "claim_id", "age", "wage"), "age", "wage")


@query(
    "standard_scaler",
    on_split(
        "SELECT claim_id, round((age - am) / s1, 6) AS age, round((wage - wm) / s2, 6) AS wage FROM split_claims, f",
        f="SELECT avg(age) AS am, stddev_pop(age) AS s1, avg(wage) AS wm, stddev_pop(wage) AS s2 FROM train",
    ),
)
def standard_scaler(spark, sf):
    return _rounded(_fitted(scale.StandardScaler(columns=["age", "wage"]), spark, sf, "claim_id", "age", "wage"), "age", "wage")


VARIED = ["age", "wage", "ime4_count", "dependents", "birth_year"]


@query(
    "variance_ranking",
    on_split("\nUNION ALL ".join(f"SELECT '{c}' AS feature, round(ln(var_samp({c})), 6) AS log_variance FROM train" for c in VARIED)),
)
def variance_ranking(spark, sf):
    out = scale.variance_ranking(split_claims(spark, sf).filter("split = 'train'"), VARIED)
    return out.select("feature", F.round(F.ln("variance"), 6).alias("log_variance"))

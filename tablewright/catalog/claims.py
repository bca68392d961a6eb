"""A table of insurance claims derived from the order tables.

It has the shape of a raw claims file: dates out of order, zeros and codes that stand
for "missing", nulls, a skewed label. The same SQL text runs on Spark and as the
first CTE of the SQL twins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablewright.catalog.registry import table
from tablewright.operators.sample import stratified_split
from tablewright.session import cut_lineage

TABLES = ("orders", "customer", "nation", "region", "lineitem", "part")

CLAIMS = """
SELECT o.o_orderkey AS claim_id,
 CASE WHEN o.o_orderkey % 97 = 0 THEN NULL ELSE CAST(o.o_orderdate AS DATE) END AS accident_date,
 CAST(l.first_ship AS DATE) AS assembly_date,
 CASE WHEN o.o_orderkey % 11 = 0 THEN NULL ELSE CAST(l.last_ship AS DATE) END AS c2_date,
 CASE WHEN o.o_orderkey % 3 <> 0 THEN NULL ELSE CAST(l.last_ship AS DATE) END AS c3_date,
 CASE WHEN o.o_orderkey % 41 = 0 THEN '2020-02-31' WHEN o.o_orderkey % 4 <> 0 THEN NULL
      ELSE substr(CAST(CAST(l.last_ship AS DATE) AS VARCHAR(10)), 1, 10) END AS hearing_date_raw,
 CASE WHEN o.o_orderkey % 37 = 0 THEN NULL WHEN o.o_orderkey % 43 = 0 THEN 0 ELSE CAST(8 + o.o_custkey % 85 AS INT) END AS age,
 CASE WHEN o.o_orderkey % 9 = 0 THEN NULL WHEN o.o_orderkey % 31 = 0 THEN 0
      ELSE CAST(year(o.o_orderdate) - (8 + o.o_custkey % 85) + CASE WHEN o.o_orderkey % 29 = 0 THEN 1 ELSE 0 END AS INT) END AS birth_year,
 CASE WHEN o.o_orderkey % 2 = 0 THEN 0.0 WHEN o.o_orderkey % 7 = 0 THEN NULL WHEN o.o_orderkey % 501 = 0 THEN o.o_totalprice * 100 ELSE o.o_totalprice / 100 END AS wage,
 CASE WHEN o.o_orderkey % 5 <> 0 THEN NULL ELSE CAST(l.n_lines * 3 AS INT) END AS ime4_count,
 CAST(o.o_orderkey % 7 AS INT) AS dependents,
 CASE WHEN o.o_orderkey % 53 = 0 THEN 'X' WHEN o.o_orderkey % 47 = 0 THEN 'U' WHEN o.o_custkey % 3 = 0 THEN 'F' ELSE 'M' END AS gender,
 CASE WHEN o.o_orderkey % 6 = 0 THEN 'Y' ELSE 'N' END AS covid_flag,
 CASE WHEN o.o_orderkey % 59 = 0 THEN 'U' WHEN o.o_orderkey % 61 = 0 THEN 'Y' ELSE 'N' END AS adr_flag,
 CASE WHEN o.o_custkey % 5 < 2 THEN 'Y' ELSE 'N' END AS attorney_flag,
 CASE WHEN o.o_orderkey % 13 = 0 THEN NULL ELSE c.c_mktsegment END AS industry,
 CASE WHEN o.o_orderkey % 17 = 0 THEN 'UNKNOWN' ELSE l.first_type END AS carrier_type,
 c.c_name AS carrier_name,
 CASE WHEN o.o_orderkey % 100 IN (0, 19) THEN NULL WHEN n.n_nationkey = 24 THEN -9 ELSE n.n_nationkey END AS body_code,
 CASE WHEN o.o_orderkey % 100 IN (0, 19, 23) THEN NULL ELSE n.n_name END AS body_desc,
 CASE WHEN o.o_orderkey % 100 IN (0, 21) THEN NULL ELSE n.n_regionkey END AS cause_code,
 CASE WHEN o.o_orderkey % 100 IN (0, 21, 27) THEN NULL ELSE r.r_name END AS cause_desc,
 o.o_orderstatus AS district,
 CASE WHEN o.o_orderkey % 211 = 0 THEN NULL WHEN o.o_orderkey % 100 < 51 THEN '2. NON-COMP'
      WHEN o.o_totalprice > 400000 THEN '4. TEMPORARY' WHEN o.o_totalprice > 150000 THEN '3. MED ONLY'
      WHEN o.o_totalprice > 60000 THEN '5. PPD SCH LOSS' WHEN o.o_totalprice > 20000 THEN '1. CANCELLED' ELSE '8. DEATH' END AS claim_type
FROM {orders} o
JOIN {customer} c ON o.o_custkey = c.c_custkey
JOIN {nation} n ON c.c_nationkey = n.n_nationkey
JOIN {region} r ON n.n_regionkey = r.r_regionkey
JOIN (SELECT l_orderkey, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship, count(*) AS n_lines, min(p_type) AS first_type
      FROM {lineitem} JOIN {part} ON l_partkey = p_partkey GROUP BY l_orderkey) l ON o.o_orderkey = l.l_orderkey
"""

CLAIMS_SQL = CLAIMS.format(**{t: t for t in TABLES})

SPLIT_SQL = """
SELECT * EXCLUDE (split_rank, class_size),
       CASE WHEN split_rank <= round(0.7 * class_size) THEN 'train' ELSE 'val' END AS split
FROM (SELECT *, row_number() OVER (PARTITION BY claim_type ORDER BY md5(CAST(claim_id AS VARCHAR) || ':0'), claim_id) AS split_rank,
             count(*) OVER (PARTITION BY claim_type) AS class_size
      FROM claims WHERE claim_type IS NOT NULL)
"""


def claims(spark: SparkSession, sf_dir: str, **replaced: DataFrame) -> DataFrame:
    """The claims view; a keyword replaces one of the base tables (say, by a stream)."""
    base = {t: replaced.get(t) if t in replaced else table(spark, sf_dir, t) for t in TABLES}
    return spark.sql(CLAIMS, **base)


def split_claims(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Labelled claims with a ``split`` column: 70 % of every class is 'train'.

    The view is written once: split, fit and result each read a few of its columns
    instead of joining the base tables again. With ``columns``, only ``claim_id``, ``claim_type`` and these
    are worked out and written; the rows are the same.
    """
    labelled = claims(spark, sf_dir).filter("claim_type IS NOT NULL")
    labelled = cut_lineage(labelled.select(*dict.fromkeys(["claim_id", "claim_type", *columns])) if columns else labelled)
    return split_of(labelled)


def split_of(view: DataFrame) -> DataFrame:
    """The labelled rows of the claims view with their ``split``."""
    return stratified_split(view.filter("claim_type IS NOT NULL"), "claim_type", "claim_id", {"train": 0.7}, rest="val")


def on_claims(select: str, **ctes: str) -> str:
    """SQL over ``claims`` with further CTEs."""
    return _with({"claims": CLAIMS_SQL, **ctes}, select)


def on_split(select: str, **ctes: str) -> str:
    """SQL over ``claims``, ``split_claims`` and ``train`` with further CTEs."""
    base = {"claims": CLAIMS_SQL, "split_claims": SPLIT_SQL, "train": "SELECT * FROM split_claims WHERE split = 'train'"}
    return _with({**base, **ctes}, select)


def _with(ctes: dict[str, str], select: str) -> str:
    return "WITH " + ",\n".join(f"{n} AS ({q})" for n, q in ctes.items()) + "\n" + select

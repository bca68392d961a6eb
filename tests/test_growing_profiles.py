"""Merged partial states equal the reports of the whole table."""

import pytest
from pyspark.sql import functions as F

from tablewright.operators import growing, profile

SCHEMA = "day string, x double, n int, kind string"
NUMERIC, TEXT = ["x", "n"], ["kind", "n"]


def rows_of(day, size, shift=0):
    return [(day, None if i % 7 == 0 else 1e6 + (i * 37 % 101) / 8 + shift, i % 4, None if i % 5 == 0 else f"k{i % 3 + shift}") for i in range(size)]


def equal(spark, path, df):
    def table_of(frame):
        return {r["column_name"]: {k: v for k, v in r.asDict().items() if k != "column_name"} for r in frame.collect()}

    merged, whole = table_of(growing.merged_numeric(spark, path, NUMERIC)), table_of(profile.numeric_summary(df, NUMERIC))
    assert merged.keys() == whole.keys()
    for c in merged:
        assert merged[c] == pytest.approx(whole[c], rel=1e-9)
    assert table_of(growing.merged_categorical(spark, path, TEXT)) == table_of(profile.categorical_summary(df, TEXT))
    assert growing.merged_missing(spark, path).collect() == profile.missing_report(df, ["x", "n", "kind"]).collect()
    counts = [tuple(r) for r in growing.merged_value_counts(spark, path, "kind").collect()]
    assert counts == [tuple(r) for r in profile.value_counts(df, "kind").collect()]


def test_merged_reports_equal_full_ones_and_days_replace_themselves(spark, tmp_path):
    path = str(tmp_path / "state")
    days = {"d1": rows_of("d1", 60), "d2": rows_of("d2", 33, 2), "d3": rows_of("d3", 1, 5)}
    frame = lambda: spark.createDataFrame([r for rows in days.values() for r in rows], SCHEMA).repartition(3)
    growing.refresh(frame(), path, F.col("day"), ["d1"], NUMERIC, TEXT)
    growing.refresh(frame(), path, F.col("day"), ["d2", "d3"], NUMERIC, TEXT)
    equal(spark, path, frame())
    # The second day was corrected, the third one is gone; the first is not read again.
    days["d2"], days["d3"] = rows_of("d2", 50, 9), []
    later = frame().filter("day <> 'd1'")
    growing.refresh(later, path, F.col("day"), ["d2", "d3"], NUMERIC, TEXT)
    equal(spark, path, frame())


def test_columns_without_values_and_empty_tables(spark, tmp_path):
    path = str(tmp_path / "state")
    growing.refresh(spark.createDataFrame([], SCHEMA), path, F.col("day"), ["d1"], NUMERIC, TEXT)
    assert growing.merged_numeric(spark, path, NUMERIC).count() == 0 and growing.merged_missing(spark, path).count() == 0
    growing.refresh(spark.createDataFrame([("d1", None, 3, None), (None, 1.0, 1, "x")], SCHEMA), path, F.col("day"), ["d1"], NUMERIC, TEXT)
    found = {r["column_name"]: r for r in growing.merged_numeric(spark, path, NUMERIC).collect()}
    assert found["x"]["n_known"] == 0 and found["x"]["mean"] is None and found["x"]["median"] is None
    assert found["n"]["median"] == 3 and found["n"]["std"] is None

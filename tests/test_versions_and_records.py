"""Versions are seen whole or not at all; arriving records reach one sink, once, also after a failure."""

import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from tablewright.operators.base import Step
from tablewright.plans import versions
from tablewright.plans.preparation import Preparation
from tablewright.sources.tables import RecordContract
from tablewright.streaming import records

CONTRACT = RecordContract({"id": "long", "age": "int", "sex": "string", "zip": "string"}, {"sex": ["F", "M"]})
ROWS = [("1", "30", "F"), ("2", "x", "M"), ("3", "7", "Z"), ("4", None, None), ("5", "12", "F"), (None, "40", "M"), ("1", "30", "F")]


def prepared(spark, columns):
    df = spark.createDataFrame([(0, 1)], "age int, year int")
    return Preparation([Pipeline(stages=[Step("zero_to_null", column=c)]).fit(df) for c in columns], columns)


def test_a_broken_save_leaves_the_version_before(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "prepared")
    with pytest.raises(FileNotFoundError):
        Preparation.load(path, spark)
    prepared(spark, ["age", "year"]).save(path, spark)
    assert Preparation.load(path, spark).classes == ["age", "year"]
    broken = prepared(spark, ["year", "age"])
    broken.models[1] = None  # the second of two pipelines cannot be written
    with pytest.raises(AttributeError):
        broken.save(path, spark)
    loaded = Preparation.load(path, spark)
    assert loaded.classes == ["age", "year"] and len(loaded.models) == 2
    prepared(spark, ["year"]).save(path, spark)
    assert Preparation.load(path, spark).classes == ["year"]
    assert versions.drop_versions(spark, path) == 1 and Preparation.load(path, spark).classes == ["year"]
    row = Preparation.load(path, spark).transform(spark.createDataFrame([(0, 0)], "age int, year int")).first()
    assert row["age"] == 0 and row["year"] is None


def arrive(spark, folder, rows):
    spark.createDataFrame(rows, "id string, age string, sex string").coalesce(1).write.mode("append").parquet(folder)


def stream_of(spark, folder):
    arriving = spark.readStream.schema("id string, age string, sex string").parquet(folder)
    return records.with_reasons(arriving, CONTRACT, {"under age": F.col("age") < 14})


def sinks(spark, path):
    accepted = sorted(records.read_sink(spark, path, "accepted", CONTRACT).collect(), key=str)
    rejected = {r["id"]: r["reasons"] for r in records.read_sink(spark, path, "rejected", CONTRACT).collect()}
    return [(r["id"], r["age"], r["sex"], r["zip"]) for r in accepted], rejected


ACCEPTED = [(1, 30, "F", None), (1, 30, "F", None), (4, None, None, None), (None, 40, "M", None)]
REJECTED = {2: ["unreadable age"], 3: ["illegal sex", "under age"], 5: ["under age"]}


def test_a_restart_neither_loses_nor_doubles_records(spark, tmp_path, monkeypatch):
    arrived, path, progress = (str(tmp_path / n) for n in ("arrived", "parted", "progress"))
    arrive(spark, arrived, ROWS)
    assert sinks(spark, path) == ([], {})

    def fail(*_):
        raise RuntimeError("lost after both sinks, before the batch is published")

    monkeypatch.setattr(records, "publish", fail)
    with pytest.raises(Exception, match="lost after both sinks"):
        records.write_parted(stream_of(spark, arrived), path, progress).awaitTermination()
    assert sinks(spark, path) == ([], {})  # written, but not published
    monkeypatch.undo()
    records.write_parted(stream_of(spark, arrived), path, progress).awaitTermination()
    accepted, rejected = sinks(spark, path)
    assert sorted(accepted, key=str) == sorted(ACCEPTED, key=str) and rejected == REJECTED
    arrive(spark, arrived, [("9", "50", "M"), ("10", "50", "?")])
    records.write_parted(stream_of(spark, arrived), path, progress).awaitTermination()
    accepted, rejected = sinks(spark, path)
    assert len(accepted) == 5 and (9, 50, "M", None) in accepted and rejected == {**REJECTED, 10: ["illegal sex"]}


def test_a_batch_that_fails_between_the_sinks_is_repeated(spark, tmp_path, monkeypatch):
    arrived, path, progress = (str(tmp_path / n) for n in ("arrived", "parted", "progress"))
    arrive(spark, arrived, ROWS)
    # The second sink cannot be written: a file stands where its folder should be.
    (tmp_path / "parted").mkdir()
    blocked = tmp_path / "parted" / "rejected"
    blocked.write_text("")
    with pytest.raises(Exception):
        records.write_parted(stream_of(spark, arrived), path, progress).awaitTermination()
    assert (tmp_path / "parted" / "accepted" / "batch-0000000000").exists() and sinks(spark, path) == ([], {})
    blocked.unlink()
    records.write_parted(stream_of(spark, arrived), path, progress).awaitTermination()
    accepted, rejected = sinks(spark, path)
    assert sorted(accepted, key=str) == sorted(ACCEPTED, key=str) and rejected == REJECTED


def test_reasons_on_awkward_records(spark):
    empty = spark.createDataFrame([], "id string, age string, sex string")
    assert records.with_reasons(empty, CONTRACT).columns == [*CONTRACT.types, "reasons"]
    assert records.with_reasons(empty, CONTRACT).count() == 0
    extra = spark.createDataFrame([("1", "2", "M", "kept out", ["x"])], "id string, age string, sex string, note string, reasons array<string>")
    row = records.with_reasons(extra, CONTRACT, {"always": F.lit(True)}).first()
    assert row["reasons"] == ["always"] and row.asDict().keys() == {*CONTRACT.types, "reasons"}

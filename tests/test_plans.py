"""The scale helpers against brute force, with their large paths forced."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.functions.hashing import hash_order, hash_uniform
from tablewright.operators.impute import group_medians
from tablewright.operators import encode
from tablewright.plans.lookup import WEIGHT, FittedTable, attach
from tablewright.plans.prefix import running_sums
from tablewright.plans.quantiles import exact_quantiles
from tablewright.plans.rank_cut import hash_cut


def skewed(spark, n=6000):
    """Keys 0..n-1; a third of the rows share one value and one class."""
    return spark.range(n).select(
        F.col("id").alias("key"),
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("c"), (F.col("id") % 40).cast("string"))).alias("cls"),
        F.when(F.col("id") % 3 == 0, F.lit(7.0)).when(F.col("id") % 11 == 0, F.lit(None)).otherwise(hash_uniform(F.col("id"), "v") * 1000).alias("value"),
    )


@pytest.mark.parametrize("want", [0, 1, 5, 100, 10_000])
def test_hash_cut_takes_the_first_rows_of_every_class(spark, want):
    df = skewed(spark)
    got = df.filter(hash_cut(df, "key", {"t": F.lit(want)}, by=["cls"], seed="s")["t"]).toPandas()
    pdf = df.withColumn("h", hash_order(F.col("key"), "s")).toPandas().sort_values(["h", "key"])
    expected = pdf.groupby("cls").head(want)
    assert set(got["key"]) == set(expected["key"])


def test_hash_cut_null_class_and_no_class(spark):
    df = spark.range(50).select(F.col("id").alias("key"), F.when(F.col("id") < 20, "a").alias("cls"))
    got = df.filter(hash_cut(df, "key", {"t": F.lit(3)}, by=["cls"])["t"]).groupBy("cls").count().collect()
    assert {r["cls"]: r["count"] for r in got} == {"a": 3, None: 3}
    assert df.filter(hash_cut(df, "key", {"t": F.lit(7)})["t"]).count() == 7
    assert df.filter(hash_cut(df, "key", {"t": F.lit(700)})["t"]).count() == 50


def test_split_is_disjoint_complete_and_proportional(spark):
    from tablewright.operators.sample import stratified_split

    df = skewed(spark)
    out = stratified_split(df, "cls", "key", {"train": 0.6, "val": 0.3}, rest="test").toPandas()
    assert len(out) == 6000 and out["key"].is_unique
    shares = out.groupby(["cls", "split"]).size().unstack(fill_value=0)
    total = shares.sum(axis=1)
    assert ((shares["train"] - 0.6 * total).abs() <= 1).all() and ((shares["val"] - 0.3 * total).abs() <= 1).all()


@pytest.mark.parametrize("limit", [0, 5, 200, 1_000_000])
def test_quantiles_by_narrowing_equal_sorting(spark, limit):
    df = skewed(spark)
    qs = [0.0, 0.001, 0.25, 0.3333, 0.5, 0.9, 0.999, 1.0]
    wanted = {"v": (F.col("value"), qs), "k": (F.col("key"), qs), "none": (F.lit(None).cast("double"), [0.5])}
    got = exact_quantiles(df, wanted, max_distinct=limit, accuracy=100)
    pdf = df.toPandas()
    assert np.allclose(got["v"], np.quantile(pdf["value"].dropna(), qs))
    assert np.allclose(got["k"], np.quantile(pdf["key"], qs))
    assert got["none"] == [None]


def test_running_sums_equal_cumsum(spark):
    counts = skewed(spark).filter("value is not null").groupBy("value").agg(F.count("*").alias("n"))
    got = running_sums(counts, [F.desc("value")], ["n"], ranges=5).toPandas().sort_values("value", ascending=False)
    assert (got["n_upto"].to_numpy() == got["n"].cumsum().to_numpy()).all()


@pytest.fixture
def no_broadcast(spark):
    """Every fitted table counts as large."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def keyed_stats(df):
    return df.filter("cls is not null").groupBy("cls").agg(F.avg("value").alias("m"), F.count("*").alias(WEIGHT))


@pytest.mark.parametrize("large", [False, True])
def test_attach_by_broadcast_and_by_shuffle_agree(spark, large, request):
    if large:
        request.getfixturevalue("no_broadcast")
    df = skewed(spark).withColumn("cls", F.when(F.col("key") % 5 > 0, F.col("cls")))
    table = FittedTable.of(keyed_stats(df))
    assert bool(table.hot) == large
    got = attach(df, table, {"cls": "cls"}).toPandas().sort_values("key")
    assert got["key"].tolist() == list(range(6000))
    pdf = df.toPandas()
    means = pdf.dropna(subset=["cls"]).groupby("cls")["value"].mean()
    assert np.allclose(got["m"], pdf["cls"].map(means), equal_nan=True)


def test_hot_and_null_keys_are_spread(spark, no_broadcast):
    """A third of the rows with one key and a third without: no join partition holds much more than its share."""
    df = spark.range(30_000).select(
        F.col("id").alias("key"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.concat(F.lit("c"), (F.col("id") % 997).cast("string"))).alias("cls"), F.lit(1.0).alias("value")
    )
    width = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = attach(df, FittedTable.of(keyed_stats(df)), {"cls": "cls"})
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", width)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 30_000 and max(sizes) < 2.5 * 30_000 / 16


def leaves(df):
    return df._jdf.queryExecution().optimizedPlan().collectLeaves().size()


def test_plan_grows_by_a_constant_per_column(spark, no_broadcast):
    df = spark.range(300).select("id", *[(F.col("id") % (7 + i)).cast("string").alias(f"c{i}") for i in range(5)])
    sizes = []
    for n in (1, 2, 5):
        columns = [f"c{i}" for i in range(n)]
        sizes.append(leaves(encode.FrequencyEncoder(columns=columns).fit(df).transform(df)))
    assert sizes == [2, 3, 6]


def test_large_encoder_scores_a_stream(spark, no_broadcast, tmp_path):
    df = spark.range(500).select("id", F.when(F.col("id") % 3 > 0, (F.col("id") % 40).cast("string")).alias("a"), F.lit("same").alias("b"))
    model = encode.FrequencyEncoder(columns=["a", "b"]).fit(df)
    df.write.parquet(str(tmp_path / "rows"))
    stream = model.transform(spark.readStream.schema(df.schema).parquet(str(tmp_path / "rows")))
    query = stream.writeStream.format("memory").queryName("encoded").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(str, spark.table("encoded").collect())) == sorted(map(str, model.transform(df).collect()))


def test_group_medians_with_a_hot_group(spark):
    df = skewed(spark)
    got = {r["cls"]: r["fitted_value"] for r in group_medians(df, "cls", "value").collect()}
    expected = df.toPandas().groupby("cls")["value"].median().to_dict()
    assert got == pytest.approx(expected)

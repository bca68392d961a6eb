"""Small literal cases for the rules that are easy to get wrong."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright import catalog
from tablewright.catalog import claims
from tablewright.functions import expressions as ex
from tablewright.operators import cascade, clean, encode, features, impute, metrics, models, neighbors, outliers, rules, select
from tablewright.plans import lookup
from tablewright.sources import tables


def column(df, name):
    return [r[name] for r in df.orderBy("i").collect()]


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 25.0), (3, None), (4, -3.0)], "i int, x double")
    assert column(df.withColumn("x", ex.clip(F.col("x"), 0.0, 20.0)), "x") == [5.0, 20.0, None, 0.0]


def test_shifted_log_clamps_and_adds_two(spark):
    df = spark.createDataFrame([(1, -4.0), (2, 0.0), (3, 98.0), (4, None)], "i int, x double")
    got = column(features.add_log(df, "x"), "x_log")
    assert got[:3] == pytest.approx([math.log(2), math.log(2), math.log(100)]) and got[3] is None
    assert column(features.add_log(df, "x"), "x") == [0.0, 0.0, 98.0, None]


def test_bins_are_right_closed(spark):
    df = spark.createDataFrame([(1, 0), (2, 29), (3, 30), (4, 50), (5, 1000), (6, 1001), (7, None)], "i int, x int")
    assert column(df.withColumn("b", ex.binned(F.col("x"), [0, 29, 50, 1000], ["a", "b", "c"])), "b") == [None, "a", "b", "b", "c", None, None]


def test_season_starts_in_december_and_null_stays_null(spark):
    df = spark.createDataFrame([(1, "2020-12-01"), (2, "2020-02-29"), (3, "2020-03-01"), (4, "2020-11-30"), (5, None)], "i int, d string")
    df = df.withColumn("d", F.to_date("d"))
    assert column(features.add_season(df, "d"), "d_season") == ["Winter", "Winter", "Spring", "Fall", None]
    assert column(features.add_season(df, "d", named=False), "d_season") == [1, 1, 2, 4, None]


def test_days_between_rounds_down(spark):
    df = spark.sql("select 1 i, timestamp_ntz'2020-01-02 12:00:00' a, date'2020-01-02' b union all select 2, timestamp_ntz'2020-01-01 00:00:00', date'2020-01-03'")
    assert column(features.add_days_between(df, "a", "b", into="d"), "d") == [-1, 2]


def test_earliest_date_and_swap_differ(spark):
    df = spark.sql("select 1 i, date'2020-05-01' a, date'2020-01-01' b union all select 2, cast(null as date), date'2020-01-01'")
    first = rules.earliest_date(df, "a", ["b"])
    assert [str(x) for x in column(first, "a")] == ["2020-01-01", "2020-01-01"] and [str(x) for x in column(first, "b")] == ["2020-01-01"] * 2
    swapped = rules.swap_dates(df, "a", "b")
    assert [str(x) for x in column(swapped, "a")] == ["2020-01-01", "None"] and [str(x) for x in column(swapped, "b")] == ["2020-05-01", "2020-01-01"]


def test_age_mismatch_is_false_for_null(spark):
    df = spark.sql("select 1 i, 30 age, 1990 b, date'2020-06-01' d union all select 2, 30, 1985, date'2020-06-01' union all select 3, cast(null as int), 1990, date'2020-06-01'")
    assert column(rules.lower_mismatched_age(df, "age", "b", "d"), "age") == [30, 29, None]


def test_mode_ties_take_the_smallest_and_unknown_groups_stay_null(spark):
    train = spark.createDataFrame([(1, "g", "b"), (2, "g", "a"), (3, "h", None), (4, None, "z")], "i int, g string, v string")
    rows = spark.createDataFrame([(1, "g", None), (2, "h", None), (3, "new", None), (4, None, None), (5, "g", "kept")], "i int, g string, v string")
    model = impute.GroupModeFill(group="g", column="v").fit(train)
    assert column(model.transform(rows), "v") == ["a", None, None, None, "kept"]
    fallback = impute.GroupStatisticFill(column="v", group="g").fit(train)
    assert column(fallback.transform(rows), "v") == ["a", "a", "a", "a", "kept"]


def test_repeated_code_takes_the_description_of_the_largest_key(spark):
    train = spark.createDataFrame([(1, 7, "old"), (2, 7, "new"), (3, 8, None)], "i int, c int, d string")
    rows = spark.createDataFrame([(1, 7, None), (2, 8, None), (3, 7, "mine")], "i int, c int, d string")
    model = impute.DescriptionFromCode(code="c", description="d", key="i").fit(train)
    assert column(model.transform(rows), "d") == ["new", None, "mine"]


def test_proportional_fill_keeps_known_values_and_can_be_repeated(spark):
    df = spark.range(4000).select(F.col("id").alias("claim_id"), F.when(F.col("id") % 4 > 0, F.concat(F.lit("v"), (F.col("id") % 7).cast("string"))).alias("c"))
    got = {r["claim_id"]: r["c"] for r in impute.ProportionalFill(column="c").fit(df).transform(df).collect()}
    assert len(got) == 4000 and None not in got.values()
    known = {r["claim_id"]: r["c"] for r in df.filter("c is not null").collect()}
    assert all(got[k] == v for k, v in known.items())
    again = {r["claim_id"]: r["c"] for r in impute.ProportionalFill(column="c").fit(df).transform(df.repartition(7)).collect()}
    assert again == got


def cell_masses(rows, k):
    """Share of every value over all cells."""
    out = {}
    for r in rows:
        out[r["fitted_value"]] = out.get(r["fitted_value"], 0) + r["fitted_share"] / k
        out[r["fitted_other"]] = out.get(r["fitted_other"], 0) + (1 - r["fitted_share"]) / k
    return out


@pytest.mark.parametrize("counts", [[5], [1, 1, 1], [7, 1, 1, 1, 1, 1, 2, 30, 3], [1000, 1, 1000, 1, 1, 998], list(range(1, 60)), [1] * 20 + [400, 3, 3, 41]])
def test_cells_hold_the_distribution(counts):
    random.Random(sum(counts)).shuffle(counts)
    rows = [dict(zip(("cell", "fitted_value", "fitted_other", "fitted_share"), r)) for r in impute._cells_on_driver(list(enumerate(counts)))]
    assert sorted(r["cell"] for r in rows) == list(range(len(counts)))
    assert all(0 < r["fitted_share"] <= 1 for r in rows)
    masses = cell_masses(rows, len(counts))
    assert all(masses[i] == pytest.approx(n / sum(counts), abs=1e-12) for i, n in enumerate(counts))


@pytest.mark.parametrize("counts", [[1000, 1, 1000, 1, 1, 998, 7, 7], [1] * 20 + [400, 3, 3, 41]])
def test_cells_of_long_lists_are_those_of_short_ones(spark, monkeypatch, counts):
    monkeypatch.setattr(impute, "SHORT_LIST", 0)
    k, table = impute.alias_cells(spark.createDataFrame(list(enumerate(counts)), "value int, n long"))
    assert k == len(counts)
    assert sorted(map(tuple, table.df.collect())) == sorted(impute._cells_on_driver(list(enumerate(counts))))


def test_drawn_shares_are_those_of_the_training_rows(spark):
    df = spark.range(60_000).select(F.col("id").alias("claim_id"), F.when(F.col("id") % 3 > 0, F.floor(F.sqrt(F.col("id") % 100))).alias("c"))
    filled = impute.ProportionalFill(column="c", into="d").fit(df).transform(df)
    shares = {r["d"]: (r["known"], r["drawn"]) for r in filled.groupBy("d").agg(F.count("c").alias("known"), F.count_if(F.col("c").isNull()).alias("drawn")).collect()}
    for known, drawn in shares.values():
        assert abs(drawn / 20_000 - known / 40_000) < 5 * (known / 40_000 / 20_000) ** 0.5


def test_five_fills_scan_the_rows_once(spark, tmp_path):
    rows = spark.range(500).select(F.col("id").alias("claim_id"), *[F.when(F.col("id") % 3 > 0, F.col("id") % (40 + i)).alias(f"c{i}") for i in range(5)])
    rows.write.parquet(str(tmp_path / "rows"))
    df = spark.read.parquet(str(tmp_path / "rows"))
    for i in range(5):
        df = impute.ProportionalFill(column=f"c{i}").fit(df).transform(df)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert len([line for line in plan.splitlines() if "Relation [claim_id#" in line]) == 1
    assert "Union" not in plan
    assert df.where(" or ".join(f"c{i} is null" for i in range(5))).count() == 0


def test_a_stream_is_filled_as_a_batch_is(spark, tmp_path):
    rows = spark.range(300).select(F.col("id").alias("claim_id"), F.when(F.col("id") % 3 > 0, F.col("id") % 40).alias("c"))
    rows.write.parquet(str(tmp_path / "rows"))
    model = impute.ProportionalFill(column="c").fit(rows)
    stream = model.transform(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "rows")))
    stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    got, want = spark.read.schema(rows.schema).parquet(str(tmp_path / "out")), model.transform(rows)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*rows.columns).collect()))


def test_fit_sees_training_rows_only(spark):
    rows = [(i, float(i), "train" if i < 50 else "val") for i in range(100)]
    df = spark.createDataFrame(rows, "i int, x double, split string")
    changed = df.withColumn("x", F.when(F.col("split") == "val", 1e9).otherwise(F.col("x")))
    for operator in (outliers.LogIqr(column="x"), outliers.IqrTrim(column="x"), features.IncomeClass(column="x"), outliers.BelowQuantile(column="x")):
        assert operator.fit(df).state() == operator.fit(changed).state()


def test_log_iqr_drops_in_training_and_caps_elsewhere(spark):
    values = [10.0, 11.0, 12.0, 13.0, 14.0, 9999.0, 0.0, None, -5.0]
    df = spark.createDataFrame([(i, v, s) for s in ("train", "val") for i, v in enumerate(values)], "i int, x double, split string")
    out = outliers.LogIqr(column="x").fit(df).transform(df)
    assert column(out.filter("split = 'train'"), "x") == [10.0, 11.0, 12.0, 13.0, 14.0, 0.0, None]
    val = column(out.filter("split = 'val'"), "x")
    assert len(val) == 9 and val[5] < 9999.0 and val[6:] == [0.0, None, -5.0]


def test_binary_encoder_refuses_three_values(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "i int, x string")
    with pytest.raises(ValueError):
        encode.BinaryEncoder(columns=["x"]).fit(df)
    with pytest.raises(ValueError):
        encode.BinaryEncoder(columns=["x"]).fit(df.filter("x = 'a'"))


def test_dummies_fail_or_give_zero_for_unseen(spark):
    train = spark.createDataFrame([(1, "a"), (2, "b")], "i int, x string")
    rows = spark.createDataFrame([(1, "z"), (2, None)], "i int, x string")
    assert column(encode.DummyEncoder(column="x", unseen="zero").fit(train).transform(rows), "x_b") == [0.0, 0.0]
    with pytest.raises(Exception, match="unseen value z"):
        encode.DummyEncoder(column="x").fit(train).transform(rows).collect()


def test_unseen_category_gets_prior_and_zero_count(spark):
    train = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "b", "x"), (4, None, "x")], "i int, c string, y string")
    rows = spark.createDataFrame([(1, "new"), (2, None)], "i int, c string")
    encoded = encode.TargetEncoder(columns=["c"], label="y").fit(train).transform(rows)
    assert column(encoded, "c_encoded_x") == [0.75, 0.75]
    assert column(encode.FrequencyEncoder(columns=["c"]).fit(train).transform(rows), "c_freq") == [0, 0]


def test_taxonomies_have_no_code_twice():
    for groups in encode.CODE_GROUPS.values():
        codes = [c for g in groups.values() for c in g]
        assert len(codes) == len(set(codes))


def test_near_duplicates_pass_by_pass(spark):
    df = spark.createDataFrame([(1, "a", "x", 1), (2, "a", "x", 2), (3, "a", "y", 2), (4, "b", "y", 2), (5, None, "q", 9), (6, None, "q", 9)], "k int, a string, b string, c int")
    got = sorted(r["k"] for r in clean.drop_near_duplicates(df, "k").collect())
    pdf = df.toPandas()
    for left_out in ("a", "b", "c"):
        pdf = pdf.sort_values("k").drop_duplicates(subset=[c for c in ("a", "b", "c") if c != left_out])
    assert got == sorted(pdf["k"])


def test_repeated_keys_leave_no_row(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "k int, v string")
    assert {r["v"] for r in clean.drop_repeated_keys(df, ["k"]).collect()} == {"c", "d"}


def test_contract_casts_and_reports(spark):
    df = spark.createDataFrame([("1", "x"), ("z", None)], "a string, b string")
    contract = tables.RecordContract({"a": "int", "b": "string", "c": "date"}, {"b": ["y"]})
    out = contract.breaches(contract.enforce(df)).collect()
    assert [(r["a"], r["illegal_b"]) for r in out] == [(1, True), (None, False)]
    assert contract.missing_columns(df) == ["c"]


@pytest.mark.parametrize("x,dof,p", [(3.841458820694124, 1, 0.05), (5.991464547107979, 2, 0.05), (11.070497693516351, 5, 0.05), (23.209251158954356, 10, 0.01), (0.0, 3, 1.0)])
def test_chi2_tail(x, dof, p):
    assert select._upper_tail(x, dof) == pytest.approx(p, rel=1e-9)


def test_vote_needs_three_methods(spark):
    votes = spark.createDataFrame([("m1", "a"), ("m2", "a"), ("m3", "a"), ("m3", "a"), ("m1", "b"), ("m2", "b")], "method string, feature string")
    assert [r["feature"] for r in select.vote(votes).collect()] == ["a"]
    matrix = {r["feature"]: (r["m1"], r["m3"], r["selected"]) for r in select.selection_matrix(votes, ["m1", "m2", "m3"]).collect()}
    assert matrix == {"a": (True, True, True), "b": (True, False, False)}


def test_stage_plan_removes_positives_for_good():
    groups = [["Hello"], ["How"], ["Are"], ["You", "?"]]
    words = ["Hello", "How", "Are", "You", "?", "Fine"]
    assert cascade.stage_plan(groups, words) == [
        (["Hello"], ["How", "Are", "You", "?", "Fine"]),
        (["How"], ["Are", "You", "?", "Fine"]),
        (["Are"], ["You", "?", "Fine"]),
        (["You", "?"], ["Fine"]),
    ]
    with pytest.raises(ValueError):
        cascade.binary_relabel("y", [])
    with pytest.raises(ValueError):
        cascade.broadcast_thresholds([0.1, 0.2], 3)


def test_cascade_equals_shrinking_the_rows_stage_by_stage(spark):
    rows = [(i, (i * 7 % 10) / 10, (i * 3 % 10) / 10, (i * 9 % 10) / 10) for i in range(40)]
    df = spark.createDataFrame(rows, "i int, s1 double, s2 double, s3 double")
    stages = [(F.col("s1"), 0.6, "A"), (F.col("s2"), 0.5, "B"), (F.col("s3"), 0.7, "C")]
    got = column(df.withColumn("p", cascade.decide(stages)), "p")
    expected, left = {}, list(rows)
    for at, (_, threshold, name) in enumerate(stages, start=1):
        expected |= {r[0]: name for r in left if r[at] > threshold}
        left = [r for r in left if not r[at] > threshold]
    expected |= {r[0]: cascade.PLACEHOLDER for r in left}
    assert got == [expected[i] for i in range(40)]


def test_report_counts_a_class_never_predicted_as_zero(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")], "y string, p string")
    rows = {r["class"]: r for r in metrics.classification_report(df, "y", "p").collect()}
    assert rows["c"]["precision"] == rows["c"]["recall"] == rows["c"]["f1"] == 0
    assert rows["accuracy"]["f1"] == 0.5 and rows["accuracy"]["precision"] is None
    assert rows["macro avg"]["f1"] == pytest.approx((0.5 + 2 / 3 + 0) / 3)


def test_auc_gives_half_for_ties(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1)], "y int, s double")
    assert metrics.roc_auc(df, "y", "s").first()["auc"] == pytest.approx(0.875)


def brute(points, k):
    out = {}
    for key, vec, _ in points:
        order = sorted((math.dist(vec, v), other) for other, v, _ in points if other != key)
        out[key] = order[:k]
    return out


@pytest.mark.parametrize("block,cell_rows", [(16, 30), (2048, 1000), (5, 6)])
def test_neighbours_equal_brute_force(spark, monkeypatch, block, cell_rows):
    monkeypatch.setattr(neighbors, "BLOCK", block)
    # A third of the points are copies of one point, the others lie on a coarse grid with ties.
    points = [(i, [0.0, 0.0] if i % 3 == 0 else [float(i * 13 % 17), float(i * 7 % 11)], i % 2) for i in range(240)]
    df = spark.createDataFrame(points, "row_key long, vec array<double>, label int")
    got: dict[int, list] = {}
    for r in neighbors.nearest(df, df, 4, ["label"], cell_rows=cell_rows).orderBy("row_key", "rank").collect():
        assert r["neighbor_label"] == r["neighbor_key"] % 2
        got.setdefault(r["row_key"], []).append((r["distance"], r["neighbor_key"]))
    expected = brute(points, 4)
    assert got.keys() == expected.keys()
    for key in expected:
        assert [n for _, n in got[key]] == [n for _, n in expected[key]]
        assert [d for d, _ in got[key]] == pytest.approx([d for d, _ in expected[key]])


def cloud(spark, n, dims, seed=1):
    rng = np.random.default_rng(seed)
    points = rng.random((n, dims))
    points[0] = 100.0  # one far outlier
    return spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "row_key long, vec array<double>")


@pytest.mark.parametrize("dims,most", [(2, 0.06), (4, 0.3)])
def test_rows_are_sent_to_few_cells(spark, dims, most):
    df = cloud(spark, 4_000, dims)
    tree, placed, blocks = neighbors.cell_tree(df, 4_000, 40)
    home = neighbors._in_cells(df, tree)
    kind = df.schema["row_key"].dataType
    first = neighbors._candidates(home, placed, blocks, 3, kind, kind)
    bounds = first.groupBy("row_key").agg(F.max(F.when(F.col("rank") == 3, F.col("distance"))).alias("bound"))
    sent = neighbors.cells_to_search(home.join(bounds, "row_key", "left"), tree).where("row_key <> 0")
    assert tree.n_cells >= 90 and sent.count() <= most * tree.n_cells * 4_000


def test_probes_trade_recall_for_cells(spark):
    df = cloud(spark, 1_500, 16)
    exact, one, some = ({(r["row_key"], r["neighbor_key"]) for r in neighbors.nearest(df, df, 5, cell_rows=50, probes=p).collect()} for p in (None, 1, 12))
    recall = [len(exact & x) / len(exact) for x in (one, some)]
    assert 0.1 < recall[0] < recall[1] and recall[1] > 0.75


def test_smote_reaches_the_ratio_and_stays_on_segments(spark):
    points = [(i, [float(i), float(i)], 1 if i < 6 else 0) for i in range(106)]
    df = spark.createDataFrame(points, "row_key long, vec array<double>, label int")
    out = neighbors.smote(df, "label", 1, ratio=0.25, k=3).collect()
    new = [r for r in out if "#" in r["row_key"]]
    assert len(out) == 106 + 19 and len(new) == 19 and len({r["row_key"] for r in out}) == len(out)
    assert all(r["label"] == 1 and 0 <= r["vec"][0] <= 5 and r["vec"][0] == pytest.approx(r["vec"][1]) for r in new)


def test_ridge_separates_two_clouds(spark):
    rows = [(i, float(i % 5), "a" if i % 2 else "b", 10.0 if i % 2 else -10.0) for i in range(60)]
    df = spark.createDataFrame(rows, "claim_id long, noise double, y string, x double")
    out = models.fit_predict(df, df, "ridge", ["x", "noise"], "y", "claim_id")
    assert out.filter("prediction <> y").count() == 0


def test_large_training_partitions_are_dealt_evenly(spark, monkeypatch):
    seen = []

    class Reader:
        def fit(self, data):
            seen.append([len(p) for p in data.rdd.glom().collect()] + [sorted(r["features"][0] for r in data.collect())])

    monkeypatch.setattr(models, "classifier", lambda *args, **kwargs: Reader())
    df = spark.range(1000).select(F.col("id").cast("double").alias("x"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("y")).coalesce(1)
    models.fit_classifier(df, "forest", ["x"], "y", ["a", "b"])
    monkeypatch.setattr(models, "ROWS_OF_PART", 200)
    models.fit_classifier(df, "forest", ["x"], "y", ["a", "b"])
    models.fit_classifier(df.limit(0), "forest", ["x"], "y", ["a", "b"])
    assert [len(s) - 1 for s in seen[:2]] == [1, 5]
    assert max(seen[1][:-1]) <= 210 and seen[0][-1] == seen[1][-1] == list(map(float, range(1000)))


def test_elimination_keeps_the_telling_feature(spark):
    rows = [(i, float(i * 37 % 19), float(i % 2) + 0.01 * (i % 7), "a" if i % 2 else "b") for i in range(120)]
    df = spark.createDataFrame(rows, "claim_id long, noise double, x double, y string")
    path = models.recursive_elimination(df, ["noise", "x"], "y", "claim_id", maxIter=20)
    assert models.features_after_elimination(path, 1) == ["x"]


def test_frequency_encoder_with_a_large_table(spark, monkeypatch):
    df = spark.range(300).select(F.col("id").alias("i"), (F.col("id") % 90).cast("string").alias("a"), F.lit("same").alias("b"))
    expected = sorted(map(tuple, encode.FrequencyEncoder(columns=["a", "b"]).fit(df).transform(df).collect()))
    monkeypatch.setattr(lookup, "_broadcast_bytes", lambda spark: -1)
    got = sorted(map(tuple, encode.FrequencyEncoder(columns=["a", "b"]).fit(df).transform(df).select("i", "a", "b", "a_freq", "b_freq").collect()))
    assert got == expected


def test_split_of_some_columns_has_the_same_rows(spark, sf_dir, monkeypatch):
    written = []
    cut = claims.cut_lineage
    monkeypatch.setattr(claims, "cut_lineage", lambda df: written.append(df.columns) or cut(df))
    whole = claims.split_claims(spark, sf_dir).select("claim_id", "claim_type", "age", "split")
    some = claims.split_claims(spark, sf_dir, "age")
    assert written[1] == ["claim_id", "claim_type", "age"] and some.columns == whole.columns
    assert whole.exceptAll(some).count() == some.exceptAll(whole).count() == 0 < some.count()
    written.clear()
    catalog.QUERIES["label_index"](spark, sf_dir)
    assert written == [["claim_id", "claim_type"]]

"""Feature filters and votes."""

from __future__ import annotations

import math
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.expressions import digamma
from tablewright.operators.clean import class_list
from tablewright.plans.lookup import WEIGHT, FittedTable, attach
from tablewright.plans.prefix import running_sums
from tablewright.plans.quantiles import exact_quantiles
from tablewright.session import cut_lineage


#: Rows whose neighbours are looked for together.
NEIGHBOUR_BLOCK = 8_192


def _upper_tail(x: float, dof: int) -> float:
    """P(chi-square with a whole number of degrees of freedom > x)."""
    if dof <= 0 or x != x:
        return float("nan")
    half = max(x, 0.0) / 2
    if half == 0:
        return 1.0
    first, total = (0.0, 0.0) if dof % 2 == 0 else (0.5, math.erfc(math.sqrt(half)))
    for i in range((dof - dof % 2) // 2):
        power = first + i
        total += math.exp(power * math.log(half) - half - math.lgamma(power + 1))
    return min(total, 1.0)


@F.pandas_udf(T.DoubleType())
def chi2_p_value(x: pd.Series, dof: pd.Series) -> pd.Series:
    """Only for report rows, of which there is one per feature."""
    return pd.Series([_upper_tail(a, int(d)) for a, d in zip(x, dof)], dtype="float64")


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of value pairs without nulls, in long form."""
    pairs = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    return pairs.groupBy(a, b).agg(F.count("*").alias("n"))


def contingency_wide(df: DataFrame, rows: str, columns: str) -> DataFrame:
    """One column per value of ``columns``; absent pairs count 0."""
    levels = class_list(df, columns)
    return (
        df.filter(F.col(rows).isNotNull())
        .groupBy(rows)
        .agg(*[F.count_if(F.col(columns) == v).alias(str(v)) for v in levels])
    )


def association_report(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """Independence chi-square, Cramér's V and mutual information of features and a label.

    Levels are counted per class in one shuffle for all features. The statistics are
    sums over levels of terms that need only the level's own counts, so no margin has
    to be joined back: with counts ``n_i`` of class i in a level of size r and class
    sizes ``c_i``, ``chi2 = n * (sum(n_i^2 / (r * c_i)) - 1)``. ``chi2`` has the
    continuity correction when there is one degree of freedom.
    """
    labelled = df.filter(F.col(label).isNotNull())
    classes = class_list(labelled, label)
    ids = range(len(classes))
    text = labelled.select(F.col(label).alias("cls"), *[F.col(c).cast("string").alias(c) for c in features])
    long = text.unpivot(["cls"], features, "feature", "level").filter("level is not null")
    levels = long.groupBy("feature", "level").agg(
        F.count("*").cast("double").alias("r"), *[F.count_if(F.col("cls") == v).cast("double").alias(f"n{i}") for i, v in enumerate(classes)]
    )

    def plogp(c: Column) -> Column:
        return F.when(c > 0, c * F.ln(c)).otherwise(0.0)

    def total(terms: list[Column]) -> Column:
        out = F.lit(0.0)
        for t in terms:
            out = out + t
        return out

    sums = levels.groupBy("feature").agg(
        F.sum("r").alias("n"),
        F.count("*").alias("n_levels"),
        F.sum(1 / F.col("r")).alias("inv_r"),
        F.sum(plogp(F.col("r"))).alias("r_log"),
        F.sum(total([plogp(F.col(f"n{i}")) for i in ids])).alias("cell_log"),
        *[F.sum(f"n{i}").alias(f"c{i}") for i in ids],
        *[F.sum(F.col(f"n{i}") * F.col(f"n{i}") / F.col("r")).alias(f"s{i}") for i in ids],
    )
    n = F.col("n")
    present = total([F.when(F.col(f"c{i}") > 0, 1.0).otherwise(0.0) for i in ids]).cast("int")
    inv_c = total([F.when(F.col(f"c{i}") > 0, 1 / F.col(f"c{i}")).otherwise(0.0) for i in ids])
    plain = n * (total([F.when(F.col(f"c{i}") > 0, F.col(f"s{i}") / F.col(f"c{i}")).otherwise(0.0) for i in ids]) - 1)
    c_log = total([plogp(F.col(f"c{i}")) for i in ids])
    out = sums.select(
        "feature",
        n.cast("long").alias("n"),
        "n_levels",
        present.alias("n_classes"),
        F.greatest(plain, F.lit(0.0)).alias("chi2_plain"),
        (n * F.col("inv_r") * inv_c).alias("inverse_expected"),
        (F.ln(n) + F.try_divide(F.col("cell_log") - F.col("r_log") - c_log, n)).alias("mutual_information"),
    ).withColumn("dof", ((F.col("n_levels") - 1) * (F.col("n_classes") - 1)).cast("int"))
    # In a 2x2 table all four cells are equally far from expectation.
    gap = F.sqrt(F.try_divide("chi2_plain", "inverse_expected"))
    corrected = F.pow(F.greatest(gap - 0.5, F.lit(0.0)), 2) * F.col("inverse_expected")
    out = out.withColumn("chi2", F.when(F.col("dof") == 1, corrected).otherwise(F.col("chi2_plain")))
    narrow = F.least(F.col("n_levels"), F.col("n_classes")) - 1
    v = F.when(narrow > 0, F.sqrt(F.try_divide("chi2", F.col("n") * narrow)))
    return out.select("feature", "n", "n_levels", "n_classes", "dof", "chi2", v.alias("cramers_v"), "mutual_information")


def feature_chi2(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """Chi-square of non-negative feature sums per class against the class shares."""
    by_class = df.filter(F.col(label).isNotNull()).groupBy(label).agg(
        F.count("*").cast("double").alias("n_class"), *[F.sum(F.col(c).cast("double")).alias(c) for c in features]
    )
    long = by_class.unpivot([label, "n_class"], features, "feature", "observed")
    sums = long.groupBy("feature").agg(
        F.sum("n_class").alias("n"),
        F.sum("observed").alias("total"),
        F.sum(F.col("observed") * F.col("observed") / F.col("n_class")).alias("s"),
        (F.count("*") - 1).cast("int").alias("dof"),
    )
    chi2 = F.when(F.col("total") > 0, F.col("n") / F.col("total") * F.col("s") - F.col("total"))
    return sums.select("feature", "dof", F.greatest(chi2, F.lit(0.0)).alias("chi2"))


def with_p_value(report: DataFrame) -> DataFrame:
    return report.withColumn("p_value", chi2_p_value("chi2", "dof"))


def chi2_and_v_filter(df: DataFrame, features: list[str], label: str, p_below: float = 0.05, v_from: float = 0.1) -> DataFrame:
    """Features whose sums depend on the class and whose Cramér's V is not small."""
    chi2 = with_p_value(feature_chi2(df, features, label)).select("feature", "chi2", "p_value")
    v = association_report(df, features, label).select("feature", "cramers_v")
    return chi2.join(v, "feature").filter((F.col("p_value") < p_below) & (F.col("cramers_v") >= v_from))


def mutual_information_filter(df: DataFrame, features: list[str], label: str, above: float = 0.01) -> DataFrame:
    report = association_report(df, features, label).select("feature", "mutual_information")
    return report.filter(F.col("mutual_information") > above)


def quantile_bins(df: DataFrame, features: list[str], n_bins: int = 10) -> DataFrame:
    """Replace numbers by the number of inner quantiles at or below them."""
    cuts = exact_quantiles(df, {c: (F.col(c), [i / n_bins for i in range(1, n_bins)]) for c in features})

    def place(c: str) -> Column:
        out = F.lit(0)
        for cut in sorted({x for x in cuts[c] if x is not None}):
            out = out + F.when(F.col(c) >= cut, 1).otherwise(0)
        return F.when(F.col(c).isNotNull(), out)

    return df.withColumns({c: place(c) for c in features})


def binned_mutual_information(df: DataFrame, features: list[str], label: str, n_bins: int = 10) -> DataFrame:
    binned = quantile_bins(df.select(label, *features), features, n_bins)
    return association_report(binned, features, label).select("feature", "mutual_information")


def _distances(counts: DataFrame, k: int) -> DataFrame:
    """``counts`` (feature, class, value, n, size) with ``radius``: the distance of a value's k-th neighbour in its class.

    Blocks are cut by rank; a block also gets the k rows before and after it, so every row meets its
    neighbours without its class coming together. Of a class with k rows or fewer the farthest row counts.
    """
    ordered = running_sums(counts.withColumn("one", F.lit(1)), [F.asc("feature"), F.asc("class"), F.asc("value")], ["one"])
    at = F.col("one_upto")
    first, last = (F.floor((at + shift) / F.lit(NEIGHBOUR_BLOCK)) for shift in (-k, k))
    placed = ordered.withColumn("block", F.explode(F.sequence(first, last)))
    near = Window.partitionBy("block").orderBy("one_upto")
    around = []
    for i in range(1, k + 1):
        for side in (F.lag, F.lead):
            same = side("feature", i).over(near).eqNullSafe(F.col("feature")) & side("class", i).over(near).eqNullSafe(F.col("class"))
            around.append(F.when(same, F.struct(F.abs(side("value", i).over(near) - F.col("value")).alias("d"), side("n", i).over(near).alias("n"))))
    own = F.struct(F.lit(0.0).alias("d"), (F.col("n") - 1).alias("n"))
    known = placed.withColumn("around", F.array_sort(F.filter(F.array(own, *around), lambda x: x.isNotNull())))
    known = known.where(F.col("block") == F.floor(at / F.lit(NEIGHBOUR_BLOCK)))
    start = F.struct(F.lit(0).cast("long").alias("met"), F.lit(0.0).alias("d"))
    enough = F.least(F.lit(k), F.col("size") - 1)
    kth = F.aggregate("around", start, lambda s, x: F.when(s["met"] >= enough, s).otherwise(F.struct((s["met"] + x["n"]).alias("met"), x["d"].alias("d"))))
    return known.select("feature", "class", "value", "n", "size", kth["d"].alias("radius"))


def neighbour_mutual_information(df: DataFrame, features: list[str], label: str, k: int = 3) -> DataFrame:
    """(feature, mutual_information) of numbers with a class, by nearest neighbours, in nats and at least 0.

    For a row, r is the distance of its k-th nearest row of the same class (the farthest, if there are fewer) and m the
    number of rows v of any class with x - r < v < x + r, itself included (v = x where r is 0). With N rows and n of the row's
    class, the estimate is digamma(N) + mean(digamma(min(k, n - 1)) - digamma(n) - digamma(m)). Nothing is
    drawn at random to part ties. Rows without a number or class, and classes of one row, are left out by column; a column
    without rows left gets null.

    Equal values are counted first. m is the difference of two running counts, at x + r and x - r, read from one order
    of all columns' values and bounds.
    """
    long = df.select(F.col(label).alias("class"), *[F.col(c).cast("double").alias(c) for c in features]).unpivot(["class"], features, "feature", "value")
    long = long.filter(F.col("class").isNotNull() & F.col("value").isNotNull() & ~F.isnan("value"))
    counts = cut_lineage(long.groupBy("feature", "class", "value").agg(F.count("*").alias("n")))
    # One row per feature and class.
    sizes = FittedTable.of(counts.groupBy(F.col("feature"), F.col("class")).agg(F.sum("n").alias("size")))
    sized = attach(counts, sizes, {"feature": "feature", "class": "class"}).where(F.col("size") > 1)
    rows = cut_lineage(_distances(sized, k))

    x, r = F.col("value"), F.col("radius")
    # At one place, a bound that leaves the value out comes before it (0), one that takes it in after it (2).
    low = F.struct((x - r).alias("at"), F.when(r > 0, 2).otherwise(0).alias("side"))
    high = F.struct((x + r).alias("at"), F.when(r > 0, 0).otherwise(2).alias("side"))
    bounds = rows.select("feature", F.explode(F.array(low, high)).alias("bound"), F.lit(0).cast("long").alias("n")).distinct()
    values = rows.groupBy("feature", F.col("value")).agg(F.sum("n").alias("n")).select("feature", F.struct(x.alias("at"), F.lit(1).alias("side")).alias("bound"), "n")
    upto = running_sums(bounds.unionByName(values), [F.asc("feature"), F.asc("bound")], ["n"]).where(F.col("bound.side") != 1)
    upto = cut_lineage(upto.select("feature", F.col("bound.at").alias("at"), F.col("bound.side").alias("side"), F.col("n_upto").alias("upto")))

    def counted(rows: DataFrame, bound: Column, name: str) -> DataFrame:
        asked = rows.withColumn("asked", bound)
        table = FittedTable(upto.withColumnRenamed("upto", name))
        asked = asked.withColumns({"asked_at": F.col("asked.at"), "asked_side": F.col("asked.side")}).drop("asked")
        return attach(asked, table, {"feature": "feature", "asked_at": "at", "asked_side": "side"}).drop("asked_at", "asked_side")

    met = counted(counted(rows, low, "below"), high, "upto_high")
    n = F.col("n").cast("double")
    fewest = F.least(F.lit(k), F.col("size") - 1).cast("double")
    terms = digamma(fewest) - digamma(F.col("size").cast("double")) - digamma((F.col("upto_high") - F.col("below")).cast("double"))
    found = met.groupBy("feature").agg(F.sum("n").cast("double").alias("total"), F.sum(n * terms).alias("terms"))
    estimate = F.greatest(F.lit(0.0), digamma(F.col("total")) + F.col("terms") / F.col("total"))
    listed = df.sparkSession.createDataFrame([(c,) for c in features], "feature string")
    return listed.join(found.select("feature", estimate.alias("mutual_information")), "feature", "left")


def average_ranks(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, value, n, avg_rank) for the distinct values of all columns at once."""
    doubles = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    long = doubles.unpivot([], columns, "feature", "value").filter("value is not null")
    counts = long.groupBy("feature", "value").agg(F.count("*").alias("n"))
    summed = running_sums(counts, [F.asc("feature"), F.asc("value")], ["n"])
    # Ranks run through all features in order; a feature starts where the one before it ended.
    starts = FittedTable.of(summed.groupBy("feature").agg((F.max("n_upto") - F.sum("n")).alias("start")))
    placed = attach(summed, starts, {"feature": "feature"})
    return placed.select("feature", "value", "n", (F.col("n_upto") - F.col("start") - (F.col("n") - 1) / 2).alias("avg_rank"))


def spearman_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rank correlation of every pair of columns over rows without nulls.

    The rows stay whole: each column's ranks are joined to them, by a broadcast where the column has few values.
    """
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).na.drop()
    # Written, so that both readings have the same rows; their numbers spread equal ones.
    rows = cut_lineage(rows.withColumn("row_no", F.monotonically_increasing_id()))
    ranks = FittedTable.of(average_ranks(rows, columns).withColumn(WEIGHT, F.col("n")).drop("n"), part="feature")
    for c in columns:
        own = ranks.of_part(c)
        rows = attach(rows, FittedTable(own.df.withColumnRenamed("avg_rank", f"rank_{c}"), own.hot), {c: "value"}).drop(c)
    pairs = list(combinations(sorted(columns), 2))

    def correlation(a: str, b: str) -> Column:
        # Null for a constant column, where corr() would fail.
        return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))

    row = rows.agg(*[correlation(f"rank_{a}", f"rank_{b}").alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    parts = [F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.col(f"p{i}").alias("correlation")) for i, (a, b) in enumerate(pairs)]
    return row.select(F.inline(F.array(*parts)))


def strong_pairs(df: DataFrame, columns: list[str], above: float = 0.8) -> DataFrame:
    return spearman_matrix(df, columns).filter(F.abs("correlation") > above).orderBy(F.desc(F.abs("correlation")))


def combine_filters(chosen: DataFrame, also_chosen: DataFrame, dropped: list[DataFrame] | None = None) -> DataFrame:
    """Union of two feature lists less the union of the drop lists (``feature`` columns)."""
    out = chosen.select("feature").union(also_chosen.select("feature")).distinct()
    for d in dropped or []:
        out = out.join(d.select("feature"), "feature", "left_anti")
    return out


def cumulative_cut(importance: DataFrame, share: float = 0.9) -> DataFrame:
    """Features in descending importance up to the first that reaches the share.

    One row per feature, so the global window is small whatever the data.
    """
    order = Window.orderBy(F.desc("importance"), "feature").rowsBetween(Window.unboundedPreceding, 0)
    ranked = importance.withColumns(
        {"position": F.row_number().over(Window.orderBy(F.desc("importance"), "feature")), "cumulative": F.sum("importance").over(order)}
    )
    return ranked.filter(F.col("cumulative") - F.col("importance") < share)


def vote(votes: DataFrame, at_least: int = 3) -> DataFrame:
    """Features named by enough methods; ``votes`` has (method, feature) rows."""
    counted = votes.distinct().groupBy("feature").agg(F.count("*").alias("n_votes"))
    return counted.filter(F.col("n_votes") >= at_least)


def selection_matrix(votes: DataFrame, methods: list[str], at_least: int = 3) -> DataFrame:
    """One row per feature, one boolean per method, and the verdict."""
    flags = [F.max(F.col("method") == m).alias(m) for m in methods]
    counted = votes.distinct().groupBy("feature").agg(*flags, F.count("*").alias("n_votes"))
    return counted.withColumn("selected", F.col("n_votes") >= at_least)

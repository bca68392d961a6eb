"""Exact "first k rows of every class" without sorting a class in one task.

A window partitioned by the class would send a class with half of all rows to one
task. Here the rows are ordered by a hash of their key, so a histogram over the
first digits of the hash shows which digit bucket holds row k of each class. Only
that bucket is ranked; the answer is one cut value per class, and choosing the rows
is then a comparison without any shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.hashing import hash_order

DIGITS = 4
MAX_CLASSES = 10_000


def _class_key(by: list[str]) -> Column:
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\u0000null")) for c in by]
    return F.concat_ws("\u0001", *parts) if parts else F.lit("")


def hash_cut(
    df: DataFrame, key: str, wants: dict[str, Column], by: list[str] | None = None, seed: str | int | Column = 0
) -> dict[str, Column]:
    """For each entry of ``wants`` a boolean column marking the first rows of every class.

    A want is an expression over ``n_rows`` (the size of the class) and ``class_key``
    (the class values joined as text) that says how many rows to mark. Rows are
    ordered by ``(hash(key), key)``; ``key`` must be unique within a class. ``seed`` may
    be a column, which gives each of its values an order of its own.
    """
    by = by or []
    names = list(wants)
    digest = hash_order(F.col(key), seed)
    keyed = df.select(_class_key(by).alias("class_key"), digest.alias("digest"), F.col(key).alias("cut_key"))
    keyed = keyed.withColumn("bucket", F.substring("digest", 1, DIGITS))

    per_class = Window.partitionBy("class_key")
    ordered = per_class.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    histogram = (
        keyed.groupBy("class_key", "bucket")
        .agg(F.count("*").alias("n"))
        .withColumn("n_rows", F.sum("n").over(per_class))
        .withColumn("upto", F.sum("n").over(ordered))
    )
    edges = []
    for name in names:
        want = wants[name].cast("long")
        hit = (F.col("upto") - F.col("n") < want) & (want <= F.col("upto"))
        edges.append(
            F.struct(F.lit(name).alias("name"), want.alias("want"), (want - F.col("upto") + F.col("n")).alias("rank"), hit.alias("hit"))
        )
    # A want above the class size marks the whole class, so the last bucket reports it as well.
    found = (
        histogram.withColumn("edge", F.explode(F.array(*edges)))
        .filter(F.col("edge.hit") | ((F.col("upto") == F.col("n_rows")) & (F.col("edge.want") > F.col("n_rows"))))
        .select("class_key", "bucket", "edge.name", "edge.rank", "edge.hit")
        .limit(MAX_CLASSES * len(names) + 1)
        .collect()
    )
    if len(found) > MAX_CLASSES * len(names):
        raise ValueError(f"more than {MAX_CLASSES} classes in {by}")

    whole = {(r["name"], r["class_key"]) for r in found if not r["hit"]}
    partial = [(r["class_key"], r["bucket"], r["name"], r["rank"]) for r in found if r["hit"]]
    cuts: dict[str, dict[str, tuple]] = {n: {} for n in names}
    if partial:
        edge_rows = df.sparkSession.createDataFrame(partial, "class_key string, bucket string, name string, rank long")
        ranked = keyed.join(F.broadcast(edge_rows), ["class_key", "bucket"]).withColumn(
            "position", F.row_number().over(Window.partitionBy("class_key", "bucket", "name").orderBy("digest", "cut_key"))
        )
        for r in ranked.filter("position = rank").collect():
            cuts[r["name"]][r["class_key"]] = (r["digest"], r["cut_key"])

    return {n: _cut_column(key, by, digest, cuts[n], {c for m, c in whole if m == n}) for n in names}


def _cut_column(key: str, by: list[str], digest: Column, cuts: dict[str, tuple], whole: set[str]) -> Column:
    cls = _class_key(by)
    if not by:
        if whole:
            return F.lit(True)
        if not cuts:
            return F.lit(False)
        (edge, edge_key), = cuts.values()
        return (digest < edge) | ((digest == edge) & (F.col(key) <= F.lit(edge_key)))
    taken = F.lit(False)
    if whole:
        taken = cls.isin(*sorted(whole))
    if not cuts:
        return taken
    pairs = reduce(lambda acc, kv: acc + [F.lit(kv[0]), F.struct(F.lit(kv[1][0]).alias("d"), F.lit(kv[1][1]).alias("k"))], sorted(cuts.items()), [])
    edge = F.create_map(*pairs)[cls]
    below = (digest < edge["d"]) | ((digest == edge["d"]) & (F.col(key) <= edge["k"]))
    return taken | F.coalesce(below, F.lit(False))

"""Connected components of a graph of any size, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.session import cut_lineage


def _least(edges: DataFrame) -> DataFrame:
    """(node, least): the smallest neighbour of every node, itself included. Combined before the shuffle."""
    return edges.groupBy("u").agg(F.min("v").alias("least")).select(F.col("u").alias("node"), F.least("u", "least").alias("least"))


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours are tied to its smallest one."""
    around = _both_ways(edges)
    least = _least(around)
    tied = around.where("v > u").join(least, F.col("u") == F.col("node")).select(F.col("v").alias("u"), F.col("least").alias("v"))
    return tied.where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node's smaller neighbours, and the node itself, are tied to the smallest of them."""
    downward = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(downward)
    tied = downward.join(least, F.col("u") == F.col("node")).select(F.col("v").alias("u"), F.col("least").alias("v"))
    selves = least.select(F.col("node").alias("u"), F.col("least").alias("v"))
    return tied.unionByName(selves).where("u <> v").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(node, group) for every node of an edge (a, b); ``group`` is the smallest node of its component.

    Each round is a few aggregations and joins, written to the shared folder; rounds grow with the
    logarithm of the longest chain. Edges with a null end, and of a node with itself, are ignored;
    repeated edges count once.
    """
    now = cut_lineage(edges.where("a is not null and b is not null and a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct())
    state = None
    while True:
        now = cut_lineage(_small_star(_large_star(now)))
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")).collect()[0]
        if (seen["n"], seen["sum"]) == state:
            break
        state = (seen["n"], seen["sum"])
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("group"))
    return nodes.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("group")).distinct())

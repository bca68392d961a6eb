"""Gradient-boosted trees whose one-against-rest parts grow together.

MLlib fits every part by itself and runs a job or more for each level of each tree, so that six classes, 100 steps and six
levels are thousands of jobs. Here one job serves a level of all parts: its tasks add up the residuals of their rows by
part, node, feature and bin, Spark adds up the tasks' sums, and the driver picks the splits. Of the two sides of a split the smaller
is counted and the larger gets what is left. Otherwise the trees are MLlib's: log loss on
labels of -1 and 1, a first tree on the labels, cuts between the values of a bounded sample, splits by variance, a share of the
rows drawn anew at each step.

The driver gets sums of parts x nodes x features x bins, however many rows there are. Rows are kept as one byte a feature and one number a part.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark import RDD, StorageLevel
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.ml.param import Param
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that are worked on at a time, about; few enough for a processor's cache.
BLOCK_ROWS = 32_768
#: A task has about so many rows at least: starting tasks takes longer than fewer rows do.
TASK_ROWS = 25_000
#: The sums of more tasks are added up by tasks before the driver gets them.
TASKS_TO_DRIVER = 32
#: After so many steps the rows' scores are worked out from all trees, which keeps their lineage short.
STEPS_OF_LINEAGE = 25
#: Levels of a tree at most: its nodes are kept as full arrays.
DEEPEST = 12
SAMPLE = 10_000


@dataclass
class Trees:
    """A tree of each part. Level ``d`` begins at node 2^d - 1; a node that is not split sends all rows to the left."""

    feature: np.ndarray  # (parts, 2^depth - 1)
    cut: np.ndarray  # the last bin that goes to the left
    value: np.ndarray  # (parts, 2^depth)
    rate: float

    def leaves(self, bins: np.ndarray, part: int, depth: int) -> np.ndarray:
        """The place of every row (a column of ``bins``) among the nodes of a level."""
        n = bins.shape[1]
        flat, rows, place = bins.ravel(), np.arange(n), np.zeros(n, np.int64)
        for level in range(depth):
            own = slice(2**level - 1, 2 ** (level + 1) - 1)
            at = (self.feature[part, own] * n).take(place)
            at += rows
            right = flat.take(at) > self.cut[part, own].take(place)
            place *= 2
            place += right
        return place

    def add_to(self, scores: np.ndarray, bins: np.ndarray) -> None:
        depth = self.value.shape[1].bit_length() - 1
        for part in range(len(scores)):
            scores[part] += self.rate * self.value[part].take(self.leaves(bins, part, depth))


@dataclass
class Block:
    """Some rows: their bins (feature, row), classes and weights, and their scores (part, row)."""

    number: tuple[int, int]
    bins: np.ndarray
    target: np.ndarray
    weight: np.ndarray | None
    scores: np.ndarray


def cuts_of(values: np.ndarray, most: int) -> np.ndarray:
    """At most ``most`` cuts between the distinct values, of about as many values each."""
    known, counts = np.unique(values[np.isfinite(values)], return_counts=True)
    middles = known[:-1] + (known[1:] - known[:-1]) / 2
    if len(middles) <= most:
        return middles
    stride = counts.sum() / (most + 1)
    reached, wanted, out = np.cumsum(counts), stride, []
    for i, middle in enumerate(middles):
        # Cut before the value that would lead farther from the wanted count.
        if abs(reached[i] - wanted) < abs(reached[i + 1] - wanted):
            out.append(middle)
            wanted += stride
    return np.array(out[:most])


def binned(values: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """(feature, row) number of cuts below each value; a value that is not a number is above all."""
    return np.stack([np.searchsorted(c, values[:, f], side="left") for f, c in enumerate(cuts)]).astype(np.uint8)


def sampled_cuts(rows: DataFrame, n_rows: int, max_bins: int, seed: int) -> list[np.ndarray]:
    """The cuts of every dimension of ``x``, from a sample of the rows that is bounded."""
    wanted = max(max_bins**2, SAMPLE)
    sample = rows.select(vector_to_array("x").alias("x"))
    sample = (sample.sample(False, wanted / n_rows, seed) if wanted < n_rows else sample).collect()
    values = np.array([r["x"] for r in sample], dtype="float64")
    return [cuts_of(values[:, f], max_bins - 1) for f in range(values.shape[1])]


def blocks_of(rows: DataFrame, cuts: list[np.ndarray], weighted: bool, parts: int, block_rows: int = BLOCK_ROWS) -> RDD:
    """The rows (x, y and, if weighted, w) as ``Block`` of about ``block_rows`` with scores of 0."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bins = binned(np.array(batch["x"].tolist(), dtype="float64").reshape(len(batch), -1), cuts)
            weights = batch["w"].to_numpy(dtype="float64").tobytes() if weighted else None
            yield pd.DataFrame({"bins": [bins.tobytes()], "target": [batch["y"].to_numpy(dtype="int32").tobytes()], "weight": [weights]})

    def block(number: tuple[int, int], packed: list) -> Block:
        classes = [np.frombuffer(row["target"], np.int32) for row in packed]
        bins = [np.frombuffer(row["bins"], np.uint8).reshape(-1, len(c)) for row, c in zip(packed, classes) if len(c)]
        own = np.concatenate([np.frombuffer(row["weight"], np.float64) for row in packed]) if weighted else None
        target = np.concatenate(classes)
        return Block(number, np.concatenate(bins, axis=1), target, own, np.zeros((parts, len(target))))

    def unpack(part: int, packed: Iterable) -> Iterator[Block]:
        number, held, size = 0, [], 0
        for row in packed:
            held.append(row)
            size += len(row["target"]) // 4
            if size >= block_rows:
                yield block((part, number), held)
                number, held, size = number + 1, [], 0
        if size:
            yield block((part, number), held)

    columns = [vector_to_array("x").alias("x"), F.col("y").cast("int").alias("y"), *([F.col("w").cast("double").alias("w")] if weighted else [])]
    plain = rows.select(*columns).mapInPandas(encode, "bins binary, target binary, weight binary")
    return plain.rdd.mapPartitionsWithIndex(unpack)


def _residuals(block: Block, part: int, positive: int, some: np.ndarray, first: bool) -> np.ndarray:
    label = np.where(block.target[some] == positive, 1.0, -1.0)
    if first:
        return label
    return 4 * label / (1 + np.exp(np.minimum(2 * label * block.scores[part][some], 700.0)))


def _level_sums(grown: Trees, counted: np.ndarray, step: int, positives: list[int], n_bins: int, share: float, seed: int, blocks: Iterable[Block]) -> Iterator[np.ndarray]:
    """Weights and sums of residuals by part, place in the sums, feature and bin; ``counted`` has the place of each node of the level, or -1."""
    total: np.ndarray | None = None
    level, places = counted.shape[1].bit_length() - 1, max(counted.shape[1] // 2, 1)
    for block in blocks:
        drawn = np.random.default_rng([seed, step, *block.number]).random(len(block.target)) < share if share < 1 else np.ones(len(block.target), bool)
        some = np.flatnonzero(drawn)
        bins = np.ascontiguousarray(block.bins[:, some])
        weight = None if block.weight is None else block.weight[some]
        wide = bins.astype(np.int64)
        if total is None:
            total = np.zeros((2, len(positives), len(bins), places * n_bins))
        # At the root all parts have the same rows.
        rows = [np.bincount(x, weight, n_bins) for x in wide] if level == 0 else None
        for part, positive in enumerate(positives):
            if rows is not None:
                residual = _residuals(block, part, positive, some, step == 0)
                residual = residual if weight is None else residual * weight
                for f, x in enumerate(wide):
                    total[0, part, f] += rows[f]
                    total[1, part, f] += np.bincount(x, residual, n_bins)
                continue
            place = counted[part].take(grown.leaves(bins, part, level))
            own = np.flatnonzero(place >= 0)
            if not len(own):
                continue
            first_bin = place.take(own) * n_bins
            residual = _residuals(block, part, positive, some.take(own), step == 0)
            own_weight = None if weight is None else weight.take(own)
            residual = residual if own_weight is None else residual * own_weight
            for f, x in enumerate(wide):
                cell = x.take(own)
                cell += first_bin
                total[0, part, f] += np.bincount(cell, own_weight, places * n_bins)
                total[1, part, f] += np.bincount(cell, residual, places * n_bins)
    if total is not None:
        yield total


def _smaller_sides(before: np.ndarray, grown: Trees, level: int, n_bins: int) -> np.ndarray:
    """(part, node of the level): the number of the node above where the node is the smaller side of its split, else -1."""
    above = slice(2 ** (level - 1) - 1, 2**level - 1)
    feature, cut = grown.feature[:, above], grown.cut[:, above]
    rows = before[0].reshape(*before.shape[1:3], -1, n_bins)
    part, node = np.indices(feature.shape)
    of_bins = rows[part, feature, node]
    left = np.where(np.arange(n_bins) <= cut[..., None], of_bins, 0).sum(2)
    left_is_smaller = 2 * left <= of_bins.sum(2)
    counted = np.full((len(feature), 2 * feature.shape[1]), -1, np.int64)
    splits = cut < n_bins
    for side, smaller in ((0, left_is_smaller), (1, ~left_is_smaller)):
        counted[:, side::2] = np.where(splits & smaller, node, -1)
    return counted


def _both_sides(before: np.ndarray, sums: np.ndarray, counted: np.ndarray, n_bins: int) -> np.ndarray:
    """The sums of all nodes of a level: the larger side has what the smaller leaves of the node above; one that is not split sends all to the left."""
    whole = before.reshape(*before.shape[:3], -1, n_bins)
    small = sums.reshape(whole.shape)
    out = np.empty((*whole.shape[:3], 2 * whole.shape[3], n_bins))
    left, right = (counted[None, :, None, side::2, None] >= 0 for side in (0, 1))
    rest = whole - small
    out[..., 0::2, :] = np.where(left, small, np.where(right, rest, whole))
    out[..., 1::2, :] = np.where(right, small, np.where(left, rest, 0.0))
    return out.reshape(*before.shape[:3], -1)


def _with_scores(steps: list[Trees], anew: bool, block: Block) -> Block:
    scores = np.zeros_like(block.scores) if anew else block.scores.copy()
    for trees in steps:
        trees.add_to(scores, block.bins)
    return Block(block.number, block.bins, block.target, block.weight, scores)


def _split(grown: Trees, level: int, sums: np.ndarray, n_bins: int, least_rows: float, least_gain: float, last: bool) -> np.ndarray:
    """Write the best splits of a level into the trees, and the leaves after the last; returns the gain of each feature."""
    _, parts, n_features, _ = sums.shape
    nodes = 2**level
    # (part, node, feature, bin)
    n, s = (np.cumsum(x.reshape(parts, n_features, nodes, n_bins).transpose(0, 2, 1, 3), axis=3) for x in sums)
    all_n, all_s = n[..., -1:], s[..., -1:]
    right_n, right_s = all_n - n, all_s - s
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = (s * s / n + right_s * right_s / right_n - all_s * all_s / all_n) / all_n
    # What rounding leaves of an empty side is no row.
    empty = 1e-9 * all_n
    gain[~((n >= least_rows) & (right_n >= least_rows) & (n > empty) & (right_n > empty))] = -np.inf
    gain = gain.reshape(parts, nodes, -1)
    best = gain.argmax(2)
    best_gain = np.take_along_axis(gain, best[..., None], 2)[..., 0]
    splits = (best_gain > 1e-12) & (best_gain >= least_gain)
    feature, cut = np.where(splits, best // n_bins, 0), np.where(splits, best % n_bins, n_bins)
    own = slice(nodes - 1, 2 * nodes - 1)
    grown.feature[:, own], grown.cut[:, own] = feature, cut
    node_n, node_s = all_n[:, :, 0, 0], all_s[:, :, 0, 0]
    if last:
        at = np.minimum(best, n_features * n_bins - 1)[..., None]
        sides = []
        for values, whole in ((n, node_n), (s, node_s)):
            left = np.where(splits, np.take_along_axis(values.reshape(parts, nodes, -1), at, 2)[..., 0], whole)
            sides.append(np.stack([left, whole - left], axis=2).reshape(parts, -1))
        grown.value[:] = np.divide(sides[1], sides[0], out=np.zeros_like(sides[1]), where=sides[0] > 0)
        # The side that gets no rows.
        grown.value[:, 1::2][~splits] = 0.0
    gains = np.zeros((parts, n_features))
    for part in range(parts):
        own_splits = splits[part]
        np.add.at(gains[part], feature[part][own_splits], best_gain[part][own_splits] * node_n[part][own_splits])
    return gains


class BoostedTrees(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """A boosted model of two classes, or one of each class against the rest, by MLlib's names of the settings."""

    defaults: dict[str, Any] = {
        "n_classes": 2, "features": "features", "target": "target", "weight": None, "seed": 42, "maxIter": 100, "stepSize": 0.05, "maxDepth": 6,
        "subsamplingRate": 0.8, "maxBins": 32, "minInstancesPerNode": 1, "minInfoGain": 0.0,
    }

    def __init__(self, **args: Any):
        super().__init__()
        unknown = set(args) - set(self.defaults)
        if unknown:
            raise TypeError(f"no argument {sorted(unknown)}")
        self.args = Param(self, "args", "keyword arguments")
        self._set(args={**self.defaults, **args})

    @classmethod
    def takes(cls, args: dict[str, Any]) -> bool:
        """Whether it has all these settings; MLlib's trees have more. Weighted rows are not counted."""
        if args.get("weight") and args.get("minInstancesPerNode", 1) != 1:
            return False
        return set(args) <= set(cls.defaults) and 1 <= args.get("maxDepth", 6) <= DEEPEST and 2 <= args.get("maxBins", 32) <= 255

    def _fit(self, dataset: DataFrame) -> "BoostedTreesModel":
        a = self.getOrDefault(self.args)
        columns = [F.col(a["features"]).alias("x"), F.col(a["target"]).alias("y"), *([F.col(a["weight"]).alias("w")] if a["weight"] else [])]
        rows = dataset.select(*columns)
        n_rows = rows.count()
        if not n_rows:
            raise ValueError("no rows to learn from")
        cuts = sampled_cuts(rows, n_rows, a["maxBins"], a["seed"])
        positives = [1] if a["n_classes"] == 2 else list(range(a["n_classes"]))
        tasks = math.ceil(n_rows / TASK_ROWS)
        blocks = blocks_of(rows.coalesce(tasks), cuts, bool(a["weight"]), len(positives)).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            steps, gains = self._grown(blocks, cuts, positives, a)
        finally:
            blocks.unpersist()
        whole = gains.sum(1, keepdims=True)
        shares = np.divide(gains, whole, out=np.zeros_like(gains), where=whole > 0)
        state = {
            "n_classes": a["n_classes"], "features": a["features"], "cuts": [c.tolist() for c in cuts], "importances": shares.mean(0).tolist(),
            "steps": [{"feature": t.feature.tolist(), "cut": t.cut.tolist(), "value": t.value.tolist(), "rate": t.rate} for t in steps],
        }
        return BoostedTreesModel(state)

    @staticmethod
    def _grown(blocks: RDD, cuts: list[np.ndarray], positives: list[int], a: dict[str, Any]) -> tuple[list[Trees], np.ndarray]:
        parts, depth, n_bins = len(positives), a["maxDepth"], max(len(c) for c in cuts) + 1
        steps: list[Trees] = []
        gains = np.zeros((parts, len(cuts)))
        reduce_depth = 1 if blocks.getNumPartitions() <= TASKS_TO_DRIVER else 2
        state, held = blocks, []
        try:
            for step in range(a["maxIter"]):
                grown = Trees(np.zeros((parts, 2**depth - 1), np.int64), np.full((parts, 2**depth - 1), n_bins, np.int64), np.zeros((parts, 2**depth)), 1.0 if step == 0 else a["stepSize"])
                sums = np.zeros(0)
                for level in range(depth):
                    # Below the root only the smaller side of every split is counted.
                    counted = _smaller_sides(sums, grown, level, n_bins) if level else np.zeros((parts, 1), np.int64)
                    if level and (counted < 0).all():
                        found = np.zeros((2, parts, len(cuts), 2 ** (level - 1) * n_bins))
                    else:
                        summed = functools.partial(_level_sums, grown, counted, step, positives, n_bins, a["subsamplingRate"], a["seed"])
                        found = state.mapPartitions(summed).treeReduce(np.add, reduce_depth)
                    sums = _both_sides(sums, found, counted, n_bins) if level else found
                    gains += _split(grown, level, sums, n_bins, 0.0 if a["weight"] else a["minInstancesPerNode"], a["minInfoGain"], level == depth - 1)
                    # The rows' new scores are kept once a job has worked them out; those before are no longer needed.
                    while len(held) > 1:
                        held.pop(0).unpersist()
                steps.append(grown)
                anew = len(steps) % STEPS_OF_LINEAGE == 0
                source, since = (blocks, list(steps)) if anew else (state, [grown])
                state = source.map(functools.partial(_with_scores, since, anew)).persist(StorageLevel.MEMORY_AND_DISK)
                held.append(state)
        finally:
            for rdd in held:
                rdd.unpersist()
        return steps, gains


class BoostedTreesModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Adds ``rawPrediction``, ``probability`` and ``prediction``. Probabilities of several classes are those of the parts, divided by their sum."""

    def __init__(self, state: dict | None = None):
        super().__init__()
        self.state = Param(self, "state", "cuts and trees")
        self._set(state=state or {})

    def copy(self, extra: dict | None = None) -> "BoostedTreesModel":
        return self

    @property
    def featureImportances(self) -> DenseVector:
        """Mean over the parts, each of which adds up to 1."""
        return Vectors.dense(self.getOrDefault(self.state)["importances"])

    def _transform(self, dataset: DataFrame) -> DataFrame:
        state = self.getOrDefault(self.state)
        n_classes = state["n_classes"]
        cuts = [np.array(c) for c in state["cuts"]]
        steps = [Trees(np.array(t["feature"], np.int64), np.array(t["cut"], np.int64), np.array(t["value"]), t["rate"]) for t in state["steps"]]
        parts = 1 if n_classes == 2 else n_classes

        @F.pandas_udf("array<double>")
        def scores(x: pd.Series) -> pd.Series:
            out = []
            for first in range(0, len(x), BLOCK_ROWS):
                some = x.iloc[first : first + BLOCK_ROWS]
                bins = binned(np.array(some.tolist(), dtype="float64").reshape(len(some), -1), cuts)
                found = np.zeros((parts, len(some)))
                for trees in steps:
                    trees.add_to(found, bins)
                out += list(found.T)
            return pd.Series(out, dtype="object")

        out = dataset.withColumn("rawPrediction", scores(vector_to_array(state["features"])))
        score = F.col("rawPrediction")
        own = F.transform(score, lambda m: 1 / (1 + F.exp(-2 * m)))
        if n_classes == 2:
            out = out.withColumn("probability", F.array(1 - own[0], own[0])).withColumn("rawPrediction", F.array(-score[0], score[0]))
            best = (score[1] > 0).cast("double")
        else:
            total = F.aggregate(own, F.lit(0.0), lambda t, p: t + p)
            out = out.withColumn("probability", F.transform(own, lambda p: F.coalesce(F.try_divide(p, total), F.lit(1.0 / n_classes))))
            best = (F.array_position(score, F.array_max(score)) - 1).cast("double")
        out = out.withColumn("prediction", best)
        return out.withColumn("probability", array_to_vector("probability")).withColumn("rawPrediction", array_to_vector("rawPrediction"))

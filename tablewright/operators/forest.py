"""Random forests whose trees grow together, level by level.

MLlib keeps a number per row and tree, and each of its tasks sends sums of all nodes as objects. Here rows are kept as one byte a
feature; how often a tree's sample has a row is drawn anew from the seed, and a row's node is found anew from the root. One job
serves a level of all trees, or a job for some trees at a time where their counts would take more than ``COUNT_BYTES`` of a
task: tasks count their rows by node, feature, bin and class, further tasks add these up and pick the splits, and the driver
gets the splits. Otherwise the trees are MLlib's: cuts between the values of a bounded sample, Gini impurity, Poisson
samples, some features drawn for every node, sides of one answer joined again.
"""

from __future__ import annotations

import base64
import functools
import io
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

from tablewright.operators.boosting import DEEPEST, TASK_ROWS, Block, binned, blocks_of, sampled_cuts

#: Rows that are worked on at a time, about: many for the counts of a level, few enough for a processor's cache.
BLOCK_ROWS = 131_072
#: A task has about so many rows where there are enough tasks for all cores: every task sends counts of all nodes.
ROWS_OF_TASK = 524_288
#: Bytes of the counts that a task holds.
COUNT_BYTES = 1 << 26
#: Rows that are scored at a time.
SCORED_ROWS = 16_384


def _poisson_table() -> np.ndarray:
    """The Poisson quantile (mean 1) of each of 65,536 equal parts of the unit interval."""
    reached = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(20)])
    return np.searchsorted(reached, (np.arange(65_536) + 0.5) / 65_536, side="right").astype(np.uint8)


POISSON = _poisson_table()


def drawn(seed: int, tree: int, block: Block, bootstrap: bool) -> np.ndarray:
    """How often the tree's sample has each row of the block."""
    n = len(block.target)
    if not bootstrap:
        return np.ones(n, np.uint8)
    return POISSON.take(np.frombuffer(np.random.default_rng([seed, tree, *block.number]).bytes(2 * n), np.uint16))


@dataclass
class Forest:
    """Level ``d`` of a tree begins at node 2^d - 1; a node that is not split sends all rows to the left."""

    feature: np.ndarray  # (trees, 2^depth - 1)
    cut: np.ndarray  # the last bin that goes to the left
    counts: np.ndarray  # (trees, 2^(depth + 1) - 1, classes)
    gain: np.ndarray  # (trees, 2^depth - 1), 0 where a node is not split
    n_bins: int

    @classmethod
    def empty(cls, trees: int, depth: int, n_classes: int, n_bins: int) -> "Forest":
        nodes = 2**depth - 1
        return cls(np.zeros((trees, nodes), np.int64), np.full((trees, nodes), n_bins, np.int64), np.zeros((trees, 2 * nodes + 1, n_classes)), np.zeros((trees, nodes)), n_bins)

    @property
    def depth(self) -> int:
        return self.feature.shape[1].bit_length()

    def prune(self) -> None:
        """Join leaves of one node that give the same answer, from below."""
        answer = self.counts.argmax(2)
        split = np.concatenate([self.gain > 0, np.zeros((len(self.gain), 2**self.depth), bool)], axis=1)
        for level in reversed(range(self.depth)):
            own = np.arange(2**level - 1, 2 ** (level + 1) - 1)
            left, right = 2 * own + 1, 2 * own + 2
            joined = split[:, own] & ~split[:, left] & ~split[:, right] & (answer[:, left] == answer[:, right])
            split[:, own] &= ~joined
        keep = split[:, : self.gain.shape[1]]
        self.feature, self.cut, self.gain = np.where(keep, self.feature, 0), np.where(keep, self.cut, self.n_bins), np.where(keep, self.gain, 0.0)

    def importances(self) -> np.ndarray:
        """Gain times rows by feature: shares of each tree, added up to shares."""
        n_features, size = int(self.feature.max(initial=0)) + 1, self.counts[:, : self.gain.shape[1]].sum(2)
        by_tree = np.stack([np.bincount(f, g * n, n_features) for f, g, n in zip(self.feature, self.gain, size)])
        whole = by_tree.sum(1, keepdims=True)
        total = np.divide(by_tree, whole, out=np.zeros_like(by_tree), where=whole > 0).sum(0)
        return total / total.sum() if total.sum() > 0 else total

    def shares(self) -> np.ndarray:
        """(tree, place in the last level, class): the shares of the classes in the leaf that sends its rows there."""
        trees, _, n_classes = self.counts.shape
        out = np.zeros((trees, 2**self.depth, n_classes))
        reached = np.ones((trees, 1), bool)
        for level in range(self.depth + 1):
            own = slice(2**level - 1, 2 ** (level + 1) - 1)
            split = self.gain[:, own] > 0 if level < self.depth else np.zeros_like(reached)
            tree, at = np.nonzero(reached & ~split)
            counts = self.counts[:, own][tree, at]
            out[tree, at << (self.depth - level)] = counts / np.maximum(counts.sum(1, keepdims=True), 1)
            reached = np.repeat(reached & split, 2, axis=1)
        return out


def places(feature: np.ndarray, cut: np.ndarray, flat: np.ndarray, n: int, rows: np.ndarray, depth: int) -> np.ndarray:
    """The place of some rows among the nodes of a level; ``flat`` has the bins, feature by feature, of ``n`` rows."""
    place = np.zeros(len(rows), np.int64)
    for level in range(depth):
        own = slice(2**level - 1, 2 ** (level + 1) - 1)
        at = (feature[own] * n).take(place)
        at += rows
        right = flat.take(at) > cut[own].take(place)
        place *= 2
        place += right
    return place


@dataclass
class Level:
    """What a job of a level needs: some trees so far, and of each the nodes to split with their features."""

    level: int
    trees: list[int]
    feature: list[np.ndarray]
    cut: list[np.ndarray]
    slot: list[np.ndarray]  # by place: the node's number among those to split, or -1
    drawn: list[np.ndarray]  # (node to split, feature)
    n_bins: int
    n_classes: int
    seed: int
    bootstrap: bool
    chunks: int

    def chunk(self, i: int) -> int:
        return i * self.chunks // len(self.trees)


def _level_counts(job: Level, blocks: Iterable[Block]) -> Iterator[tuple[int, tuple[int, np.ndarray]]]:
    """Of each tree the rows by drawn feature, node, bin and class, under the number of its chunk."""
    total: list[np.ndarray] = []
    of_node = job.n_bins * job.n_classes
    for block in blocks:
        total = total or [np.zeros((d.shape[1], len(d) * of_node), np.int32) for d in job.drawn]
        n, flat = len(block.target), block.bins.ravel()
        for i, tree in enumerate(job.trees):
            times = drawn(job.seed, tree, block, job.bootstrap)
            rows = np.flatnonzero(times)
            slot = job.slot[i].take(places(job.feature[i], job.cut[i], flat, n, rows, job.level))
            known = slot >= 0
            if not known.all():
                rows, slot = rows[known], slot[known]
            weight = times.take(rows).astype("float64")
            first = slot * of_node
            first += block.target.take(rows)
            for j, sums in enumerate(total[i]):
                at = (job.drawn[i][:, j] * n).take(slot)
                at += rows
                cell = np.multiply(flat.take(at), job.n_classes, dtype=np.int64)
                cell += first
                np.add(sums, np.bincount(cell, weight, len(sums)), out=sums, casting="unsafe")
    for i in range(len(total)):
        yield job.chunk(i), (i, total[i])


def _gini(counts: np.ndarray, n: np.ndarray) -> np.ndarray:
    out = np.ones(n.shape)
    for c in range(counts.shape[-1]):
        share = counts[..., c] / n
        out -= share * share
    return out


def _best_splits(job: Level, least_rows: int, least_gain: float, counted: Iterable[tuple[int, tuple[int, np.ndarray]]]) -> Iterator[tuple]:
    """(place of the tree in the job, feature, cut, gain, rows of the left and of the right by class) of the nodes of whole trees."""
    sums: dict[int, np.ndarray] = {}
    for _, (i, counts) in counted:
        if i in sums:
            sums[i] += counts
        else:
            sums[i] = counts.astype(np.int64)
    for i in list(sums):
        features = job.drawn[i]
        nodes, some = features.shape
        # (node, feature, bin, class)
        below = sums.pop(i).reshape(some, nodes, job.n_bins, job.n_classes).transpose(1, 0, 2, 3).cumsum(2)
        whole = below[:, 0, -1]
        above = whole[:, None, None] - below
        n, n_below, n_above = whole.sum(1)[:, None, None], below.sum(3), above.sum(3)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = _gini(whole, whole.sum(1))[:, None, None] - n_below / n * _gini(below, n_below) - n_above / n * _gini(above, n_above)
        gain[(n_below < max(least_rows, 1)) | (n_above < max(least_rows, 1)) | ~(gain >= least_gain)] = -np.inf
        best = gain.reshape(nodes, -1).argmax(1)
        which, cut = best // job.n_bins, best % job.n_bins
        own = np.arange(nodes)
        yield i, features[own, which], cut, gain[own, which, cut], below[own, which, cut], above[own, which, cut]


class ForestTrees(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """A random forest, by MLlib's names of the settings. Features are drawn as under MLlib's ``auto``: as many as the root of their number, for one tree all."""

    defaults: dict[str, Any] = {
        "n_classes": 2, "features": "features", "target": "target", "seed": 42, "numTrees": 20, "maxDepth": 5, "maxBins": 32, "minInstancesPerNode": 1, "minInfoGain": 0.0,
        "bootstrap": True, "featureSubsetStrategy": "auto",
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
        """Whether it has all these settings; MLlib's forests have more."""
        if args.get("featureSubsetStrategy", "auto") not in ("auto", "all", "sqrt"):
            return False
        return set(args) <= set(cls.defaults) and 1 <= args.get("maxDepth", 5) <= DEEPEST and 2 <= args.get("maxBins", 32) <= 255

    def _fit(self, dataset: DataFrame) -> "ForestTreesModel":
        a = self.getOrDefault(self.args)
        rows = dataset.select(F.col(a["features"]).alias("x"), F.col(a["target"]).alias("y"))
        n_rows = rows.count()
        if not n_rows:
            raise ValueError("no rows to learn from")
        cuts = sampled_cuts(rows, n_rows, a["maxBins"], a["seed"])
        cores = dataset.sparkSession.sparkContext.defaultParallelism
        tasks = max(math.ceil(n_rows / ROWS_OF_TASK), min(math.ceil(n_rows / TASK_ROWS), cores))
        blocks = blocks_of(rows.coalesce(tasks), cuts, False, 0, BLOCK_ROWS).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            forest = self._grown(blocks, len(cuts), max(len(c) for c in cuts) + 1, cores, a)
        finally:
            blocks.unpersist()
        forest.prune()
        importances = np.zeros(len(cuts))
        found = forest.importances()
        importances[: len(found)] = found
        state = {"n_classes": a["n_classes"], "features": a["features"], "cuts": [c.tolist() for c in cuts], "importances": importances.tolist()}
        return ForestTreesModel({**state, "trees": _packed(feature=forest.feature.astype(np.int32), cut=forest.cut.astype(np.int16), shares=forest.shares())})

    @staticmethod
    def _grown(blocks: RDD, n_features: int, n_bins: int, cores: int, a: dict[str, Any]) -> Forest:
        n_trees, depth, n_classes = a["numTrees"], a["maxDepth"], a["n_classes"]
        every = a["featureSubsetStrategy"] == "all" or (a["featureSubsetStrategy"] == "auto" and n_trees == 1)
        some = n_features if every else math.ceil(math.sqrt(n_features))
        forest, seed = Forest.empty(n_trees, depth, n_classes, n_bins), a["seed"] % 2**63
        open_nodes = [np.zeros(1, np.int64) for _ in range(n_trees)]
        for level in range(depth):
            draws = np.random.default_rng([seed, level, n_trees])
            features = [np.sort(draws.random((len(nodes), n_features)).argsort(1)[:, :some], axis=1) for nodes in open_nodes]
            size = n_bins * n_classes * some * 4
            for trees in _bands([len(nodes) * size for nodes in open_nodes]):
                slots = []
                for t in trees:
                    slot = np.full(2**level, -1, np.int64)
                    slot[open_nodes[t]] = np.arange(len(open_nodes[t]))
                    slots.append(slot)
                upto = 2**level - 1
                job = Level(
                    level, trees, [forest.feature[t, :upto] for t in trees], [forest.cut[t, :upto] for t in trees], slots, [features[t] for t in trees],
                    n_bins, n_classes, seed, a["bootstrap"], min(len(trees), 2 * cores),
                )
                counted = blocks.mapPartitions(functools.partial(_level_counts, job)).partitionBy(job.chunks, int)
                picked = counted.mapPartitions(functools.partial(_best_splits, job, a["minInstancesPerNode"], a["minInfoGain"])).collect()
                for i, feature, cut, gain, below, above in picked:
                    open_nodes[trees[i]] = _write(forest, trees[i], level, open_nodes[trees[i]], feature, cut, gain, below, above)
        return forest


def _bands(sizes: list[int]) -> Iterator[list[int]]:
    """Trees with nodes to split, as many at a time as ``COUNT_BYTES`` hold (one at least)."""
    band: list[int] = []
    held = 0
    for tree, size in enumerate(sizes):
        if not size:
            continue
        if band and held + size > COUNT_BYTES:
            yield band
            band, held = [], 0
        band.append(tree)
        held += size
    if band:
        yield band


def _write(forest: Forest, tree: int, level: int, nodes: np.ndarray, feature: np.ndarray, cut: np.ndarray, gain: np.ndarray, below: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Put the splits of a level's nodes into the tree; returns the places in the next level that are to be split."""
    at = 2**level - 1 + nodes
    if level == 0:
        forest.counts[tree, 0] = (below + above)[0]
    split = gain > 0
    at, below, above = at[split], below[split], above[split]
    forest.feature[tree, at], forest.cut[tree, at], forest.gain[tree, at] = feature[split], cut[split], gain[split]
    forest.counts[tree, 2 * at + 1], forest.counts[tree, 2 * at + 2] = below, above
    if level + 1 == forest.depth:
        return nodes[:0]
    mixed = np.stack([(side > 0).sum(1) > 1 for side in (below, above)], axis=1)
    return np.stack([2 * nodes[split], 2 * nodes[split] + 1], axis=1)[mixed]


def _packed(**arrays: np.ndarray) -> str:
    out = io.BytesIO()
    np.savez_compressed(out, **arrays)
    return base64.b64encode(out.getvalue()).decode()


class ForestTreesModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Adds ``rawPrediction`` (shares of the classes, added up over the trees), ``probability`` and ``prediction``."""

    def __init__(self, state: dict | None = None):
        super().__init__()
        self.state = Param(self, "state", "cuts and trees")
        self._set(state=state or {})

    def copy(self, extra: dict | None = None) -> "ForestTreesModel":
        return self

    @property
    def featureImportances(self) -> DenseVector:
        return Vectors.dense(self.getOrDefault(self.state)["importances"])

    def _transform(self, dataset: DataFrame) -> DataFrame:
        state = self.getOrDefault(self.state)
        cuts = [np.array(c) for c in state["cuts"]]
        with np.load(io.BytesIO(base64.b64decode(state["trees"]))) as trees:
            feature, cut, shares = trees["feature"].astype(np.int64), trees["cut"], trees["shares"]
        depth, n_classes = feature.shape[1].bit_length(), state["n_classes"]

        @F.pandas_udf("array<double>")
        def votes(x: pd.Series) -> pd.Series:
            out = []
            for first in range(0, len(x), SCORED_ROWS):
                some = x.iloc[first : first + SCORED_ROWS]
                n = len(some)
                flat, rows = binned(np.array(some.tolist(), dtype="float64").reshape(n, -1), cuts).ravel(), np.arange(n)
                found = np.zeros((n, n_classes))
                for f, c, s in zip(feature, cut, shares):
                    found += s.take(places(f, c, flat, n, rows, depth), axis=0)
                out += list(found)
            return pd.Series(out, dtype="object")

        out = dataset.withColumn("rawPrediction", votes(vector_to_array(state["features"])))
        raw = F.col("rawPrediction")
        total = F.aggregate(raw, F.lit(0.0), lambda t, v: t + v)
        out = out.withColumn("probability", F.transform(raw, lambda v: F.coalesce(F.try_divide(v, total), F.lit(0.0))))
        out = out.withColumn("prediction", (F.array_position(raw, F.array_max(raw)) - 1).cast("double"))
        return out.withColumn("probability", array_to_vector("probability")).withColumn("rawPrediction", array_to_vector("rawPrediction"))

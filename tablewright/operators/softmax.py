"""Multinomial logistic regressions on the rows of all folds but one, from rows that are encoded once.

The rows are kept as blocks of standardised columns, parted by fold. A fit takes a job for each value and gradient of its loss.
Steps are L-BFGS's; its first matrix is the inverse of a bound on the second derivatives, which follows from sums of products
of the columns (Boehning 1992), and a fit may begin where one with more columns ended. Both save jobs; without a penalty neither moves the optimum.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values and steps that L-BFGS remembers, and the values over which the loss must have come to rest.
MEMORY = 10
REST = 5
#: Sums of more tasks are added up by tasks before the driver gets them.
TASKS_TO_DRIVER = 32

#: Of each fold the columns, one row a record, and the classes.
Block = dict[int, tuple[np.ndarray, np.ndarray]]


def _encoded(rows: DataFrame, features: list[str], target: str, fold: str, mean: np.ndarray, scale: np.ndarray) -> RDD:
    columns = [F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)]

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = (batch[[f"x{i}" for i in range(len(features))]].to_numpy(dtype="float64") - mean) * scale
            for part in np.unique(batch["part"]):
                own = (batch["part"] == part).to_numpy()
                yield pd.DataFrame({"part": [int(part)], "x": [x[own].tobytes()], "y": [batch["y"].to_numpy(dtype="int64")[own].tobytes()]})

    def unpack(packed: Iterable) -> Iterator[Block]:
        for row in packed:
            yield {row["part"]: (np.frombuffer(row["x"]).reshape(-1, len(features)), np.frombuffer(row["y"], np.int64))}

    plain = rows.select(*columns, F.col(target).cast("int").alias("y"), F.col(fold).cast("int").alias("part"))
    return plain.mapInPandas(encode, "part int, x binary, y binary").rdd.mapPartitions(unpack)


def _loss(weights: np.ndarray, skip: int | None, blocks: Iterable[Block]) -> Iterator[np.ndarray]:
    """The gradient by column (the constant last) and class, and below it the loss."""
    out = np.zeros((len(weights) + 1, weights.shape[1]))
    for block in blocks:
        for part, (x, y) in block.items():
            if part == skip:
                continue
            # Class by class, so that a row's few classes are not the inner loop.
            z = weights[:-1].T @ x.T
            z += weights[-1][:, None]
            z -= z.max(0)
            at = np.arange(len(y))
            out[-1, 0] -= z[y, at].sum()
            np.exp(z, out=z)
            whole = z.sum(0)
            out[-1, 0] += np.log(whole).sum()
            z /= whole
            z[y, at] -= 1
            out[:-2] += (z @ x).T
            out[-2] += z.sum(1)
    yield out


def _hits(weights: np.ndarray, fold: int, blocks: Iterable[Block]) -> Iterator[int]:
    yield sum(int(((weights[:-1].T @ x.T + weights[-1][:, None]).argmax(0) == y).sum()) for block in blocks for part, (x, y) in block.items() if part == fold)


class FoldedSoftmax:
    """Fits over one frame; ``sums`` has each fold's ``Sums`` of the features (the target last). Use as a context: it keeps its blocks."""

    def __init__(self, rows: DataFrame, features: list[str], target: str, fold: str, n_classes: int, sums: dict[int, Any], maxIter: int = 100, tol: float = 1e-6):
        total = functools.reduce(lambda a, b: a + b, sums.values())
        spread = np.sqrt(np.maximum(np.diag(total.covariance), 0.0))[:-1]
        known = spread > 1e-7 * np.sqrt(np.maximum(np.diag(total.products)[:-1] / total.n, 0.0))
        #: A column without variance counts as 0 everywhere.
        self.scale = np.divide(1.0, spread, out=np.zeros_like(spread), where=known)
        self.mean = (total.mean + total.start)[:-1]
        self.centre, self.sums, self.total = total.mean[:-1], sums, total
        self.n_classes, self.most, self.tol = n_classes, maxIter, tol
        self.blocks = _encoded(rows, features, target, fold, self.mean, self.scale).persist(StorageLevel.MEMORY_AND_DISK)
        self.depth = 1 if self.blocks.getNumPartitions() <= TASKS_TO_DRIVER else 2

    def __enter__(self) -> "FoldedSoftmax":
        return self

    def __exit__(self, *error: Any) -> None:
        self.blocks.unpersist()

    def _products(self, used: list[int], skip: int | None) -> tuple[np.ndarray, float]:
        """Mean products of the standardised columns and the constant over a fit's rows, and their number."""
        own = self.total if skip is None else self.total - self.sums[skip]
        first, products = own.first[:-1], own.products[:-1, :-1]
        c = self.centre
        products = (products - np.outer(first, c) - np.outer(c, first) + own.n * np.outer(c, c)) * np.outer(self.scale, self.scale)
        first = (first - own.n * c) * self.scale
        whole = np.block([[products, first[:, None]], [first[None, :], np.array([[own.n]])]])
        at = [*used, len(c)]
        return whole[np.ix_(at, at)] / own.n, own.n

    def fit(self, used: list[int], skip: int | None, start: np.ndarray | None = None) -> np.ndarray:
        """Weights by column (the constant last) and class, on the rows of all folds but ``skip``."""
        products, n = self._products(used, skip)
        first_matrix = 2 * np.linalg.pinv(products)

        def loss(weights: np.ndarray) -> tuple[float, np.ndarray]:
            found = self.blocks.mapPartitions(functools.partial(_loss, self._of_all(used, weights), skip)).treeReduce(np.add, self.depth) / n
            return float(found[-1, 0]), found[[*used, len(self.scale)]]

        at = np.zeros((len(used) + 1, self.n_classes)) if start is None else start
        value, gradient = loss(at)
        values, past = [value], []
        for _ in range(self.most):
            step = -_turned(gradient, past, first_matrix)
            slope = float((step * gradient).sum())
            if not slope < 0:
                break
            size = 1.0
            while True:
                new_value, new_gradient = loss(at + size * step)
                if new_value <= value + 1e-4 * size * slope or size < 1e-6:
                    break
                size /= 2
            if not new_value < value:
                break
            past = [*past, (size * step, new_gradient - gradient)][-MEMORY:]
            at, value, gradient = at + size * step, new_value, new_gradient
            values.append(value)
            if len(values) > REST and values[-1 - REST] - value <= self.tol * math.log(self.n_classes):
                break
        return at

    def hits(self, used: list[int], weights: np.ndarray, fold: int) -> int:
        """How many rows of the fold get their class."""
        return self.blocks.mapPartitions(functools.partial(_hits, self._of_all(used, weights), fold)).sum()

    def _of_all(self, used: list[int], weights: np.ndarray) -> np.ndarray:
        """The weights with those of the columns that are not used, which are 0."""
        out = np.zeros((len(self.scale) + 1, self.n_classes))
        out[[*used, len(self.scale)]] = weights
        return out

    def coefficients(self, used: list[int], weights: np.ndarray) -> np.ndarray:
        """By class and column, of the columns as they came."""
        return (weights[:-1] * self.scale[used, None]).T


def _turned(gradient: np.ndarray, past: list[tuple[np.ndarray, np.ndarray]], first_matrix: np.ndarray) -> np.ndarray:
    """L-BFGS's approximate inverse of the second derivatives, times the gradient."""
    q, kept = gradient.copy(), []
    for s, y in reversed(past):
        rho = 1 / max(float((s * y).sum()), 1e-300)
        alpha = rho * float((s * q).sum())
        q -= alpha * y
        kept.append((s, y, rho, alpha))
    r = first_matrix @ q
    if past:
        s, y = past[-1]
        r *= float((s * y).sum()) / max(float((y * (first_matrix @ y)).sum()), 1e-300)
    for s, y, rho, alpha in reversed(kept):
        r += s * (alpha - rho * float((y * r).sum()))
    return r

"""Hard negatives by exact integer scores, in the manner of the Four Russians.

A candidate's whole components are stored as bit planes: of every eight neighbouring dimensions, the bits
of one plane make a byte. For an anchor, a table per eight dimensions holds the sum of its
components over every subset of the eight. A score is then a sum of table entries, looked up
by the candidate's bytes and shifted by plane; the last plane carries the sign.

Candidates are dealt to shards by hash, whatever their label, and blocks of anchors stream through
every shard. Equal vectors of one label are stored once, with as many ids as a result can need.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.meetings import BLOCK_QUERIES, collapse, groups, meet, scaled_vectors, shard_count, stacked, values, vectors, whole_numbers, within_long
from tablewright.session import cut_lineage

SCALE = 256
POSITIVES = 5
NEGATIVES = 10
#: Hundredths of the positive's score between which a negative's lies.
LOWEST, HIGHEST = 30, 90
ANCHORS_EVERY = 100
#: Anchors scored together, and candidates looked up at a time: their sums fit the processor's caches.
TOGETHER = 16
CHUNK = 4_096
KEYS = ["dim", "shard", "block"]

FOUND = pa.schema([("ano", pa.int64()), ("level", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


class BitPlanes:
    """Whole vectors as packed bytes, ``packed[plane, group, row]``."""

    def __init__(self, vecs: np.ndarray):
        self.n = len(vecs)
        size = np.abs(vecs).max() if vecs.size else 0.0
        whole = vecs.astype(np.int64) if size < 2.0**52 else whole_numbers(vecs)
        self.planes = int(size).bit_length() + 1
        n_groups = math.ceil(vecs.shape[1] / 8)
        self.packed = np.zeros((self.planes, n_groups, self.n), np.uint8)
        for plane in range(self.planes):
            # Python's and numpy's shift keep the sign, so the last plane is the sign of two's complement.
            bits = ((whole >> plane) & 1).astype(np.uint8)
            padded = np.zeros((self.n, n_groups * 8), np.uint8)
            padded[:, : vecs.shape[1]] = bits
            self.packed[plane] = np.packbits(padded, axis=1, bitorder="little").T

    def weight(self, plane: int) -> int:
        return -(1 << plane) if plane == self.planes - 1 else 1 << plane


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """``table[group, byte, anchor]``: sum of the anchor's components whose bits are set in the byte."""
    n, dim = anchors.shape
    n_groups = math.ceil(dim / 8)
    padded = np.zeros((n, n_groups * 8), anchors.dtype)
    padded[:, :dim] = anchors
    parts = padded.reshape(n, n_groups, 8)
    table = np.zeros((n_groups, 256, n), anchors.dtype)
    for d in range(8):
        table[:, 1 << d : 2 << d] = table[:, : 1 << d] + parts[:, :, d].T[:, None, :]
    return table


def scores(candidates: BitPlanes, anchors: np.ndarray, begin: int = 0, end: int | None = None) -> np.ndarray:
    """Exact inner products, (candidate, anchor), of the candidates from ``begin`` to ``end``, cut to longs."""
    end = candidates.n if end is None else end
    # No partial sum, also a hundredfold, may leave 64 bits; else Python integers are used.
    reach = float(np.abs(anchors).sum(1).max(initial=0.0)) * 2.0**candidates.planes * 128
    table = subset_sums(anchors.astype(np.int64) if reach < 2.0**63 else whole_numbers(anchors))
    out = np.zeros((end - begin, len(anchors)), table.dtype)
    for a in range(begin, end, CHUNK):
        b = min(end, a + CHUNK)
        for plane in range(candidates.planes):
            part = np.zeros((b - a, len(anchors)), table.dtype)
            for group in range(len(table)):
                part += table[group].take(candidates.packed[plane, group, a:b], axis=0)
            out[a - begin : b - begin] += part * candidates.weight(plane)
    return within_long(out) if out.dtype == object else out


def first_ids(found: np.ndarray, rows: np.ndarray, ids: list, own: int | None, k: int) -> list[tuple[int, int]]:
    """(score, id) of the best ``k`` ids among ``rows``, ties by id."""
    if len(rows) > k + 1:
        # All rows that score as much as the (k+1)-th: one of the k before may hold the own id alone.
        least = np.partition(found[rows], len(rows) - k - 1)[len(rows) - k - 1]
        rows = rows[found[rows] >= least]
    pairs = sorted((-int(found[r]), i) for r in rows.tolist() for i in ids[r] if i != own)
    return [(-minus, i) for minus, i in pairs[:k]]


class Shard:
    """Candidates of one shard, ordered by label."""

    def __init__(self, stored: list[pa.RecordBatch]):
        self.labels = values(stored, "label")
        self.ids = [i for b in stored for i in b.column("ids").to_pylist()]
        self.planes = BitPlanes(stacked(stored, "vec"))

    def of_label(self, label: int) -> tuple[int, int]:
        return int(np.searchsorted(self.labels, label)), int(np.searchsorted(self.labels, label, side="right"))


def _positives(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for stored, asked in groups(batches, KEYS):
        shard = Shard(stored) if stored else None
        for part in asked:
            out: tuple[list, ...] = ([], [], [], [])
            labels, vecs = part.column("label").to_numpy(), vectors(part.column("vec"))
            anos, owns = part.column("ano").to_pylist(), part.column("anchor_id").to_pylist()
            for label in np.unique(labels).tolist() if shard else []:
                begin, end = shard.of_label(label)
                mine = np.flatnonzero(labels == label)
                for a in range(0, len(mine) if begin < end else 0, TOGETHER):
                    some = mine[a : a + TOGETHER]
                    found = scores(shard.planes, vecs[some], begin, end)
                    for column, i in enumerate(some.tolist()):
                        for score, j in first_ids(found[:, column], np.arange(end - begin), shard.ids[begin:end], owns[i], k):
                            _add(out, anos[i], None, j, score)
            yield _batch(out)


def _negatives(batches: Iterator[pa.RecordBatch], k: int, lowest: int, highest: int) -> Iterator[pa.RecordBatch]:
    for stored, asked in groups(batches, KEYS):
        shard = Shard(stored) if stored else None
        for part in asked:
            out: tuple[list, ...] = ([], [], [], [])
            rows = part.select(["ano", "label", "levels"]).to_pylist() if shard else []
            vecs = vectors(part.column("vec"))
            for a in range(0, len(rows), TOGETHER):
                found = scores(shard.planes, vecs[a : a + TOGETHER])
                for column, r in enumerate(rows[a : a + TOGETHER]):
                    of, (begin, end) = found[:, column], shard.of_label(r["label"])
                    for level in r["levels"]:
                        fits = (of * 100 >= lowest * level) & (of * 100 <= highest * level)
                        fits[begin:end] = False
                        for score, j in first_ids(of, np.flatnonzero(fits), shard.ids, None, k):
                            _add(out, r["ano"], level, j, score)
            yield _batch(out)


def _add(out: tuple[list, ...], ano: int, level: int | None, j: int, score: int) -> None:
    for column, value in zip(out, (ano, level, j, score)):
        column.append(value)


def _batch(out: tuple[list, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, FOUND)], schema=FOUND)


def _met(rows: DataFrame, anchors: DataFrame, shards: int, blocks: int, *extra: str) -> DataFrame:
    """Every anchor with every shard of its vector length."""
    stored = rows.withColumn("shard", F.pmod(F.xxhash64("vec", "label"), F.lit(shards)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = anchors.select("ano", "anchor_id", "label", "vec", F.size("vec").alias("dim"), *extra, F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.pmod(F.xxhash64("ano"), F.lit(blocks)).cast("int").alias("block"))
    return meet(stored, asked, KEYS, ["label", "ano"])


def hard_negatives(
    df: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, lowest: int = LOWEST, highest: int = HIGHEST, scale: int = SCALE,
    id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    A score is the inner product of floor(``scale`` * x) over the components, ordered from the highest, ties by
    smaller id. An anchor's positives are its first ``positives`` other rows of its label; for each, the first
    ``negatives`` rows of other labels whose score is between ``lowest`` and ``highest`` hundredths of
    the positive's. ``label_col`` holds whole numbers. Rows with a null id, label or vector, with a null or
    non-finite component or one whose product with ``scale`` is no finite double take no part, nor do vectors of another length
    meet an anchor. Rows equal in id, label and scaled vector count once; rows of one id that
    differ count each, as anchors too. A score beyond a long counts as its end. Other columns are ignored; empty tables give no rows.
    """
    label = F.col(label_col).cast("long").alias("label")
    known = F.col("label").isNotNull()
    rows = collapse(scaled_vectors(df, scale, id_col, vec_col, label).where(known), max(positives + 1, negatives), ["label", "vec"])
    rows = cut_lineage(rows.withColumn("dim", F.size("vec")))
    # Written once, so that the numbers stay what they are.
    chosen = scaled_vectors(anchors, scale, id_col, vec_col, label).where(known).distinct()
    chosen = cut_lineage(chosen.select(F.monotonically_increasing_id().alias("ano"), F.col("id").alias("anchor_id"), "label", "vec"))
    shards = shard_count(rows.count(), df.sparkSession.sparkContext.defaultParallelism)
    blocks = max(1, math.ceil(chosen.count() / BLOCK_QUERIES))

    schema = "ano long, level long, vec_id long, score long"
    best = Window.partitionBy("ano").orderBy(F.desc("score"), "vec_id")
    same = _met(rows, chosen, shards, blocks).mapInArrow(lambda b: _positives(b, positives), schema)
    same = same.withColumn("place", F.row_number().over(best)).where(F.col("place") <= positives)
    pairs = cut_lineage(same.select("ano", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    # At most ``positives`` numbers per anchor.
    levels = pairs.groupBy("ano").agg(F.array_sort(F.collect_set("positive_score")).alias("levels"))
    asked = chosen.join(levels, "ano")
    other = _met(rows, asked, shards, blocks, "levels").mapInArrow(lambda b: _negatives(b, negatives, lowest, highest), schema)
    within = Window.partitionBy("ano", "level").orderBy(F.desc("score"), "vec_id")
    other = other.withColumn("rank", F.row_number().over(within)).where(F.col("rank") <= negatives)
    other = other.select("ano", F.col("level").alias("positive_score"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = pairs.join(other, ["ano", "positive_score"]).join(chosen.select("ano", "anchor_id"), "ano")
    return named.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def mine_embeddings(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``hard_negatives`` of rows whose id is divisible by 100; first, labels of ids divisible by 7 move on to the next of ten."""
    moved = F.when(F.col(id_col) % 7 == 0, (F.col(label_col) + 1) % 10).otherwise(F.col(label_col)).cast("long")
    rows = df.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("embedding"), moved.alias("label"))
    return hard_negatives(rows, rows.where(F.col("vec_id") % ANCHORS_EVERY == 0))

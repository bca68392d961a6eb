"""Nearest neighbours, synthetic minority rows and Tomek links.

``nearest`` is an exact partitioned join. A tree over a bounded sample cuts the space into cells
of about ``CELL_ROWS`` base rows, and neighbouring cells make a part. Every query row first meets its own part, which
gives a bound on its k-th distance; then it is sent once to each other part with a cell whose bounding box is
nearer than its own bound. Where they meet, a row is compared with the cells of the part that are near enough, by one
product of matrices; distances are measured, dimension by dimension, only where the product leaves a doubt. An outlier
widens nobody's search but its own. Parts are cut into blocks of bounded size, a block keeps k candidates
per query row, and vectors of neighbours are joined after the last merge.

In many dimensions boxes exclude little, and rows meet nearly all parts: meetings stay quadratic, but rows move once per
part and not per cell. With ``bits`` other parts are searched by a table of
approximations (one byte per dimension, ``operators/vector_codes.py``): what travels and is scanned are codes,
and only vectors that the bounds cannot exclude are fetched, each moved once. The result stays exact. ``probes``
limits the cells searched per row to the nearest ones, which makes the result approximate.

Copies of one vector need no more than k + 1 of their keys as candidates, so a vector
that fills a third of the table does not make a large block.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, GroupedData, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.hashing import hash_uniform
from tablewright.operators import vector_codes
from tablewright.operators.sample import random_sample
from tablewright.session import cut_lineage

#: Base rows of a cell, sampled rows per cell, and most cells of the tree on the driver; larger tables get larger
#: cells, which are searched block by block.
CELL_ROWS = 1024
SAMPLE_PER_CELL = 8
MAX_CELLS = 65_536
BLOCK = 2048
#: A part has about one in ``PARTS`` of the base rows, and at most so many rows and bytes of vectors.
PARTS = 8
PART_ROWS = 65_536
PART_BYTES = 1 << 24
#: Query rows that are compared at a time, and dimensions from which on single precision does for the doubtless ones.
TILE = 1024
SINGLE_FROM = 16
# Relative slack against rounding in the bounds; it can only add candidates.
SLACK = 1e-9


def _distances(rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Euclidean distances, summed dimension by dimension."""
    out = np.zeros((len(rows), len(others)))
    for d in range(rows.shape[1]):
        step = rows[:, d, None] - others[None, :, d]
        out += step * step
    return np.sqrt(out)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype="float64").reshape(len(column), -1)


def as_vectors(df: DataFrame, key: str, features: list[str], *payload: str) -> DataFrame:
    """``(row_key, vec, payload…)`` with the features as one array; rows with nulls are left out."""
    vec = F.array(*[F.col(c).cast("double") for c in features])
    return df.na.drop(subset=features).select(F.col(key).alias("row_key"), vec.alias("vec"), *payload)


@dataclass
class CellTree:
    """Median cuts of a sample. Node i is a leaf (cell) where ``cut_at[i]`` is -1."""

    cut_at: np.ndarray  # dimension
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    cell: np.ndarray
    n_cells: int
    low: np.ndarray | None = None  # bounding box of the base rows under a node
    high: np.ndarray | None = None

    @classmethod
    def build(cls, sample: np.ndarray, n_cells: int) -> "CellTree":
        nodes: list[list] = []
        cells = 0

        def grow(rows: np.ndarray, want: int) -> int:
            nonlocal cells
            at = len(nodes)
            nodes.append([-1, 0.0, -1, -1, -1])
            spread = rows.max(0) - rows.min(0) if len(rows) else np.zeros(1)
            d = int(spread.argmax())
            cut = float(np.median(rows[:, d])) if want > 1 and len(rows) > 1 else 0.0
            under = rows[:, d] < cut if want > 1 and len(rows) > 1 else None
            if under is None or spread[d] == 0 or under.all() or not under.any():
                nodes[at][4] = cells
                cells += 1
                return at
            nodes[at][:2] = d, cut
            nodes[at][2] = grow(rows[under], want // 2)
            nodes[at][3] = grow(rows[~under], want - want // 2)
            return at

        grow(sample, n_cells)
        columns = list(zip(*nodes))
        return cls(np.array(columns[0]), np.array(columns[1]), np.array(columns[2]), np.array(columns[3]), np.array(columns[4]), cells)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rows), np.int32)
        todo = [(0, np.arange(len(rows)))]
        while todo:
            node, some = todo.pop()
            if self.cut_at[node] < 0:
                out[some] = self.cell[node]
                continue
            under = rows[some, self.cut_at[node]] < self.cut[node]
            for child, part in ((self.left[node], some[under]), (self.right[node], some[~under])):
                if len(part):
                    todo.append((child, part))
        return out

    def set_boxes(self, low: np.ndarray, high: np.ndarray) -> None:
        """Boxes of the cells (infinite and reversed where a cell has no base rows), joined upwards."""
        self.low = np.full((len(self.cut_at), low.shape[1]), np.inf)
        self.high = np.full_like(self.low, -np.inf)
        for node in range(len(self.cut_at) - 1, -1, -1):
            if self.cut_at[node] < 0:
                self.low[node], self.high[node] = low[self.cell[node]], high[self.cell[node]]
            else:
                kids = [self.left[node], self.right[node]]
                self.low[node], self.high[node] = self.low[kids].min(0), self.high[kids].max(0)

    def within(self, rows: np.ndarray, bound: np.ndarray) -> list[list[tuple[float, int]]]:
        """For each row: (distance of the box, cell) of the cells not farther than its bound."""
        found: list[list[tuple[float, int]]] = [[] for _ in rows]
        todo = [(0, np.arange(len(rows)))]
        while todo:
            node, some = todo.pop()
            gap = np.maximum(np.maximum(self.low[node] - rows[some], rows[some] - self.high[node]), 0)
            away = np.sqrt((gap * gap).sum(1))
            near = away <= bound[some] * (1 + SLACK) + SLACK
            near &= np.isfinite(away)
            some, away = some[near], away[near]
            if not len(some):
                continue
            if self.cut_at[node] < 0:
                for i, d in zip(some.tolist(), away.tolist()):
                    found[i].append((d, int(self.cell[node])))
            else:
                todo += [(self.left[node], some), (self.right[node], some)]
        return found

    def near_parts(self, rows: np.ndarray, bound: np.ndarray, span: int) -> np.ndarray:
        """For each row and part of ``span`` cells, whether one of them is not farther than the row's bound."""
        near = np.zeros((len(rows), -(-self.n_cells // span)), bool)
        reach = bound * (1 + SLACK) + SLACK
        todo = [(0, np.arange(len(rows)))]
        while todo:
            node, some = todo.pop()
            if self.cut_at[node] < 0:
                some = some[~near[some, self.cell[node] // span]]
            gap = np.maximum(np.maximum(self.low[node] - rows[some], rows[some] - self.high[node]), 0)
            away = np.sqrt((gap * gap).sum(1))
            some = some[(away <= reach[some]) & np.isfinite(away)]
            if not len(some):
                continue
            if self.cut_at[node] < 0:
                near[some, self.cell[node] // span] = True
            else:
                todo += [(self.left[node], some), (self.right[node], some)]
        return near


def _in_cells(rows: DataFrame, tree: CellTree) -> DataFrame:
    @F.pandas_udf("int")
    def locate(vec: pd.Series) -> pd.Series:
        return pd.Series(tree.locate(_matrix(vec)) if len(vec) else [], dtype="int32")

    return rows.withColumn("cell", locate("vec"))


def _meetings(sent: DataFrame, placed: DataFrame, blocks: DataFrame, sent_columns: list[str], placed_columns: list[str], block: int | None = None) -> tuple[GroupedData, GroupedData]:
    """Every block of the sent rows (columns ``q_<name>``) with every block of the base rows of its cell, to be cogrouped."""
    own = F.pmod(F.xxhash64(F.col("row_key")), F.lit(1 << 30))
    counted = sent.groupBy("cell").agg(F.count("*").alias("n"))
    layout = blocks.join(counted, "cell").select("cell", "b_blocks", F.ceil(F.col("n") / (block or BLOCK)).cast("int").alias("q_blocks"))
    q_side = (
        sent.join(layout, "cell")
        .withColumn("q_block", (own % F.col("q_blocks")).cast("int"))
        .withColumn("b_block", F.explode(F.sequence(F.lit(0), F.col("b_blocks") - 1)))
        .select(F.col("cell").alias("q_cell"), "q_block", F.col("b_block").alias("q_b_block"), *[F.col(c).alias(f"q_{c}") for c in ["row_key", *sent_columns]])
    )
    b_side = (
        placed.join(layout, "cell")
        .withColumn("b_block", (own % F.col("b_blocks")).cast("int"))
        .withColumn("for_block", F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1)))
        .select("cell", "for_block", "b_block", "row_key", *placed_columns)
    )
    return q_side.groupBy("q_cell", "q_block", "q_b_block"), b_side.groupBy("cell", "for_block", "b_block")


class _Base:
    """Base rows of a block, cell by cell, made ready for products with query rows. Rows that are not finite are left out."""

    def __init__(self, vec: np.ndarray, leaf: np.ndarray):
        self.at = np.flatnonzero(np.isfinite(vec).all(1))
        self.at = self.at[np.argsort(leaf[self.at], kind="stable")]
        self.vec = vec[self.at]
        leaf = leaf[self.at]
        starts = np.flatnonzero(np.concatenate([[True], leaf[1:] != leaf[:-1]])) if len(leaf) else np.zeros(0, int)
        self.cells = list(zip(starts.tolist(), [*starts[1:].tolist(), len(leaf)]))
        self.low = np.minimum.reduceat(self.vec, starts) if len(leaf) else self.vec
        self.high = np.maximum.reduceat(self.vec, starts) if len(leaf) else self.vec
        self.kind = np.float32 if vec.shape[1] >= SINGLE_FROM and np.abs(self.vec).max(initial=0) < 1e15 else np.float64
        # Products of all sides of a distance, each cell around its own centre: x x - 2 x y + y y.
        self.centres, self.factors, self.sizes = [], [], []
        for a, b in self.cells:
            centre = self.vec[a:b].mean(0)
            x = self.vec[a:b] - centre
            size = (x * x).sum(1)
            self.centres.append(centre)
            self.factors.append(np.column_stack([-2 * x, size, np.ones(len(x))]).astype(self.kind).T)
            self.sizes.append(math.sqrt(size.max()))

    def gaps(self, rows: np.ndarray) -> np.ndarray:
        """Distance of every row to the box of every cell."""
        out = np.zeros((len(rows), len(self.cells)))
        for d in range(rows.shape[1]):
            gap = np.maximum(np.maximum(self.low[None, :, d] - rows[:, d, None], rows[:, d, None] - self.high[None, :, d]), 0)
            out += gap * gap
        return np.sqrt(out)

    def products(self, rows: np.ndarray, cell: int) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of the rows to a cell's rows, and for each row by how much they may be wrong."""
        y = rows - self.centres[cell]
        size = (y * y).sum(1)
        with np.errstate(over="ignore", invalid="ignore"):
            squares = np.column_stack([y, np.ones(len(y)), size]).astype(self.kind) @ self.factors[cell]
        wrong = (4 * rows.shape[1] + 32) * np.finfo(self.kind).eps * (np.sqrt(size) + self.sizes[cell]) ** 2
        return squares, wrong + np.finfo(self.kind).tiny


def _nearest_in_block(rows: np.ndarray, keys: np.ndarray, reach: np.ndarray, base: _Base, base_keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, base row, distance) of the k nearest base rows within the reach of each row, ties by the order of the base rows."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    enough = k + _most_of_a_key(base_keys)
    for first in range(0, len(rows), TILE):
        tile = np.arange(first, min(first + TILE, len(rows)))
        tile = tile[np.isfinite(rows[tile]).all(1)]
        if not len(tile) or not base.cells:
            continue
        near, limit = base.gaps(rows[tile]), reach[tile].astype("float64")
        home = near.argmin(1)
        best = (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        # A row's nearest cell first: it draws the limit in.
        for own in (True, False):
            for cell, (a, b) in enumerate(base.cells):
                some = np.flatnonzero((home == cell) == own)
                some = some[near[some, cell] <= limit[some] * (1 + SLACK) + SLACK]
                if not len(some):
                    continue
                squares, wrong = base.products(rows[tile[some]], cell)
                with np.errstate(over="ignore"):
                    most = (limit[some] * (1 + SLACK) + SLACK) ** 2
                open_ended = np.flatnonzero(~np.isfinite(limit[some])) if b - a >= enough else np.zeros(0, int)
                if len(open_ended):
                    # More than k, as a row may meet itself.
                    kth = np.partition(squares[open_ended], enough - 1, axis=1)[:, enough - 1]
                    most[open_ended] = np.where(np.isnan(kth), np.inf, kth + wrong[open_ended])
                q_at, b_at = _not_above(squares, _above(most + wrong, base.kind)[:, None])
                q_at, b_at = some[q_at], a + b_at
                distance = _pair_distances(rows, tile[q_at], base.vec, b_at)
                b_at = base.at[b_at]
                keep = (distance <= limit[q_at]) & np.isfinite(distance) & (keys[tile[q_at]] != base_keys[b_at])
                if not keep.any():
                    continue
                q_all, b_all, d_all = (np.concatenate([x, y[keep]]) for x, y in zip(best, (q_at, b_at, distance)))
                order = np.lexsort((b_all, d_all, q_all))
                q_all, b_all, d_all = q_all[order], b_all[order], d_all[order]
                starts = np.flatnonzero(np.concatenate([[True], q_all[1:] != q_all[:-1]]))
                counts = np.diff(np.append(starts, len(q_all)))
                place = np.arange(len(q_all)) - np.repeat(starts, counts)
                full = starts[counts >= k] + k - 1
                limit[q_all[full]] = np.minimum(limit[q_all[full]], d_all[full])
                best = tuple(x[place < k] for x in (q_all, b_all, d_all))
        out.append((tile[best[0]], best[1], best[2]))
    return tuple(np.concatenate([o[i] for o in out]) if out else np.zeros(0, int) for i in range(3))


def _most_of_a_key(keys: np.ndarray) -> int:
    """How often the commonest key occurs: as many of a row's nearest may be itself."""
    return int(pd.Series(keys).value_counts(dropna=False).max()) if len(keys) else 0


def _above(limit: np.ndarray, kind: type) -> np.ndarray:
    """The limits in a narrower type, rounded up."""
    with np.errstate(over="ignore"):
        return np.nextafter(limit.astype(kind), kind(np.inf))


def _not_above(squares: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the entries that are not above the limit, also of those that are no number; few of many, so found in one dimension."""
    return np.divmod(np.flatnonzero(~(squares > limit)), squares.shape[1])


def _pair_distances(left: np.ndarray, left_at: np.ndarray, right: np.ndarray, right_at: np.ndarray) -> np.ndarray:
    """Distances of the pairs, summed in the order of ``_distances``."""
    out = np.zeros(len(left_at))
    for d in range(left.shape[1]):
        step = left[left_at, d] - right[right_at, d]
        out += step * step
    return np.sqrt(out)


def _candidates(sent: DataFrame, placed: DataFrame, blocks: DataFrame, k: int, key_type: T.DataType, query_type: T.DataType, block: int | None = None) -> DataFrame:
    """k candidates per query row and block of the cells or parts it was sent to: row_key, neighbor_key, distance.

    Farther ones than the query row's ``bound`` are left out, if there is one; ``leaf`` tells the cells within a part.
    """
    out_schema = T.StructType([T.StructField("row_key", query_type), T.StructField("neighbor_key", key_type), T.StructField("distance", T.DoubleType())])

    def block_join(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({f.name: pd.Series([], dtype="object") for f in out_schema.fields})
        # Keys are in order, so of equal distances at the limit the smaller keys are kept.
        right = right.sort_values("row_key", kind="stable").reset_index(drop=True)
        keys, own = right["row_key"].to_numpy(), left["q_row_key"].to_numpy()
        leaf = right["leaf"].to_numpy() if "leaf" in right else np.zeros(len(right), int)
        reach = left["q_bound"].fillna(math.inf).to_numpy(dtype="float64") if "q_bound" in left else np.full(len(left), np.inf)
        q_at, b_at, distance = _nearest_in_block(_matrix(left["q_vec"]), own, reach, _Base(_matrix(right["vec"]), leaf), keys, k)
        return pd.DataFrame({"row_key": own[q_at], "neighbor_key": keys[b_at], "distance": distance})

    extra = [c for c in ("bound",) if c in sent.columns], [c for c in ("leaf",) if c in placed.columns]
    q_blocks, b_blocks = _meetings(sent, placed, blocks, ["vec", *extra[0]], ["vec", *extra[1]], block)
    found = q_blocks.cogroup(b_blocks).applyInPandas(block_join, out_schema)
    merged = Window.partitionBy("row_key").orderBy("distance", "neighbor_key")
    return found.withColumn("rank", F.row_number().over(merged)).filter(F.col("rank") <= k)


def parts_to_search(rows: DataFrame, tree: CellTree, span: int) -> DataFrame:
    """One row per (row, other part of ``span`` cells) that may hold nearer rows; ``rows`` has vec, own part as cell, and bound.

    The parts are found once and written as one list per row.
    """

    @F.pandas_udf("array<int>")
    def others(vec: pd.Series, cell: pd.Series, bound: pd.Series) -> pd.Series:
        if not len(vec):
            return pd.Series([], dtype="object")
        near = tree.near_parts(_matrix(vec), bound.fillna(math.inf).to_numpy(dtype="float64"), span)
        near[np.arange(len(near)), cell.to_numpy()] = False
        return pd.Series([np.flatnonzero(n).astype(np.int32) for n in near])

    listed = cut_lineage(rows.select("row_key", "vec", "bound", others("vec", "cell", "bound").alias("parts")))
    return listed.select("row_key", "vec", F.explode("parts").alias("cell"), "bound")


def cells_to_search(rows: DataFrame, tree: CellTree, probes: int | None = None) -> DataFrame:
    """One row per (row, other cell) that may hold nearer rows; ``rows`` has vec, own cell and bound."""

    @F.pandas_udf("array<int>")
    def others(vec: pd.Series, cell: pd.Series, bound: pd.Series) -> pd.Series:
        if not len(vec):
            return pd.Series([], dtype="object")
        near = tree.within(_matrix(vec), bound.fillna(math.inf).to_numpy())
        kept = [sorted(x for x in cells if x[1] != own) for cells, own in zip(near, cell.tolist())]
        return pd.Series([[c for _, c in cells[: None if probes is None else probes - 1]] for cells in kept])

    return rows.withColumn("cell", F.explode(others("vec", "cell", "bound"))).select("row_key", "vec", "cell", "bound")


def _coded_pairs(rows: np.ndarray, own: np.ndarray, reach: np.ndarray, codes: np.ndarray, keys: np.ndarray, edges: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(row, coded row, lower, upper, whether it tells) of the pairs of a block that bounds cannot exclude."""
    dims = range(rows.shape[1])
    low = np.stack([edges[d, codes[:, d]] for d in dims], axis=1)
    high = np.stack([edges[d, codes[:, d].astype(np.int64) + 1] for d in dims], axis=1)
    middle, half = (low + high) / 2, (high - low) / 2
    corner = np.sqrt((half * half).sum(1)) * (1 + SLACK)
    enough = k + _most_of_a_key(keys)
    chunks = [slice(a, a + 4 * TILE) for a in range(0, len(codes), 4 * TILE)]
    bases = [_Base(middle[c], np.zeros(len(middle[c]), int)) for c in chunks]
    out: list[tuple[np.ndarray, ...]] = []
    for first in range(0, len(rows), TILE):
        tile = np.arange(first, min(first + TILE, len(rows)))
        tile = tile[np.isfinite(rows[tile]).all(1)]
        limit = reach[tile]
        held = [np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros(0)]
        for chunk, base in zip(chunks, bases) if len(tile) else ():
            squares, wrong = base.products(rows[tile], 0)
            far, most = corner[chunk], limit.copy()
            open_ended = np.flatnonzero(~np.isfinite(limit)) if len(far) >= enough else np.zeros(0, int)
            if len(open_ended):
                # More than k, as a row may meet itself.
                upper = np.sqrt(np.maximum(squares[open_ended] + wrong[open_ended, None], 0)) + far
                most[open_ended] = np.partition(upper, enough - 1, axis=1)[:, enough - 1]
            most = most * (1 + 1e-6) + SLACK
            within = _above(most, base.kind)[:, None] + _above(far * (1 + 1e-6), base.kind)[None, :]
            q_at, b_at = _not_above(squares - _above(wrong, base.kind)[:, None], within * within)
            b_at += chunk.start
            q_at, b_at = (x[own[tile[q_at]] != keys[b_at]] for x in (q_at, b_at))
            lower, upper = np.zeros(len(q_at)), np.zeros(len(q_at))
            for d in dims:
                x = rows[tile[q_at], d]
                under, over = low[b_at, d] - x, x - high[b_at, d]
                lower += np.square(np.maximum(np.maximum(under, over), 0))
                upper += np.square(np.maximum(-under, -over))
            held = [np.concatenate(x) for x in zip(held, (q_at, b_at, np.sqrt(lower), np.sqrt(upper)))]
            # The k smallest upper bounds of each row tell, and limit the row.
            order = np.lexsort((held[3], held[0]))
            held = [x[order] for x in held]
            starts = np.flatnonzero(np.concatenate([[True], held[0][1:] != held[0][:-1]])) if len(order) else np.zeros(0, int)
            counts = np.diff(np.append(starts, len(order)))
            full = starts[counts >= k] + k - 1
            limit[held[0][full]] = np.minimum(limit[held[0][full]], held[3][full])
            tells = (np.arange(len(order)) - np.repeat(starts, counts) < k) & np.isfinite(held[3])
            keep = (held[2] <= limit[held[0]] * (1 + SLACK) + SLACK) & np.isfinite(held[2])
            held = [x[keep] for x in held]
            tells = tells[keep]
        if len(held[0]):
            out.append((tile[held[0]], *held[1:], tells))
    if not out:
        return (np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros(0), np.zeros(0, bool))
    return tuple(np.concatenate([o[i] for o in out]) for i in range(5))


def coded_candidates(sent: DataFrame, placed: DataFrame, blocks: DataFrame, k: int, edges: np.ndarray, block: int | None = None) -> DataFrame:
    """``(row_key, neighbor_key)`` that codes cannot exclude: the k nearest of the cells a row was sent to are among them.

    A pair stays when its lower bound is at most the row's own bound and the k-th smallest upper bound over all
    cells. A block tells at most k upper bounds of a row, so no row's bounds pile up. The middles of the intervals and the
    distance from there to their corners exclude most pairs by one product of matrices; the others get the bounds of each dimension.
    """
    key_type, query_type = placed.schema["row_key"].dataType, sent.schema["row_key"].dataType
    out_schema = T.StructType(
        [
            T.StructField("row_key", query_type),
            T.StructField("neighbor_key", key_type),
            T.StructField("lower", T.DoubleType()),
            T.StructField("upper", T.DoubleType()),
            T.StructField("tells", T.BooleanType()),
        ]
    )

    def block_join(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({f.name: pd.Series([], dtype="object") for f in out_schema.fields})
        own, keys = left["q_row_key"].to_numpy(), right["row_key"].to_numpy()
        reach = left["q_bound"].fillna(math.inf).to_numpy(dtype="float64")
        codes = vector_codes.unpack(right["codes"])
        q_at, b_at, lower, upper, tells = _coded_pairs(_matrix(left["q_vec"]), own, reach, codes, keys, edges, k)
        return pd.DataFrame({"row_key": own[q_at], "neighbor_key": keys[b_at], "lower": lower, "upper": upper, "tells": tells})

    q_blocks, b_blocks = _meetings(sent, placed, blocks, ["vec", "bound"], ["codes"], block)
    found = cut_lineage(q_blocks.cogroup(b_blocks).applyInPandas(block_join, out_schema))
    order = Window.partitionBy("row_key").orderBy("upper")
    limits = (
        found.filter("tells").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)
        .groupBy("row_key").agg(F.max(F.when(F.col("place") == k, F.col("upper"))).alias("reach"))
    )
    near = F.col("reach").isNull() | (F.col("lower") <= F.col("reach") * (1 + SLACK) + SLACK)
    return found.join(limits, "row_key", "left").filter(near).select("row_key", "neighbor_key")


def _measured(pairs: DataFrame, queries: DataFrame, base: DataFrame) -> DataFrame:
    """Distances of pairs, summed in the order of ``_distances``."""
    sides = pairs.join(base.select(F.col("row_key").alias("neighbor_key"), F.col("vec").alias("b_vec")), "neighbor_key")
    sides = sides.join(queries.select("row_key", F.col("vec").alias("q_vec")), "row_key")
    steps = F.zip_with("q_vec", "b_vec", lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double")))
    return sides.select("row_key", "neighbor_key", F.sqrt(F.aggregate(steps, F.lit(0.0), lambda t, x: t + x)).alias("distance"))


def cell_tree(base: DataFrame, n_base: int, cell_rows: int = CELL_ROWS) -> tuple[CellTree, DataFrame, DataFrame]:
    """The tree with its boxes, the base rows with their cell, and (cell, b_blocks)."""
    n_cells = max(1, min(MAX_CELLS, math.ceil(n_base / cell_rows)))
    # At most SAMPLE_PER_CELL * MAX_CELLS vectors.
    sample = random_sample(base, "row_key", n=min(n_base, SAMPLE_PER_CELL * n_cells), seed="cells").select("vec").collect()
    tree = CellTree.build(np.array([r["vec"] for r in sample], dtype="float64"), n_cells)
    placed = cut_lineage(_in_cells(base, tree))
    dims = range(tree_dims := len(sample[0]["vec"]))
    bounds = [f(F.get("vec", F.lit(d))).alias(f"{n}{d}") for d in dims for n, f in (("lo", F.min), ("hi", F.max))]
    boxes = placed.groupBy("cell").agg(F.count("*").alias("n"), *bounds).collect()  # one row per cell
    low, high = np.full((tree.n_cells, tree_dims), np.inf), np.full((tree.n_cells, tree_dims), -np.inf)
    for r in boxes:
        low[r["cell"]], high[r["cell"]] = [r[f"lo{d}"] for d in dims], [r[f"hi{d}"] for d in dims]
    tree.set_boxes(low, high)
    sizes = [(r["cell"], max(1, math.ceil(r["n"] / BLOCK))) for r in boxes]
    return tree, placed, base.sparkSession.createDataFrame(sizes, "cell int, b_blocks int")


def _probed(queries: DataFrame, tree: CellTree, placed: DataFrame, blocks: DataFrame, k: int, key_type: T.DataType, query_type: T.DataType, probes: int) -> DataFrame:
    """Candidates from a row's own cell and the ``probes - 1`` nearest others."""
    at_home = cut_lineage(_in_cells(queries, tree))
    first = cut_lineage(_candidates(at_home, placed, blocks, k, key_type, query_type))
    if tree.n_cells == 1 or probes <= 1:
        return first
    sent = cut_lineage(cells_to_search(_bounded(at_home, first, k), tree, probes))
    return _merged(first, _candidates(sent, placed, blocks, k, key_type, query_type), k)


def _of_all_parts(
    queries: DataFrame, base: DataFrame, tree: CellTree, placed: DataFrame, n_base: int, k: int, key_type: T.DataType, query_type: T.DataType, bits: int | None
) -> DataFrame:
    """The k nearest from a row's own part and all others that may hold nearer rows."""
    rows = max(1, min(math.ceil(n_base / PARTS), PART_ROWS, PART_BYTES // (8 * tree.low.shape[1] or 1)))
    span = max(1, round(rows * tree.n_cells / n_base))

    def parted(of: DataFrame) -> DataFrame:
        return of.withColumn("leaf", F.col("cell")).withColumn("cell", F.floor(F.col("cell") / span).cast("int"))

    placed, rows = parted(placed), max(rows, BLOCK)
    sizes = placed.groupBy("cell").agg(F.count("*").alias("n"))
    # One row per part.
    blocks = queries.sparkSession.createDataFrame([(r["cell"], max(1, math.ceil(r["n"] / (2 * rows)))) for r in sizes.collect()], "cell int, b_blocks int")
    at_home = cut_lineage(parted(_in_cells(queries, tree)).drop("leaf"))
    first = cut_lineage(_candidates(at_home, placed, blocks, k, key_type, query_type, max(BLOCK, rows // 4)))
    if tree.n_cells <= span:
        return first
    sent = parts_to_search(_bounded(at_home, first, k), tree, span)
    if bits is None:
        return _merged(first, _candidates(sent, placed, blocks, k, key_type, query_type, rows), k)
    ends = vector_codes.edges(placed, bits)
    pairs = coded_candidates(sent, cut_lineage(vector_codes.encode(placed, ends).drop("vec")), blocks, k, ends, rows)
    return _merged(first, _measured(pairs, queries, base), k)


def _bounded(at_home: DataFrame, first: DataFrame, k: int) -> DataFrame:
    # A row that met fewer than k others has no bound yet.
    bounds = first.groupBy("row_key").agg(F.max(F.when(F.col("rank") == k, F.col("distance"))).alias("bound"))
    return at_home.join(bounds, "row_key", "left")


def _merged(first: DataFrame, more: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("row_key").orderBy("distance", "neighbor_key")
    both = first.drop("rank").unionByName(more.drop("rank"))
    return both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def nearest(
    queries: DataFrame, base: DataFrame, k: int, payload: list[str] | None = None, cell_rows: int = CELL_ROWS, probes: int | None = None, bits: int | None = None
) -> DataFrame:
    """The ``k`` nearest base rows of every query row, nearest first, ties by base key.

    Both frames have ``row_key`` (unique) and ``vec`` (array of numbers); a base row with the
    query's own key is skipped. Result: ``row_key, rank, neighbor_key, distance,
    neighbor_vec`` and the payload columns of the neighbour as ``neighbor_<name>``. Exact, unless
    ``probes`` limits the cells searched per row (its own and the nearest others). ``bits`` (1 to 8)
    searches the other cells by codes of so many bits per dimension, with the same result.
    """
    payload = payload or []
    key_type, query_type = base.schema["row_key"].dataType, queries.schema["row_key"].dataType
    vec = F.transform("vec", lambda x: x.cast("double"))
    whole = base.select("row_key", vec.alias("vec"), *payload)
    # Floats travel as floats; they are doubles where they are compared.
    single = all(df.schema["vec"].dataType == T.ArrayType(T.FloatType(), df.schema["vec"].dataType.containsNull) for df in (base, queries))
    moved = F.col("vec") if single else vec.alias("vec")
    queries = queries.select("row_key", moved)

    # Copies beyond the k + 1 smallest keys can never be among k neighbours. The rank
    # filter is applied before the shuffle as well, so copies do not pile up in a task.
    copies = Window.partitionBy("vec").orderBy("row_key")
    base = cut_lineage(base.select("row_key", moved).withColumn("copy_no", F.row_number().over(copies)).filter(F.col("copy_no") <= k + 1).drop("copy_no"))
    n_base = base.count()
    if n_base == 0:
        raise ValueError("no rows to be neighbours")
    tree, placed, blocks = cell_tree(base, n_base, cell_rows)

    if probes is not None:
        found = _probed(queries, tree, placed, blocks, k, key_type, query_type, probes)
    else:
        found = _of_all_parts(queries, base, tree, placed, n_base, k, key_type, query_type, bits)
    names = {"row_key": "neighbor_key", "vec": "neighbor_vec", **{p: f"neighbor_{p}" for p in payload}}
    side = whole.select(*[F.col(c).alias(n) for c, n in names.items()])
    return found.join(side, "neighbor_key").select("row_key", "rank", "neighbor_key", "distance", "neighbor_vec", *[f"neighbor_{p}" for p in payload])


def tomek_links(rows: DataFrame, label: str, **options) -> DataFrame:
    """Pairs of rows of different class that are each other's nearest row (smaller key first)."""
    pairs = cut_lineage(
        nearest(rows.select("row_key", "vec"), rows.select("row_key", "vec", label), 1, [label], **options)
        .join(rows.select("row_key", F.col(label).alias("own_label")), "row_key")
        .select("row_key", "neighbor_key", "own_label", F.col(f"neighbor_{label}").alias("other_label"))
    )
    back = pairs.select(F.col("neighbor_key").alias("row_key"), F.col("row_key").alias("neighbor_key"))
    mutual = pairs.join(back, ["row_key", "neighbor_key"], "left_semi")
    return mutual.filter((F.col("own_label") != F.col("other_label")) & (F.col("row_key") < F.col("neighbor_key")))


def remove_tomek_links(rows: DataFrame, label: str, **options) -> DataFrame:
    """Drop both rows of every Tomek link."""
    links = tomek_links(rows, label, **options)
    involved = links.select("row_key").union(links.select(F.col("neighbor_key").alias("row_key")))
    return rows.join(involved, "row_key", "left_anti")


def smote(rows: DataFrame, label: str, minority, ratio: float | None = None, k: int = 5, seed: str | int = 0, **options) -> DataFrame:
    """Rows with synthetic minority rows added until minority / rest reaches ``ratio``.

    A synthetic row lies on the line from a minority row to one of its k nearest
    minority rows. Every minority row is used equally often, the remainder falls on a
    hashed choice; draws depend on key and seed only. Keys become text, synthetic ones
    are ``<key>#<copy>``; ``ratio=None`` balances the classes.
    """
    minor = rows.filter(F.col(label) == minority)
    n_minor, n_all = minor.count(), rows.count()
    n_new = int((n_all - n_minor) * (1.0 if ratio is None else ratio)) - n_minor
    out = rows.select(F.col("row_key").cast("string").alias("row_key"), "vec", label)
    if n_new <= 0:
        return out
    if n_minor < 2:
        raise ValueError("at least two minority rows are needed")
    found = nearest(minor.select("row_key", "vec"), minor.select("row_key", "vec"), min(k, n_minor - 1), **options)
    lists = found.groupBy("row_key").agg(F.sort_array(F.collect_list(F.struct("rank", "neighbor_vec"))).alias("near"))
    extra = random_sample(minor, "row_key", n=n_new % n_minor, seed=f"{seed}:extra").select("row_key", F.lit(1).alias("one_more"))
    copies = (
        minor.select("row_key", "vec")
        .join(lists, "row_key")
        .join(extra, "row_key", "left")
        .withColumn("n_copies", F.lit(n_new // n_minor) + F.coalesce("one_more", F.lit(0)))
        .filter("n_copies > 0")
        .withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
        .withColumn("new_key", F.concat(F.col("row_key").cast("string"), F.lit("#"), F.col("copy_no").cast("string")))
    )
    pick = F.floor(hash_uniform(F.col("new_key"), f"{seed}:pick") * F.size("near")).cast("int")
    gap = hash_uniform(F.col("new_key"), f"{seed}:gap")
    drawn = copies.withColumn("other", F.get(F.col("near"), pick)["neighbor_vec"]).withColumn("gap", gap)
    new_vec = F.zip_with("vec", "other", lambda a, b: a + F.col("gap") * (b - a))
    synthetic = drawn.select(F.col("new_key").alias("row_key"), new_vec.alias("vec"), F.lit(minority).alias(label))
    return out.unionByName(synthetic)


def smote_tomek(rows: DataFrame, label: str, minority, ratio: float | None = None, k: int = 5, seed: str | int = 0, **options) -> DataFrame:
    """``smote`` followed by the removal of Tomek links."""
    grown = cut_lineage(smote(rows, label, minority, ratio, k, seed, **options))
    return remove_tomek_links(grown, label, **options)


def knn_vote(queries: DataFrame, base: DataFrame, label: str, k: int = 5, share_of=None, **options) -> DataFrame:
    """Majority class of the k nearest base rows; a tie goes to the smaller class. With ``share_of`` also its share."""
    found = nearest(queries, base, k, [label], **options)
    votes = found.groupBy("row_key", F.col(f"neighbor_{label}").alias("prediction")).agg(F.count("*").alias("n"))
    share = [] if share_of is None else [(F.sum(F.when(F.col("prediction") == share_of, F.col("n")).otherwise(0)) / F.sum("n")).alias("share")]
    return votes.groupBy("row_key").agg(F.min_by("prediction", F.struct(-F.col("n"), F.col("prediction"))).alias("prediction"), *share)

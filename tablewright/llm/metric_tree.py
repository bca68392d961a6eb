"""Exact largest inner products: best-first search in M-trees.

An inner product becomes a distance by one more component: with M the largest norm, a stored vector x
gets sqrt(M^2 - |x|^2) and a query q gets 0, so all stored vectors have the norm M and
d(q, x)^2 = |q|^2 + M^2 - 2<q, x>. The nearest vectors are those of the largest products.

The index is a table of entries. A page holds up to ``PAGE`` entries; an entry of an inner page has
a routing vector, the covering radius of the page below it and its distance to the routing vector
above; an entry of a leaf has a stored vector and that distance. A query reads the page with the best
bound next. By the triangle inequality entries are passed over without computing a distance where
the stored distances already show that nothing under them can enter the result.

The topmost level is spread over Spark: vectors go to the nearest of a bounded number of pivots
(cells), a cell is cut into shards of bounded size, and each shard has a tree. A query
searches its nearest cell first, and then only shards of cells whose bound reaches its k-th score.
Equal vectors are stored once.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.meetings import BLOCK_QUERIES, DOUBLE_EXACT, LONG_LEAST, SHARD_ROWS, collapse, groups, meet, scaled_vectors, shard_count, stacked, values, vectors, whole_numbers, within_long
from tablewright.session import cut_lineage

SCALE = 1_024
PAGE = 64
#: Pivots of one vector length; they go to every task.
CELLS_MOST = 1_024
SEED = 11
#: Bounds are widened by this share of |q|^2 + M^2, which is far more than rounding can change them.
SLACK = 1e-6

ENTRY = "shard long, page int, slot int, child int, radius double, above double, vec array<double>, ids array<long>"
FOUND = "qno long, query_id long, shard long, vec_id long, score long"


def lifted(rows: np.ndarray, largest: float) -> np.ndarray:
    """The vectors with the component that brings them to the norm ``largest``."""
    return np.column_stack([rows, np.sqrt(np.maximum(largest**2 - (rows * rows).sum(1), 0.0))])


def distances(points: np.ndarray, point: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - point) ** 2).sum(1))


def least_of(kth: float) -> float:
    """What a bound must reach: cut to the lowest long, lower products tie with it."""
    return -math.inf if kth <= LONG_LEAST else kth


@dataclass
class Tree:
    """Entries in order of page and slot; ``starts[p]`` to ``starts[p + 1]`` is page p. Page 0 is the root."""

    starts: np.ndarray
    child: np.ndarray
    radius: np.ndarray
    above: np.ndarray
    vecs: np.ndarray
    ids: list
    #: Inner products computed and avoided by all searches so far.
    computed: int = 0
    avoided: int = 0

    def __post_init__(self):
        self.largest = math.sqrt((self.vecs * self.vecs).sum(1).max()) if len(self.vecs) else 0.0

    def products(self, rows: np.ndarray, query: np.ndarray, norm: float) -> np.ndarray:
        """Exact, as no sum leaves the whole numbers that doubles hold, else in Python integers cut to longs."""
        if norm * self.largest < DOUBLE_EXACT:
            return self.vecs[rows] @ query
        return within_long(whole_numbers(self.vecs[rows]) @ whole_numbers(query))

    def search(self, query: np.ndarray, k: int, own: int, least: float = -math.inf) -> list[tuple[int, int]]:
        """(score, id) of the best ``k`` ids but ``own`` that score ``least`` or more, best first, ties by id."""
        norm = math.sqrt((query * query).sum())
        total = norm**2 + self.largest**2
        slack = SLACK * total
        best: list[tuple] = []
        kth = least

        def bound(lower: np.ndarray) -> np.ndarray:
            return (total - np.maximum(lower, 0.0) ** 2) / 2 + slack

        todo = [(-math.inf, 0, math.nan)]
        while todo:
            minus, page, to_router = heapq.heappop(todo)
            if -minus < least_of(kth):
                break
            rows = np.arange(self.starts[page], self.starts[page + 1])
            # Comparisons with an unknown distance are false, so they keep every entry.
            kept = rows[~(bound(np.abs(to_router - self.above[rows]) - self.radius[rows]) < least_of(kth))]
            self.computed += len(kept)
            self.avoided += len(rows) - len(kept)
            if not len(kept):
                continue
            scores = self.products(kept, query, norm)
            if self.child[kept[0]] >= 0:
                near = np.sqrt(np.maximum(total - 2 * scores.astype(float), 0.0))
                upper = bound(near - self.radius[kept])
                for u, row, d in zip(upper.tolist(), kept.tolist(), near.tolist()):
                    if not u < least_of(kth):
                        heapq.heappush(todo, (-u, int(self.child[row]), d))
                continue
            enough = np.flatnonzero(scores >= kth)
            if len(enough):
                fresh = [(-int(scores[i]), j) for i in enough.tolist() for j in self.ids[kept[i]] if j != own]
                best = heapq.nsmallest(k, best + fresh)
                if len(best) == k:
                    kth = max(kth, -best[-1][0])
        return [(-minus, j) for minus, j in best]


def _parts(points: np.ndarray, rows: np.ndarray, n: int) -> list[np.ndarray]:
    """``n`` groups of about equal size, cut in two again and again between two vectors far apart."""
    if n == 1:
        return [rows]
    one = points[rows[np.argmax(distances(points[rows], points[rows[0]]))]]
    from_one = distances(points[rows], one)
    other = points[rows[np.argmax(from_one)]]
    order = np.argsort(from_one - distances(points[rows], other), kind="stable")
    at = len(rows) * (n // 2) // n
    return _parts(points, rows[order[:at]], n // 2) + _parts(points, rows[order[at:]], n - n // 2)


def bulk_load(vecs: np.ndarray, ids: list, page: int = PAGE) -> Tree:
    """A balanced tree over distinct vectors: all leaves at one depth, all pages of at most ``page`` entries."""
    largest = math.sqrt((vecs * vecs).sum(1).max()) if len(vecs) else 0.0
    points = lifted(vecs, largest)
    pages: list[list[tuple]] = []

    def grow(rows: np.ndarray, height: int, router: int) -> int:
        no = len(pages)
        pages.append([])
        above = distances(points[rows], points[router]) if router >= 0 else np.zeros(len(rows))
        if height == 1:
            pages[no] = [(-1, 0.0, float(d), int(r)) for r, d in zip(rows, above)]
            return no
        for part in _parts(points, rows, math.ceil(len(rows) / page ** (height - 1))):
            own = int(part[np.argmin(distances(points[part], points[part].mean(0)))])
            radius = float(distances(points[part], points[own]).max())
            up = float(distances(points[own][None], points[router])[0]) if router >= 0 else 0.0
            pages[no].append((grow(part, height - 1, own), radius, up, own))
        return no

    height = 1
    while page**height < len(vecs):
        height += 1
    grow(np.arange(len(vecs)), height, -1)
    entries = [e for p in pages for e in p]
    rows = [e[3] for e in entries]
    return Tree(
        np.cumsum([0, *map(len, pages)]), np.array([e[0] for e in entries], int), np.array([e[1] for e in entries]), np.array([e[2] for e in entries]),
        vecs[rows], [ids[r] if e[0] < 0 else [] for r, e in zip(rows, entries)],
    )


@dataclass
class Cell:
    first_shard: int
    shards: int
    near: float
    far: float


@dataclass
class TreeIndex:
    """What ``build_index`` returns: the table of entries, and the topmost level, which is bounded."""

    entries: DataFrame
    pivots: dict[int, np.ndarray]
    largest: dict[int, float]
    cells: dict[int, dict[int, Cell]]


def _batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


PLACED = pa.schema([("dim", pa.int32()), ("cell", pa.int32()), ("away", pa.float64()), ("vec", pa.list_(pa.float64())), ("ids", pa.list_(pa.int64()))])
ENTRIES = pa.schema([("shard", pa.int64()), ("page", pa.int32()), ("slot", pa.int32()), ("child", pa.int32()), ("radius", pa.float64()), ("above", pa.float64()), ("vec", pa.list_(pa.float64())), ("ids", pa.list_(pa.int64()))])
ROUTED = pa.schema([("shard", pa.int64()), ("qno", pa.int64()), ("query_id", pa.int64()), ("vec", pa.list_(pa.float64())), ("least", pa.int64()), ("home", pa.int64())])
RESULTS = pa.schema([("qno", pa.int64()), ("query_id", pa.int64()), ("shard", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def build_index(df: DataFrame, keep: int, scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding") -> TreeIndex:
    """M-trees over all rows; of equal vectors the ``keep`` smallest ids are stored.

    One row per vector length and cell goes to the driver, and at most ``CELLS_MOST`` pivots per length.
    """
    spark = df.sparkSession
    rows = cut_lineage(collapse(scaled_vectors(df, scale, id_col, vec_col), keep, ["vec"]).withColumn("dim", F.size("vec")))
    square = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)
    sizes = {r["dim"]: (r["n"], math.sqrt(r["square"])) for r in rows.groupBy("dim").agg(F.count("*").alias("n"), F.max(square).alias("square")).collect()}
    largest = {dim: norm for dim, (_, norm) in sizes.items()}
    wanted = {dim: min(CELLS_MOST, shard_count(n, spark.sparkContext.defaultParallelism)) for dim, (n, _) in sizes.items()}
    chosen: dict[int, list] = {dim: [] for dim in wanted}
    drawn = rows.withColumn("place", F.row_number().over(Window.partitionBy("dim").orderBy(F.xxhash64("vec", F.lit(SEED)), "vec")))
    for r in drawn.where(F.col("place") <= max(wanted.values(), default=0)).orderBy("dim", "place").select("dim", "vec").collect():
        if len(chosen[r["dim"]]) < wanted[r["dim"]]:
            chosen[r["dim"]].append(r["vec"])
    pivots = {dim: lifted(np.array(v, float).reshape(len(v), dim), largest[dim]) for dim, v in chosen.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                cells, away = nearest_pivot(lifted(vectors(part.column("vec")), largest[dim]), pivots[dim])
                yield _batch(PLACED, [dim] * part.num_rows, cells, away, part.column("vec"), part.column("ids"))

    placed = cut_lineage(rows.select("dim", "vec", "ids").mapInArrow(place, "dim int, cell int, away double, vec array<double>, ids array<long>"))
    cells: dict[int, dict[int, Cell]] = {dim: {} for dim in sizes}
    after = 0
    for r in placed.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.min("away").alias("near"), F.max("away").alias("far")).orderBy("dim", "cell").collect():
        cell = Cell(after, math.ceil(r["n"] / SHARD_ROWS), r["near"], r["far"])
        cells[r["dim"]][r["cell"]] = cell
        after += cell.shards
    table = [(dim, no, c.first_shard, c.shards) for dim, of in cells.items() for no, c in of.items()]
    # One row per length and cell.
    numbered = placed.join(F.broadcast(spark.createDataFrame(table, "dim int, cell int, first long, shards int")), ["dim", "cell"])
    numbered = numbered.select((F.col("first") + F.pmod(F.xxhash64("vec", F.lit(SEED)), F.col("shards"))).alias("shard"), "vec", "ids")

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for stored, _ in groups(batches, ["shard"]):
            shard = stored[0].column("shard")[0].as_py()
            tree = bulk_load(stacked(stored, "vec"), [ids for b in stored for ids in b.column("ids").to_pylist()])
            page = np.repeat(np.arange(len(tree.starts) - 1), np.diff(tree.starts))
            slot = np.arange(len(page)) - tree.starts[page]
            for a in range(0, len(page), 4_096):
                b = min(len(page), a + 4_096)
                yield _batch(ENTRIES, [shard] * (b - a), page[a:b], slot[a:b], tree.child[a:b], tree.radius[a:b], tree.above[a:b], list(tree.vecs[a:b]), tree.ids[a:b])

    by_shard = numbered.withColumn("is_query", F.lit(False)).repartition("shard").sortWithinPartitions("shard")
    return TreeIndex(cut_lineage(by_shard.mapInArrow(load, ENTRY)), pivots, largest, cells)


def nearest_pivot(points: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest pivot of each point, and the distance to it."""
    best, away = np.zeros(len(points), np.int32), np.full(len(points), np.inf)
    for no, pivot in enumerate(pivots):
        d = distances(points, pivot)
        closer = d < away
        best[closer], away[closer] = no, d[closer]
    return best, away


def _routed(asked: DataFrame, index: TreeIndex, first: bool) -> DataFrame:
    """Which shards a query visits: at first one shard of its nearest cell, later all others that can reach its ``least``."""
    pivots, largest, cells = index.pivots, index.largest, index.cells

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for r in batch.to_pylist():
                dim = len(r["vec"])
                if not cells.get(dim):
                    continue
                q = np.array([*r["vec"], 0.0])
                away = distances(pivots[dim], q)
                if first:
                    no = min(cells[dim], key=lambda c: away[c])
                    home = cells[dim][no].first_shard + r["qno"] % cells[dim][no].shards
                    shards = [home]
                else:
                    home, shards, total = r["home"], [], float(q @ q) + largest[dim] ** 2
                    for no, c in cells[dim].items():
                        lower = max(away[no] - c.far, c.near - away[no], 0.0)
                        if r["least"] is None or not (total - lower**2) / 2 + SLACK * total < least_of(r["least"]):
                            shards += [s for s in range(c.first_shard, c.first_shard + c.shards) if s != home]
                for shard in shards:
                    for column, value in zip(out, (shard, r["qno"], r["query_id"], r["vec"], r["least"], home)):
                        column.append(value)
                    if len(out[0]) == 4_096:
                        yield _batch(ROUTED, *out)
                        out = ([], [], [], [], [], [])
            yield _batch(ROUTED, *out)

    return asked.mapInArrow(route, "shard long, qno long, query_id long, vec array<double>, least long, home long")


def _search(index: TreeIndex, routed: DataFrame, blocks: int, k: int) -> DataFrame:
    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for stored, asked in groups(batches, ["shard", "block"]):
            if not stored:
                continue
            page = values(stored, "page")
            starts = np.concatenate([np.searchsorted(page, np.arange(page[-1] + 1)), [len(page)]])
            ids = [i for b in stored for i in b.column("ids").to_pylist()]
            tree = Tree(starts, values(stored, "child"), values(stored, "radius"), values(stored, "above"), stacked(stored, "vec"), ids)
            for part in asked:
                out: tuple[list, ...] = ([], [], [], [], [])
                for r in part.select(["shard", "qno", "query_id", "least", "vec"]).to_pylist():
                    least = -math.inf if r["least"] is None else r["least"]
                    for score, j in tree.search(np.array(r["vec"], float), k, r["query_id"], least):
                        for column, value in zip(out, (r["qno"], r["query_id"], r["shard"], j, score)):
                            column.append(value)
                yield _batch(RESULTS, *out)

    rows, asked = index.entries.withColumn("block", F.lit(0)), routed.withColumn("block", F.lit(0))
    if blocks > 1:
        rows = index.entries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        asked = routed.withColumn("block", F.pmod(F.xxhash64("qno"), F.lit(blocks)).cast("int"))
    return meet(rows, asked, ["shard", "block"], ["page", "slot", "qno"]).mapInArrow(visit, FOUND)


def largest_products(df: DataFrame, queries: DataFrame, k: int = 10, scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query row the ``k`` rows of the largest inner product.

    Components x count as floor(``scale`` * x). Candidates are all rows of ``df`` of the query's vector
    length but those of its own id; ties go to the smaller id, and with fewer than k candidates all
    are returned. Rows whose id or vector is null, that hold a null or non-finite component or one whose product with
    ``scale`` is no finite double take no part. Zero vectors do. Rows equal in id and scaled vector count
    once; rows of one id with different vectors count each. A score beyond a long
    counts as its end. Other columns are ignored; an empty table gives no rows.
    """
    index = build_index(df, k + 1, scale, id_col, vec_col)
    scaled = scaled_vectors(queries, scale, id_col, vec_col).distinct()
    # Written once, so that the numbers stay what they are.
    asked = cut_lineage(scaled.select(F.monotonically_increasing_id().alias("qno"), F.col("id").alias("query_id"), "vec", F.lit(None).cast("long").alias("least"), F.lit(None).cast("long").alias("home")))
    blocks = max(1, math.ceil(asked.count() / BLOCK_QUERIES))
    routed = _routed(asked, index, True)
    near = cut_lineage(_search(index, routed, blocks, k))
    kth = near.groupBy("qno").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") == k)
    bounded = routed.select("qno", "query_id", "vec", "home").join(kth.select("qno", "least"), "qno", "left")
    far = _search(index, _routed(bounded.select("qno", "query_id", "vec", "least", "home"), index, False), blocks, k)
    best = Window.partitionBy("qno").orderBy(F.desc("score"), "vec_id", "shard")
    ranked = near.unionByName(far).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def largest_products_by_rule(df: DataFrame, every: int = 100, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``largest_products`` with the rows whose id is divisible by ``every`` as queries."""
    return largest_products(df, df.where(F.col(id_col) % every == 0), k, id_col=id_col, vec_col=vec_col)

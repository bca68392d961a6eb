"""Approximate nearest neighbours by cosine: a forest of sorted hash strings.

Every vector gets one long string of sign bits per tree; a tree is the sorted array of its
strings. A query descends in all trees at once to its longest prefix matches and then ascends,
one bit at a time in all trees together, until it has gathered enough candidates; these are
scored exactly, in double precision.

Vectors of one length are dealt to shards at random, each of bounded size with a forest of its own, and the
stated queries stream through every shard of their length in blocks. Equal vectors are stored once, with as
many of their smallest ids as any answer can need. How many candidates are enough is measured:
a bounded sample of queries is compared with brute force over all vectors, and the
count is set so that the wanted share of their true neighbours is met.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.session import cut_lineage

TREES = 64
BITS = 32
SHARD_ROWS = 65_536
#: A shard for each core as long as it holds so many rows.
SHARD_LEAST = 2_048
SAMPLE = 64
TARGET_RECALL = 0.97
SEED = 10
#: Far more than rounding can change a cosine in double precision.
ROUNDING = 1e-9


def valid_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec) of rows that take part: id known, every component finite, not all zero."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == math.inf))
    rows = rows.where(F.col("id").isNotNull() & F.col("vec").isNotNull())
    return rows.where(~F.coalesce(bad, F.lit(False)) & F.exists("vec", lambda x: x != 0))


def shard_of(vec: Column, shards: int) -> Column:
    """Shards of one length follow each other."""
    return (F.size(vec).cast("long") * shards + F.pmod(F.xxhash64(vec), F.lit(shards))).alias("shard")


def collapse(rows: DataFrame, keep: int) -> DataFrame:
    """One row per distinct vector, with its ``keep`` smallest ids; they are picked before the shuffle."""
    distinct = Window.partitionBy("vec").orderBy("id")
    # dense_rank: repeated rows of one id count once; rank limits are pushed below the exchange.
    ranked = rows.withColumn("rank", F.dense_rank().over(distinct)).where(F.col("rank") <= keep)
    return ranked.groupBy("vec").agg(F.array_sort(F.collect_set("id")).alias("ids"))


class Forest:
    """The trees over one shard: hash strings in order, and whose they are."""

    def __init__(self, vectors: np.ndarray, trees: int = TREES, bits: int = BITS, seed: int = SEED):
        self.unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
        self.n, self.bits = len(vectors), bits
        rng = np.random.default_rng(seed)
        self.planes = [rng.standard_normal((vectors.shape[1], bits)) for _ in range(trees)]
        self.order, self.strings = [], []
        for planes in self.planes:
            strings = self._strings(self.unit, planes)
            order = np.argsort(strings, kind="stable")
            self.order.append(order.astype(np.int32))
            self.strings.append(strings[order])

    def _strings(self, unit: np.ndarray, planes: np.ndarray) -> np.ndarray:
        signs = unit @ planes > 0
        return signs @ (np.uint64(1) << np.arange(self.bits - 1, -1, -1, dtype=np.uint64))

    def matches(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where, in each tree, the strings that share x leading bits with a query begin and end.

        Arrays (query, tree, x) for x from 0 to ``bits``.
        """
        unit = queries / np.linalg.norm(queries, axis=1)[:, None]
        begins = np.zeros((len(queries), len(self.planes), self.bits + 1), np.int32)
        ends = np.full_like(begins, self.n)
        for t, planes in enumerate(self.planes):
            own = self._strings(unit, planes)
            for x in range(1, self.bits + 1):
                free = np.uint64(self.bits - x)
                low = own >> free << free
                begins[:, t, x] = np.searchsorted(self.strings[t], low)
                ends[:, t, x] = np.searchsorted(self.strings[t], low + (np.uint64(1) << free))
        return begins, ends

    def candidates(self, begins: np.ndarray, ends: np.ndarray, enough: float) -> np.ndarray:
        """Rows of one query: the deepest level at which all trees together hold ``enough`` matches, or all rows."""
        totals = (ends - begins).sum(0)
        reached = np.flatnonzero(totals >= enough)
        x = int(reached[-1]) if len(reached) else 0
        if x == 0:
            return np.arange(self.n)
        return np.unique(np.concatenate([order[a:b] for order, a, b in zip(self.order, begins[:, x].tolist(), ends[:, x].tolist())]))

    def needed(self, begins: np.ndarray, ends: np.ndarray, row: int) -> int:
        """How many matches must count as enough for one query to meet ``row``."""
        totals = (ends - begins).sum(0)
        for x in range(self.bits, 0, -1):
            if any((order[a:b] == row).any() for order, a, b in zip(self.order, begins[:, x].tolist(), ends[:, x].tolist())):
                return int(totals[x + 1]) + 1 if x < self.bits else 1
        return int(totals[1]) + 1


def cosines(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Row by row in the same order of operations, so equal vectors get equal scores."""
    return (vectors * query).sum(1) / (np.sqrt((vectors * vectors).sum(1)) * np.sqrt((query * query).sum()))


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list, Iterator[pa.RecordBatch]]]:
    """For each shard: its vectors, their ids, and a stream of the query rows that follow."""

    def runs() -> Iterator[tuple[int, bool, pa.RecordBatch]]:
        for batch in batches:
            if batch.num_rows:
                keys = batch.column("shard").to_numpy() * 2 + batch.column("is_query").to_numpy(zero_copy_only=False).astype(int)
                cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
                for a, b in zip(cuts, cuts[1:]):
                    yield int(keys[a]) // 2, bool(keys[a] % 2), batch.slice(a, b - a)

    parts = runs()
    waiting = next(parts, None)
    while waiting is not None:
        shard, vectors, ids = waiting[0], [], []
        while waiting is not None and waiting[0] == shard and not waiting[1]:
            vectors.append(_vectors(waiting[2].column("vec")))
            ids += waiting[2].column("ids").to_pylist()
            waiting = next(parts, None)

        def queries() -> Iterator[pa.RecordBatch]:
            nonlocal waiting
            while waiting is not None and waiting[0] == shard and waiting[1]:
                yield waiting[2]
                waiting = next(parts, None)

        yield (np.concatenate(vectors) if vectors else np.empty((0, 0))), ids, queries()


def _sharded(index: DataFrame, queries: DataFrame, shards: int) -> DataFrame:
    """Index rows and, after them, all queries, for every shard."""
    none = F.lit(None)
    rows = index.select(shard_of(F.col("vec"), shards), F.lit(False).alias("is_query"), none.cast("long").alias("id"), "vec", "ids")
    asked = queries.select(F.explode(F.sequence(F.size("vec").cast("long") * shards, F.size("vec").cast("long") * shards + (shards - 1))).alias("shard"), F.lit(True).alias("is_query"), "id", "vec", none.cast("array<long>").alias("ids"))
    return rows.unionByName(asked).repartition("shard").sortWithinPartitions("shard", "is_query", "id")


def _brute_force(index: DataFrame, sample: list, k: int) -> list[tuple[int, list[float]]]:
    """The k nearest distinct vectors of each sampled query: (number of the query, vector)."""
    asked = [np.array(r["vec"]) for r in sample]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.list_value_length(batch.column("vec")).to_numpy(zero_copy_only=False)
            out = ([], [], [])
            for size in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == size))
                vectors, ids = _vectors(part.column("vec")), part.column("ids").to_pylist()
                for no, query in enumerate(asked):
                    if len(query) != size:
                        continue
                    scores = cosines(vectors, query)
                    scores[[i == [sample[no]["id"]] for i in ids]] = -2
                    for row in np.argsort(-scores, kind="stable")[:k].tolist():
                        if scores[row] >= -1.5:
                            for column, value in zip(out, (no, float(scores[row]), vectors[row].tolist())):
                                column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.float64()), pa.array(out[2], pa.list_(pa.float64()))], ["no", "score", "vec"])

    best = Window.partitionBy("no").orderBy(F.desc("score"), "vec")
    found = index.mapInArrow(scan, "no long, score double, vec array<double>").withColumn("rank", F.row_number().over(best))
    return [(r["no"], r["vec"]) for r in found.where(F.col("rank") <= k).select("no", "vec").collect()]


def enough_matches(index: DataFrame, queries: DataFrame, shards: int, k: int, target: float, sample: int = SAMPLE) -> float:
    """Matches to gather, as a share of trees times rows of a shard, for the wanted recall.

    Fitted on ``sample`` queries (chosen by a hash of the id) and their exact neighbours.
    """
    chosen = queries.orderBy(F.xxhash64("id", F.lit(SEED)), "id", "vec").limit(sample).collect()
    truth = _brute_force(index, chosen, k)
    if not truth:
        return 1.0
    spark = index.sparkSession
    # sample * k rows: a query and one of its true neighbours
    pairs = spark.createDataFrame([(no, chosen[no]["vec"] + vec) for no, vec in truth], "id long, vec array<double>")
    half = (F.size("vec") / 2).cast("int")
    pairs = pairs.withColumn("home", shard_of(F.slice("vec", half + 1, half), shards))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for vectors, _, asked in _by_shard(batches):
            forest = Forest(vectors) if len(vectors) else None
            for batch in asked:
                both = _vectors(batch.column("vec"))
                half = both.shape[1] // 2
                if forest is None:
                    continue
                begins, ends = forest.matches(both[:, :half])
                shares = []
                for i, wanted in enumerate(both[:, half:]):
                    row = np.flatnonzero((vectors == wanted).all(1))
                    if len(row):
                        shares.append(forest.needed(begins[i], ends[i], int(row[0])) / (TREES * forest.n))
                yield pa.RecordBatch.from_arrays([pa.array(shares, pa.float64())], ["share"])

    none = F.lit(None)
    rows = index.select(shard_of(F.col("vec"), shards), F.lit(False).alias("is_query"), none.cast("long").alias("id"), "vec", "ids")
    asked = pairs.select(F.col("home").alias("shard"), F.lit(True).alias("is_query"), "id", "vec", none.cast("array<long>").alias("ids"))
    placed = rows.unionByName(asked).repartition("shard").sortWithinPartitions("shard", "is_query", "id")
    shares = [r["share"] for r in placed.mapInArrow(measure, "share double").collect()]
    return float(np.quantile(shares, target, method="higher")) if shares else 1.0


def nearest(df: DataFrame, queries: DataFrame, k: int = 5, target_recall: float = TARGET_RECALL, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest rows found for each query row.

    Candidates are all rows of ``df`` but those of the query's own id. Ties go to the smaller id; with
    fewer than k candidates all are returned. Rows whose id is null or whose vector is null, zero
    or holds a null or non-finite component take no part, as query or
    candidate. Vectors of different lengths do not meet. Repeated rows count once. Other columns are ignored; an empty table gives no rows.
    """
    spark = df.sparkSession
    index = cut_lineage(collapse(valid_vectors(df, id_col, vec_col), k + 1))
    # Queries are few against all rows and are read several times.
    asked = cut_lineage(valid_vectors(queries, id_col, vec_col).dropDuplicates(["id", "vec"]))
    n = index.count()
    shards = max(1, math.ceil(n / SHARD_ROWS), min(spark.sparkContext.defaultParallelism, n // SHARD_LEAST))
    share = enough_matches(index, asked, shards, k, target_recall)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for vectors, ids, blocks in _by_shard(batches):
            forest = Forest(vectors) if len(vectors) else None
            for block in blocks:
                if forest is None:
                    continue
                for at in range(0, block.num_rows, 256):
                    part = block.slice(at, 256)
                    wanted = _vectors(part.column("vec"))
                    begins, ends = forest.matches(wanted)
                    out = ([], [], [], [])
                    for i, own in enumerate(part.column("id").to_pylist()):
                        rows = forest.candidates(begins[i], ends[i], share * TREES * forest.n)
                        rough = forest.unit[rows] @ (wanted[i] / np.linalg.norm(wanted[i]))
                        # One of the k + 1 best may be the query itself. All that rounding could bring among them are scored exactly.
                        if len(rows) > k + 1:
                            rows = rows[rough >= np.partition(rough, len(rows) - k - 1)[len(rows) - k - 1] - ROUNDING]
                        scores = cosines(vectors[rows], wanted[i])
                        found = sorted((-s, j) for s, r in zip(scores.tolist(), rows.tolist()) for j in ids[r] if j != own)[:k]
                        for minus, j in found:
                            for column, value in zip(out, (own, j, -minus, i + at)):
                                column.append(value)
                    vec = part.column("vec").take(pa.array([v - at for v in out[3]], pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64()), vec], ["query_id", "vec_id", "score", "vec"])

    found = _sharded(index, asked, shards).mapInArrow(search, "query_id long, vec_id long, score double, vec array<double>")
    best = Window.partitionBy("query_id", F.xxhash64("vec")).orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("vec_id"), "score")


def nearest_by_rule(df: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``nearest`` with the rows whose id is divisible by ``every`` as queries."""
    return nearest(df, df.where(F.col(id_col) % every == 0), k, id_col=id_col, vec_col=vec_col)

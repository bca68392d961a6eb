"""All pairs of texts with similar sets of word n-grams: a chosen-path join.

Every distinct set of shingles is embedded into ``COORDINATES`` minhash values, so two sets share a
coordinate with the probability of their Jaccard similarity. A run starts with all sets in one
bucket and splits it on sampled coordinates: sets with the same values there -- sampled shared
tokens -- go on together. The first two splits are one step, since a passage that many texts share
fills the buckets of one token. Buckets that are still large are split again, on coordinates drawn
from the path that led there; small ones are compared by brute force, first on eight bits
of each coordinate, then exactly on the shingles. Runs are repeated until pairs at the threshold are
met with the target recall.

Nothing is emitted per pair. Equal sets are one set with a weight. A pair that meets in several
buckets counts in the smallest of them only, which both sets' lists of buckets tell, so every
task returns a few numbers per member: its number of links, and edges that span the bucket's
groups. Buckets that no token splits (most members are alike) are compared block by block
in as many tasks as they need.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.components import connected
from tablewright.session import cut_lineage

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.999
COORDINATES = 64
#: Largest bucket for brute force in one go, rows of a block of a larger one, and levels of splitting.
SMALL = 512
BLOCK = 512
DEPTH = 5
#: Coordinates of the first split of a run.
FIRST = 2
#: A bucket that keeps this share of its parent's sets is not split further: its sets are alike.
ALIKE = 0.7
#: Every later bucket is split on one coordinate, one in four on a second: 1 / THRESHOLD on average.
SECOND_ONE_IN = 4
#: Shared coordinates below which a pair cannot be near: five standard deviations under the threshold's mean.
LEAST_SHARED = 35
#: Shingles hashed at once, and columns of an intersection matrix.
CHUNK = 4_096

_RNG = np.random.default_rng(2)
_LETTER = _RNG.integers(0, 2**64, 256, np.uint64)
_PLACE = _RNG.integers(0, 2**64, WORDS + 1, np.uint64) | np.uint64(1)
_MULTIPLY = _RNG.integers(0, 2**64, COORDINATES, np.uint64) | np.uint64(1)
_ADD = _RNG.integers(0, 2**64, COORDINATES, np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 12, 13, 32]] = True
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        for name, base in (("up", _BASE), ("down", _UNBASE)):
            steps = np.full(max(n, 1 << 16), base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def shingles(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams of a text.

    Words are runs without blanks, in lower case. A text of fewer words than an n-gram has one
    shingle, all of its words; a text without words has none.
    """
    data = np.frombuffer(text.lower().encode(), np.uint8)
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_SPACE[data]
    edges = np.diff(inside)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if not len(starts):
        return np.empty(0, np.uint64)
    up, down = _power(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LETTER[data] * up[: len(data)], out=sums[1:])
    words = _mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _BASE)
    n = min(WORDS, len(words))
    count = len(words) - n + 1
    total = np.full(count, _PLACE[WORDS] * np.uint64(n), np.uint64)
    for k in range(n):
        total = _mix(total + words[k : k + count] * _PLACE[k])
    return np.unique(total)


def coordinates(tokens: np.ndarray) -> np.ndarray:
    """Minhash values of a set that is not empty, 32 bits each."""
    best = np.full(COORDINATES, 2**64 - 1, np.uint64)
    for at in range(0, len(tokens), CHUNK):
        part = tokens[at : at + CHUNK]
        hashed = np.multiply.outer(_MULTIPLY, part)
        hashed += _ADD[:, None]
        hashed ^= hashed >> np.uint64(32)
        hashed *= _BASE
        np.minimum(best, hashed.min(1), out=best)
    return (_mix(best) >> np.uint64(32)).astype(np.uint32)


def set_key(tokens: np.ndarray) -> bytes:
    """128 bits that equal sets share."""
    first = _mix(tokens + np.uint64(1)).sum(dtype=np.uint64)
    second = _mix(tokens ^ _BASE).sum(dtype=np.uint64)
    return first.tobytes() + second.tobytes()


def runs_for(recall: float, depth: int = DEPTH, threshold: float = THRESHOLD) -> int:
    """Runs until a pair at the threshold, split ``depth`` times, is met with the wanted probability."""
    lost = 1 - threshold
    stay = 1 - ((1 - 1 / SECOND_ONE_IN) * lost + lost**2 / SECOND_ONE_IN)
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**FIRST * stay ** (depth - 1)))


def embed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, h, set, coords, sketch) per document; ``set`` is null where there are no words."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, coords, sketches = [], [], []
            for text in batch.column(2):
                tokens = shingles(text.as_py())
                if len(tokens):
                    values = coordinates(tokens)
                    keys.append(set_key(tokens))
                    coords.append(values.view(np.int32))
                    sketches.append(values.astype(np.uint8).tobytes())
                else:
                    keys.append(None)
                    coords.append(None)
                    sketches.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(coords, pa.list_(pa.int32())), pa.array(sketches, pa.binary())], ["id", "h", "set", "coords", "sketch"]
            )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).select("id", F.xxhash64("text").alias("h"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(measure, "id long, h long, set binary, coords array<int>, sketch binary")


def _split(path: Column, coords: Column, level: int) -> Column:
    """The paths on which a set goes on: the same coordinates for all sets of a bucket."""
    first = F.pmod(F.xxhash64(path, F.lit(level), F.lit("first")), F.lit(COORDINATES)).cast("int")
    second = F.pmod(F.xxhash64(path, F.lit(level), F.lit("second")), F.lit(COORDINATES)).cast("int")
    twice = F.pmod(F.xxhash64(path, F.lit(level), F.lit("twice")), F.lit(SECOND_ONE_IN)) == 0
    chosen = F.when(twice & (first != second), F.array(first, second)).otherwise(F.array(first))
    return F.transform(chosen, lambda c: F.xxhash64(path, c, F.get(coords, c)))


def _roots(coords: Column, runs: int) -> Column:
    """The first split of every run, each on coordinates of its own as long as they last."""
    chosen = [[(run * FIRST + k) % COORDINATES for k in range(FIRST)] for run in range(runs)]
    return F.array(*[F.xxhash64(F.lit(run), *[F.get(coords, F.lit(c)) for c in own]) for run, own in enumerate(chosen)])


def buckets(sets: DataFrame, runs: int) -> DataFrame:
    """(leaf, n, set): the buckets of two or more sets that are to be compared."""
    paths = sets.select(F.explode(_roots(F.col("coords"), runs)).alias("path"), "set", F.lit(None).cast("long").alias("parent_n"))
    leaves = None
    for level in range(1, DEPTH + 1):
        sizes = paths.groupBy("path").agg(F.count("*").alias("n"), F.max("parent_n").alias("parent_n")).where("n > 1")
        sizes = sizes.withColumn("done", (F.col("n") <= SMALL) | (F.coalesce(F.col("n") >= ALIKE * F.col("parent_n"), F.lit(False))) | F.lit(level == DEPTH))
        tagged = cut_lineage(paths.drop("parent_n").join(sizes.drop("parent_n"), "path"))
        found = tagged.where("done").select(F.col("path").alias("leaf"), "n", "set")
        leaves = found if leaves is None else leaves.unionByName(found)
        large = tagged.where("not done")
        if level == DEPTH or large.isEmpty():
            break
        split = large.join(sets.select("set", "coords"), "set")
        paths = split.select(F.explode(_split(F.col("path"), F.col("coords"), level)).alias("path"), "set", F.col("n").alias("parent_n"))
    return leaves


def _meetings(leaves: DataFrame, sets: DataFrame) -> DataFrame:
    """(leaf, low, high, block, set, sketch, weight, others): a row per set and place where it is compared.

    ``others`` are 32 bits of all leaves of the set. A leaf of more than ``SMALL`` sets is cut into blocks, and
    every pair of blocks is a place.
    """
    short = F.hash("leaf")
    own = leaves.groupBy("set").agg(F.array_sort(F.collect_set(short)).alias("others"))
    rows = leaves.join(own, "set").join(sets.select("set", "sketch", "weight"), "set")
    n_blocks = F.when(F.col("n") <= SMALL, 1).otherwise(F.ceil(F.col("n") / BLOCK)).cast("int")
    rows = rows.withColumn("n_blocks", n_blocks).withColumn("block", F.pmod(F.xxhash64("set", "leaf"), F.col("n_blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    return rows.select(
        "leaf", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", short.alias("short"), "set", "sketch", "weight", "others"
    )


def _whole_groups(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Runs of about ``rows`` rows that end with a group (leaf, low, high), and where the groups begin."""
    waiting: list[pa.RecordBatch] = []

    def cuts(table: pa.Table) -> np.ndarray:
        changed = np.zeros(table.num_rows, bool)
        changed[:1] = True
        for name in ("leaf", "low", "high"):
            values = table.column(name).to_numpy()
            changed[1:] |= values[1:] != values[:-1]
        return np.flatnonzero(changed)

    for batch in batches:
        waiting.append(batch)
        if sum(b.num_rows for b in waiting) >= rows:
            table = pa.Table.from_batches(waiting)
            begins = cuts(table)
            if len(begins) > 1:
                yield table.slice(0, begins[-1]).combine_chunks(), begins[:-1]
                waiting = table.slice(begins[-1]).to_batches()
    if waiting and sum(b.num_rows for b in waiting):
        table = pa.Table.from_batches(waiting).combine_chunks()
        yield table, cuts(table)


def _candidates(table: pa.Table, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one group that share enough of their sketches and have no smaller leaf in common."""
    n = table.num_rows
    sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(n, COORDINATES)
    block, short = table.column("block").to_numpy(), table.column("short").to_numpy()
    across = table.column("low").to_numpy() != table.column("high").to_numpy()
    ends = np.append(begins[1:], n)
    end_of = np.repeat(ends, ends - begins)
    others = table.column("others").to_pylist()
    # Leaves before this one, padded with values that no other row has.
    width = max(map(len, others))
    smaller = np.empty((n, width), np.int64)
    for i, (own, here) in enumerate(zip(others, short.tolist())):
        before = [x for x in own if x < here]
        smaller[i, : len(before)] = before
        smaller[i, len(before) :] = 2**40 + i
    left, right = [], []
    active = np.arange(n)
    for step in range(1, int((ends - begins).max(initial=1))):
        active = active[active + step < end_of[active]]
        if not len(active):
            break
        for at in range(0, len(active), 1 << 16):
            a = active[at : at + (1 << 16)]
            b = a + step
            near = (sketch[a] == sketch[b]).sum(1) >= LEAST_SHARED
            near &= ~across[a] | (block[a] != block[b])
            a, b = a[near], b[near]
            for lo in range(0, len(a), 2_048):
                p, q = a[lo : lo + 2_048], b[lo : lo + 2_048]
                first = ~(smaller[p][:, :, None] == smaller[q][:, None, :]).any((1, 2))
                left.append(p[first])
                right.append(q[first])
    if not left:
        return np.empty(0, int), np.empty(0, int)
    return np.concatenate(left), np.concatenate(right)


PLACE = "leaf long, low int, high int, block int, short int, set binary, sketch binary, weight long, others array<int>"


def _sketch_matches(meetings: DataFrame) -> DataFrame:
    """The rows of ``meetings`` that take part in a candidate pair there."""

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, begins in _whole_groups(batches, 20_000):
            rows = np.unique(np.concatenate(_candidates(table, begins)))
            yield from table.take(pa.array(rows)).to_batches()

    placed = meetings.repartition("leaf", "low", "high").sortWithinPartitions("leaf", "low", "high", "set")
    return placed.mapInArrow(match, PLACE)


def _similar(tokens: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the pairs reach the threshold, exactly."""
    sizes = np.array([len(t) for t in tokens])
    if len(left) <= 4 * len(tokens):
        common = np.array([len(np.intersect1d(tokens[a], tokens[b], assume_unique=True)) for a, b in zip(left.tolist(), right.tolist())], np.int64)
    else:
        # Intersections of all members at once, a run of tokens at a time.
        ids, column = np.unique(np.concatenate(tokens), return_inverse=True)
        row = np.repeat(np.arange(len(tokens)), sizes)
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        total = np.zeros((len(tokens), len(tokens)), np.float64)
        for at in range(0, len(ids), CHUNK):
            lo, hi = np.searchsorted(column, (at, at + CHUNK))
            holds = np.zeros((len(tokens), min(CHUNK, len(ids) - at)), np.float32)
            holds[row[lo:hi], column[lo:hi] - at] = 1
            total += holds @ holds.T
        common = np.rint(total[left, right]).astype(np.int64)
    return common >= threshold * (sizes[left] + sizes[right] - common)


def _links(matched: DataFrame, threshold: float) -> DataFrame:
    """(set, links, root): per place and member, how many documents it is linked to there, and an edge."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, begins in _whole_groups(batches, 256):
            left, right = _candidates(table, begins)
            sets, weight = table.column("set").to_pylist(), table.column("weight").to_numpy()
            texts = table.column("text")
            links = np.zeros(len(sets), np.int64)
            root = list(range(len(sets)))

            def find(i: int) -> int:
                while root[i] != i:
                    root[i] = root[root[i]]
                    i = root[i]
                return i

            ends = np.append(begins[1:], table.num_rows)
            group = np.searchsorted(begins, left, "right") - 1
            order = np.argsort(group, kind="stable")
            left, right, group = left[order], right[order], group[order]
            for g in np.unique(group).tolist():
                lo, hi = np.searchsorted(group, (g, g + 1))
                base = int(begins[g])
                tokens = [shingles(texts[i].as_py()) for i in range(base, int(ends[g]))]
                near = _similar(tokens, left[lo:hi] - base, right[lo:hi] - base, threshold)
                for a, b in zip(left[lo:hi][near].tolist(), right[lo:hi][near].tolist()):
                    links[a] += weight[b]
                    links[b] += weight[a]
                    root[find(a)] = find(b)
            linked = np.flatnonzero(links).tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([sets[i] for i in linked], pa.binary()), pa.array(links[linked], pa.int64()), pa.array([sets[find(i)] for i in linked], pa.binary())], ["set", "links", "root"]
            )

    placed = matched.repartition("leaf", "low", "high").sortWithinPartitions("leaf", "low", "high", "set")
    return placed.mapInArrow(verify, "set binary, links long, root binary")


def _grouped(docs: DataFrame, threshold: float, recall: float, id_col: str, text_col: str) -> DataFrame:
    """(id, h, class_id, n_links, stays) per row of ``docs``; ``stays`` marks one document of each class."""
    embedded = cut_lineage(embed(docs, id_col, text_col))
    known = embedded.where(F.col("set").isNotNull())
    # Of equal sets the smallest id stands for all; null ids come last.
    kept = F.struct(F.col("id").isNull().alias("last"), "id", "h")
    sets = known.groupBy("set").agg(F.count("*").alias("weight"), F.min(kept).alias("kept"), F.first("coords").alias("coords"), F.first("sketch").alias("sketch"))
    sets = cut_lineage(sets)
    leaves = buckets(sets, runs_for(recall))
    matched = cut_lineage(_sketch_matches(_meetings(leaves, sets)))

    # One whole text for each set that is compared exactly.
    wanted = matched.select("set").distinct().join(sets.select("set", F.col("kept.id").alias("kept_id"), F.col("kept.h").alias("kept_h")), "set")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    texts = texts.join(wanted, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("h") == F.col("kept_h"))).select("set", "text").dropDuplicates(["set"])
    links = cut_lineage(_links(matched.join(texts, "set"), threshold))

    groups = connected(links.select(F.col("set").alias("a"), F.col("root").alias("b")).where("a <> b"))
    per_set = links.groupBy("set").agg(F.sum("links").alias("links"))
    facts = sets.select("set", "weight", "kept").join(per_set, "set", "left").join(groups.withColumnRenamed("node", "set"), "set", "left")
    # Sets without copies and links need no row: their document is a class of its own.
    facts = facts.where((F.col("weight") > 1) | F.col("links").isNotNull())
    facts = facts.select("set", "kept", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("group", "set").alias("group"))
    classes = facts.groupBy("group").agg(F.min("kept").alias("class"))
    facts = facts.join(classes, "group").select("set", "class", "n_links")
    joined = embedded.select("id", "h", "set").join(facts, "set", "left")
    alone = F.col("n_links").isNull()
    return joined.select(
        "id",
        "h",
        F.when(alone, F.col("id")).otherwise(F.col("class.id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        (alone | (F.col("id").eqNullSafe(F.col("class.id")) & (F.col("h") == F.col("class.h")))).alias("stays"),
    )


def similar_documents(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, class_id, n_links.

    Two documents are linked when the Jaccard similarity of their sets of five-word shingles reaches
    ``threshold`` (0.8 or more; the splitting is laid out for that). ``n_links`` counts the other documents a document
    is linked to, its copies included; ``class_id`` is the smallest id of its connected group. A null
    text or one without words is linked to nothing and its class is its own id. Rows equal in id
    and text count each, like any copies. Null ids are kept; a class of null ids only has a null id. Other
    columns are ignored. An empty table gives no rows.
    """
    found = _grouped(docs, threshold, recall, id_col, text_col)
    return found.select(F.col("id").alias(id_col), "class_id", "n_links")


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, one of each connected group: that with the smallest id, all columns as they are.

    Rows equal in id and text are one document. Texts without words (null, empty, blanks) are copies of each other:
    the one with the smallest id stays.
    """
    wordless = ~F.coalesce(F.col(text_col), F.lit("")).rlike("[^ \\t\\n\\f\\r]")
    one_wordless = docs.where(wordless).orderBy(F.col(id_col).asc_nulls_last(), F.xxhash64(text_col)).limit(1)
    docs = docs.where(~wordless)
    stays = _grouped(docs, threshold, recall, id_col, text_col).where("stays").select(F.col("id").alias("stays_id"), F.col("h").alias("stays_h")).distinct()
    named = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    place = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    key, h = F.col(place[id_col]).cast("long"), F.xxhash64(place[text_col])
    rows = named.join(stays, key.eqNullSafe(F.col("stays_id")) & (h == F.col("stays_h")))
    return rows.dropDuplicates(["stays_id", "stays_h"]).drop("stays_id", "stays_h").toDF(*docs.columns).unionByName(one_wordless)

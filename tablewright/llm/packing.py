"""Packing documents into training sequences by bounded-space online best-fit.

A task takes pieces one after another and keeps at most ``open_bins`` sequences open. Which
free spaces occur among them is one bit each in a bitset, so the best fit (the least space
that still holds the piece) is found with a shift and the lowest set bit. A piece that fits
nowhere opens a sequence; when too many are open, the fullest closes first. A task reads ahead
by a fixed number of pieces and takes each such run longest first: long pieces open sequences,
short ones fill them. Where an order is to be kept, sequences are filled from one such run only,
and a run is a short stretch of the order.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.tokens import encoder
from tablewright.session import cut_lineage

CAPACITY = 2048
OPEN_BINS = 2048
#: Pieces that a task looks at together; each run of so many goes in longest first.
LOOKAHEAD = 4096
#: Tokens of a run where an order is kept: an eighth of a round of the mixing schedule, at four characters a token.
STRETCH_TOKENS = 1 << 21
PIECES = "id long, piece int, start long, length long, ids_crc32 long"
PIECE_NAMES = ["id", "piece", "start", "length", "ids_crc32"]


def best_fit(lengths: Iterable[int], capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> Iterator[tuple[int, int]]:
    """For each length (1 to capacity): the number of its bin, and its offset there."""
    bins = defaultdict(list)  # free space -> open bins with it
    free_bits = 0
    n_open = n_bins = 0
    for length in lengths:
        fits = free_bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            held = bins[free]
            number = held.pop()
            if not held:
                free_bits ^= 1 << free
            n_open -= 1
        else:
            free, number = capacity, n_bins
            n_bins += 1
        yield number, capacity - free
        left = free - length
        if left:
            if n_open == open_bins:
                # The fullest of all open bins, this one included, closes.
                fullest = (free_bits & -free_bits).bit_length() - 1
                if left <= fullest:
                    continue
                held = bins[fullest]
                held.pop(0)
                if not held:
                    free_bits ^= 1 << fullest
                n_open -= 1
            bins[left].append(number)
            free_bits |= 1 << left
            n_open += 1


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str, text_col: str, place: tuple[Column, ...] = ()) -> DataFrame:
    """Encoded documents, each followed by ``end_id``, cut at ``capacity`` where longer; and ``place_0``, ... of the document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        tail = int(end_id).to_bytes(4, "little")
        for batch in batches:
            out = ([], [], [], [], [])
            row = []
            for i, (doc_id, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1))):
                ids = memoryview(encode.ids(text.as_py() or "") + tail)
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for column, value in zip(out, (doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part))):
                        column.append(value)
                    row.append(i)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            places = [column.take(pa.array(row, pa.int64())) for column in batch.columns[2:]]
            yield pa.RecordBatch.from_arrays([*[pa.array(c, k) for c, k in zip(out, kinds)], *places], ["id", "piece", "start", "length", "ids_crc32", *names])

    names = [f"place_{i}" for i in range(len(place))]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *[c.cast("long").alias(n) for c, n in zip(place, names)])
    return rows.mapInArrow(cut, ", ".join([PIECES, *[f"{n} long" for n in names]]))


def file_order(docs: DataFrame) -> tuple[Column, ...]:
    """Where a row of a table that Spark has written stands: number of its part, number of the part's file, row of the file.

    Readers put the files into partitions by size. A frame that is not read from files has the order of its partitions.
    """
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    by_partition = (F.monotonically_increasing_id(),)
    if not plan.nodeName().endswith("Relation"):
        return by_partition  # sorted or joined since it was read
    number = lambda pattern: F.coalesce(F.expr(f"try_cast(nullif(regexp_extract(_metadata.file_name, '{pattern}', 1), '') AS long)"), F.lit(0))
    place = (number("^part-([0-9]+)"), number("[-.]c([0-9]+)[.]"), F.xxhash64("_metadata.file_name"), F.col("_metadata.row_index"))
    try:
        docs.select(*place).schema
    except AnalysisException:
        return by_partition  # not files, or files whose rows have no numbers
    return place


def pack_documents(
    docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, open_bins: int = OPEN_BINS,
    lookahead: int = LOOKAHEAD, in_order: bool = False, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    Only lengths and checksums are shuffled, spread by a hash of the piece so that no document,
    however long, fills one task; each task packs its share, in hash order, and numbers its
    sequences by partition. With ``in_order`` the pieces are packed in the order in which the documents
    were written (``file_order``), spread by ranges of it: each run of ``lookahead`` pieces, or fewer at
    ``STRETCH_TOKENS`` tokens, has its own sequences, and ``sequence_id`` follows the order. A null text is empty (one token, the end id); repeated rows and null
    ids are packed like any other. Other columns are ignored. An empty table gives no rows.
    """
    order = file_order(docs) if in_order else ()
    pieces = token_pieces(docs, tokenizer, end_id, capacity, id_col, text_col, order)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        feed = _Feed()
        packed = best_fit(feed, capacity, open_bins)
        for rows in _runs(batches, lookahead):
            longest_first = np.argsort(-rows.column("length").to_numpy(), kind="stable")
            rows = rows.take(pa.array(longest_first))
            lengths = rows.column("length").to_pylist()
            feed.give(lengths)
            placed = [next(packed) for _ in lengths]
            rows = rows.append_column("sequence_id", pa.array([base + b for b, _ in placed], pa.int64()))
            yield from rows.append_column("offset", pa.array([o for _, o in placed], pa.int64())).to_batches()

    def place_in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 40
        for run in _runs(batches, lookahead):
            for rows in _stretches(run, STRETCH_TOKENS):
                lengths = rows.column("length").to_numpy()
                longest_first = np.argsort(-lengths, kind="stable")
                bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
                for i, (number, offset) in zip(longest_first.tolist(), best_fit(lengths[longest_first].tolist(), capacity, open_bins)):
                    bins[i], offsets[i] = number, offset
                # Sequences are numbered as their first pieces come.
                _, begins, own = np.unique(bins, return_index=True, return_inverse=True)
                numbers = np.argsort(np.argsort(begins))[own]
                rows = rows.select(PIECE_NAMES).append_column("sequence_id", pa.array(first + numbers, pa.int64()))
                yield from rows.append_column("offset", pa.array(offsets, pa.int64())).to_batches()
                first += len(begins)

    if in_order:
        # Tokens are counted once: ranges are sampled from the written pieces.
        pieces = cut_lineage(pieces)
        keys = [f"place_{i}" for i in range(len(order))] + ["piece"]
        placed = pieces.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(place_in_order, f"{PIECES}, sequence_id long, offset long")
        return placed.withColumnRenamed("id", id_col)
    mixed = pieces.repartition("id", "piece").sortWithinPartitions(F.xxhash64("id", "piece", F.lit("pack")), "id", "piece", "length", "ids_crc32")
    return mixed.mapInArrow(place, f"{PIECES}, sequence_id long, offset long").withColumnRenamed("id", id_col)


def _runs(batches: Iterable[pa.RecordBatch], n: int) -> Iterator[pa.Table]:
    """The rows of the batches in runs of n; the last may be shorter."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        waiting.append(batch)
        while sum(b.num_rows for b in waiting) >= n:
            rows = pa.Table.from_batches(waiting)
            yield rows.slice(0, n).combine_chunks()
            waiting = rows.slice(n).to_batches()
    if waiting and sum(b.num_rows for b in waiting):
        yield pa.Table.from_batches(waiting).combine_chunks()


def _stretches(rows: pa.Table, tokens: int) -> Iterator[pa.Table]:
    """The rows in stretches of at most so many tokens; a piece alone may have more."""
    ends = np.cumsum(rows.column("length").to_numpy())
    at = 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + tokens, "right")))
        yield rows.slice(at, stop - at)
        at = stop


class _Feed:
    """Lengths that arrive batch by batch, as one iterator."""

    def __init__(self):
        self.now: Iterator[int] = iter(())

    def give(self, lengths: list[int]) -> None:
        self.now = iter(lengths)

    def __iter__(self):
        return self

    def __next__(self) -> int:
        return next(self.now)

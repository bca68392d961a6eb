"""Mixing sources to target weights by Pfair scheduling.

Each source's text is cut into blocks of equal volume. A source of weight w owes its k-th block
in the slots from floor(k / w) to ceil((k + 1) / w); among the blocks whose time has come, the
one with the earliest deadline takes the next slot. All deadlines are met, so at every slot each
source has had its weight times the slots so far, give or take less than one block.

Weights are taken exactly, as fractions, so the deviation does not grow with the slots. When a
source has run out its share goes to the others: the target at a slot is what all sources
would have if they were poured in at their weights, each up to its volume. The slots are laid
out one after another by one task, which holds a block of every source and writes the places
as it goes; the driver holds none of them. Every document is placed exactly once.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.session import cut_lineage

BLOCK_CHARS = 65_536
#: Slots that are written together.
ROUND_SLOTS = 1_024
#: Default weights are volumes to this power, so small sources come up more often than their volume says.
ALPHA = 0.5
ADDED = ["mix_block", "mix_slot", "mix_start"]
ROWS_PER_BUCKET = 1_000


def schedule(blocks: dict[str, int], weights: dict[str, float]) -> Iterator[tuple[int, str, int]]:
    """(slot, source, block) for every block: at each slot every source is within one block of its weight.

    While no source is used up, block k of a source of weight w of all is due in the slots from floor(k / w)
    to ceil((k + 1) / w). A weight of zero is taken as less than all others.
    """
    names = sorted(s for s, n in blocks.items() if n)
    if not names:
        return
    exact = {s: Fraction(weights[s]) for s in names}
    least = min((x for x in exact.values() if x > 0), default=Fraction(1)) / 2**60
    exact = {s: max(x, least) for s, x in exact.items()}
    scale = math.lcm(*(x.denominator for x in exact.values()))
    whole = {s: int(x * scale) for s, x in exact.items()}
    # When level v is reached, a source has had min(blocks, weight * v). Levels at which sources end, as whole
    # numbers that keep their order, and before each the blocks of those that ended and the weight of the others.
    shift = 2 * max(whole.values()).bit_length() + 1
    ending = sorted(names, key=lambda s: ((blocks[s] << shift) // whole[s], s))
    levels = [(blocks[s] << shift) // whole[s] for s in ending]
    ended, others = [0], [sum(whole.values())]
    for s in ending:
        ended.append(ended[-1] + blocks[s])
        others.append(others[-1] - whole[s])

    def time(s: str, k: int) -> tuple[int, int]:
        """When the source has had k blocks: rounded down and up."""
        piece = bisect_left(levels, (k << shift) // whole[s])
        down, rest = divmod(others[piece] * k, whole[s])
        return ended[piece] + down, ended[piece] + down + (rest > 0)

    waiting = [(0, s, 0) for s in names]  # release, source, block
    ready: list[tuple[int, str, int, int]] = []  # deadline, source, block, release of the next
    for slot in range(sum(blocks[s] for s in names)):
        while waiting and waiting[0][0] <= slot:
            _, s, k = heapq.heappop(waiting)
            after, deadline = time(s, k + 1)
            heapq.heappush(ready, (deadline, s, k, after))
        _, s, k, after = heapq.heappop(ready)
        yield slot, s, k
        if k + 1 < blocks[s]:
            heapq.heappush(waiting, (after, s, k + 1))


def mix_sources(
    docs: DataFrame, weights: dict[str | None, float] | None = None, alpha: float = ALPHA, block_chars: int = BLOCK_CHARS, round_slots: int = ROUND_SLOTS,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """The documents with ``mix_block`` (block of its source) and ``mix_slot`` and ``mix_start`` (first code point, in its source).

    Sorting by slot, then start, gives the mixed order. A document belongs to the block in which it
    begins; a long one fills the blocks after it too, so its whole volume counts. Within a source
    documents are in hash order. ``weights`` gives each source its weight; without it, or for sources
    that it leaves out (scaled alike), volume to the power ``alpha``. A null source is a source of its own; a null text
    has no volume; sources without volume are placed in the first slot. Repeated rows are placed one
    after another. All columns are kept, but columns that have the names of the added ones are
    replaced. An empty table stays empty.
    """
    own = [c for c in docs.columns if c not in ADDED]
    place = _places(docs)
    placed = _scheduled(docs, weights, alpha, block_chars, round_slots, place[id_col], place[text_col], place[source_col])
    return placed.select(*[F.col(place[c]).alias(c) for c in own], *ADDED)


def in_mixed_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The documents, unchanged, in the order of the schedule: range-partitioned and sorted by slot. Options as in ``mix_sources``."""
    place = _places(docs)
    chosen = {"weights": None, "alpha": ALPHA, "block_chars": BLOCK_CHARS, "round_slots": ROUND_SLOTS, **options}
    placed = _scheduled(docs, **chosen, id_col=place[id_col], text_col=place[text_col], source_col=place[source_col])
    order = ["mix_slot", "mix_start", place[id_col]]
    return placed.repartitionByRange(*order).sortWithinPartitions(*order).select(*[F.col(place[c]).alias(c) for c in docs.columns])


def _places(docs: DataFrame) -> dict[str, str]:
    """Plain names for the columns while the schedule is joined, so none can clash."""
    return {c: f"c{i}" for i, c in enumerate(docs.columns)}


def _lay_out(volumes: DataFrame, given: dict[str, float], alpha: float, block_chars: int, round_slots: int) -> DataFrame:
    """(source, block, slot) of every block, from (source, chars): one task goes through the slots and writes them as it goes."""

    def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chars = {s: c for batch in batches for s, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if c}
        natural = {s: c**alpha for s, c in chars.items()}
        named = sorted(s for s in natural if s in given)
        scale = math.fsum(given[s] for s in named) / math.fsum(natural[s] for s in named) if named else 1
        places = schedule({s: -(-c // block_chars) for s, c in chars.items()}, {s: given.get(s, scale * w) for s, w in natural.items()})
        while together := list(islice(places, round_slots)):
            slots, sources, blocks = zip(*together)
            yield pa.RecordBatch.from_arrays([pa.array(sources, pa.string()), pa.array(blocks, pa.int64()), pa.array(slots, pa.int64())], ["source", "block", "slot"])

    return cut_lineage(volumes.coalesce(1).mapInArrow(lay_out, "source string, block long, slot long"))


def _scheduled(docs: DataFrame, weights, alpha: float, block_chars: int, round_slots: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    docs = docs.toDF(*_places(docs).values())
    prefix = "mix_"
    key, at, volume, bucket, offset = (f"{prefix}{x}" for x in ("key", "hash", "size", "bucket", "offset"))
    given = {("null" if s is None else f"={s}"): float(w) for s, w in (weights or {}).items()}

    hashed = F.xxhash64(F.col(id_col), F.col(text_col), F.lit("mix"))
    rows = docs.withColumns(
        {
            key: F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("null")),
            at: hashed,
            volume: F.coalesce(F.length(text_col), F.lit(0)).cast("long"),
        }
    )
    per_source = cut_lineage(rows.groupBy(key).agg(F.sum(volume).alias("chars"), F.count("*").alias("n")))
    plan = _lay_out(per_source.select(F.col(key).alias("source"), "chars"), given, alpha, block_chars, round_slots)

    n_rows = per_source.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).collect()[0]["n"]
    buckets = max(1, math.ceil(n_rows / ROWS_PER_BUCKET))
    rows = rows.withColumn(bucket, F.pmod(F.col(at), F.lit(buckets)))
    # Where each bucket begins in its source, and the slots of the blocks it reaches: a few rows per source, however large the source.
    totals = rows.groupBy(key, bucket).agg(F.sum(volume).alias("chars"))
    before = Window.partitionBy(key).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    last = F.ceil(F.sum("chars").over(Window.partitionBy(key)) / block_chars) - 1
    reached = totals.select(key, bucket, "chars", F.coalesce(F.sum("chars").over(before), F.lit(0)).alias(offset), last.alias("last"))
    bounds = [F.least(F.floor(x / block_chars), F.col("last")) for x in (F.col(offset), F.col(offset) + F.col("chars"))]
    reached = reached.withColumn("block", F.explode_outer(F.when(F.col("last") >= 0, F.sequence(*bounds))))
    reached = reached.join(plan.withColumnRenamed("source", key), [key, "block"], "left")
    offsets = reached.groupBy(key, bucket).agg(
        F.max(offset).alias(offset),
        F.max("last").alias(f"{prefix}last"),
        F.min("block").alias(f"{prefix}first"),
        F.array_sort(F.collect_list("slot")).alias(f"{prefix}slots"),  # a source's slots rise with its blocks
    )
    inside = Window.partitionBy(key, bucket).orderBy(at, id_col, volume).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(offsets, [key, bucket]).withColumn(f"{prefix}start", F.col(offset) + F.coalesce(F.sum(volume).over(inside), F.lit(0)))
    block = F.least(F.floor(F.col(f"{prefix}start") / block_chars), F.col(f"{prefix}last"))
    placed = placed.withColumn(f"{prefix}block", F.greatest(block, F.lit(0)).cast("long"))
    slot = F.get(f"{prefix}slots", (F.col(f"{prefix}block") - F.col(f"{prefix}first")).cast("int"))
    placed = placed.withColumn(f"{prefix}slot", F.coalesce(slot, F.lit(0)).cast("long"))
    return placed.select(*docs.columns, f"{prefix}block", f"{prefix}slot", f"{prefix}start")

"""Locality-sensitive digests of texts: quartiles of hashed byte triplets.

A five-byte window slides over the UTF-8 text; the six triplets that hold its newest byte are
hashed into 128 buckets. Each bucket's count is written as its quartile among the counts
(two bits), after a header of a checksum, the logarithm of the length and the ratios of the
quartiles. Texts that share most of their bytes give digests that differ in few codes.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.session import shuffle_width

BUCKETS = 128
#: The newest byte and two of the four before it, as distances back.
TRIPLETS = [(1, 2), (1, 3), (2, 3), (2, 4), (1, 4), (3, 4)]
#: Bytes counted at once; it bounds the memory of a long text.
CHUNK = 1 << 20
LENGTH_BASE = 1.1
#: Cost of codes that differ by 0, 1, 2, 3 quartiles, of a step in a header field, and the bound of the score.
CODE_COST = np.array([0, 1, 2, 6])
FIELD_COST = 12
MAX_DIFFERENCE = 400
RANGES_PER_PARTITION = 4


def triplet_counts(data: bytes) -> np.ndarray:
    """How many triplets fall into each bucket."""
    counts = np.zeros(BUCKETS, np.int64)
    step = CHUNK - 4
    for at in range(0, max(len(data) - 4, 0), step):
        b = np.frombuffer(data, np.uint8, min(CHUNK, len(data) - at), at).astype(np.uint32)
        newest, one, two = b[4:] * np.uint32(0x9E3779B1), b * np.uint32(0x85EBCA6B), b * np.uint32(0xC2B2AE35)
        n = len(newest)
        for salt, (i, j) in enumerate(TRIPLETS):
            mixed = newest + one[4 - i : 4 - i + n]
            mixed ^= two[4 - j : 4 - j + n]
            mixed += np.uint32(salt * 0x27D4EB2F & 0xFFFFFFFF)
            mixed *= np.uint32(0x165667B1)
            mixed >>= np.uint32(25)
            counts += np.bincount(mixed, minlength=BUCKETS)
    return counts


def digest(text: str) -> np.ndarray:
    """Header fields (checksum, length, two ratios), then 128 quartile codes. Defined for every text, the empty one too."""
    data = text.encode()
    counts = triplet_counts(data)
    ordered = np.sort(counts)
    q1, q2, q3 = (int(ordered[BUCKETS * k // 4 - 1]) for k in (1, 2, 3))
    codes = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    length = min(255, round(math.log(len(data) + 1, LENGTH_BASE)))
    ratios = [q * 15 // q3 if q3 else 0 for q in (q1, q2)]
    return np.concatenate([np.array([zlib.crc32(data) & 255, length, *ratios], np.uint8), codes.astype(np.uint8)])


def to_hex(d: np.ndarray) -> str:
    codes = d[4:].reshape(-1, 4)
    body = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    return bytes([int(d[0]), int(d[1]), int(d[2]) << 4 | int(d[3])]).hex() + body.astype(np.uint8).tobytes().hex()


def difference(a: np.ndarray, b: np.ndarray) -> int:
    """0 for equal digests; each field and code adds to it."""
    apart = np.abs(a.astype(np.int16) - b)
    total = int(a[0] != b[0]) + int(CODE_COST[apart[4:]].sum())
    for step in apart[1:4].tolist():
        total += step if step <= 1 else (step - 1) * FIELD_COST
    return total


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """1 for equal digests, 0 at ``MAX_DIFFERENCE`` and beyond."""
    return 1 - min(difference(a, b), MAX_DIFFERENCE) / MAX_DIFFERENCE


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(range_no, border, id, tie, text) such that sorting a range puts every document before its successor.

    Documents go to ranges of ids; a copy of each range's first document is also sent, marked as
    border, to the range before it (the very first one to the last range). So each text is shuffled
    once, and no order spans tasks. What reaches the driver is the range bounds and the
    first id of each range.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    n = RANGES_PER_PARTITION * shuffle_width(spark)
    cuts = docs.select(F.col(id_col).cast("double").alias("id")).approxQuantile("id", [k / n for k in range(1, n)], 0.2 / n) if n > 1 else []
    splits = [-math.inf, *(sorted(set(cuts)) or [0.0]), math.inf]
    keyed = rows.withColumn("as_double", F.col("id").cast("double"))
    ranged = Bucketizer(splits=splits, inputCol="as_double", outputCol="range", handleInvalid="keep").transform(keyed)
    ranged = ranged.select(F.when(F.col("id").isNull(), -1).otherwise(F.col("range")).cast("int").alias("range_no"), "id", "tie", "text")
    first = F.min(F.struct(F.col("id").isNotNull().alias("known"), "id", "tie")).alias("first")
    heads = sorted(ranged.groupBy("range_no").agg(first).collect(), key=lambda r: r["range_no"])
    # One row per range: its first document, and the range that needs a copy of it.
    targets = [(r["range_no"], r["first"]["id"], r["first"]["tie"], heads[i - 1]["range_no"]) for i, r in enumerate(heads)]
    borders = spark.createDataFrame(targets, "range_no int, head_id long, head_tie long, target int")
    marked = ranged.join(F.broadcast(borders), "range_no")
    here = F.struct(F.col("range_no"), F.lit(0).alias("border"))
    there = F.struct(F.col("target").alias("range_no"), F.lit(1).alias("border"))
    is_head = F.col("id").eqNullSafe(F.col("head_id")) & (F.col("tie") == F.col("head_tie"))
    places = F.when(is_head, F.array(here, there)).otherwise(F.array(here))
    return marked.select(F.inline(places), "id", "tie", "text")


def fingerprint_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the document with its last half (rounded down, code points) replaced by the
    start of the next document in order of ids. A null text counts as empty; null ids come first;
    rows of one id follow each other by a hash of their texts; a table of one document follows
    itself. Texts under five bytes have no triplets, so their digests are equal if their lengths
    and checksums are. Other columns are ignored; an empty table stays empty.
    """

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # range, id, text, its digest
        names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        for batch in batches:
            out = [[] for _ in names]
            heads = zip(batch.column("range_no").to_pylist(), batch.column("border").to_pylist(), batch.column("id").to_pylist(), batch.column("text"))
            for range_no, border, doc_id, text in heads:
                if border and (held is None or held[0] != range_no):
                    continue  # a further copy of the same border
                text = text.as_py()
                own = digest(text)
                if held is not None and held[0] == range_no:
                    _, before_id, before, before_digest = held
                    half = len(before) // 2
                    edited = before[: len(before) - half] + text[:half]
                    edited_digest = digest(edited)
                    values = (
                        before_id, len(before), hashlib.sha256(edited.encode()).hexdigest(), to_hex(before_digest), to_hex(edited_digest),
                        likeness(before_digest, edited_digest), likeness(before_digest, own),
                    )
                    for column, value in zip(out, values):
                        column.append(value)
                held = None if border else (range_no, doc_id, text, own)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)

    order = ["range_no", "border", F.col("id").asc_nulls_first(), "tie"]
    placed = with_next(docs, id_col, text_col).repartition("range_no").sortWithinPartitions(*order)
    schema = f"`{id_col}` long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return placed.mapInArrow(digests, schema)

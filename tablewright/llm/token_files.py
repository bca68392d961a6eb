"""Token ids in files of fixed-width bits.

Every id takes the fewest bits that hold the vocabulary. A file is

    magic | blocks | document index | block offsets | footer

A block packs up to ``block_ids`` ids, 64 ids to ``width`` 64-bit words, so packing and
unpacking are a few array operations. The block offsets let a reader fetch any range of
ids with one read of the blocks that hold it. The document index has each document's id
(with a null flag) and length. All numbers are little-endian.

Executors write the files straight into a folder that all of them reach (pyarrow opens local,
S3, GCS and HDFS paths), each attempt under a name of its own. Only files that the manifest
names are part of the result, so a lost or repeated task leaves nothing behind that is read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.tokens import encoder
from tablewright.session import scratch_path

MAGIC = b"BITIDS01"
FOOTER = struct.Struct("<BIQQQQ8s")  # width, block_ids, n_ids, n_docs, index at, offsets at, magic
BLOCK_IDS = 1 << 16
#: Ids that a reader holds at once.
READ_IDS = 1 << 20


def width_for(vocab_size: int) -> int:
    return max(1, (vocab_size - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids below 2**width, as bits from the lowest up; padded with zeros to a multiple of 64 ids."""
    rows = -(-len(ids) // 64)
    cells = np.zeros(rows * 64, "<u8")
    cells[: len(ids)] = ids
    cells = cells.reshape(rows, 64)
    words = np.zeros((rows, width), "<u8")
    for j in range(64):
        word, shift = divmod(j * width, 64)
        words[:, word] |= cells[:, j] << np.uint64(shift)
        if shift + width > 64:
            words[:, word + 1] |= cells[:, j] >> np.uint64(64 - shift)
    return words.tobytes()


def unpack(data: bytes, width: int, n: int) -> np.ndarray:
    words = np.frombuffer(data, "<u8").reshape(-1, width)
    cells = np.empty((len(words), 64), "<u8")
    for j in range(64):
        word, shift = divmod(j * width, 64)
        cells[:, j] = words[:, word] >> np.uint64(shift)
        if shift + width > 64:
            cells[:, j] |= words[:, word + 1] << np.uint64(64 - shift)
    cells &= np.uint64((1 << width) - 1)
    return cells.reshape(-1)[:n].astype("<u4")


class BitWriter:
    """Writes one file, block by block, as the ids come."""

    def __init__(self, out, vocab_size: int, block_ids: int = BLOCK_IDS):
        self.out, self.width, self.block_ids = out, width_for(vocab_size), block_ids
        self.at = out.write(MAGIC)
        self.offsets, self.n_ids = [], 0
        self.waiting: list[np.ndarray] = []
        self.n_waiting = 0
        self.doc_ids: list[int] = []
        self.nulls = bytearray()
        self.lengths: list[int] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.lengths.append(len(ids))
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= self.block_ids:
            rest = np.concatenate(self.waiting)
            whole = len(rest) // self.block_ids * self.block_ids
            for at in range(0, whole, self.block_ids):
                self._block(rest[at : at + self.block_ids])
            self.waiting, self.n_waiting = [rest[whole:].copy()], len(rest) - whole

    def _block(self, ids: np.ndarray) -> None:
        self.offsets.append(self.at)
        self.at += self.out.write(pack(ids, self.width))
        self.n_ids += len(ids)

    def close(self) -> None:
        if self.n_waiting:
            self._block(np.concatenate(self.waiting))
        self.offsets.append(self.at)
        index_at = self.at
        index = np.array(self.doc_ids, "<i8").tobytes() + bytes(self.nulls) + np.array(self.lengths, "<i8").tobytes()
        offsets_at = index_at + self.out.write(index)
        self.out.write(np.array(self.offsets, "<u8").tobytes())
        self.out.write(FOOTER.pack(self.width, self.block_ids, self.n_ids, len(self.doc_ids), index_at, offsets_at, MAGIC))


class BitReader:
    """Random access to one file; ``source`` is an open, seekable file."""

    def __init__(self, source):
        self.source = source
        end = source.seek(0, 2)
        self.width, self.block_ids, self.n_ids, n, index_at, offsets_at, magic = FOOTER.unpack(self._read(end - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a file of packed ids")
        index = self._read(index_at, 17 * n)
        null = np.frombuffer(index, "u1", n, 8 * n)
        ids = np.frombuffer(index, "<i8", n)
        self.doc_ids = [None if gone else i for i, gone in zip(ids.tolist(), null.tolist())]
        self.lengths = np.frombuffer(index, "<i8", n, 9 * n)
        self.offsets = np.frombuffer(self._read(offsets_at, end - FOOTER.size - offsets_at), "<u8")

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids from start to stop (exclusive); reads only the blocks that hold them."""
        stop = min(stop, self.n_ids)
        if start >= stop:
            return np.empty(0, "<u4")
        first, last = start // self.block_ids, (stop - 1) // self.block_ids
        begin = int(self.offsets[first])
        data = self._read(begin, int(self.offsets[last + 1]) - begin)
        base = first * self.block_ids
        # Whole blocks are multiples of 64 ids, so their words can be read as one run.
        return unpack(data, self.width, stop - base)[start - base :]


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, append ``end_id``, write files in ascending id order; returns their manifest.

    Manifest: shard (files in order of ids), file, n_docs, n_ids, start (ids in all files before).
    A null text is empty (only the end id). A null document id comes first; equal ids are ordered by
    a hash of the text. Other columns are ignored. An empty table gives no files. A text of any
    length is encoded whole; one text must fit a task's memory.
    """
    spark = docs.sparkSession
    folder = path.rstrip("/")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        out = writer = None
        shard = TaskContext.get().partitionId()
        name = f"{folder}/ids-{shard:06d}-{uuid.uuid4().hex}.bits"
        encode = encoder(tokenizer)
        tail = int(end_id).to_bytes(4, "little")
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                store, place = fs.FileSystem.from_uri(name)
                store.create_dir(place.rsplit("/", 1)[0], recursive=True)
                out = store.open_output_stream(place)
                writer = BitWriter(out, encode.vocab_size)
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                writer.add(doc_id, np.frombuffer(encode.ids(text.as_py() or "") + tail, "<u4"))
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"shard": [shard], "file": [name], "n_docs": [len(writer.doc_ids)], "n_ids": [writer.n_ids]})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # Bounds come from the ids alone, so the sampling pass reads no text.
    first = F.col("id").asc_nulls_first()
    ordered = rows.repartitionByRange(first).sortWithinPartitions(first, F.xxhash64("text"))
    manifest_path = f"{folder}/_manifest"
    ordered.mapInArrow(write, "shard long, file string, n_docs long, n_ids long").write.parquet(manifest_path)

    # One row per file; the running sum over them is done here.
    files = sorted(spark.read.parquet(manifest_path).collect(), key=lambda r: r["shard"])
    before, rows_out = 0, []
    for r in files:
        rows_out.append((r["shard"], r["file"], r["n_docs"], r["n_ids"], before))
        before += r["n_ids"]
    return spark.createDataFrame(rows_out, "shard long, file string, n_docs long, n_ids long, start long")


def read_token_files(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document from the files: id, start, n_tokens, ids_crc32 (of 32-bit little-endian ids)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, place = fs.FileSystem.from_uri(row["file"])
                with store.open_input_file(place) as source:
                    yield from _documents(BitReader(source), row["start"], id_col)

    n = max(1, manifest.count())
    spread = manifest.repartitionByRange(n, "shard")
    return spread.mapInArrow(read, f"`{id_col}` long, start long, n_tokens long, ids_crc32 long")


def _documents(reader: BitReader, start: int, id_col: str) -> Iterator[pa.RecordBatch]:
    ends = np.cumsum(reader.lengths)
    begins = ends - reader.lengths
    at = 0
    while at < len(ends):
        upto = max(at + 1, int(np.searchsorted(ends, begins[at] + READ_IDS, "right")))
        crcs = []
        if upto == at + 1:  # possibly longer than what is held at once
            crc = 0
            for lo in range(int(begins[at]), int(ends[at]), READ_IDS):
                crc = zlib.crc32(reader.ids(lo, min(lo + READ_IDS, int(ends[at]))).tobytes(), crc)
            crcs.append(crc)
        else:
            held = memoryview(reader.ids(int(begins[at]), int(ends[upto - 1])).tobytes())
            cuts = ((np.append(begins[at:upto], ends[upto - 1]) - begins[at]) * 4).tolist()
            crcs = [zlib.crc32(held[a:b]) for a, b in zip(cuts, cuts[1:])]
        yield pa.RecordBatch.from_arrays(
            [pa.array(reader.doc_ids[at:upto], pa.int64()), pa.array(begins[at:upto] + start), pa.array(reader.lengths[at:upto]), pa.array(crcs, pa.int64())],
            [id_col, "start", "n_tokens", "ids_crc32"],
        )
        at = upto


def token_table(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write the files into the shared folder and read them back."""
    path = scratch_path(docs.sparkSession, "token-files")
    return read_token_files(write_token_files(docs, path, tokenizer, end_id))

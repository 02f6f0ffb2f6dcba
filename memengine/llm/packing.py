"""Bounded-space online best-fit packing of tokenised documents into sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memengine.llm.common import as_bytes, chunks, cut, table
from memengine.llm.tokenizing import REMEMBERED, encoder

CAPACITY, OPEN_BINS = 1024, 1024
#: Pieces that one task packs, about; a task leaves at most OPEN_BINS sequences that are not full.
PIECES = 250_000


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, with_ids: bool = False, remembered: int = REMEMBERED) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each row's ids and ``end_id``, cut only where over ``capacity``.

    The first piece takes what does not fill a sequence, all others are full. ids are little-endian unsigned 32-bit.
    Null and empty texts are the end id alone; rows that repeat are each cut.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer, remembered), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            body, ids = batch.column("body"), batch.column("doc_id")
            for a, b, _, _ in chunks(body, 1 << 20):
                owner, rows = [], []
                for i, raw in enumerate(encode.encode([x.as_py().decode("utf-8", "replace") for x in body.slice(a, b - a)])):
                    raw += end
                    n = len(raw) // 4
                    at, size = 0, n % capacity or capacity
                    for piece in range(-(-n // capacity)):
                        part = raw[4 * at : 4 * (at + size)]
                        owner.append(i)
                        rows.append((piece, at, size, zlib.crc32(part), part))
                        at, size = at + size, capacity
                cols = list(zip(*rows, strict=True))
                out = [ids.slice(a, b - a).take(pa.array(owner)), pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:4])]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                yield pa.RecordBatch.from_arrays([*out, pa.array(cols[4])] if with_ids else out, names=[*names, "ids"] if with_ids else names)

    return as_bytes(docs).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


class OpenBins:
    """A fixed number of open bins; bit f of a bitset says that some bin has exactly f free places."""

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit, self.open, self.next, self.bits = capacity, limit, 0, 0, 0
        self.free: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, f: int) -> int:
        bin_id = self.free[f].pop()
        if not self.free[f]:
            self.bits ^= 1 << f
        self.open -= 1
        return bin_id

    def place(self, size: int) -> tuple[int, int]:
        """(bin, offset) in the open bin with the least room that is enough, or in a new one; the fullest closes for it."""
        fit = self.bits >> size
        if fit:
            f = size + (fit & -fit).bit_length() - 1
            bin_id = self._take(f)
        else:
            if self.open == self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)
            f, bin_id = self.capacity, self.next
            self.next += 1
        rest = f - size
        if rest:
            self.free[rest].append(bin_id)
            self.bits |= 1 << rest
            self.open += 1
        return bin_id, self.capacity - f


def pack(pieces: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, per_task: int = PIECES) -> DataFrame:
    """The rows of ``pieces`` with (sequence_id, offset), by best fit among ``open_bins`` open sequences.

    Pieces are dealt to tasks by hash, so tasks get alike mixes of lengths and no task grows with the data; each packs
    its own sequences in the order of that hash. ``pieces`` must be cheap to read twice (a checkpoint or a table).
    Lengths are 1 to ``capacity``; other columns pass through.
    """
    spread = F.xxhash64("doc_id", "piece", "ids_crc32")
    parts = max(1, round(pieces.count() / per_task))
    dealt = pieces.withColumn("_at", spread).repartition(parts, "_at").sortWithinPartitions("_at", "doc_id", "piece").drop("_at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, first = OpenBins(capacity, open_bins), TaskContext.get().partitionId() << 32
        for batch in batches:
            placed = [bins.place(n) for n in batch.column("length").to_pylist()]
            more = [pa.array([first + p[0] for p in placed], pa.int64()), pa.array([p[1] for p in placed], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return dealt.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids): the packed sequences themselves, from ``pack`` over pieces that carry ``ids``."""
    row = F.struct("offset", "ids", "doc_id")
    return packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(row)).alias("r")).select(
        "sequence_id", F.aggregate("r", F.lit(b""), lambda x, r: F.concat(x, r["ids"])).alias("ids"), F.col("r.doc_id").alias("doc_ids")
    )


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = CAPACITY, remembered: int = REMEMBERED) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every row of documents.

    ``remembered`` words stay with a worker: fewer take less memory and more time, and give the same rows.
    """
    return pack(cut(token_pieces(docs, tokenizer, end_id, capacity, remembered=remembered)), capacity)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))

"""Token ids as Arrow stream files of fixed-size-list batches: equal-length sequences with masks, read without copies.

A part is two files in the stream format. ``<part>.tokens`` has columns input_ids and mask, fixed-size lists of
``LENGTH`` values, in batches of ``ROWS`` sequences (the last may be shorter): the ids of the part's documents, one after
the other, padded with zeros at the very end, where the mask is false. ``<part>.docs`` has doc_id, start (ids of the
part before the document) and n_tokens.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memengine.llm.common import as_bytes, chunks, cut, fresh_dir, table
from memengine.llm.tokenizing import encoder

LENGTH, ROWS = 1024, 256
_DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def _store(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


class TokenWriter:
    """Writes one part. Files get their names only when they are whole."""

    def __init__(self, uri: str, small: bool, length: int = LENGTH, rows: int = ROWS):
        self.fs, self.path = _store(uri)
        self.dtype, self.length, self.step = np.uint16 if small else np.uint32, length, length * rows
        kind = pa.from_numpy_dtype(self.dtype)
        self.schema = pa.schema([("input_ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.out = [self.fs.open_output_stream(f"{self.path}.{x}.part") for x in ("tokens", "docs")]
        self.tokens, self.docs = pa.ipc.new_stream(self.out[0], self.schema), pa.ipc.new_stream(self.out[1], _DOCS)
        self.held: list[np.ndarray] = []
        self.n_held = self.n = self.n_docs = 0

    def add(self, doc_ids: pa.Array, ids: list[np.ndarray]) -> None:
        sizes = np.array([len(x) for x in ids], np.int64)
        starts = self.n + np.cumsum(sizes) - sizes
        self.docs.write_batch(pa.RecordBatch.from_arrays([doc_ids, pa.array(starts), pa.array(sizes)], schema=_DOCS))
        self.held.extend(ids)
        self.n_held, self.n, self.n_docs = self.n_held + int(sizes.sum()), self.n + int(sizes.sum()), self.n_docs + len(ids)
        if self.n_held >= self.step:
            flat = np.concatenate(self.held).astype(self.dtype)
            whole = len(flat) // self.step * self.step
            for a in range(0, whole, self.step):
                self._batch(flat[a : a + self.step], self.step)
            self.held, self.n_held = [flat[whole:].copy()], len(flat) - whole

    def _batch(self, flat: np.ndarray, real: int) -> None:
        mask = np.arange(len(flat)) < real
        self.tokens.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (flat, mask)], schema=self.schema))

    def close(self) -> None:
        if self.n_held:
            flat = np.concatenate(self.held).astype(self.dtype)
            self._batch(np.pad(flat, (0, -len(flat) % self.length)), len(flat))
        for stream, out, x in zip((self.tokens, self.docs), self.out, ("tokens", "docs"), strict=True):
            stream.close()
            out.close()
            self.fs.move(f"{self.path}.{x}.part", f"{self.path}.{x}")


class TokenReader:
    """Reads one part; a local part is mapped into memory, and nothing of it is copied."""

    def __init__(self, uri: str):
        fs, path = _store(uri)
        opened = [pa.memory_map(f"{path}.{x}") if isinstance(fs, pa.fs.LocalFileSystem) else fs.open_input_file(f"{path}.{x}") for x in ("tokens", "docs")]
        self.tokens, self.docs = (pa.ipc.open_stream(x) for x in opened)
        self.length = self.tokens.schema.field("input_ids").type.list_size
        self.batches: list[pa.RecordBatch] = []

    def sequence(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """(ids, mask) of sequence i: every batch but the last has as many rows as the first, so its place is known."""
        if not self.batches:
            self.batches = list(self.tokens)
        k, row = divmod(i, len(self.batches[0]))
        batch = self.batches[k]
        return batch.column(0).slice(row, 1).flatten().to_numpy(zero_copy_only=True), batch.column(1).slice(row, 1).flatten()

    def documents(self) -> Iterator[tuple[pa.RecordBatch, list[int]]]:
        """The index, batch by batch, with the crc32 of each document's ids as little-endian unsigned 32-bit integers."""
        flat, at = np.zeros(0, np.uint32), 0
        for docs in self.docs:
            sums = []
            for n in docs.column("n_tokens").to_pylist():
                crc = 0
                while n:
                    if at == len(flat):
                        flat, at = next(self.tokens).column(0).flatten().to_numpy(zero_copy_only=True), 0
                    part = flat[at : at + n]
                    crc = zlib.crc32(part.astype("<u4").tobytes(), crc)
                    at, n = at + len(part), n - len(part)
                sums.append(crc)
            yield docs, sums


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, length: int = LENGTH) -> DataFrame:
    """Write the rows' ids, each with ``end_id``, in ascending doc_id order; returns (part, uri, n_docs, n_tokens).

    ``folder`` is a URI that all tasks can write to. Parts are ranges of doc_id, null ids first. A task that runs again
    writes files of another name; the table lists the files of the attempt that counted. Null and empty texts are the
    end id alone; rows that repeat are each written.
    """
    fs, path = _store(folder)
    fs.create_dir(path, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        encode, writer = encoder(tokenizer), None
        uri = f"{folder}/{task.partitionId():06d}-{task.taskAttemptId()}"
        for batch in batches:
            body, ids = batch.column("body"), batch.column("doc_id")
            for a, b, _, _ in chunks(body, 1 << 20):
                writer = writer or TokenWriter(uri, encode.size <= 1 << 16, length)
                texts = [x.as_py().decode("utf-8", "replace") for x in body.slice(a, b - a)]
                writer.add(ids.slice(a, b - a), [np.append(np.frombuffer(x, "<u4"), np.uint32(end_id)) for x in encode.encode(texts)])
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pydict({"part": [task.partitionId()], "uri": [uri], "n_docs": [writer.n_docs], "n_tokens": [writer.n]})

    ordered = as_bytes(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return cut(ordered.mapInArrow(run, "part long, uri string, n_docs long, n_tokens long"))


def read_documents(parts: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files of ``write_tokens``; start counts over all parts."""
    listed, before = [], 0
    for r in sorted(parts.collect(), key=lambda r: r["part"]):  # a row for each file
        listed.append((r["uri"], before))
        before += r["n_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for docs, sums in TokenReader(uri).documents():
                    start = pa.array(docs.column("start").to_numpy() + base)
                    yield pa.RecordBatch.from_arrays([docs.column("doc_id"), start, docs.column("n_tokens"), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    files = parts.sparkSession.createDataFrame(listed, "uri string, base long")
    return files.repartition(max(1, len(listed))).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    parts = write_tokens(table(spark, sf_dir, "documents"), fresh_dir(spark, "tokens"), public_tokenizers.path("byte_bpe_50k.json"))
    return read_documents(parts)

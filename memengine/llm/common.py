"""What the corpus operators share: table access, checkpoints, and vectorised byte-level text handling in tasks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task looks at in one numpy step; a longer text is a step of its own.
CHUNK_BYTES = 512 << 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``); a fresh local one where it is unset and all run
    on this machine."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir is unset: name a folder that driver and executors share")
        named = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named.rstrip("/")


#: Spark's setting by which a query's shuffle files go as soon as it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows are computed once and outlive lost executors, and the shuffle files behind them go at once."""
    spark = df.sparkSession
    shared_dir(spark)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a frame follows the setting that it was made under
    finally:
        spark.conf.set(CLEANUP, before)


def placed(rows: DataFrame, *order, name: str) -> DataFrame:
    """The rows with their place, from 1, in a total order: ranges of the order are sorted apart, and each range starts
    behind the rows of those before it. The driver gets a count for each range."""
    at = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id()))
    part, counts = F.shiftrightunsigned("_row", 33), {}
    for r in at.groupBy(part.alias("part")).count().collect():
        counts[r["part"]] = r["count"]
    before, n = [], 0
    for p in range(max(counts, default=-1) + 1):
        before.append(n)
        n += counts.get(p, 0)
    start = F.element_at(F.array(*map(F.lit, before or [0])), (part + 1).cast("int"))
    return at.withColumn(name, start.cast("long") + F.col("_row").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_row")


def fresh_dir(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


_kept: dict = {}


def worker_state() -> dict:
    """What a Python worker keeps from task to task of one stage. Tasks of another stage start with nothing, so that
    one stage's memory is not held through the next ones: every function that runs in tasks asks for it once."""
    task = TaskContext.get()
    stage = task.stageId() if task else None
    if _kept.get("stage") != stage:
        _kept.clear()
        _kept["stage"] = stage
    return _kept


def as_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, body): the id, and the UTF-8 bytes of the whole text; a null text has no bytes."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("body"))


#: log2 of the bits of a hash filter: 8 MB, however many values it stands for.
FILTER_BITS = 26


def hash_filter(values: DataFrame, hashed: str) -> np.ndarray:
    """A bit set by the top FILTER_BITS bits of each 64-bit hash; the driver gets its non-empty words, 2**20 at most."""
    cell = F.shiftrightunsigned(hashed, 64 - FILTER_BITS)
    bit = F.expr(f"shiftleft(1L, int(shiftrightunsigned({hashed}, {64 - FILTER_BITS}) & 63))")
    words = values.groupBy(F.shiftright(cell, 6).alias("at")).agg(F.bit_or(bit).alias("set")).toArrow()
    bits = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    bits[words.column("at").to_numpy().astype(np.int64)] = words.column("set").to_numpy().astype(np.int64).view(np.uint64)
    return bits


def passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash may be one of the filter's values; true for every one that is."""
    cell = hashes.view(np.uint64) >> np.uint64(64 - FILTER_BITS)
    return bits[(cell >> np.uint64(6)).astype(np.int64)] >> (cell & np.uint64(63)) & np.uint64(1) != 0


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column, and the n + 1 offsets of its values in them."""
    wide = np.int64 if pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), at


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets in those bytes) for runs of rows of about ``limit`` bytes."""
    worker_state()
    data, at = buffers(column)
    a, n = 0, len(column)
    while a < n:
        b = max(a + 1, min(n, int(np.searchsorted(at, at[a] + limit, side="right")) - 1))
        yield a, b, data[at[a] : at[b]], at[a : b + 1] - at[a]
        a = b


def lookup(is_member) -> np.ndarray:
    return np.array([bool(is_member(c)) for c in range(256)])


#: Byte classes. Bytes of 128 and over belong to characters outside ASCII, which are word characters.
WORD_BYTES = lookup(lambda c: 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128)
LOWER_BYTES = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)

_M, _GOLD = 0x9E3779B97F4A7C15 | 1, np.uint64(0x9E3779B97F4A7C15)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int = _M) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n at least; base is odd."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        made = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            made.append(np.cumprod(p, dtype=np.uint64))
        have = (made[0], made[1])
        if size <= 1 << 22:
            _powers[base] = have
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit over all output bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def words(data: np.ndarray, at: np.ndarray, members: np.ndarray = WORD_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each maximal run of member bytes within a value, and how many runs each value has."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at) - 1, np.int64)
    inside = members[data]
    edge = np.empty(n + 1, bool)
    edge[0] = edge[n] = True
    np.not_equal(inside[1:], inside[:-1], out=edge[1:n])
    cuts = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < n)]
    edge[cuts] = True
    runs = np.flatnonzero(edge)
    keep = inside[runs[:-1]]
    start, end = runs[:-1][keep], runs[1:][keep]
    return start, end, np.diff(np.searchsorted(start, at))


def span_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = _M) -> np.ndarray:
    """64-bit hash of values[start:end] for each span; equal spans have equal hashes wherever they stand."""
    up, down = powers(len(values) + 1, base)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * _GOLD)


def without(docs: DataFrame, bad: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is none of ``bad(doc_id)``, as an anti join has them. Texts are shuffled only of rows that a
    filter of a fixed size may name; the others stay where they are."""
    bad, h = cut(bad), F.xxhash64(F.col("doc_id").cast("long"))
    held = docs.sparkSession.sparkContext.broadcast(hash_filter(bad.select(h.alias("h")), "h"))

    @F.pandas_udf("boolean")
    def may(hashes: pd.Series) -> pd.Series:
        return pd.Series(passes(held.value, hashes.to_numpy(np.int64)))

    asked = docs.filter(may(h)).join(bad, "doc_id", "left_anti").select(*docs.columns)
    return docs.filter(~may(h)).unionByName(asked)

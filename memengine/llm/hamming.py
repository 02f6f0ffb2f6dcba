"""Links between 64-bit fingerprints that differ in few bits, found by pigeonhole blocks."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memengine.llm.common import cut, worker_state

#: One in so many fingerprints shows which buckets are large; so many hot keys (8 bytes each) are sent to all tasks at most.
SAMPLE_ONE_IN, BROADCAST_KEYS = 64, 500_000
#: A bucket of about as many fingerprints is split by the bits that its block key leaves free.
BUCKET = 4096


def masks(bits: list[int], blocks: int, differ: int) -> list[int]:
    """Masks over ``bits`` cut into ``blocks`` runs: one mask for each choice of all but ``differ`` runs.

    Two values that differ in at most ``differ`` of the bits agree under one of the masks at least.
    """
    runs = [sum(1 << b for b in run.tolist()) for run in np.array_split(np.array(bits), blocks)]
    return [sum(kept) for kept in combinations(runs, blocks - differ)]


def _long(value: int):
    return F.lit(value - (1 << 64) if value >> 63 else value)


def star_links(ids: np.ndarray, fps: np.ndarray, differ: int) -> tuple[list, list]:
    """Links that join exactly the same nodes as all pairs within ``differ`` bits do: each component hangs on its least id.

    Only fingerprints that no component has reached yet are compared, so a dense group costs about its size.
    """
    src, dst = [], []
    left = np.arange(len(ids))
    while len(left) > 1:
        reached, edge, left = [left[0]], [left[0]], left[1:]
        while edge and len(left):
            near = np.bitwise_count(fps[left] ^ fps[edge.pop()]) <= differ
            if near.any():
                edge.extend(left[near])
                reached.extend(left[near])
                left = left[~near]
        if len(reached) > 1:
            own = np.sort(ids[reached])
            src.extend(own[1:].tolist())
            dst.extend([int(own[0])] * (len(own) - 1))
    return src, dst


def _bucket_links(differ: int):
    """Links within each bucket, from rows sorted by key; only the last bucket of a batch is held back for the next."""

    def links(keys: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
        same = keys[1:] == keys[:-1]
        start = np.flatnonzero(np.concatenate([[True], ~same])) if len(keys) else np.zeros(0, np.int64)
        size = np.diff(np.append(start, len(keys)))
        fps = values.view(np.uint64)
        two = start[size == 2]
        two = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= differ]
        src, dst = values[two + 1].tolist(), values[two].tolist()
        for a, n in zip(start[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            own = np.unique(values[a : a + n])
            s, d = star_links(own, own.view(np.uint64), differ)
            src += s
            dst += d
        return pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state()
        keys, values = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            keys = np.concatenate([keys, batch.column("key").to_numpy()])
            values = np.concatenate([values, batch.column("fp").to_numpy()])
            done = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            yield links(keys[:done], values[:done])
            keys, values = keys[done:], values[done:]
        yield links(keys, values)

    return run


def hamming_links(fps: DataFrame, differ: int = 3, blocks: int = 6, bucket: int = BUCKET) -> DataFrame:
    """(src, dst) between distinct fingerprints ``fp``: the components of all pairs within ``differ`` bits, with fewer links.

    The 64 bits are cut into blocks; pairs within ``differ`` bits agree on all but ``differ`` of them, so each choice
    of blocks keys a bucket, and one shuffle brings the buckets together. A sample tells which buckets hold ``bucket``
    fingerprints or more; those are cut again before the shuffle, by the bits that their key leaves free: 8 runs of
    them, all but ``differ`` kept, which leaves room for few distinct values a bucket, whatever the data. Within a
    bucket only links between a component's least member and the others come out.
    """
    level1 = masks(list(range(64)), blocks, differ)
    level2 = [masks([b for b in range(64) if not m >> b & 1], 8, differ) for m in level1]
    keyed = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(_long(m)) for m in level1])).alias("t", "part")).select("fp", "t", F.xxhash64("t", "part").alias("key"))
    some = keyed.filter(F.pmod(F.xxhash64("fp", F.lit("sample")), F.lit(SAMPLE_ONE_IN)) == 0)
    hot = cut(some.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") >= max(2, bucket // SAMPLE_ONE_IN)).select(F.col("key").alias("hot")))
    if n := hot.count():
        finer = F.element_at(F.array(*[F.array(*[_long(m) for m in x]) for x in level2]), F.col("t") + 1)
        keys = F.when(F.col("hot").isNull(), F.array("key")).otherwise(F.transform(finer, lambda m, i: F.xxhash64("key", i, F.col("fp").bitwiseAND(m))))
        keyed = keyed.join(F.broadcast(hot) if n <= BROADCAST_KEYS else hot.hint("shuffle_hash"), keyed["key"] == hot["hot"], "left").select("fp", F.explode(keys).alias("key"))
    dealt = keyed.select("key", "fp").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(_bucket_links(differ), "src long, dst long").distinct()

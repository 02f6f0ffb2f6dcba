"""Tables that are computed once and outlive lost executors, in the folder that driver and executors share; folds over ordered rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows that a fold holds as Python objects at once.
ROWS_AT_ONCE = 1000


def _shared(df: DataFrame) -> str:
    """The checkpoint folder, set where it is not: that of ``spark.checkpoint.dir``, or a fresh local one where all run on this machine."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("spark.checkpoint.dir is unset: name a folder that driver and executors share")
            named = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in ``spark.checkpoint.dir``; in a fresh local folder where that is unset and all run on this machine."""
    _shared(df)
    return df.checkpoint(eager=True)


def kept(df: DataFrame) -> DataFrame:
    """As ``cut``, in columns: for long tables of numbers and repeated ids, which take a small part of the room so."""
    at = f"{_shared(df)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def fold_sorted(df: DataFrame, keys: list[str], order: list[str], fold: Callable[[tuple, Iterator[dict]], Iterator[tuple]], schema: str) -> DataFrame:
    """The rows of ``schema`` that fold(key, rows) gives for each group of ``keys``, whose rows come one after the other by ``order``.

    Groups follow each other in sorted partitions, so that a small one has no cost of its own, and a large one is never held.
    """
    made = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for a in range(0, b.num_rows, ROWS_AT_ONCE) for r in b.slice(a, ROWS_AT_ONCE).to_pylist())
        out = (x for key, group in groupby(rows, lambda r: tuple(r[k] for k in keys)) for x in fold(key, group))
        while part := list(islice(out, ROWS_AT_ONCE)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), made, strict=True)], schema=made)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)

"""Importance resampling towards a target's distribution of hashed word runs.

Counts of hashed features of all documents and of all target texts give each bucket a gain, the logarithm of how much more
often the target has it. A document's weight is the mean gain of its features; weights plus Gumbel noise that is fixed by
the document's id are ranked, and the best are a draw without replacement in proportion to the weights.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memengine.llm.common import cut, placed, table

#: Features fall into so many buckets; tasks and the driver hold a number for each.
BUCKETS = 10_000
#: Documents below so many words are never drawn, and of the others so many in a hundred are.
LEAST_WORDS, PERCENT = 20, 10
SEED = 2024

#: A-Z become a-z; every other ASCII byte but a letter or digit becomes a blank. Bytes of 128 and over are parts of words.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def hashed(body: bytes, longest: int) -> tuple[int, list[int]]:
    """The number of words, and the crc32 of each run of 1 to ``longest`` of them: a run's sum is the seed of the run that is a word longer."""
    words = body.translate(PLAIN).split()
    runs = list(map(zlib.crc32, words))
    out = runs
    for n in range(2, longest + 1):
        runs = [zlib.crc32(b" " + w, seed) for w, seed in zip(words[n - 1 :], runs, strict=False)]
        out = out + runs
    return len(words), out


def _bodies(batch: pa.RecordBatch) -> Iterator[bytes]:
    for body in batch.column("body"):
        yield body.as_buffer().to_pybytes() if body.is_valid else b""


def bucket_counts(texts: DataFrame, longest: int, buckets: int) -> np.ndarray:
    """How often all rows' features fall into each bucket. A task sends one row for each bucket it has met."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: Counter = Counter()
        for batch in batches:
            for body in _bodies(batch):
                met.update(np.remainder(hashed(body, longest)[1], buckets).tolist())
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(met.keys(), pa.int64()), "n": pa.array(met.values(), pa.int64())})

    found = texts.select(F.col("text").cast("binary").alias("body")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def gains(have: np.ndarray, want: np.ndarray) -> np.ndarray:
    """floor(1000 ln(smoothed share in the target / smoothed share in the documents)) of each bucket, in doubles."""
    n_have, n_want = float(have.sum() + len(have)), float(want.sum() + len(want))
    return np.array([math.floor(1000 * math.log((t + 1.0) * n_have / ((s + 1.0) * n_want))) for s, t in zip(have.tolist(), want.tolist(), strict=True)], np.int64)


def noise(doc_id: object, seed: int) -> int:
    """Gumbel noise in thousandths, fixed by the seed and the id; a null id counts as the empty text."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def resample(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = BUCKETS, least: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank, n_words) of every row; rank counts the drawn rows from 1, and is null for others.

    Words are maximal runs of ASCII letters, digits and characters outside ASCII, with A-Z lower-cased; features are all
    runs of 1 to ``longest`` words, repeats included. Null and empty texts have no features and weight 0. Of the N rows with
    at least ``least`` words the floor(percent N / 100) highest scores are drawn, ties to the smaller doc_id, nulls last; rows
    that repeat are each ranked. An empty target makes rare features the better ones; an empty table stays empty. Ids keep
    their type. Both tables are read twice or once as a whole; only a number for each bucket passes through the driver.
    """
    gain = gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets))
    held = docs.sparkSession.sparkContext.broadcast(gain)  # a fixed size

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_features, weight, total = [], [], [], []
            for doc_id, body in zip(batch.column("doc_id").to_pylist(), _bodies(batch), strict=True):
                n, runs = hashed(body, longest)
                mean = int(held.value[np.remainder(np.array(runs, np.int64), buckets)].sum()) // len(runs) if runs else 0
                n_words.append(n)
                n_features.append(len(runs))
                weight.append(mean)
                total.append(mean + noise(doc_id, seed))
            numbers = [pa.array(x, pa.int64()) for x in (n_features, weight, total, n_words)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *numbers], names=["doc_id", "n_features", "weight", "score", "n_words"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("body")).mapInArrow(score, f"doc_id {kind}, n_features long, weight long, score long, n_words long")
    rows = cut(rows.withColumn("_few", F.col("n_words") < least))
    drawn = rows.filter(~F.col("_few")).count() * percent // 100
    at = placed(rows, F.col("_few").asc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), name="_at")
    return at.select("doc_id", "n_features", "weight", "score", F.when(F.col("_at") <= drawn, F.col("_at")).alias("rank"), "n_words")


def query(spark, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_words")


#: crc32 by its table of 256 remainders, once for each distinct word.
ORACLE = r"""
WITH remainders AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab FROM range(256) AS r(i)),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
dw AS (SELECT doc_id, unnest(w) AS word FROM d), bw AS (SELECT unnest(w) AS word FROM b),
bytes AS (SELECT word, list_transform(range(1, strlen(word) + 1), lambda i: CAST('0x' || substr(hex(encode(word)), 2 * i - 1, 2) AS BIGINT)) AS v FROM (SELECT word FROM dw UNION SELECT word FROM bw)),
hashed AS (SELECT word, xor(list_reduce(list_prepend(4294967295, v), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM bytes, remainders),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN hashed USING (word) GROUP BY 1), t AS (SELECT bucket, count(*) AS t FROM bw JOIN hashed USING (word) GROUP BY 1),
gains AS (SELECT bucket, CAST(floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST((SELECT count(*) FROM dw) + 10000 AS DOUBLE) / (CAST(s + 1 AS DOUBLE) * CAST((SELECT count(*) FROM bw) + 10000 AS DOUBLE)))) AS BIGINT) AS g FROM s LEFT JOIN t USING (bucket)),
means AS (SELECT doc_id, CAST(sum(g) AS BIGINT) AS total, count(*) AS n FROM dw JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY 1),
scored AS (SELECT d.doc_id, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 0 ELSE (total - ((total % n) + n) % n) // n END AS weight,
  CAST('0x' || substr(sha256('2024:' || CAST(d.doc_id AS VARCHAR)), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN means USING (doc_id)),
totals AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM scored),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n >= 20 ORDER BY score DESC, doc_id) AS place FROM totals)
SELECT doc_id, CAST(n AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score,
       CASE WHEN n >= 20 AND place <= (SELECT 10 * count(*) FROM scored WHERE n >= 20) // 100 THEN place END AS rank
FROM ranked
"""

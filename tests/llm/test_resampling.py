import collections
import hashlib
import math
import re
import zlib

import pytest
from pyspark.sql import functions as F

from memengine.llm import resampling

SF = "/root/testdata/sf0.001"
ODD = [None, "", " .\n", "A", "a b", "One two three four", "one TWO, three-four", "İ ß é 日本", "Xy9 " * 60_000, "one two three four"]


def slow(docs, target, longest, buckets, least, percent, seed):
    """The draw by plain loops and whole strings."""

    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(words) - n + 1)]

    s, t = (collections.Counter(b for text in texts for b in features(text)[1]) for texts in ([x for _, x in docs], target))
    n_s, n_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = [math.floor(1000 * math.log((t[b] + 1) * n_s / ((s[b] + 1) * n_t))) for b in range(buckets)]
    out = []
    for i, text in docs:
        n, f = features(text)
        weight = math.floor(sum(gain[b] for b in f) / len(f)) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), n])
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    drawn = {id(r): k for k, r in enumerate(able[: percent * len(able) // 100], 1)}
    return collections.Counter((*r[:4], drawn.get(id(r))) for r in out)


def rows(df):
    return collections.Counter(tuple(r)[:5] for r in df.collect())


@pytest.mark.parametrize(("longest", "buckets", "least", "percent"), [(1, 10_000, 20, 10), (3, 97, 1, 50)])
def test_draw_is_that_of_plain_loops(spark, longest, buckets, least, percent):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet").repartition(3), spark.read.parquet(f"{SF}/benchmark.parquet")
    want = slow([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in bench.collect()], longest, buckets, least, percent, 7)
    assert rows(resampling.resample(docs, bench, longest, buckets, least, percent, 7)) == want


def test_odd_rows_ids_of_any_type_and_columns_that_clash(spark):
    found = [(f"d{i}", t, 1.5, 2, 3) for i, t in enumerate(ODD)] + [("d5", ODD[5], 1.5, 2, 3), (None, "no id", None, None, None)]
    docs = spark.createDataFrame(found, "doc_id string, text string, score double, weight int, rank int").repartition(3)
    target = spark.createDataFrame([(None,), ("two three",), ("",)], "text string")
    want = slow([r[:2] for r in found], [None, "two three", ""], 2, 50, 2, 60, 1)
    assert rows(resampling.resample(docs, target, 2, 50, 2, 60, 1)) == want
    assert sorted(r.rank for r in resampling.resample(docs, target, 1, 50, 0, 100, 1).collect()) == list(range(1, len(found) + 1))


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert resampling.resample(docs.limit(0), docs).count() == 0
    assert [tuple(r)[:3] for r in resampling.resample(docs, docs.limit(0).select(F.col("text"))).collect()] == [(1, 2, math.floor(1000 * math.log(10002 / (2 * 10000))))]

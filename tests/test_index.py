import random
import re

import pytest
from memengine.operators import index as ix
from pyspark.sql import functions as F

TEXTS = [None, "", "?!", "The the THE other", "a b a c a", "Élan élan élan", "x " * 30_000 + "y", "one two three one two", "日本 日本"]


def slow_postings(docs):
    out = {}
    for d, text in docs:
        words = [w.lower().replace("é", "e").replace("é", "e") for w in re.findall(r"(?:\ẃ?)+", text or "")]
        for i, w in enumerate(words):
            out.setdefault((w, d, len(words)), []).append(i)
    return {k: (len(v), v) for k, v in out.items()}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(f"d{i}", t, i) for i, t in enumerate(TEXTS)], "doc_id string, text string, tf int").repartition(3)


def rows(index):
    return {(r.term, r.doc_id, r.dl): (r.tf, list(r.positions)) for r in index.postings.collect()}


def test_postings_and_their_plan(spark, docs):
    index = ix.build_index(docs)
    assert rows(index) == slow_postings([(f"d{i}", t) for i, t in enumerate(TEXTS)])
    assert {r.doc_id: r.dl for r in index.lengths.collect()}["d2"] == 0 and index.lengths.count() == len(TEXTS)
    assert ix.build_index(docs.limit(0)).postings.count() == 0
    plan = ix.build_index(spark.range(9).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"))).postings._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and rows(ix.build_index(docs.select(F.lit(7).alias("doc_id"), "text").filter("text like 'a%'")))[("a", 7, 5)] == (3, [0, 2, 4])


def test_a_stored_index_reads_the_folders_of_its_terms(spark, docs, tmp_path):
    index = ix.build_index(docs)
    ix.store_index(index, str(tmp_path), buckets=16)
    stored = ix.load_index(spark, str(tmp_path), buckets=16)
    assert {k: (tf, p) for k, (tf, p) in rows(stored).items()} == rows(index)
    phrases = spark.createDataFrame([(1, ["one", "two"]), (2, ["the"]), (3, ["nowhere"])], "phrase_id int, terms array<string>")
    hits = ix.phrase_hits(phrases, stored)
    assert {tuple(r) for r in hits.collect()} == {tuple(r) for r in ix.phrase_hits(phrases, index).collect()} == {(1, "d7", 5, 2), (2, "d3", 4, 3)}
    few = stored.of_terms(spark.createDataFrame([("the",), ("one",)], "term string"))
    assert 1 <= few.select(F.input_file_name()).distinct().select(F.regexp_extract(F.col("input_file_name()"), r"bucket=(\d+)", 1)).distinct().count() <= 2
    assert "PartitionFilters: [bucket#" in few._jdf.queryExecution().executedPlan().toString().replace("isnotnull(", "")
    ix.store_index(ix.build_index(spark.createDataFrame([("new", "one more")], "doc_id string, text string")), str(tmp_path), 16, mode="append")
    assert rows(ix.load_index(spark, str(tmp_path), 16))[("one", "new", 2)] == (1, [0])


def test_every_kind_of_fault_is_found_and_mended(spark):
    rng = random.Random(2)
    texts = {f"d{i}": " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 12))) for i in range(60)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id string, text string").repartition(3)
    whole = ix.build_index(docs)
    assert ix.index_faults(docs, whole).count() == 0 and ix.index_health(docs, whole).first()["sound"]
    old = dict(list(texts.items())[:50]) | {"d3": "other words", "d4": " ".join(reversed("a b c d".split())), "gone": "a b", "d6": texts["d6"] + " a"}
    texts4 = docs.withColumn("text", F.when(F.col("doc_id") == "d4", F.lit("a b c d")).otherwise(F.col("text")))
    index = ix.build_index(spark.createDataFrame(list(old.items()), "doc_id string, text string"))
    lost = index.postings.filter("not (doc_id = 'd8' and term = 'c')").union(index.postings.filter("doc_id = 'd9'").limit(1))
    index = ix.Index(lost, index.lengths.filter("doc_id <> 'd11'"))
    want = {f"d{i}": "missing" for i in range(50, 60)} | {"d3": "damaged", "d4": "damaged", "d6": "damaged", "d9": "damaged", "d11": "damaged", "gone": "stale"}
    want |= {"d8": "damaged"} if "c" in texts["d8"] else {}
    want = {d: f for d, f in want.items() if not (d in ("d9", "d11") and not texts[d])}
    assert {r.doc_id: r.fault for r in ix.index_faults(texts4, index).collect()} == want
    mended = ix.repaired(texts4, index)
    assert rows(mended) == rows(ix.build_index(texts4)) and ix.index_health(texts4, mended).first()["sound"]

import re

import corpus_pipeline
import public_tokenizers
from memengine.llm import decontam, langid, lines, packing, simhash

SF = "/root/testdata/sf0.001"


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages_do_what_the_operators_decide(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    now, stages = docs, dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "line_dedup", "near_dedup", "decontaminate", "pack"]
    kept = stages["language_id"](spark, now, SF).cache()
    said = {r.doc_id: r for r in langid.identify(now, langid.learn(now)).collect()}
    assert ids(kept) == sorted(i for i, r in said.items() if r.lang_pred != "und" and r.score >= 0.5) and kept.columns == docs.columns
    assert len(ids(kept)) > 0.97 * len(ids(now))
    now, kept = kept, stages["line_dedup"](spark, kept, SF).cache()
    want = {r.doc_id: r for r in lines.dedup_lines(now).collect()}
    got = {r.doc_id: r for r in kept.collect()}
    assert set(got) == {i for i, r in want.items() if r.n_removed == 0 or r.text.strip(" ")} and kept.columns == docs.columns
    assert all(r.text == want[i].text and r.n_chars == len(r.text) for i, r in got.items())
    seen = [x for _, r in sorted(got.items()) for line in r.text.split("\n") if (x := " ".join(re.findall("[a-z0-9\x80-\U0010ffff]+", line.lower())))]
    assert len(seen) == len(set(seen))
    now, kept = kept, stages["near_dedup"](spark, kept, SF).cache()
    groups = {r.doc_id: r.component_id for r in simhash.similar_documents(now).collect()}
    assert ids(kept) == sorted(set(groups.values()))
    now, kept = kept, stages["decontaminate"](spark, kept, SF).cache()
    bad = {r.doc_id for r in decontam.contamination(now, spark.read.parquet(f"{SF}/benchmark.parquet")).collect() if r.contaminated}
    assert ids(kept) == sorted(set(ids(now)) - bad)
    packed = stages["pack"](spark, kept, SF)
    assert sorted({r.doc_id for r in packed.collect()}) == ids(kept)


def test_short_documents_have_a_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    short = [(10**6 + i, t, "en", "s", len(t)) for i, t in enumerate(["This.", "Re.", "Thtion.", "The esingor.", "Ereaea.", "12 34"])]
    docs = docs.union(spark.createDataFrame(short, docs.schema))
    gone = set(ids(docs)) - set(ids(langid.keep_identified(docs)))
    assert gone == {r.doc_id for r in docs.filter(~docs.text.rlike(r"\p{L}") | docs.text.isNull()).collect()} and 10**6 + 5 in gone


def test_each_row_has_its_own_language(spark):
    """F8 of round 4"""
    shape = "doc_id long, text string, lang string, source string, n_chars long"
    words = {"en": "the house of that weather with thing".split(), "de": "das haus über schön nicht für straße".split()}
    rows = [(i, " ".join(words[lang][(i * 3 + j * j) % 7] for j in range(12)), lang, "s", 1) for i in range(60) for lang in [("en", "de")[i % 2]]]
    odd = [(None, "12 34", None, "s", 1), (None, "that weather with the thing", None, "s", 1), (100, "56 - 78", None, "s", 1), (100, "schön nicht über das haus", None, "s", 1), (101, None, None, "s", 1)]
    got = langid.keep_identified(spark.createDataFrame(rows + odd, shape))
    said = sorted([(r.doc_id, r.text, r.lang) for r in got.collect() if r.doc_id is None or r.doc_id >= 60], key=str)
    assert said == [(100, "schön nicht über das haus", "de"), (None, "that weather with the thing", "en")]
    assert sorted(tuple(r) for r in got.filter("doc_id < 60").collect()) == rows and got.columns == [c.split()[0] for c in shape.split(", ")]
    assert {tuple(r) for r in langid.keep_identified(spark.createDataFrame(odd, shape).filter("lang is null")).collect()} == {odd[1], odd[3]}


def test_run_and_odd_rows(spark, tmp_path):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns) and out.count() > 150
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "same words here", "en", "s", 15), (None, "same words here", "en", "s", 15), (3, "same words here", None, "s", 15), (4, "12 34", "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json")).count() == 6
    assert {r.doc_id for r in corpus_pipeline.dedup_lines(spark, docs, SF).collect()} == {None, 1, 2, 4}

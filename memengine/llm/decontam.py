"""Benchmark decontamination by winnowed fingerprints.

A k-gram of words is a fingerprint if its hash is the least in some window of k-grams. With k-grams of 7 words and
windows of 7 k-grams, two texts that share 13 consecutive words share a fingerprint inside them, so joining the
fingerprints of documents and benchmark items finds every shared passage; each hit is then extended word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from memengine.llm.common import LOWER_BYTES, as_bytes, chunks, cut, hash_filter, mix, passes, span_hash, table, without, words

#: Words of a window; a shorter item is one window of all its words.
WINDOW = 13

_SEED = pa.struct([("t", pa.int32()), ("fp", pa.int64()), ("pos", pa.int64()), ("lead", pa.int32()), ("words", pa.string())])
_SEEDS = "array<struct<t:int,fp:bigint,pos:bigint,lead:int,words:string>>"


def shape(t: int) -> tuple[int, int]:
    """(words of a k-gram, k-grams of a window) that find every shared span of t words."""
    k = (t + 1) // 2
    return k, t + 1 - k


def winnow(hashes: np.ndarray, of: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the chosen k-grams and their fingerprints, for word hashes of texts that stand one after the other.

    ``of`` numbers the text of each word. Of equal hashes in a window the last is chosen.
    """
    k, w = shape(t)
    n = len(hashes) - t + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = np.zeros(len(hashes) - k + 1, np.uint64)
    factor = 1
    for j in range(k):
        grams += hashes[j : j + len(grams)] * np.uint64(factor)
        factor = factor * 0xD6E8FEB86659FD93 % 2**64
    grams = mix(grams)
    best, at = grams[:n].copy(), np.zeros(n, np.int8)
    for j in range(1, w):
        later = grams[j : j + n]
        less = later <= best
        np.copyto(best, later, where=less)
        at[less] = j
    whole = np.flatnonzero(of[:n] == of[t - 1 :])
    place = whole + at[whole]
    place = place[np.concatenate([[True], np.diff(place) > 0])] if len(place) else place
    return place, grams[place]


def _seeds(batches: Iterator[pa.RecordBatch], lengths: list[int], bits: np.ndarray | None, own: bool) -> Iterator[pa.RecordBatch]:
    """(doc_id, n_words, seeds) of each text. own: a text's only window length is its own, ``WINDOW`` at most."""
    for batch in batches:
        body = batch.column("body")
        for a, b, data, at in chunks(body):
            data = LOWER_BYTES[data]
            start, end, count = words(data, at)
            hashes, of = span_hash(data, start, end), np.repeat(np.arange(b - a), count)
            first = np.concatenate([[0], np.cumsum(count)])
            found = []
            for t in sorted(set(np.minimum(count, WINDOW).tolist()) - {0}) if own else lengths:
                place, fp = winnow(hashes, of, t)
                if own:
                    keep = np.minimum(count, WINDOW)[of[place]] == t
                else:
                    keep = passes(bits, fp)
                k, _ = shape(t)
                for p, h in zip(place[keep].tolist(), fp[keep].view(np.int64).tolist(), strict=True):
                    lo, hi = max(first[of[p]], p - (t - k)), min(first[of[p] + 1], p + t)
                    around = b" ".join(data[s:e].tobytes() for s, e in zip(start[lo:hi], end[lo:hi], strict=True))
                    found.append((int(of[p]), t, h, int(p - first[of[p]]), int(p - lo), around.decode("utf-8", "replace")))
            found.sort(key=lambda x: x[0])
            cols = list(zip(*found, strict=True)) if found else [()] * 6
            offsets = np.searchsorted(np.array(cols[0], np.int64), np.arange(b - a + 1))
            seeds = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(cols[1:], _SEED, strict=True)], fields=list(_SEED)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(count), seeds], names=["doc_id", "n_words", "seeds"])


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Grow each shared fingerprint to both sides; what grows to t words or more is a hit, words [lo, hi) of the document."""
    for batch in batches:
        keep, lo, hi = [], [], []
        for i, r in enumerate(batch.select(["t", "pos", "lead", "words", "i_lead", "i_words"]).to_pylist()):
            d, x, p, q, t = r["words"].split(" "), r["i_words"].split(" "), r["lead"], r["i_lead"], r["t"]
            left = right = 0
            while left < min(p, q) and d[p - left - 1] == x[q - left - 1]:
                left += 1
            while right < min(len(d) - p, len(x) - q) and d[p + right] == x[q + right]:
                right += 1
            if left + right >= t and right >= shape(t)[0]:
                keep.append(i)
                lo.append(r["pos"] - left)
                hi.append(r["pos"] + right)
        rows = batch.take(pa.array(keep, pa.int64())).select(["rid", "t", "fp", "i_lead", "i_words"])
        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(lo, pa.int64()), pa.array(hi, pa.int64())], names=[*rows.schema.names, "lo", "hi"])


def contamination(docs: DataFrame, benchmark: DataFrame, share: int = 20) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for each row of documents.

    Words are maximal runs of ASCII letters, digits and characters outside ASCII, with A-Z lower-cased. A window is 13
    consecutive words of an item, or all words of a shorter one. n_hit counts the document's words that stand inside an
    occurrence of a window, n_items the items that have such a window; items_sha256 is the digest of their ids, sorted
    as strings and joined by commas (of the empty string if there are none). A document is contaminated if at least one
    in ``share`` of its words is hit. Null and empty texts have no words; a null item_id counts as the empty id; rows
    that repeat are each answered; an empty benchmark hits nothing.
    """
    items = as_bytes(benchmark.withColumn("item", F.col("item_id")), "item")
    own = cut(items.mapInArrow(lambda it: _seeds(it, [], None, True), f"doc_id long, n_words long, seeds {_SEEDS}"))
    item_seeds = own.select("doc_id", F.explode("seeds").alias("s")).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("item"), F.col("s.t").alias("t"), F.col("s.fp").alias("fp"), F.col("s.lead").alias("i_lead"), F.col("s.words").alias("i_words"))
    item_seeds = cut(item_seeds.distinct())
    lengths = sorted(r["t"] for r in item_seeds.select("t").distinct().collect())  # at most WINDOW of them
    bits = hash_filter(item_seeds, "fp")
    held = docs.sparkSession.sparkContext.broadcast(bits)  # a fixed size

    scanned = as_bytes(docs).mapInArrow(lambda it: _seeds(it, lengths, held.value, False), f"doc_id long, n_words long, seeds {_SEEDS}")
    base = cut(scanned.withColumn("rid", F.monotonically_increasing_id()))
    seeds = base.select("rid", F.explode("seeds").alias("s")).select("rid", "s.*")
    pairs = seeds.join(item_seeds.select("t", "fp", "i_lead", "i_words").distinct(), ["t", "fp"])
    hits = cut(pairs.select("rid", "t", "fp", "pos", "lead", "words", "i_lead", "i_words").mapInArrow(_extend, "rid long, t int, fp long, i_lead int, i_words string, lo long, hi long"))

    before = F.coalesce(F.max("hi").over(W.partitionBy("rid").orderBy("lo", "hi").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    covered = hits.select("rid", "lo", "hi").distinct().withColumn("new", F.greatest(F.lit(0), F.col("hi") - F.greatest("lo", before))).groupBy("rid").agg(F.sum("new").alias("n_hit"))
    joined = hits.select("rid", "t", "fp", "i_lead", "i_words").distinct().join(item_seeds, ["t", "fp", "i_lead", "i_words"]).select("rid", "item").distinct()
    listed = joined.groupBy("rid").agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list("item")), ",").alias("items"))
    n_hit = F.coalesce("n_hit", F.lit(0))
    return (
        base.select("rid", "doc_id", "n_words").join(covered, "rid", "left").join(listed, "rid", "left")
        .select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"), ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"))
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with all their columns. A row without an id stays."""
    bad = contamination(docs, benchmark).filter("contaminated").select("doc_id").distinct()
    return without(docs, bad)


def query(spark, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: DuckDB's regular expressions match bytes above ASCII by their characters, so the same class of words can be written.
ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
items AS (SELECT item_id, w, least(13, len(w)) AS t FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, t, array_to_string(w[i : i + t - 1], ' ') AS s FROM (SELECT item_id, w, t, unnest(range(1, len(w) - t + 2)) AS i FROM items)),
lengths AS (SELECT DISTINCT t FROM items),
grams AS (SELECT doc_id, t, i, array_to_string(w[i : i + t - 1], ' ') AS s FROM (SELECT doc_id, w, t, unnest(range(1, len(w) - t + 2)) AS i FROM d, lengths WHERE len(w) >= t)),
hits AS (SELECT g.doc_id, g.i, g.t, v.item_id FROM grams g JOIN windows v ON g.t = v.t AND g.s = v.s),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + t)) AS p FROM (SELECT DISTINCT doc_id, i, t FROM hits)) GROUP BY 1),
listed AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN listed USING (doc_id)
"""

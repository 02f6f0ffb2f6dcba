"""Collocations by best-first branch and bound: phrases grow from prefixes whose counts still allow a score that matters.

A phrase of which a prefix occurs c times, and the prefix's first word f times, scores at most 2c / (f + c), as the phrase
occurs c times at most and its rest no less than itself. So once each language has a threshold, only prefixes whose bound
reaches it are grown by a word, and all phrases that score as much are known with what contains them. Thresholds start at
the score of a language's 2 x ``limit``-th pair of words, and fall until ``limit`` phrases that survive reach them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from memengine.llm.common import LOWER_BYTES, buffers, chunks, cut, hash_filter, mix, passes, span_hash, table, words

LONGEST, LEAST, LIMIT = 4, 30, 2000
#: A candidate goes if a longer one that contains it has so many in a hundred of its occurrences.
SHARE = 80
#: Times as many pairs of words as are wanted that the first threshold admits, and the growth of that from round to round.
FIRST, MORE = 2, 8
#: Words of one language that a task counts at once.
HELD = 1_500_000
SCALE = 1_000_000

#: A-Z become a-z, the marks and line ends that end a piece a line feed, and a tab a blank.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else 10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in range(256))
_STEP = np.uint64(0x9E3779B97F4A7C15)


#: Bytes of words, and of what ends a piece, in texts that are ``_PLAIN``.
_WORD, _MARK = (np.array([test(c) for c in range(256)]) for test in (lambda c: c not in b" \t\n\x0b\x0c\r.,;:!?", lambda c: c in b"\n\x0b\x0c\r.,;:!?"))


def _seeds(langs: list[str]) -> np.ndarray:
    known = {lang: xxhash.xxh64_intdigest(lang.encode(), 13) for lang in set(langs)}
    return np.array([known[lang] for lang in langs], np.uint64)


def _longer(prefix: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of phrases from those of all words but the last, and of the last; a language's seed is the phrase of no word."""
    return mix(prefix * _STEP + word)


def _spelt(lang: list, phrase: pa.Array, n: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), phrase.cast(pa.string()), pa.array(n, pa.int64())], names=["lang", "phrase", "n"])


class _Words:
    """Words of one language in the order of the texts, as numbers; 0 stands between pieces."""

    def __init__(self, lang: str):
        self.lang, self.runs, self.n = lang, [], 0
        self.of: dict[bytes, int] = {b"\n": 0, b"": -1}

    def add(self, body: bytes) -> None:
        words = body.translate(_PLAIN).replace(b"\n", b" \n ").split(b" ")
        of = self.of
        for w in set(words).difference(of):
            of[w] = len(of) - 1
        run = np.fromiter(map(of.__getitem__, words), np.int32, len(words))
        self.runs += [run[run >= 0], np.zeros(1, np.int32)]
        self.n += len(run)

    def grams(self, n: int, frequent: np.ndarray | None) -> pa.RecordBatch:
        """Distinct words, or pairs of frequent words, and their counts; of words also a row without one, with their sum."""
        run, names = np.concatenate(self.runs), list(self.of)
        names[:2] = [b"\n"]  # the empty string between blanks is no word
        spelt = pa.array(names, pa.binary())
        if n == 1:
            count = np.bincount(run, minlength=len(names))[1:]
            return _spelt([self.lang] * len(names), pa.concat_arrays([spelt[1:], pa.nulls(1, pa.binary())]), [*count.tolist(), int(count.sum())])
        data, at = buffers(spelt)
        often = passes(frequent, _longer(_seeds([self.lang]), span_hash(data, at[:-1], at[1:])))
        often[0] = False
        starts = np.flatnonzero(often[run[:-1]] & often[run[1:]])
        key, count = np.unique(run[starts].astype(np.int64) << 32 | run[starts + 1], return_counts=True)
        phrase = pc.binary_join_element_wise(spelt.take(pa.array(key >> 32)), spelt.take(pa.array(key & 0xFFFFFFFF)), b" ")
        return _spelt([self.lang] * len(key), phrase, count)


def _all(docs: DataFrame, n: int, frequent: np.ndarray | None = None) -> DataFrame:
    """(lang, phrase, n) of all words, with a row for each language whose phrase is null and n their sum, or of all pairs of frequent words."""
    held = docs.sparkSession.sparkContext.broadcast(frequent)  # a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[str, _Words] = {}
        for batch in batches:
            for lang, body in zip(batch.column("lang").to_pylist(), batch.column("body"), strict=True):
                words = open_.get(lang) or open_.setdefault(lang, _Words(lang))
                words.add(body.as_buffer().to_pybytes())
                if words.n >= HELD:
                    yield open_.pop(lang).grams(n, held.value)
        while open_:
            yield open_.popitem()[1].grams(n, held.value)

    return docs.mapInArrow(run, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: np.ndarray, n: int) -> list[np.ndarray]:
    """Hashes of the phrases of 1, 2, ... n words that begin at each word, as far as there are as many."""
    word = span_hash(data, start, end)
    out = [_longer(seed, word)]
    for i in range(1, n):
        out.append(_longer(out[-1][: max(0, len(word) - i)], word[i:]))
    return out


def _some(docs: DataFrame, n: int, every: list, some: list) -> DataFrame:
    """(lang, phrase, n) of the phrases of n words that pass all of ``every`` and one of ``some``: filters of the hashes of the
    ``order`` words from place ``at`` on. Most of a text passes none, and is never spelt."""
    held = docs.sparkSession.sparkContext.broadcast((list(every), list(some)))  # filters have a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, some = held.value
        met: Counter = Counter()
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for a, b, data, at in chunks(batch.column("body")):
                data = LOWER_BYTES[data]
                start, end, count = words(data, at, _WORD)
                if len(start) < n:
                    continue
                of = np.repeat(np.arange(a, b), count)
                piece = np.cumsum(_MARK[data], dtype=np.int32)[start]
                last = len(start) - n + 1
                starts = np.flatnonzero((of[:last] == of[n - 1 :]) & (piece[:last] == piece[n - 1 :]))
                hashes = _hashes(data, start, end, _seeds(langs[a:b])[of - a], max(order for order, _, _ in every + some))
                for order, place, bits in every:
                    starts = starts[passes(bits, hashes[order - 1][starts + place])]
                starts = starts[np.logical_or.reduce([passes(bits, hashes[order - 1][starts + place]) for order, place, bits in some])]
                text = data.tobytes()
                ends = np.array([end[starts + i] for i in range(n)]).T.tolist()
                begins = np.array([start[starts + i] for i in range(n)]).T.tolist()
                met.update((langs[i], b" ".join([text[s:e] for s, e in zip(x, y, strict=True)])) for i, x, y in zip(of[starts].tolist(), begins, ends, strict=True))
                if len(met) > HELD // 8:
                    yield _spelt([k[0] for k in met], pa.array([k[1] for k in met], pa.binary()), list(met.values()))
                    met.clear()
        yield _spelt([k[0] for k in met], pa.array([k[1] for k in met], pa.binary()), list(met.values()))

    return docs.mapInArrow(run, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def _filter(phrases: DataFrame, n: int) -> np.ndarray:
    """A hash filter of phrases of n words, for tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, at in chunks(batch.column("phrase")):
                start, end, _ = words(data, at, _WORD)
                h = _hashes(data, start, end, np.repeat(_seeds(batch.column("lang").slice(a, b - a).to_pylist()), n), n)[-1][::n]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["h"])

    return hash_filter(phrases.select("lang", F.col("phrase").cast("binary").alias("phrase")).mapInArrow(run, "h long"), "h")


def _head(k: int) -> F.Column:
    return F.substring_index("phrase", " ", k)


def _tail(k: int) -> F.Column:
    return F.substring_index("phrase", " ", -k)


def _in_parts(a: str, parts: str) -> F.Column:
    """floor(2 SCALE a / parts), exactly: the product may leave 64 bits."""
    return F.expr(f"(cast({a} as decimal(20,0)) * {2 * SCALE}) div ({parts})")


def _scored(grams: DataFrame, m: int, parts: DataFrame) -> DataFrame:
    """(lang, phrase, a, score, k, l, r, first) of phrases of m words: of all cuts the lowest score, ties to the shorter first part.
    ``first`` is how often the first word occurs."""
    cuts = F.array(*(F.struct(F.lit(k).alias("k"), _head(k).alias("head"), _tail(m - k).alias("tail")) for k in range(1, m)))
    rows = grams.select("lang", "phrase", F.col("n").alias("a"), F.explode(cuts).alias("c")).select("lang", "phrase", "a", "c.*")
    for side, name in (("head", "l"), ("tail", "r")):
        rows = rows.join(parts.select("lang", F.col("phrase").alias(side), F.col("n").alias(name)), ["lang", side])
    lowest = F.min(F.struct(_in_parts("a", "l + r").alias("score"), "k", "l", "r")).alias("b")
    return rows.groupBy("lang", "phrase").agg(F.first("a").alias("a"), lowest, F.max(F.when(F.col("k") == 1, F.col("l"))).alias("first")).select("lang", "phrase", "a", "b.*", "first")


def _thresholds(pairs: DataFrame, wanted: int) -> list[tuple[str, int]]:
    """For each language the score of its ``wanted``-th best pair; 0 where there are fewer. Whole scores are few: SCALE at most."""
    better = F.sum("count").over(W.partitionBy("lang").orderBy(F.desc("score")))
    scores = pairs.groupBy("lang", "score").count().withColumn("better", better)
    found = scores.groupBy("lang").agg(F.coalesce(F.max(F.when(F.col("better") >= wanted, F.col("score"))), F.lit(0)).alias("least"))
    return [(r["lang"], r["least"]) for r in found.collect()]  # a number for each language


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, limit: int = LIMIT, share: int = SHARE, first: int = FIRST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``limit`` best phrases of 2 to ``longest`` words.

    A-Z are lower-cased; ``.,;:!?`` and line ends part a text into pieces, blanks and tabs part pieces into words. n counts a
    language's words, and f(phrase) all its occurrences within pieces, overlaps included. A phrase is a candidate if
    a = f(phrase) is ``least`` or more. Cutting it in two gives l and r, the counts of both parts, and the score
    floor(2000000 a / (l + r)); the cut with the lowest counts, ties to the shorter first part. A candidate goes if a longer
    one that contains it has ``share`` percent of its occurrences. Ranks fall with score, then a, then rise with the phrase's
    bytes. Null texts have no words, a null lang is ``und``; rows that repeat count as often as they stand there; a language
    without candidates has no rows, nor has an empty table. Languages are taken to be few: the driver holds a threshold for each.
    """
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("body"))
    spark, enough = docs.sparkSession, F.col("n") >= least
    ones = cut(_all(rows, 1).filter(F.col("phrase").isNull() | enough))
    totals = ones.filter("phrase is null").select("lang", "n")
    known = ones = ones.filter("phrase is not null")
    word = _filter(ones, 1)
    twos = cut(_all(rows, 2, word).filter(enough))
    pairs = cut(_scored(twos, 2, ones))
    pair = _filter(pairs, 2)
    done, wanted = [], first * limit
    open_ = _thresholds(pairs, wanted)
    while open_:
        threshold = spark.createDataFrame(open_, "lang string, least long")
        level = pairs.join(threshold, "lang")
        known, found, within = ones.unionByName(twos), [], []
        for m in range(2, longest + 1):
            if m > 2:
                # grown by a word from a prefix that allows the threshold, or around a phrase that reaches it
                some = [(m - 1, 0, _filter(level.filter(_in_parts("a", "first + a") >= F.col("least")), m - 1)), (m - 1, 1, _filter(level.filter("score >= least"), m - 1))]
                grams = cut(_some(rows, m, every=[(2, i, pair) for i in range(m - 1)], some=some).filter(enough))
                within += [grams.select("lang", part(m - 1).alias("phrase"), "n") for part in (_head, _tail)]
                level = _level(rows, grams, m, known, ones, threshold, enough)
                known = known.unionByName(grams)
            found.append(level.filter("score >= least").select("lang", "phrase", "a", "l", "r", "score"))
        longer = _union(within or [twos.limit(0)]).groupBy("lang", "phrase").agg(F.max("n").alias("most"))
        clear = f"most is null or 100 * cast(most as decimal(20,0)) < {share} * cast(a as decimal(20,0))"
        kept = cut(_union(found).join(longer, ["lang", "phrase"], "left").filter(clear).drop("most"))
        counts = {r["lang"]: r["count"] for r in kept.groupBy("lang").count().collect()}
        settled = {lang for lang, low in open_ if low == 0 or counts.get(lang, 0) >= limit}
        done.append(kept.filter(F.col("lang").isin(sorted(settled))))
        wanted *= MORE
        open_ = [t for t in _thresholds(pairs.filter(~F.col("lang").isin(sorted(settled))), wanted) if t[0] not in settled] if len(settled) < len(open_) else []
    every = _union([pairs.limit(0).drop("k", "first"), *done])
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = every.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= limit)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _level(rows: DataFrame, grams: DataFrame, m: int, known: DataFrame, ones: DataFrame, threshold: DataFrame, enough: F.Column) -> DataFrame:
    """The phrases of m words whose own count allows the threshold, scored; counts of their last parts that growth has not met are asked for."""
    first = ones.select("lang", F.col("phrase").alias("head"), F.col("n").alias("f"))
    able = grams.withColumn("head", _head(1)).join(first, ["lang", "head"]).join(threshold, "lang").filter(_in_parts("n", "f + n") >= F.col("least"))
    able = cut(able.select("lang", "phrase", "n"))
    for size in range(3, m):
        missing = cut(able.select("lang", _tail(size).alias("phrase")).distinct().join(known, ["lang", "phrase"], "left_anti"))
        if not missing.isEmpty():
            asked = _some(rows, size, every=[], some=[(size, 0, _filter(missing, size))]).join(missing, ["lang", "phrase"], "left_semi")
            known = known.unionByName(cut(asked.filter(enough)))
    return cut(_scored(able, m, known).join(threshold, "lang"))


def query(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


_GRAMS = "\nUNION ALL ".join(f"SELECT lang, list_aggregate(w[i : i + {n - 1}], 'string_agg', ' ') AS phrase, {n} AS m FROM (SELECT lang, w, unnest(range(1, len(w) - {n - 2})) AS i FROM pieces WHERE len(w) >= {n})" for n in range(1, LONGEST + 1))
_PARTS = "list_aggregate(w[{}], 'string_agg', ' ')"
ORACLE = rf"""
WITH pieces AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM (SELECT coalesce(lang, 'und') AS lang,
  unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents)),
grams AS ({_GRAMS}),
f AS (SELECT lang, phrase, m, count(*) AS a FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(a) AS n FROM f WHERE m = 1 GROUP BY 1),
candidates AS (SELECT lang, phrase, m, a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND a >= {LEAST}),
cuts AS (SELECT *, {_PARTS.format("1 : k")} AS head, {_PARTS.format("k + 1 : m")} AS tail FROM (SELECT *, unnest(range(1, m)) AS k FROM candidates)),
scored AS (SELECT c.*, x.a AS l, y.a AS r, 2000000::HUGEINT * c.a // (x.a + y.a) AS score FROM cuts c JOIN f x ON c.lang = x.lang AND c.head = x.phrase JOIN f y ON c.lang = y.lang AND c.tail = y.phrase),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_parts AS (SELECT lang, {_PARTS.format("i : i + s - 1")} AS phrase, a FROM (SELECT *, unnest(range(1, m - s + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS s FROM candidates))),
longer AS (SELECT lang, phrase, max(a) AS most FROM inner_parts GROUP BY ALL),
kept AS (SELECT o.* FROM lowest o LEFT JOIN longer USING (lang, phrase) WHERE most IS NULL OR 100 * most::HUGEINT < {SHARE} * o.a::HUGEINT),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= {LIMIT}
"""

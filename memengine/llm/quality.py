"""Quality scores by a sparse rule ensemble: tree paths over text statistics, lasso logistic weights, Spark expressions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memengine.llm.common import as_bytes, chunks, table
from memengine.llm.langid import held_out

#: Labelled rows to learn from at most; trees, their depth, and the thresholds of a statistic that they choose among.
SAMPLE, TREES, DEPTH, BINS = 20_000, 24, 3, 24
LASSO = 2e-3
STATISTICS = ["size", "n_words", "word_bytes", "upper", "digits", "marks", "stops", "bars", "other_bytes", "line_words", "distinct_words", "distinct_lines", "marked_words"]

_CLASS = np.zeros(256, np.int64)
for _c in range(256):
    _CLASS[_c] = next((k for k, chars in enumerate([range(97, 123), range(65, 91), range(48, 58), b" \t\n\r\x0b\x0c", b".,;:?'\"()-", b"|<>{}[]\\/_=^~`", b"!#$%&*@+", range(128, 256)]) if _c in chars), 8)


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        body = batch.column("body")
        for a, b, data, at in chunks(body):
            rows, sizes = b - a, np.diff(at).astype(float)
            counts = np.bincount(np.repeat(np.arange(rows) * 9, np.diff(at)) + _CLASS[data], minlength=9 * rows).reshape(rows, 9).astype(float)
            lower, upper, digit, _, stop, bar, mark, other, _ = counts.T
            words, lines, kinds, line_kinds, marked = (np.zeros(rows) for _ in range(5))
            for i, text in enumerate(body.slice(a, rows).to_pylist()):
                parts, own = text.split(), text.split(b"\n")
                distinct = set(parts)
                words[i], kinds[i], lines[i], line_kinds[i] = len(parts), len(distinct), len(own), len(set(own))
                marked[i] = sum(w[-1:] in b"!#$%&*@+|" for w in distinct)
            per = lambda x, y: x / np.maximum(y, 1)
            stats = [np.log1p(sizes), np.log1p(words), per(lower + upper + other, words), per(upper, lower + upper), per(digit, sizes), per(mark, sizes), per(stop, sizes), per(bar, sizes), per(other, sizes), np.log1p(per(words, lines)), per(kinds, words), per(line_kinds, lines), per(marked, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, rows), *map(pa.array, stats)], names=["doc_id", *STATISTICS])


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, statistics) of each row's whole text; a null text counts as empty."""
    return as_bytes(docs).mapInArrow(_statistics, "doc_id long, " + ", ".join(f"{s} double" for s in STATISTICS))


@dataclass
class Rules:
    """Weighted conjunctions of (statistic, is above, threshold); the score is the logistic of their sum."""

    rules: list[tuple[tuple[str, bool, float], ...]]
    weights: list[float]
    constant: float

    def score(self) -> Column:
        total = F.lit(self.constant)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            holds = F.lit(True)
            for name, above, threshold in rule:
                holds = holds & ((F.col(name) > threshold) if above else (F.col(name) <= threshold))
            total = total + F.when(holds, F.lit(weight)).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def tree_paths(binned: np.ndarray, residual: np.ndarray, depth: int, least: int) -> list[tuple[list, np.ndarray, float]]:
    """(path, rows, mean residual) of every node but the root of a least-squares tree; a path lists (column, above, bin)."""
    found, todo = [], [([], np.arange(len(binned)))]
    while todo:
        path, rows = todo.pop()
        if path:
            found.append((path, rows, float(residual[rows].mean())))
        if len(path) == depth or len(rows) < 2 * least:
            continue
        best = (1e-12, 0, 0)
        r = residual[rows]
        for j in range(binned.shape[1]):
            n = np.cumsum(np.bincount(binned[rows, j], minlength=BINS + 1))[:-1]
            s = np.cumsum(np.bincount(binned[rows, j], r, minlength=BINS + 1))[:-1]
            ok = (n >= least) & (len(rows) - n >= least)
            gain = np.where(ok, s**2 / np.maximum(n, 1) + (r.sum() - s) ** 2 / np.maximum(len(rows) - n, 1) - r.sum() ** 2 / len(rows), 0)
            if gain.max() > best[0]:
                best = (gain.max(), j, int(gain.argmax()))
        if best[0] > 1e-12:
            _, j, cut = best
            high = binned[rows, j] > cut
            todo += [(path + [(j, True, cut)], rows[high]), (path + [(j, False, cut)], rows[~high])]
    return found


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO, seed: int = 0) -> Rules:
    """x: (rows, statistics); y: 0 or 1. Rules come from boosted trees on random halves; FISTA fits their lasso weights."""
    rng = np.random.default_rng(seed)
    rate = float(np.clip(y.mean(), 0.01, 0.99))
    base = float(np.log(rate / (1 - rate)))
    if y.min() == y.max():
        return Rules([], [], base)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    f, rules = np.full(len(y), base), {}
    for _ in range(trees):
        half = rng.permutation(len(y))[: max(2, len(y) // 2)]
        paths = tree_paths(binned[half], (y - 1 / (1 + np.exp(-f)))[half], depth, max(5, len(y) // 400))
        for path, _, mean in paths:
            holds = np.all([(binned[:, j] > c) == above for j, above, c in path], axis=0)
            rules.setdefault(tuple((STATISTICS[j], above, float(cuts[j][min(c, len(cuts[j]) - 1)])) for j, above, c in path), holds)
            if len(path) == depth:
                f = f + 2.0 * mean * holds
    names, z = list(rules), np.stack(list(rules.values()), axis=1).astype(float) if rules else np.zeros((len(y), 0))
    step = 4 * len(y) / (np.linalg.norm(z, 2) ** 2 + len(y) + 1e-9)
    w, b, v, c, t = np.zeros(z.shape[1]), base, np.zeros(z.shape[1]), base, 1.0
    for _ in range(400):
        error = (1 / (1 + np.exp(-(z @ v + c))) - y) / len(y)
        moved = v - step * (z.T @ error)
        w2, b2 = np.sign(moved) * np.maximum(np.abs(moved) - step * lasso, 0), c - step * error.sum()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    kept = np.flatnonzero(np.abs(w) > 1e-6)
    return Rules([names[i] for i in kept], w[kept].tolist(), float(b))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Rules:
    """Fit on at most ``sample`` labelled rows, chosen by a hash of the id; rows whose crc32(doc_id) mod 5 is 0 never.

    The driver gets the statistics of those rows. Without any labelled row every text scores 0.5.
    """
    known = labels.filter("doc_id is not null and quality is not null").filter(~held_out(5, 0)).select(F.col("doc_id").alias("id"), (F.col("quality") == 1).cast("double").alias("y"))
    known = known.orderBy(F.xxhash64("id"), "id", "y").limit(sample)
    rows = statistics(docs.select("doc_id", "text").join(F.broadcast(known.select("id").distinct()), F.col("doc_id") == F.col("id")).select("doc_id", "text"))
    got = rows.join(F.broadcast(known), F.col("doc_id") == F.col("id")).orderBy("doc_id", *STATISTICS, "y").toPandas()
    if got.empty:
        return Rules([], [], 0.0)
    return fit(got[STATISTICS].to_numpy(float), got["y"].to_numpy(float))


def score_quality(docs: DataFrame, rules: Rules, threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted, statistics) for each row; predicted is 1 where the score is ``threshold`` or more.

    Null and empty texts have the statistics of an empty text. Rows that repeat are each scored.
    """
    return statistics(docs).withColumn("score", rules.score()).select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *STATISTICS)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_quality(docs, learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(5, 0).alias("held_out"), "score", "predicted")

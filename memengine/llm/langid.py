"""Language identification by string kernels: blended-spectrum n-gram presence, Nystroem landmarks, one-versus-rest kernel ridge."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from memengine.llm.common import mix, table, worker_state

#: n-grams of 1 to SPECTRUM characters, hashed into 2**PLACES places; the kernel counts the places that two texts share.
SPECTRUM, PLACES = 3, 14
#: Labelled documents to learn from at most, over all languages, and how many of those are landmarks.
SAMPLE, LANDMARKS = 1600, 96
#: Groups that a language's rows are first chosen in.
SPREAD = 64
RIDGE = 1e-3
UNKNOWN = "und"
_LETTER = np.array([97 <= c <= 122 or c >= 128 for c in range(256)])


def presence(texts: list[str]) -> np.ndarray:
    """(texts, 2**PLACES) zeros and ones: which n-grams a lower-cased text has; all but letters count as a space."""
    out = np.zeros((len(texts), 1 << PLACES), np.uint8)
    sizes = np.array([len(t) for t in texts])
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    codes[~_LETTER[np.minimum(codes, 255).astype(np.uint8)]] = 32
    row = np.repeat(np.arange(len(texts)), sizes)
    gram = np.zeros(len(codes), np.uint64)
    for n in range(1, SPECTRUM + 1):
        count = len(codes) - n + 1
        if count <= 0:
            break
        gram = gram[:count] * np.uint64(0x110000) + codes[n - 1 :]
        place = mix(gram + np.uint64(n << 60)) >> np.uint64(64 - PLACES)
        whole = row[:count] == row[n - 1 :]
        out[row[:count][whole], place[whole].astype(np.int64)] = 1
    return out


@dataclass
class Model:
    langs: list[str]
    landmarks: np.ndarray  # (2**PLACES, m) presence over the root of its size
    weights: np.ndarray  # (m + 1, languages): kernel values to one-versus-rest outputs, the last row a constant

    def outputs(self, has: np.ndarray) -> np.ndarray:
        dense = has.astype(np.float32)
        kernel = dense @ self.landmarks / np.sqrt(np.maximum(dense.sum(1, keepdims=True), 1))
        return kernel @ self.weights[:-1] + self.weights[-1]


def fit(has: np.ndarray, labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """has: presence of the sample, in an order that starts with the landmarks."""
    langs = sorted(set(labels))
    unit = has.astype(np.float32) / np.sqrt(np.maximum(has.sum(1, dtype=np.float64), 1))[:, None].astype(np.float32)
    marks = unit[:landmarks].T.copy()
    kernel = (unit @ marks).astype(np.float64)
    value, vector = np.linalg.eigh(kernel[: marks.shape[1]])
    keep = value > 1e-6 * value.max()
    root = vector[:, keep] / np.sqrt(value[keep])
    phi = np.hstack([kernel @ root, np.ones((len(kernel), 1))])
    target = np.where(np.array(labels)[:, None] == np.array(langs)[None, :], 1.0, -1.0)
    w = np.linalg.solve(phi.T @ phi + ridge * len(phi) * np.eye(phi.shape[1]), phi.T @ target)
    return Model(langs, marks, np.vstack([root @ w[:-1], w[-1:]]).astype(np.float32))


def held_out(modulus: int, remainder: int, id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def _presence_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    worker_state()
    for batch in batches:
        packed = [np.packbits(presence([t.as_py()])[0]).tobytes() for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("n"), pa.array(packed, pa.binary())], names=["lang", "n", "has"])


def learn(docs: DataFrame, sample: int = SAMPLE, landmarks: int = LANDMARKS) -> Model | None:
    """Fit on at most ``sample`` documents that have a language and a letter, as many for each language where there are.

    Rows whose crc32(doc_id) mod 3 is 1, and rows without an id, are never looked at. The driver gets 2 KB a document.
    """
    open_rows = docs.filter("doc_id is not null and lang is not null and text is not null").filter(~held_out(3, 1))
    langs = max(1, open_rows.select(F.count_distinct("lang")).first()[0])
    each, spread = -(-sample // langs), F.pmod(F.xxhash64("doc_id"), F.lit(SPREAD))
    nth = lambda *by: F.row_number().over(W.partitionBy("lang", *by).orderBy(F.xxhash64("doc_id"), "doc_id"))
    some = open_rows.select("doc_id", "lang").withColumn("n", nth(spread)).filter(F.col("n") <= each)  # a common language is no single group
    chosen = some.withColumn("n", nth()).filter(F.col("n") <= each).select(F.col("doc_id").alias("id"), "lang", "n").limit(sample + langs)
    texts = docs.filter(F.col("text").rlike(r"\p{L}")).select("doc_id", F.lower("text").alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).select("lang", "n", "text")
    rows = texts.mapInArrow(_presence_rows, "lang string, n int, has binary").toPandas().sort_values(["n", "lang"], kind="stable")
    if rows.empty:
        return None
    has = np.stack([np.unpackbits(np.frombuffer(x, np.uint8)) for x in rows["has"]])
    return fit(has, rows["lang"].tolist(), landmarks)


def _told(texts: list[str | None], model: Model | None) -> tuple[list[str], np.ndarray]:
    """The language and score of each lower-cased text."""
    langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    known = [i for i, t in enumerate(texts) if model is not None and t is not None and any(map(str.isalpha, t))]
    while known:
        n, size = 0, 0
        while n < len(known) and n < 128 and (n == 0 or size < 1 << 19):
            size += len(texts[known[n]])
            n += 1
        part, known = known[:n], known[n:]
        f = model.outputs(presence([texts[i] for i in part]))
        best = f.argmax(1)
        scores[part] = np.clip((f[np.arange(n), best].astype(np.float64) + 1) / 2, 0, 1)
        for i, c in zip(part, best.tolist(), strict=True):
            langs[i] = model.langs[c]
    return langs, scores


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score) for each row; score is the winning output, clipped and scaled from [-1, 1] to [0, 1].

    Null texts, texts without a letter, and all texts if there was nothing to learn from are ``und`` with score 0. Equal
    outputs go to the language that sorts first. Rows that repeat are each answered; other columns are not looked at.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # landmarks and weights: a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state()
        for batch in batches:
            langs, scores = _told(batch.column("text").to_pylist(), held.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, least: float = 0.0) -> DataFrame:
    """The rows that have a language (with a score of ``least`` or more), with all their columns; ``lang`` is the one found where it is null.

    Each row is told by its own text, whatever its id is: rows without an id too, and rows that repeat one. Texts without a
    letter go. Where there is nothing to learn from, no other text does, and ``lang`` stays. The outputs of a short text are
    all low, however clear its language is: a score is no reason to drop a document.
    """
    model = learn(docs)
    if model is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def told(texts: pd.Series) -> pd.DataFrame:
        worker_state()
        langs, scores = _told(texts.tolist(), held.value)
        return pd.DataFrame({"lang_pred": langs, "score": scores})

    # rows stay where they are; one that is not deterministic is asked once, for the filter and the column
    found = docs.withColumn("_told", told.asNondeterministic()(F.lower("text"))).filter((F.col("_told.lang_pred") != UNKNOWN) & (F.col("_told.score") >= least))
    return found.select(*(F.coalesce("lang", "_told.lang_pred").alias("lang") if c == "lang" else F.col(c) for c in docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, learn(docs))
    return found.select("doc_id", held_out(3, 1).alias("held_out"), "lang_pred", "score")

"""Exact top-k search by exhaustive term-at-a-time accumulation over blocks of sparse rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from memengine.llm.common import cut

#: Bytes of a block of candidates and of a block of queries, of ENTRY bytes a term: one task holds one of each.
CANDIDATES, QUERIES, ENTRY = 32 << 20, 16 << 20, 12
#: Rows that are a block of their own at least, where there are fewer blocks than cores.
FEWEST = 1024
#: The ends of a long.
LOWEST, LARGEST = -(2**63), 2**63 - 1


def sparse_rows(vectors: DataFrame, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, terms, weights): the non-zero floor(scale * x) of each vector and their positions.

    Weights are doubles, which hold every floor(scale * x) exactly as it was computed. A row with a null id, a null vector,
    or a vector that holds a null or non-finite component takes no part. An empty vector has no terms: it scores 0 against
    everything.
    """
    v = F.col(vector_col)
    fine = F.col(id_col).isNotNull() & v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    # doubles of 2**53 and over are whole numbers, and may not fit a long
    scaled = lambda x: F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x)
    return (
        vectors.filter(fine)
        .select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: scaled(x.cast("double") * scale)).alias("w"))
        .select("vec_id", F.filter(F.transform("w", lambda x, i: F.struct(i.alias("t"), x.alias("w"))), lambda s: s["w"] != 0).alias("e"))
        .select("vec_id", F.col("e.t").alias("terms"), F.col("e.w").alias("weights"))
    )


def _block_topk(k: int):
    def best(key, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(queries) and len(rows):
            ids = rows["vec_id"].to_numpy(np.int64)
            order = np.argsort(ids, kind="stable")  # a lower place is a smaller id, so ties go to the smaller id
            ids, n = ids[order], len(ids)
            lengths = np.array([len(x) for x in rows["terms"]])[order]
            at = np.repeat(np.arange(n), lengths)
            terms = np.concatenate([rows["terms"].iloc[i] for i in order]).astype(np.int64)
            weights = np.concatenate([rows["weights"].iloc[i] for i in order])
            asked = [np.asarray(x, float) for x in queries["weights"]]
            most = max((float(np.abs(x).sum()) for x in asked if len(x)), default=0.0) * float(np.abs(weights).max(initial=0))
            # whole numbers of any size where a sum might leave the range of a long
            kind = np.int64 if most < 2.0**62 else object
            whole = lambda x: x.astype(np.int64) if kind is np.int64 else np.array([int(y) for y in x] + [None], object)[:-1]
            weights = whole(weights)
            by = np.argsort(terms, kind="stable")
            names, first = np.unique(terms[by], return_index=True)
            postings = {}
            for t, where, what in zip(names.tolist(), np.split(at[by], first[1:]), np.split(weights[by], first[1:]), strict=True):
                if 2 * len(where) > n:  # a term that most rows have is kept as a whole column
                    full = np.zeros(n, kind)
                    full[where] = what
                    where, what = None, full
                postings[t] = (where, what)
            scores, part = np.zeros(n, kind), np.zeros(n, kind)
            for q, q_terms, q_weights in zip(queries["vec_id"].to_numpy(np.int64), queries["terms"], asked, strict=True):
                scores.fill(0)
                for t, w in zip(q_terms, whole(q_weights), strict=True):
                    if (p := postings.get(int(t))) is not None:
                        where, what = p
                        if where is None:
                            np.multiply(what, w, out=part)
                            np.add(scores, part, out=scores)
                        else:
                            scores[where] += what * w
                own = slice(*np.searchsorted(ids, [q, q + 1]))
                others = np.concatenate([np.arange(own.start), np.arange(own.stop, n)]) if own.start < own.stop else np.arange(n)
                s = np.clip(scores[others], LOWEST, LARGEST).astype(np.int64)
                if len(s) > k:
                    least = np.partition(s, len(s) - k)[len(s) - k]
                    chosen = np.concatenate([above := np.flatnonzero(s > least), np.flatnonzero(s == least)[: k - len(above)]])
                    others, s = others[chosen], s[chosen]
                out["query_id"].append(np.full(len(others), q))
                out["vec_id"].append(ids[others])
                out["score"].append(s)
        return pd.DataFrame({c: np.concatenate(x) if x else np.zeros(0, np.int64) for c, x in out.items()})

    return best


def exact_topk(queries: DataFrame, rows: DataFrame, k: int = 5, candidates: int = CANDIDATES, block: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products over all rows but those with its own id.

    Both inputs have the columns of ``sparse_rows``. Ties go to the smaller vec_id. Queries and rows are dealt into
    blocks of about ``block`` and ``candidates`` bytes; a task holds one block of each, whatever the sizes of the tables,
    and returns k rows for each of its queries, of which the k best stay. Rows that repeat an id all take part; of
    queries that repeat an id the least vector is answered. Sums are whole numbers of any size; a score beyond the range
    of a long is the end of that range, and ranks as such.
    """
    least = queries.groupBy("vec_id").agg(F.min(F.struct("terms", "weights")).alias("q")).select("vec_id", "q.terms", "q.weights")
    numbered = [cut(x.withColumn("n", F.monotonically_increasing_id())) for x in (least, rows)]
    sizes = [x.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("terms")).first() for x in numbered]
    across, down = (max(1, -(-s["terms"] * ENTRY // limit)) for s, limit in zip(sizes, (block, candidates), strict=True))
    cores = rows.sparkSession.sparkContext.defaultParallelism
    down = max(down, min(-(-cores // across), sizes[1]["n"] // FEWEST))

    def dealt(df: DataFrame, own: str, parts: int, other: str, copies: int) -> DataFrame:
        return df.withColumn(own, F.pmod(F.xxhash64("n"), F.lit(parts)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).drop("n")

    left = dealt(numbered[0], "q_block", across, "c_block", down).groupBy("q_block", "c_block")
    right = dealt(numbered[1], "c_block", down, "q_block", across).groupBy("q_block", "c_block")
    found = left.cogroup(right).applyInPandas(_block_topk(k), "query_id long, vec_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    from memengine.llm.common import table

    rows = sparse_rows(table(spark, sf_dir, "embeddings"))
    return exact_topk(rows.filter(F.col("vec_id") % 50 == 0), rows)


ORACLE = """
WITH fine AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM fine q JOIN fine c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""

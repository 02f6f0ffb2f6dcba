"""Registered queries over indexes, search, recall, selection and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memengine.functions.text import query_words, tokens
from memengine.operators import index as ix
from memengine.operators import driver, recall, render, rescore, select
from memengine.plans import views as v

# the tokeniser, the postings and BM25 in SQL
_TOKENS = r"""
toks AS (SELECT doc_id, regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}]+') AS w FROM docs),
occ AS (SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS pos FROM toks),
postings AS (SELECT term, doc_id, count(*) AS tf FROM occ GROUP BY ALL),
lens AS (SELECT doc_id, len(w) AS dl FROM toks),
stats AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM lens),
qt AS (SELECT query_id, unnest(regexp_extract_all(replace(lower(strip_accents(query_text)), 'ß', 'ss'), '[\p{L}\p{N}]+')[1:32]) AS term FROM q),
qn AS (SELECT query_id, count(*) AS n FROM qt GROUP BY 1),
df AS (SELECT term, count(*) AS df FROM postings GROUP BY 1),
bm AS (
  SELECT query_id, doc_id, round(sum(greatest(ln((n_docs - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score, count(*) AS have
  FROM qt JOIN postings USING (term) JOIN df USING (term) JOIN lens USING (doc_id), stats GROUP BY 1, 2
),
matched AS (SELECT query_id, doc_id, score FROM bm JOIN qn USING (query_id) WHERE have = n)"""

_SIGNALS = r"""
pool AS (SELECT query_id, doc_id, excluded, source_kind FROM q, docs WHERE allow_raw OR source_kind <> 'raw_transcript'),
fts0 AS (SELECT query_id, doc_id, score FROM matched JOIN pool USING (query_id, doc_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 500),
fts AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM fts0 JOIN q USING (query_id) WHERE doc_id <> excluded),
structured AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS rank FROM q JOIN docs ON contains(replace(lower(scrubbed), 'ß', 'ss'), 'go') WHERE query_id % 4 = 0 AND doc_id <> excluded AND (allow_raw OR source_kind <> 'raw_transcript')),
hay AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(replace(replace(replace(replace(lower(project_slug || ' ' || source_path || ' ' || text), 'ß', 'ss'), '\', '/'), '/', ' '), '-', ' '), '\s+')) AS part FROM docs),
ask AS (SELECT query_id, unnest(['u', 'src' || CAST(query_id % 20 AS VARCHAR)]) AS part, times FROM q),
over0 AS (SELECT query_id, doc_id, sum(times) AS overlap FROM ask JOIN hay USING (part) GROUP BY 1, 2),
paths AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, doc_id) AS rank FROM over0 JOIN pool USING (query_id, doc_id) WHERE doc_id <> excluded),
found AS (SELECT query_id, doc_id FROM fts UNION SELECT query_id, doc_id FROM structured UNION SELECT query_id, doc_id FROM paths),
recency AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY updated_at DESC, doc_id) AS rank FROM found JOIN docs USING (doc_id)),
lists AS (SELECT 'fts' AS signal, * FROM fts UNION ALL SELECT 'structured', * FROM structured UNION ALL SELECT 'paths', * FROM paths UNION ALL SELECT 'recency', * FROM recency),
active AS (SELECT query_id, count(DISTINCT signal) AS active FROM lists GROUP BY 1),
fused AS (SELECT query_id, doc_id, round(sum(1 / (60 + rank)) / any_value(active), 12) AS score, min(rank) AS best FROM lists JOIN active USING (query_id) GROUP BY 1, 2),
cand AS (SELECT f.*, source_kind, project_slug, content_sha256, trust_level, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, CASE trust_level WHEN 'user_approved' THEN 0 WHEN 'model_distilled' THEN 1 ELSE 2 END, best, updated_at DESC, doc_id) AS position FROM fused f JOIN docs USING (doc_id)),
kept AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY query_id, content_sha256 ORDER BY position) = 1),
turns AS (SELECT *, row_number() OVER (PARTITION BY query_id, source_kind, project_slug ORDER BY position) AS turn FROM kept),
chosen AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY turn, source_kind, project_slug) AS slot FROM turns)"""

_BASE = "WITH " + v.DOCS + "," + v.QUERIES + "," + _TOKENS
_ALL = _BASE + "," + _SIGNALS
_JUDGED = ", judged AS (SELECT item_id AS query_id, doc_id FROM benchmark b JOIN docs ON contains(docs.text, trim(b.text)))"


def _inputs(spark, d):
    docs = v.recall_documents(spark, d)
    index = ix.build_index(docs)
    return docs, v.recall_queries(spark, d), ix.Index(index.postings, index.lengths.persist())


def _candidates(spark, d):
    docs, queries, index = _inputs(spark, d)
    return recall.rank_lexical(queries, docs, index), queries, docs


def term_stats(spark, d) -> DataFrame:
    return ix.build_index(v.recall_documents(spark, d)).term_statistics()


def bm25_topk(spark, d) -> DataFrame:
    _, queries, index = _inputs(spark, d)
    return ix.ranked(ix.match_all(ix.query_units(queries, query_words(F.col("query_text"))), index), 10)


def phrase_search(spark, d) -> DataFrame:
    """Documents with the first three words of an item in a row."""
    _, queries, index = _inputs(spark, d)
    words = queries.select(F.col("query_id").alias("phrase_id"), F.slice(query_words(F.col("query_text")), 1, 3).alias("terms"))
    plain = words.withColumn("terms", F.transform("terms", lambda w: F.element_at(tokens(w), 1)))
    return ix.phrase_hits(plain, index).select(F.col("phrase_id").alias("query_id"), "doc_id", "tf")


def near_search(spark, d) -> DataFrame:
    _, queries, index = _inputs(spark, d)
    pairs = queries.select(F.col("query_id").alias("pair_id"), tokens(F.col("query_text")).alias("w")).select("pair_id", F.col("w")[1].alias("left"), F.col("w")[4].alias("right"))
    return ix.near_hits(pairs, index, 3).select(F.col("pair_id").alias("query_id"), "doc_id")


def prefix_search(spark, d) -> DataFrame:
    _, queries, index = _inputs(spark, d)
    heads = queries.select(F.col("query_id").alias("prefix_id"), F.substring(tokens(F.col("query_text"))[0], 1, 4).alias("prefix"))
    return ix.prefix_terms(heads, index).select(F.col("prefix_id").alias("query_id"), "term")


def index_health(spark, d) -> DataFrame:
    """An index without raw transcripts, in which every tenth text is an older one and a term has lost its postings."""
    docs, index = _damaged(spark, d)
    return ix.index_health(docs, index)


def index_faults(spark, d) -> DataFrame:
    return ix.index_faults(*_damaged(spark, d))


def index_repair(spark, d) -> DataFrame:
    """Terms of the index after repair; the same as a new index has."""
    return ix.repaired(*_damaged(spark, d)).term_statistics()


def _damaged(spark, d):
    docs = v.recall_documents(spark, d)
    old = F.when(F.substring("doc_id", 2, 9).cast("long") % 10 == 0, F.concat("text", F.lit(" older"))).otherwise(F.col("text"))
    index = ix.build_index(docs.filter("source_kind <> 'raw_transcript'").withColumn("text", old))
    return docs, ix.Index(index.postings.filter("term <> 'the'"), index.lengths)


def incremental_index(spark, d) -> DataFrame:
    """Terms after every tenth document is rewritten and every eleventh removed; the same as a new index has."""
    docs = v.recall_documents(spark, d)
    n = F.substring("doc_id", 2, 9).cast("long")
    changed = docs.filter(n % 10 == 0).withColumn("text", F.concat("text", F.lit(" rewritten")))
    new = ix.update_index(ix.build_index(docs), changed.filter(n % 11 != 0), docs.filter(n % 11 == 0))
    return new.term_statistics()


def structured_signal(spark, d) -> DataFrame:
    docs, queries, _ = _inputs(spark, d)
    return recall.structured_signal(queries, docs)


def path_signal(spark, d) -> DataFrame:
    docs, queries, _ = _inputs(spark, d)
    return recall.path_signal(queries, docs)


def recency_signal(spark, d) -> DataFrame:
    docs, queries, _ = _inputs(spark, d)
    return recall.recency_signal([recall.structured_signal(queries, docs), recall.path_signal(queries, docs)], docs)


def rrf_fuse(spark, d) -> DataFrame:
    found, _, _ = _candidates(spark, d)
    return found.select("query_id", "position", "doc_id", "score", "best")


def select_candidates(spark, d) -> DataFrame:
    found, queries, _ = _candidates(spark, d)
    return select.select_candidates(found, queries, unique_sources=True).select("query_id", "slot", "doc_id")


def select_by_fold(spark, d) -> DataFrame:
    found, queries, _ = _candidates(spark, d)
    return select.select_candidates(found, queries).select("query_id", "slot", "doc_id")


def render_context(spark, d) -> DataFrame:
    found, queries, docs = _candidates(spark, d)
    return render.render_context(select.select_candidates(found, queries, unique_sources=True), queries, docs=docs)


def recall_output(spark, d) -> DataFrame:
    docs, queries, index = _inputs(spark, d)
    done = driver.run(queries, docs, index, unique_sources=True)
    return done.outputs.join(done.diagnostics, "query_id")


def embed_rescore(spark, d) -> DataFrame:
    """Vectors of the given table stand for documents (same number) and queries (item + 100); all candidates of a query are scored."""
    found, queries, docs = _candidates(spark, d)
    e = v.table(spark, d, "embeddings")
    of_docs = e.select(F.concat(F.lit("d"), F.lpad(F.col("vec_id").cast("string"), 9, "0")).alias("doc_id"), F.col("embedding").cast("array<double>").alias("vector"))
    of_queries = e.select((F.col("vec_id") - 100).alias("query_id"), F.col("embedding").cast("array<double>").alias("vector"))
    return rescore.rescore_by_vectors(found, of_queries, of_docs, top=None).select("query_id", "position", "doc_id", F.round("score", 6).alias("score"), "mode")


def rerank_rescore(spark, d) -> DataFrame:
    """A reranker that scores by length; it fails for every query whose text ends in go."""
    def by_length(query: str, texts: list[str]) -> list[float]:
        if query.endswith(" go"):
            raise ValueError("unavailable")
        return [1 / (1 + len(t)) for t in texts]

    found, queries, docs = _candidates(spark, d)
    return rescore.rerank(found, queries, by_length, docs=docs).select("query_id", "position", "doc_id", F.round("score", 6).alias("score"), "mode")


def scrub_documents(spark, d) -> DataFrame:
    return v.recall_documents(spark, d).select("doc_id", F.sha2("scrubbed", 256).alias("scrubbed_sha256"))


QUERIES = {f.__name__: f for f in (
    term_stats, bm25_topk, phrase_search, near_search, prefix_search, index_health, index_faults, index_repair, incremental_index, structured_signal, path_signal, recency_signal, rrf_fuse, select_candidates, select_by_fold,
    render_context, recall_output, embed_rescore, rerank_rescore, scrub_documents,
)}

_SELECT = _ALL + " SELECT query_id, CAST(slot AS INTEGER) AS slot, doc_id FROM chosen"
_RANKS = " SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank FROM "
_LEFT = "(4000 - length(acc.t) - CASE WHEN acc.n > 0 THEN 2 ELSE 0 END - length(x.h))"
_PACK = f"list_reduce(list_prepend('', x.p), lambda a, s: CASE WHEN length(a) + length(s) + CASE WHEN a = '' THEN 0 ELSE 1 END > {_LEFT} THEN a WHEN a = '' THEN s ELSE a || ' ' || s END)"
_BODY = f"CASE WHEN {_LEFT} <= 0 THEN '' WHEN length(x.t) <= {_LEFT} THEN x.t WHEN {_PACK} <> '' THEN {_PACK} ELSE regexp_replace(left(x.t, {_LEFT}), '\\s+$', '') END"
_RENDER = rf""", blocks AS (SELECT query_id, slot, '{render.MARKER}' || chr(10) || '[source: ' || c.doc_id || '; kind: ' || c.source_kind || '; trust: ' || c.trust_level || '; project: ' || c.project_slug || ']' || chr(10) AS h,
  regexp_replace(scrubbed, '^\s+|\s+$', '', 'g') AS t FROM chosen c JOIN docs USING (doc_id)),
parted AS (SELECT query_id, list({{'h': h, 't': t, 'p': list_filter(list_transform(string_split(regexp_replace(t, '([.!?])\s+|\n+', '\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> ''), 'n': 0}} ORDER BY slot) AS bs FROM blocks GROUP BY 1),
made AS (SELECT query_id, list_reduce(list_prepend({{'h': '', 't': '', 'p': CAST([] AS VARCHAR[]), 'n': 0}}, bs), lambda acc, x: CASE WHEN {_BODY} = '' THEN acc ELSE {{'h': '', 't': acc.t || CASE WHEN acc.n > 0 THEN chr(10) || chr(10) ELSE '' END || x.h || {_BODY}, 'p': CAST([] AS VARCHAR[]), 'n': acc.n + 1}} END) AS m FROM parted)
SELECT query_id, coalesce(m.t, '') AS context, CAST(coalesce(m.n, 0) AS BIGINT) AS n_blocks, CAST(length(coalesce(m.t, '')) AS BIGINT) AS codepoints FROM q LEFT JOIN made USING (query_id)"""

_RESCORED = """
, vec AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
paired AS (
  SELECT c.query_id, c.doc_id, c.score, c.position, {new} AS added, {known} AS known FROM cand c {joins}
), bad AS (SELECT query_id, bool_or({first}NOT known) {also} AS bad FROM paired GROUP BY 1),
scored AS (SELECT query_id, doc_id, position, bad, CASE WHEN {first}NOT bad THEN round((score + added) / 2, 12) ELSE score END AS score FROM paired JOIN bad USING (query_id))
SELECT query_id, CAST(CASE WHEN bad THEN position ELSE row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) END AS INTEGER) AS position, doc_id, round(score, 6) AS score,
       CASE WHEN bad THEN 'lexical' ELSE '{mode}' END AS mode FROM scored"""

_HEALTH = "WITH " + v.DOCS + r""", health AS (SELECT doc_id, CASE WHEN source_kind = 'raw_transcript' THEN 'missing' WHEN CAST(doc_id[2:] AS BIGINT) % 10 = 0
  OR list_contains(regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}]+'), 'the') THEN 'damaged' END AS fault FROM docs)"""

ORACLE = {
    "term_stats": _BASE + " SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM postings GROUP BY 1",
    "bm25_topk": _BASE + " SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM matched QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 10",
    "phrase_search": _BASE + r""", p AS (SELECT query_id, regexp_extract_all(lower(strip_accents(query_text)), '[\p{L}\p{N}]+')[1:3] AS w FROM q)
      SELECT query_id, a.doc_id, count(*) AS tf FROM p JOIN occ a ON a.term = w[1] JOIN occ b ON b.doc_id = a.doc_id AND b.term = w[2] AND b.pos = a.pos + 1 JOIN occ c ON c.doc_id = a.doc_id AND c.term = w[3] AND c.pos = a.pos + 2 GROUP BY ALL""",
    "near_search": _BASE + r""", p AS (SELECT query_id, regexp_extract_all(lower(strip_accents(query_text)), '[\p{L}\p{N}]+') AS w FROM q)
      SELECT DISTINCT query_id, a.doc_id FROM p JOIN occ a ON a.term = w[2] JOIN occ b ON b.doc_id = a.doc_id AND b.term = w[5] AND b.pos <> a.pos AND abs(a.pos - b.pos) <= 4""",
    "prefix_search": _BASE + r""", p AS (SELECT query_id, left(regexp_extract_all(lower(strip_accents(query_text)), '[\p{L}\p{N}]+')[1], 4) AS prefix FROM q)
      SELECT query_id, term FROM p JOIN (SELECT DISTINCT term FROM postings) ON starts_with(term, prefix)""",
    "index_health": _HEALTH + " SELECT count(*) AS n_table, count(*) FILTER (fault IS DISTINCT FROM 'missing') AS n_index, count(*) FILTER (fault = 'missing') AS missing, CAST(0 AS BIGINT) AS stale, count(*) FILTER (fault = 'damaged') AS damaged, count(fault) = 0 AS sound FROM health",
    "index_faults": _HEALTH + " SELECT doc_id, fault FROM health WHERE fault IS NOT NULL",
    "index_repair": _BASE + " SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM postings GROUP BY 1",
    "incremental_index": "WITH " + v.DOCS + r""", now AS (SELECT doc_id, text || CASE WHEN CAST(doc_id[2:] AS BIGINT) % 10 = 0 THEN ' rewritten' ELSE '' END AS text FROM docs WHERE CAST(doc_id[2:] AS BIGINT) % 11 <> 0),
      t AS (SELECT doc_id, unnest(regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}]+')) AS term FROM now) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM t GROUP BY 1""",
    "structured_signal": _ALL + _RANKS + "structured",
    "path_signal": _ALL + _RANKS + "paths",
    "recency_signal": _ALL + " SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY updated_at DESC, doc_id) AS INTEGER) AS rank FROM (SELECT query_id, doc_id FROM structured UNION SELECT query_id, doc_id FROM paths) JOIN docs USING (doc_id)",
    "rrf_fuse": _ALL + " SELECT query_id, CAST(position AS INTEGER) AS position, doc_id, score, CAST(best AS INTEGER) AS best FROM cand",
    "select_candidates": _SELECT,
    "select_by_fold": _SELECT,
    "render_context": _ALL + _RENDER,
    "embed_rescore": _ALL + _RESCORED.format(
        new="greatest(0, list_cosine_similarity(a.v, b.v))", known="a.v IS NOT NULL AND b.v IS NOT NULL", joins="LEFT JOIN vec a ON a.vec_id = c.query_id + 100 LEFT JOIN vec b ON b.vec_id = CAST(c.doc_id[2:] AS BIGINT)", first="", also="", mode="lexical_plus_embedder"),
    "rerank_rescore": _ALL + _RESCORED.format(new="1 / (1 + length(scrubbed))", known="true", joins="JOIN docs USING (doc_id)", first="position <= 100 AND ", also="OR bool_or(query_id % 4 = 0)", mode="lexical_plus_reranker"),
    "scrub_documents": "WITH " + v.DOCS + " SELECT doc_id, sha256(scrubbed) AS scrubbed_sha256 FROM docs",
}

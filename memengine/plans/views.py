"""The engine's tables derived from the given ones, as DataFrames and as the same derivations in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from memengine.functions.text import iso_utc, scrub, tokens
from memengine.operators.index import build_index, match_all, query_units
from memengine.operators.ingest import roll_up


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stamp(minutes: Column) -> Column:
    """ISO time so many minutes after the start of 2024."""
    return iso_utc((F.lit(1704067200) + minutes * 60) * 1_000_000)


def messages(spark, sf_dir: str) -> DataFrame:
    """User and assistant turns with text, renumbered from 1 in each conversation."""
    c = table(spark, sf_dir, "conversations").filter("role IN ('user', 'assistant')").withColumn("text", F.trim("text")).filter("text <> ''")
    seq = F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    at = stamp(F.col("conv_id") * 60 + F.col("turn"))
    return c.select(F.col("conv_id").alias("session_id"), seq.alias("seq"), "role", at.alias("timestamp"), "text")


MESSAGES = """
messages AS (
  SELECT conv_id AS session_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, t) AS seq, role,
         strftime(TIMESTAMP '2024-01-01' + to_minutes(conv_id * 60 + turn), '%Y-%m-%dT%H:%M:%SZ') AS timestamp, t AS text
  FROM (SELECT conv_id, turn, role, trim(text) AS t FROM conversations WHERE role IN ('user', 'assistant')) WHERE t <> ''
)"""


def sessions(spark, sf_dir: str, m: DataFrame | None = None) -> DataFrame:
    """One row a conversation, with its roll-up; of ``m``, where the messages are at hand."""
    m = messages(spark, sf_dir) if m is None else m
    rolled = roll_up(m, F.max("timestamp").alias("ended_at"))
    project = F.concat(F.lit("-home-u-p"), (F.col("session_id") % 7).cast("string"))
    return rolled.select(
        "session_id", F.lit("chat").alias("source"), project.alias("project_slug"), F.translate(project, "-", "/").alias("cwd"), stamp(F.col("session_id") * 60).alias("started_at"), "ended_at",
        "user_msg_count", "asst_msg_count", "total_chars", F.concat(F.lit("r"), F.col("total_chars")).alias("source_revision"), F.lit("p1").alias("parser_version"),
    )


SESSIONS = MESSAGES + """, sessions AS (
  SELECT session_id, 'chat' AS source, '-home-u-p' || CAST(session_id % 7 AS VARCHAR) AS project_slug, '/home/u/p' || CAST(session_id % 7 AS VARCHAR) AS cwd,
         strftime(TIMESTAMP '2024-01-01' + to_minutes(session_id * 60), '%Y-%m-%dT%H:%M:%SZ') AS started_at, max(timestamp) AS ended_at,
         count(*) FILTER (role = 'user') AS user_msg_count, count(*) FILTER (role = 'assistant') AS asst_msg_count, CAST(sum(length(text)) AS BIGINT) AS total_chars,
         'r' || CAST(sum(length(text)) AS VARCHAR) AS source_revision, 'p1' AS parser_version
  FROM messages GROUP BY session_id
)"""


def distilled(spark, sf_dir: str) -> DataFrame:
    """Distillations of four in five sessions; every seventh of an older revision, every ninth without a key."""
    s = sessions(spark, sf_dir).filter("session_id % 5 <> 0")
    # a third of the times have a fraction, a third of them no zone
    whole = F.regexp_replace(stamp(F.col("session_id") * 60 + 5000), "Z$", "")
    distilled_at = F.concat(whole, F.element_at(F.array(F.lit(".125Z"), F.lit(""), F.lit("Z")), (F.col("session_id") % 3 + 1).cast("int")))
    notes = F.to_json(F.struct(F.concat(F.lit("summary of "), F.col("session_id")).alias("summary"), F.col("project_slug").alias("project")))
    return s.select(
        "session_id", F.when(F.col("session_id") % 9 != 0, F.sha2(F.concat_ws(":", F.lit("k"), "session_id"), 256)).alias("distillation_key"), distilled_at.alias("distilled_at"),
        F.when(F.col("session_id") % 7 == 0, F.lit("old")).otherwise(F.col("source_revision")).alias("source_revision"), "parser_version",
        F.lit("v1").alias("prompt_version"), F.lit("local").alias("provider"), F.lit("m").alias("model"), notes.alias("notes_json"), F.concat(F.lit("summary of "), F.col("session_id")).alias("summary"),
    )


DISTILLED = SESSIONS + """, distilled AS (
  SELECT session_id, CASE WHEN session_id % 9 <> 0 THEN sha256('k:' || CAST(session_id AS VARCHAR)) END AS distillation_key,
         strftime(TIMESTAMP '2024-01-01' + to_minutes(session_id * 60 + 5000), '%Y-%m-%dT%H:%M:%S') || (['.125Z', '', 'Z'])[session_id % 3 + 1] AS distilled_at,
         CASE WHEN session_id % 7 = 0 THEN 'old' ELSE source_revision END AS source_revision, parser_version, 'v1' AS prompt_version, 'local' AS provider, 'm' AS model,
         '{"summary":"summary of ' || CAST(session_id AS VARCHAR) || '","project":"' || project_slug || '"}' AS notes_json, 'summary of ' || CAST(session_id AS VARCHAR) AS summary
  FROM sessions WHERE session_id % 5 <> 0
)"""


def recall_documents(spark, sf_dir: str) -> DataFrame:
    """Documents as curated ones: quality 1 is approved memory, 0 a distilled summary, unlabelled a raw transcript."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("labelled"), "quality")
    d = table(spark, sf_dir, "documents").join(labels, F.col("doc_id") == F.col("labelled"), "left")
    kind = F.when(F.col("quality") == 1, F.lit("approved_memory")).when(F.col("quality") == 0, F.lit("distilled_summary")).otherwise(F.lit("raw_transcript"))
    trust = F.when(F.col("quality") == 1, F.lit("user_approved")).when(F.col("quality") == 0, F.lit("model_distilled")).otherwise(F.lit("untrusted_transcript"))
    return d.select(
        F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("doc_id"), F.sha2("text", 256).alias("content_sha256"), kind.alias("source_kind"), trust.alias("trust_level"), F.col("source").alias("project_slug"),
        F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("source_path"), stamp(F.col("doc_id")).alias("updated_at"), F.lit("v1").alias("source_version"), "text", scrub(F.col("text"), "/home/u").alias("scrubbed"),
    )


#: Scrubbing in DuckDB's dialect, text in, text out.
SCRUB = r"""replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0},
  '(?is)-----BEGIN [^-]+-----.*?-----END [^-]+-----', '<redacted>', 'g'), '(?i)\bBearer\s+[A-Za-z0-9._~+/=-]+', 'Bearer <redacted>', 'g'),
  '(?i)\b(?:postgres(?:ql)?|mysql|mariadb|mongodb(?:\+srv)?|redis)://[^\s<>]+', '<redacted>', 'g'),
  '(?im)\b((?:[A-Z][A-Z0-9_]*(?:KEY|TOKEN|SECRET|PASSWORD|PASSWD|CREDENTIALS?)|(?:AWS|GITHUB|OPENAI|ANTHROPIC)_[A-Z0-9_]+)\s*=)\s*[^\s#;,]+', '\1 <redacted>', 'g'),
  '(?i)\b((?:api[_-]?key|access[_-]?token|refresh[_-]?token|secret|password|passwd|token)\s*[:=]\s*)[^\s#;,]+', '\1<redacted>', 'g'), '/home/u', '<home>')"""

DOCS = """
docs AS (
  SELECT 'd' || lpad(CAST(d.doc_id AS VARCHAR), 9, '0') AS doc_id, sha256(text) AS content_sha256,
         CASE WHEN quality = 1 THEN 'approved_memory' WHEN quality = 0 THEN 'distilled_summary' ELSE 'raw_transcript' END AS source_kind,
         CASE WHEN quality = 1 THEN 'user_approved' WHEN quality = 0 THEN 'model_distilled' ELSE 'untrusted_transcript' END AS trust_level,
         source AS project_slug, source || '/' || CAST(d.doc_id AS VARCHAR) AS source_path,
         strftime(TIMESTAMP '2024-01-01' + to_minutes(d.doc_id), '%Y-%m-%dT%H:%M:%SZ') AS updated_at, 'v1' AS source_version, text, """ + SCRUB.format("text") + """ AS scrubbed
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
)"""


def recall_queries(spark, sf_dir: str) -> DataFrame:
    """The first six words of each benchmark item; every fourth names a tool, every second may see raw transcripts."""
    b = table(spark, sf_dir, "benchmark")
    words = F.array_join(F.slice(F.filter(F.split("text", r"\s+"), lambda w: w != ""), 1, 6), " ")
    i = F.col("item_id")
    cwd = F.concat(F.lit("/home/u/src"), (i % 20).cast("string"))
    return b.select(
        i.alias("query_id"), F.when(i % 4 == 0, F.concat(words, F.lit(" go"))).otherwise(words).alias("query_text"), cwd.alias("cwd"), F.when(i % 3 == 0, F.array(cwd)).otherwise(F.array().cast("array<string>")).alias("repository_roots"),
        F.array(F.concat(F.lit("d"), F.lpad((i * 7 % 1000).cast("string"), 9, "0"))).alias("excluded"), (i % 2 == 0).alias("allow_raw"), F.lit("prompt").alias("hook_event"), F.lit(4000).alias("budget"), F.lit("UserPromptSubmit").alias("event_name"),
    )


QUERIES = r"""
q AS (
  SELECT item_id AS query_id, w || CASE WHEN item_id % 4 = 0 THEN ' go' ELSE '' END AS query_text, '/home/u/src' || CAST(item_id % 20 AS VARCHAR) AS cwd,
         CASE WHEN item_id % 3 = 0 THEN 2 ELSE 1 END AS times, 'd' || lpad(CAST(item_id * 7 % 1000 AS VARCHAR), 9, '0') AS excluded, item_id % 2 = 0 AS allow_raw
  FROM (SELECT item_id, array_to_string(regexp_extract_all(text, '\S+')[1:6], ' ') AS w FROM benchmark)
)"""


def judgements(spark, sf_dir: str, index=None) -> DataFrame:
    """(query_id, doc_id): documents that hold the whole text of the query's item.

    Documents that have the item's second to fifth words are looked up in the index, and then read.
    """
    docs = recall_documents(spark, sf_dir)
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.trim("text").alias("item"))
    hits = match_all(query_units(items, F.slice(tokens(F.col("item")), 2, 4)), index or build_index(docs)).select("query_id", "doc_id")
    return hits.join(items, "query_id").join(docs.select("doc_id", "text"), "doc_id").filter(F.contains("text", "item")).select("query_id", "doc_id")


def memory(spark, sf_dir: str) -> DataFrame:
    """Every document as a memory file, touched up to 40 days before February 2024."""
    d = table(spark, sf_dir, "documents")
    body = F.col("text")
    return d.select(F.concat(F.lit("m"), "doc_id", F.lit(".md")).alias("path"), body.alias("body"), F.sha2(body, 256).alias("sha256"), F.timestamp_seconds(F.lit(1706745600) - (F.col("doc_id") % 40) * 86400 + 60).alias("modified"))


MEMORY = """
memory AS (SELECT 'm' || CAST(doc_id AS VARCHAR) || '.md' AS path, text AS body, sha256(text) AS sha256, (1706745600 - (doc_id % 40) * 86400 + 60) AS modified FROM documents)"""


def suggestions(spark, sf_dir: str) -> DataFrame:
    """Every document as a suggestion: four kinds, up to four with one target, some targets unsafe or not there, old and new bases."""
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    kind = F.element_at(F.array(*map(F.lit, ("new", "update", "remove", "index"))), (F.floor(i / 3) % 4 + 1).cast("int"))
    name = F.concat(F.when(F.floor(i / 4) % 7 == 0, F.lit("n")).otherwise(F.lit("m")), (i - i % 4).cast("string"), F.lit(".md"))
    target = F.when(i % 50 == 0, F.concat(F.lit("../"), name)).when(i % 26 == 0, F.concat(F.lit("./a/../"), name)).otherwise(name)
    base = F.when(i % 3 == 0, F.lit(None).cast("string")).when(i % 5 == 0, F.lit("stale")).otherwise(F.sha2(F.concat(F.lit("x"), i), 256))
    return d.select(
        i.alias("id"), kind.alias("kind"), target.alias("target_path"), F.concat(F.lit("- [t]("), name, F.lit(") hook\n"), "text").alias("body"), F.lit("because").alias("rationale"), F.concat_ws(",", F.lit("s1"), F.lit("s2")).alias("source_sessions"),
        base.alias("base_sha256"), (i % 4 == 0).cast("int").alias("target_existed"), F.when(i % 10 == 8, F.lit("accepted")).otherwise(F.lit("pending")).alias("status"),
    )


SUGGESTIONS = """
sugg AS (
  SELECT doc_id AS id, (['new', 'update', 'remove', 'index'])[(doc_id // 3) % 4 + 1] AS kind,
         CASE WHEN doc_id % 50 = 0 THEN '../' WHEN doc_id % 26 = 0 THEN './a/../' ELSE '' END || name AS target_path,
         CASE WHEN doc_id % 50 = 0 THEN NULL ELSE name END AS target, '- [t](' || name || ') hook' || chr(10) || text AS body,
         CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN 'stale' ELSE sha256('x' || CAST(doc_id AS VARCHAR)) END AS base_sha256, CAST(doc_id % 4 = 0 AS INTEGER) AS target_existed,
         CASE WHEN doc_id % 10 = 8 THEN 'accepted' ELSE 'pending' END AS status
  FROM (SELECT *, CASE WHEN doc_id // 4 % 7 = 0 THEN 'n' ELSE 'm' END || CAST(doc_id - doc_id % 4 AS VARCHAR) || '.md' AS name FROM documents)
)"""

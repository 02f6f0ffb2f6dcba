"""Memory files, evaluation fixtures and event payloads as tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memengine.functions.text import stable_id

PROMPT_BUDGET, START_BUDGET = 4000, 6000


def memory_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, body, sha256, modified): text files below ``root``; hidden, transient, backup and non-UTF-8 ones are left out.

    Line ends are made \\n before the digest.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    below = re.sub(r"^[a-z0-9]+:/*", "", root).strip("/") + "/"
    at = F.substring_index("path", below, -1)
    named = files.withColumn("at", at)
    hidden = F.col("at").rlike(r"(^|/)\.") | F.col("at").rlike(r"(^|/)memory-backups/") | F.col("at").rlike(r"(\.tmp|~)$")
    text = F.regexp_replace(F.col("content").cast("string"), "\r\n?", "\n")
    kept = named.filter(~hidden & F.is_valid_utf8(F.col("content").cast("string")))
    return kept.select(F.col("at").alias("path"), text.alias("body"), F.sha2(text, 256).alias("sha256"), F.col("modificationTime").alias("modified"))


def memory_documents(files: DataFrame, now: str) -> DataFrame:
    """Recall documents of memory files; ``now`` is the time of the sync."""
    kind = F.lit("approved_memory")
    return files.select(
        stable_id(kind, F.concat(F.lit("memory:"), "path")).alias("doc_id"), F.col("sha256").alias("content_sha256"), kind.alias("source_kind"), F.lit("user_approved").alias("trust_level"), F.lit(None).cast("string").alias("project_slug"),
        F.col("path").alias("source_path"), F.lit(now).alias("updated_at"), F.col("sha256").alias("source_version"), F.col("body").alias("text"),
    )


_DOCUMENTS = "array<struct<id:string,content_sha256:string,source_kind:string,trust_level:string,project_slug:string,source_path:string,source_updated_at:string,source_version:string,text:string>>"
_QUERIES = "array<struct<id:string,event:string,query:string,session_id:string,cwd:string,repository_roots:array<string>,excluded:array<string>,allow_raw_transcript:boolean,relevant:array<string>,forbidden:array<string>,injected:array<string>>>"


def fixture(spark: SparkSession, path: str, allow_raw: bool = False) -> tuple[DataFrame, DataFrame]:
    """(documents, queries) of an evaluation file; raw transcripts also need ``allow_raw``. Both arrays must be there."""
    whole = spark.read.schema(f"documents {_DOCUMENTS}, queries {_QUERIES}").json(path, multiLine=True)
    checked = whole.select(*(F.when(F.col(c).isNull(), F.raise_error(F.lit(f"a fixture needs an array of {c}")).cast(t)).otherwise(F.col(c)).alias(c) for c, t in (("documents", _DOCUMENTS), ("queries", _QUERIES))))
    d = checked.select(F.inline("documents"))
    text = F.coalesce("text", F.lit(""))
    docs = d.select(
        F.col("id").alias("doc_id"), F.coalesce("content_sha256", F.sha2(text, 256)).alias("content_sha256"), "source_kind", "trust_level", "project_slug", F.coalesce("source_path", "id").alias("source_path"),
        F.coalesce("source_updated_at", F.lit("")).alias("updated_at"), F.coalesce("source_version", F.lit("v1")).alias("source_version"), text.alias("text"),
    )
    none = F.array().cast("array<string>")
    event = F.coalesce("event", F.lit("prompt"))
    q = checked.select(F.inline("queries"))
    queries = q.select(
        F.col("id").alias("query_id"), F.coalesce("query", F.lit("")).alias("query_text"), "session_id", event.alias("hook_event"), "cwd", F.coalesce("repository_roots", none).alias("repository_roots"),
        F.when(event.startswith("session-start"), START_BUDGET).otherwise(PROMPT_BUDGET).alias("budget"), F.coalesce("excluded", none).alias("excluded"), (F.coalesce("allow_raw_transcript", F.lit(False)) & F.lit(allow_raw)).alias("allow_raw"),
        F.coalesce("relevant", none).alias("relevant"), F.coalesce("forbidden", none).alias("forbidden"), F.coalesce("injected", none).alias("injected"),
    )
    return docs, queries


def payload_queries(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(queries, rejected) of ``payloads(query_id, event_name, payload)``, the payload being a JSON object.

    A prompt event needs a prompt; both kinds a session and a folder. rejected has the reason.
    """
    p = payloads.withColumn("p", F.from_json("payload", "session_id string, cwd string, repository_roots array<string>, prompt string, source string, event string"))
    is_prompt = F.col("event_name") == "UserPromptSubmit"
    wrong = (
        F.when(~F.coalesce(F.trim("payload").startswith("{"), F.lit(False)) | F.try_parse_json("payload").isNull(), F.lit("payload must be an object"))
        .when((F.coalesce("p.session_id", F.lit("")) == "") | (F.coalesce("p.cwd", F.lit("")) == ""), F.lit("session_id and cwd are required"))
        .when(is_prompt & F.col("p.prompt").isNull(), F.lit("prompt is required"))
    )
    roots = F.coalesce("p.repository_roots", F.array().cast("array<string>"))
    seen = p.withColumn("reason", wrong)
    started = F.coalesce(F.nullif(F.col("p.source"), F.lit("")), F.nullif(F.col("p.event"), F.lit("")), F.lit("startup"))
    queries = seen.filter("reason is null").select(
        "query_id", "event_name", F.when(is_prompt, F.col("p.prompt")).otherwise(F.concat_ws(" ", F.array("p.cwd"), roots)).alias("query_text"), F.col("p.session_id").alias("session_id"), F.when(is_prompt, F.lit("prompt")).otherwise(F.concat(F.lit("session-start:"), started)).alias("hook_event"),
        F.col("p.cwd").alias("cwd"), roots.alias("repository_roots"), F.when(is_prompt, PROMPT_BUDGET).otherwise(START_BUDGET).alias("budget"), F.array().cast("array<string>").alias("excluded"), F.lit(False).alias("allow_raw"),
    )
    return queries, seen.filter("reason is not null").select("query_id", "event_name", "payload", "reason")

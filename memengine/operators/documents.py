"""The curated document store: collecting, and syncing by content."""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memengine.functions.text import MAX_DOCUMENT, stable_id, transcript, utc_stamp
from memengine.operators.index import Index, repaired, update_index

#: Fields that make a stored document stale; times do not.
COMPARED = ["content_sha256", "source_kind", "trust_level", "project_slug", "source_path", "source_version"]
EPOCH = "1970-01-01T00:00:00Z"


@F.pandas_udf(T.StringType())
def canonical_notes(notes: pd.Series) -> pd.Series:
    """The JSON with keys sorted at every depth, a blank behind commas and colons, and characters as themselves; null where it
    is no JSON, or neither an object nor an array with something in it. Numbers keep the form that Python writes, which
    decides the content hash, so this is Python's reader and writer and no VARIANT, which forgets trailing zeros."""

    def canonical(text: str | None) -> str | None:
        try:
            said = json.loads(text) if text else None
        except (ValueError, RecursionError):
            return None
        return json.dumps(said, ensure_ascii=False, sort_keys=True).encode("utf-8", "replace").decode() if isinstance(said, dict | list) and said else None

    return notes.map(canonical)


def distilled_documents(distilled: DataFrame, sessions: DataFrame) -> DataFrame:
    """One document a distillation: its notes as canonical JSON if there are any, else its summary; empty ones are left out, as
    are those with an empty key. A null key names the session."""
    rows = distilled.join(sessions.select("session_id", "project_slug"), "session_id")
    text = F.substring(F.coalesce(canonical_notes("notes_json"), "summary", F.lit("")), 1, MAX_DOCUMENT)
    key = F.coalesce("distillation_key", F.concat(F.lit("legacy:"), "session_id"))
    locator, kind = F.concat(F.lit("distilled:"), key), F.lit("distilled_summary")
    made = rows.withColumns({"_text": text, "_key": key}).filter("_text <> '' and _key <> ''")
    return made.select(
        stable_id(kind, locator).alias("doc_id"), F.sha2("_text", 256).alias("content_sha256"), kind.alias("source_kind"), F.lit("model_distilled").alias("trust_level"), "project_slug",
        locator.alias("source_path"), F.coalesce(utc_stamp(F.col("distilled_at")), F.lit(EPOCH)).alias("updated_at"), F.col("_key").alias("source_version"), F.col("_text").alias("text"),
    )


def rendered_sessions(messages: DataFrame) -> DataFrame:
    """(session_id, transcript): the messages of each session in order; a null time is left out of a header."""
    rows = messages.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("seq", "role", "text", "timestamp"))).alias("m"))
    return rows.select("session_id", transcript(F.col("m")).alias("transcript"))


def transcript_documents(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """One untrusted document a session with messages, as old as the session's start."""
    rows = rendered_sessions(messages).join(sessions, "session_id").withColumn("_text", F.rtrim("transcript", F.lit("\n"))).filter("_text <> ''")
    name = F.coalesce(F.nullif("external_session_id", F.lit("")), F.col("session_id").cast("string")) if "external_session_id" in sessions.columns else F.col("session_id").cast("string")
    locator, kind = F.concat_ws(":", F.lit("transcript"), "source", name), F.lit("raw_transcript")
    return rows.select(
        stable_id(kind, locator).alias("doc_id"), F.sha2("_text", 256).alias("content_sha256"), kind.alias("source_kind"), F.lit("untrusted_transcript").alias("trust_level"), "project_slug",
        locator.alias("source_path"), F.coalesce(utc_stamp(F.col("started_at")), F.lit(EPOCH)).alias("updated_at"), F.coalesce("source_revision", F.lit("")).alias("source_version"), F.col("_text").alias("text"),
    )


def sync_plan(stored: DataFrame, collected: DataFrame, kinds: list[str]) -> DataFrame:
    """(doc_id, source_kind, action): insert, update, skip or delete; only the kinds that were collected can lose documents."""
    old = stored.select("doc_id", F.struct(*COMPARED).alias("old"))
    new = collected.select("doc_id", F.struct(*COMPARED).alias("new"))
    both = old.join(new, "doc_id", "full_outer")
    kind = F.coalesce("new.source_kind", "old.source_kind")
    action = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), F.when(F.col("old.source_kind").isin(kinds), "delete").otherwise("keep")).when(F.col("old").eqNullSafe(F.col("new")), "skip").otherwise("update")
    return both.select("doc_id", kind.alias("source_kind"), action.alias("action")).filter("action <> 'keep'")


def apply_sync(stored: DataFrame, collected: DataFrame, plan: DataFrame) -> DataFrame:
    """The next state of the store."""
    written = collected.join(plan.filter("action IN ('insert', 'update')"), "doc_id", "left_semi")
    gone = plan.filter("action <> 'skip'").select("doc_id")
    return stored.join(gone, "doc_id", "left_anti").unionByName(written)


def sync_report(plan: DataFrame) -> DataFrame:
    """One row of counts."""
    count = lambda a: F.count_if(F.col("action") == a)
    return plan.agg(F.count_if(F.col("action") != "delete").alias("scanned"), count("insert").alias("inserted"), count("update").alias("updated"), count("delete").alias("deleted"), count("skip").alias("skipped"), F.count_if((F.col("action") != "delete") & (F.col("source_kind") == "raw_transcript")).alias("raw"))


def collect_and_sync(stored: DataFrame, collections: dict[str, DataFrame], index: Index | None = None) -> tuple[DataFrame, DataFrame, Index | None]:
    """(next store, report, index): all collections at once, each under its source kind, against what is stored.

    A kind that is not collected keeps its documents. The index, if one is given, is put right first where it is not
    sound, and then follows the plan: new and rewritten documents are indexed, deleted ones go, the rest stays.
    """
    collected = reduce(DataFrame.unionByName, collections.values())
    plan = sync_plan(stored, collected, list(collections))
    after = apply_sync(stored, collected, plan)
    if index is not None:
        written = collected.join(plan.filter("action IN ('insert', 'update')"), "doc_id", "left_semi")
        index = update_index(repaired(stored, index), written, plan.filter("action = 'delete'"))
    return after, sync_report(plan), index

"""Distillation around an external model: prompts out, completions in, checked and keyed."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memengine.functions.schema import first_fault
from memengine.functions.text import MAX_SUMMARY, fill, json_body, key_of, truncate_middle
from memengine.operators.documents import rendered_sessions

# fixed values: fields of a distillation's notes
NOTE_LISTS = ["user_facts", "preferences", "projects", "references", "decisions", "open_threads"]
TEXTS = {"type": "array", "items": {"type": "string"}}
NOTES = {"type": "object", "required": ["summary", *NOTE_LISTS], "additionalProperties": False, "properties": {"summary": {"type": "string"}, **dict.fromkeys(NOTE_LISTS, TEXTS)}}


def prompts(pending: DataFrame, messages: DataFrame, template: str) -> DataFrame:
    """(session_id, prompt, prompt_chars): one for each pending session that has messages, long transcripts cut in the middle."""
    text = rendered_sessions(messages.join(pending.select("session_id"), "session_id", "left_semi"))
    rows = text.join(pending.select("session_id", "started_at", "cwd", "project_slug"), "session_id")
    prompt = fill(template, started_at=F.col("started_at"), cwd=F.col("cwd"), project_slug=F.col("project_slug"))
    prompt = F.replace(prompt, F.lit("{{transcript}}"), truncate_middle(F.col("transcript")))
    return rows.select("session_id", prompt.alias("prompt")).withColumn("prompt_chars", F.length("prompt"))


def complete(prompts: DataFrame, model: Callable[[list[str]], list[str | None]]) -> DataFrame:
    """(session_id, completion) from a user's model over batches of prompts; null where a call fails."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            try:
                said = list(model(rows["prompt"].tolist()))
            except Exception:
                said = [None] * len(rows)
            yield pd.DataFrame({"session_id": rows["session_id"], "completion": said})

    kind = prompts.schema["session_id"].dataType.simpleString()
    return prompts.select("session_id", "prompt").mapInPandas(run, f"session_id {kind}, completion string")


def validate(completions: DataFrame, schema: dict = NOTES) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected): completions that fit the schema, and the others with the first fault; a null one has no JSON."""
    rows = completions.withColumn("fault", F.coalesce(first_fault(F.col("completion"), schema), F.lit("")))
    return rows.filter("fault = ''").drop("fault"), rows.filter("fault <> ''")


def load(valid: DataFrame, sessions: DataFrame, distilled_at: str, prompt_version: str, provider: str, model: str | None, options: str) -> DataFrame:
    """Rows of ``distilled``, with the key that says what they were made from."""
    schema = "summary string, " + ", ".join(f"`{n}` array<string>" for n in NOTE_LISTS)
    rows = valid.join(sessions.select("session_id", "source_revision", "parser_version"), "session_id")
    body = json_body(F.col("completion"))
    key = key_of(F.col("session_id"), F.col("source_revision"), F.col("parser_version"), F.lit(prompt_version), F.lit(provider), F.lit(model).cast("string"), F.lit(options))
    notes = F.from_json(body, schema)
    return rows.select("session_id", key.alias("distillation_key"), F.lit(distilled_at).alias("distilled_at"), "source_revision", "parser_version", F.lit(prompt_version).alias("prompt_version"), F.lit(provider).alias("provider"), F.lit(model).cast("string").alias("model"), body.alias("notes_json"), notes.alias("notes"), F.substring(notes["summary"], 1, MAX_SUMMARY).alias("summary"))


def findings(distilled: DataFrame) -> DataFrame:
    """(session_id, bucket, n, text): one row for each entry of the notes' lists."""
    buckets = F.array(*(F.struct(F.lit(n).alias("bucket"), F.coalesce(F.col(f"notes.{n}"), F.array().cast("array<string>")).alias("items")) for n in NOTE_LISTS))
    return distilled.select("session_id", F.explode(buckets).alias("b")).select("session_id", "b.bucket", F.posexplode("b.items").alias("n", "text"))


def usage(distilled: DataFrame) -> DataFrame:
    """One row: distillations, and entries over all lists."""
    sizes = sum((F.coalesce(F.size(F.col(f"notes.{n}")), F.lit(0)) for n in NOTE_LISTS), F.lit(0))
    return distilled.agg(F.count("*").alias("distilled"), F.coalesce(F.sum(sizes), F.lit(0)).alias("findings"))

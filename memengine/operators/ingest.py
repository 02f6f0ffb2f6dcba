"""Sessions: identity, change detection by revision, roll-ups, upserts, counters and backfill of old rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def assign_ids(parsed: DataFrame, known: DataFrame, bare: str = "claude") -> DataFrame:
    """parsed with ``session_id``: the known one of (source, external id); else a bare id for source ``bare`` unless taken; else source:external."""
    by_name = known.select("source", "external_session_id", F.col("session_id").alias("_known"))
    taken = known.select(F.col("session_id").alias("external_session_id"), F.lit(True).alias("_taken")).distinct()
    rows = parsed.join(by_name, ["source", "external_session_id"], "left").join(taken, "external_session_id", "left")
    full = F.concat_ws(":", "source", "external_session_id")
    own = F.when((F.col("source") == bare) & F.col("_taken").isNull(), F.col("external_session_id")).otherwise(full)
    return rows.withColumn("session_id", F.coalesce("_known", own)).drop("_known", "_taken")


def changed_sessions(parsed: DataFrame, known: DataFrame, force: bool = False) -> DataFrame:
    """Rows of parsed that are new, or whose revision or parser differs from the known row's, null-safely."""
    if force:
        return parsed
    old = known.select("session_id", F.col("source_revision").alias("_r"), F.col("parser_version").alias("_p"), F.lit(True).alias("_old"))
    same = F.col("source_revision").eqNullSafe(F.col("_r")) & F.col("parser_version").eqNullSafe(F.col("_p"))
    return parsed.join(old, "session_id", "left").filter(F.col("_old").isNull() | ~same).drop("_r", "_p", "_old")


def roll_up(messages: DataFrame, *more: Column) -> DataFrame:
    """(session_id, total_chars, user_msg_count, asst_msg_count), and ``more`` aggregates of a session's messages."""
    return messages.groupBy("session_id").agg(*more, F.sum(F.length("text")).alias("total_chars"), F.count_if(F.col("role") == "user").alias("user_msg_count"), F.count_if(F.col("role") == "assistant").alias("asst_msg_count"))


def upsert(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """old with the rows of new in place of those that share its keys: the next snapshot."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def ingest(parsed: DataFrame, parsed_messages: DataFrame, sessions: DataFrame, messages: DataFrame, force: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sessions, messages, counters) after taking in what changed; a changed session's messages are all replaced.

    parsed and parsed_messages share ``path``. Counters have, for each source, sessions seen, ingested, and messages.
    """
    named = assign_ids(parsed, sessions)
    changed = changed_sessions(named, sessions, force)
    fresh = parsed_messages.join(changed.select("path", "session_id"), "path").drop("path")
    rolled = changed.join(roll_up(fresh), "session_id", "left").fillna(0, ["total_chars", "user_msg_count", "asst_msg_count"])
    kept = messages.join(changed.select("session_id"), "session_id", "left_anti")
    return upsert(sessions, rolled.select(*(c for c in sessions.columns if c in rolled.columns)), "session_id"), kept.unionByName(fresh), counters(named, rolled)


def counters(seen: DataFrame, ingested: DataFrame) -> DataFrame:
    """(source, seen, ingested, messages)."""
    done = ingested.groupBy("source").agg(F.count("*").alias("ingested"), F.sum(F.col("user_msg_count") + F.col("asst_msg_count")).alias("messages"))
    return seen.groupBy("source").agg(F.count("*").alias("seen")).join(done, "source", "left").fillna(0, ["ingested", "messages"])


def backfill_sessions(sessions: DataFrame) -> DataFrame:
    """Old rows with their missing names, revisions and parsers."""
    return sessions.withColumns({
        "external_session_id": F.coalesce("external_session_id", "session_id"),
        "source_revision": F.coalesce("source_revision", F.concat(F.lit("legacy:"), F.format_string("%.6f", "jsonl_mtime"))),
        "parser_version": F.coalesce("parser_version", F.lit("claude-v1")),
    })


def backfill_distilled(distilled: DataFrame, sessions: DataFrame) -> DataFrame:
    """Old distillations with their missing keys, and the revision and parser of their sessions."""
    s = sessions.select("session_id", F.col("source_revision").alias("_r"), F.col("parser_version").alias("_p"))
    rows = distilled.join(s, "session_id", "left")
    return rows.withColumns({
        "distillation_key": F.coalesce("distillation_key", F.concat(F.lit("legacy:"), "session_id")),
        "source_revision": F.coalesce("source_revision", "_r"),
        "parser_version": F.coalesce("parser_version", "_p"),
        "prompt_version": F.coalesce("prompt_version", F.lit("legacy")),
        "provider": F.coalesce("provider", F.when(F.coalesce(F.col("model").startswith("codex:"), F.lit(False)), F.lit("codex")).otherwise(F.lit("claude"))),
    }).drop("_r", "_p")


def seed_ledger(distilled: DataFrame, sessions: DataFrame, ledger: DataFrame, watermark: str) -> DataFrame:
    """The ledger with every distillation that an old watermark (a time) had passed."""
    at = sessions.select("session_id", "ended_at", "started_at")
    passed = distilled.join(at, "session_id").filter(F.coalesce("ended_at", "started_at", "distilled_at") <= watermark)
    rows = passed.select("distillation_key", "session_id", F.lit("legacy-watermark").alias("run_id"))
    return ledger.unionByName(rows.join(ledger, "distillation_key", "left_anti"))


def sessions_needing_distill(sessions: DataFrame, distilled: DataFrame, least_chars: int = 500, project: str | None = None, refresh: tuple[str, str, str] | None = None) -> DataFrame:
    """Sessions without a distillation of their revision and parser, newest first in ``order``.

    ``refresh`` names the (prompt version, provider, model) of now: distillations by others count as missing too.
    """
    blank = lambda c: F.coalesce(c, F.lit(""))
    d = distilled.select("session_id", F.lit(True).alias("_have"), *(F.col(c).alias(f"_{c}") for c in ("source_revision", "parser_version", "prompt_version", "provider", "model")))
    stale = F.col("_have").isNull() | (blank("_source_revision") != blank("source_revision")) | (blank("_parser_version") != blank("parser_version"))
    if refresh:
        for c, now in zip(("_prompt_version", "_provider", "_model"), refresh, strict=True):
            stale = stale | (blank(c) != (now or ""))
    rows = sessions.join(d, "session_id", "left").filter(stale & (F.col("total_chars") >= least_chars))
    rows = rows if project is None else rows.filter(F.col("project_slug") == project)
    return rows.select(*sessions.columns)


def newest(pending: DataFrame, n: int) -> DataFrame:
    return pending.orderBy(F.desc_nulls_last("started_at"), "session_id").limit(n)


def distill_estimate(pending: DataFrame) -> DataFrame:
    """One row: sessions, characters, and about how many tokens they take and give."""
    total = F.coalesce(F.sum("total_chars"), F.lit(0))
    return pending.agg(F.count("*").alias("sessions"), total.alias("total_chars"), F.floor(total / 4).alias("input_tokens"), (F.count("*") * 500).alias("output_tokens"))


def status_counters(sessions: DataFrame, messages: DataFrame, distilled: DataFrame, suggestions: DataFrame) -> DataFrame:
    """One row of totals."""
    s = sessions.agg(F.count("*").alias("sessions"), F.count_distinct("project_slug").alias("projects"))
    m = messages.agg(F.count("*").alias("messages"))
    d = distilled.agg(F.count("*").alias("distilled"), F.max("distilled_at").alias("last_distilled"))
    by = suggestions.agg(*(F.count_if(F.col("status") == x).alias(x) for x in ("pending", "accepted", "rejected")))
    return s.join(m).join(d).join(by)  # one row each

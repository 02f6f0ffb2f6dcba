"""Ranked search over messages, many queries at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memengine.functions.text import query_words, tokens
from memengine.operators.index import Index, match_all, query_units, ranked, snippet


def search_messages(queries: DataFrame, messages: DataFrame, sessions: DataFrame, index: Index, k: int = 20, stemmed: bool = True, role: str | None = None, project: str | None = None) -> DataFrame:
    """The k best messages for each of ``queries(query_id, query_text)``: message and session columns, snippet, score, rank.

    ``messages`` has doc_id beside its columns, as the index has it. A message must have all words. Role and project
    narrow the hits after scoring, before the cut at k, so they change no score.
    """
    home = sessions.select("session_id", "project_slug", "cwd")
    allowed = messages.select("doc_id", "session_id") if role is None else messages.filter(F.col("role") == role).select("doc_id", "session_id")
    homes = home.select("session_id") if project is None else home.filter(F.col("project_slug") == project).select("session_id")
    hits = match_all(query_units(queries, query_words(F.col("query_text")), stemmed), index, allowed.join(homes, "session_id", "left_semi"))
    # ids are ranked; texts join the k best
    best = ranked(hits, k).join(messages, "doc_id").join(home, "session_id")
    terms = tokens(F.array_join(query_words(F.col("query_text")), " "))
    asked = queries.select("query_id", terms.alias("_terms"))
    joined = best.join(asked, "query_id")
    return joined.withColumn("snippet", snippet(F.col("text"), F.col("_terms"))).drop("_terms")


def session_summaries(sessions: DataFrame, distilled: DataFrame) -> DataFrame:
    """Every session with the summary of its distillation, null where there is none."""
    return sessions.join(distilled.select("session_id", "summary", "notes"), "session_id", "left")

"""Agent transcripts in JSON lines as session and message tables; one row of a file is one event."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memengine.functions.text import project_slug

# fixed values: text that tools put in front of what a user wrote
INJECTED = ("# AGENTS.md instructions for", "<environment_context>")
COMMAND_ECHO = ("<command-name>", "<local-command-stdout>")
_BLOCKS = "array<struct<type:string,text:string>>"


def lines(spark: SparkSession, root: str, depth: str | None = None) -> DataFrame:
    """(path, revision, modified, line, row): each JSON line of the *.jsonl files below ``root``, bad UTF-8 replaced.

    ``depth`` is a glob of folders under the root that alone is read (``*`` for one level); without it all levels are.
    Lines that are no JSON are left out. The revision is a digest of the file.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl")
    files = files.load(f"{root}/{depth}/*.jsonl") if depth else files.option("recursiveFileLookup", True).load(root)
    text = F.make_valid_utf8(F.col("content").cast("string"))
    rows = files.select("path", F.sha2("content", 256).alias("revision"), F.col("modificationTime").alias("modified"), F.posexplode(F.split(text, "\n")).alias("line", "row"))
    return rows.filter(F.try_parse_json("row").isNotNull() & F.trim("row").startswith("{"))


def _get(path: str) -> Column:
    return F.get_json_object("row", path)


def _join(blocks: Column, keep) -> Column:
    texts = F.transform(F.filter(blocks, lambda b: b["type"].isin(*keep)), lambda b: F.trim(F.coalesce(b["text"], F.lit(""))))
    return F.filter(texts, lambda t: t != "")


def _numbered(rows: DataFrame) -> DataFrame:
    seq = F.row_number().over(W.partitionBy("path").orderBy("line")).cast("long")
    return rows.select("path", seq.alias("seq"), "role", "timestamp", "text")


def rollout_sessions(spark: SparkSession, root: str, source: str = "codex", parser_version: str = "rollout-v1") -> tuple[DataFrame, DataFrame]:
    """(sessions, messages) of files whose first ``session_meta`` row names the session; sub-agents' files are left out.

    Messages are the user's input blocks, without injected ones, and the assistant's final answers; of rows that repeat a
    payload id the first that shows something counts. Times and folder come from the metadata first.
    """
    rows = lines(spark, root).select("path", "revision", "modified", "line", "row", _get("$.type").alias("type"), F.nullif(_get("$.timestamp"), F.lit("")).alias("timestamp"))
    meta = rows.filter("type = 'session_meta'").groupBy("path").agg(F.min_by("row", "line").alias("row"), F.min_by("timestamp", "line").alias("meta_at"))
    sub = F.coalesce(_get("$.payload.thread_source") == "subagent", F.lit(False)) | _get("$.payload.source.subagent").isNotNull() | F.coalesce(_get("$.payload.source").rlike(r'^\{.*"subagent"'), F.lit(False))
    stem = F.regexp_extract("path", r"([^/]+)\.jsonl$", 1)
    named = meta.filter(~sub).select(
        "path", F.coalesce(F.nullif(_get("$.payload.session_id"), F.lit("")), F.nullif(_get("$.payload.id"), F.lit("")), stem).alias("external_session_id"),
        _get("$.payload.cwd").alias("cwd"), F.coalesce("meta_at", _get("$.payload.timestamp")).alias("meta_at"),
    )
    own = rows.join(named.select("path"), "path", "left_semi")
    shown = own.filter("type = 'response_item'").filter(_get("$.payload.type") == "message").select("path", "line", "timestamp", _get("$.payload.id").alias("item"), _get("$.payload.role").alias("role"), _get("$.payload.phase").alias("phase"), F.from_json(_get("$.payload.content"), _BLOCKS).alias("blocks"))
    asked = F.filter(_join(F.col("blocks"), ["input_text"]), lambda t: ~(t.startswith(INJECTED[0]) | t.startswith(INJECTED[1])))
    said = F.when(F.col("phase") == "final_answer", _join(F.col("blocks"), ["output_text"]))
    parts = F.when(F.col("role") == "user", asked).when(F.col("role") == "assistant", said)
    visible = shown.withColumn("parts", parts).filter(F.size(F.coalesce("parts", F.array().cast("array<string>"))) > 0)
    first = F.row_number().over(W.partitionBy("path", F.coalesce(F.nullif(F.col("item"), F.lit("")), F.concat(F.lit("\0"), F.col("line")))).orderBy("line"))
    once = visible.withColumn("n", first).filter("n = 1").withColumn("text", F.trim(F.array_join("parts", "\n")))
    times = own.groupBy("path", "revision", "modified").agg(F.min_by("timestamp", F.when(F.col("timestamp").isNotNull(), F.col("line"))).alias("first_at"), F.max_by("timestamp", F.when(F.col("timestamp").isNotNull(), F.col("line"))).alias("last_at"))
    sessions = times.join(named, "path").select(
        F.lit(source).alias("source"), "external_session_id", F.col("revision").alias("source_revision"), F.lit(parser_version).alias("parser_version"), project_slug(F.col("cwd"), F.lit(source)).alias("project_slug"),
        "path", "modified", F.coalesce("meta_at", "first_at").alias("started_at"), F.coalesce("last_at", "meta_at").alias("ended_at"), "cwd", F.lit(None).cast("string").alias("git_branch"),
    )
    return sessions, _numbered(once)


def project_sessions(spark: SparkSession, root: str, source: str = "claude", parser_version: str = "project-v1") -> tuple[DataFrame, DataFrame]:
    """(sessions, messages) of ``root/<project>/*.jsonl``; the file's stem names the session.

    User content is a string, unless it echoes a command, or text blocks; assistant content text blocks only. Side chains
    give no message, but their folder, branch and times count.
    """
    rows = lines(spark, root, "*").select(
        "path", "revision", "modified", "line", _get("$.type").alias("role"), F.nullif(_get("$.timestamp"), F.lit("")).alias("timestamp"), F.nullif(_get("$.cwd"), F.lit("")).alias("cwd"), F.nullif(_get("$.gitBranch"), F.lit("")).alias("branch"),
        F.coalesce(_get("$.isSidechain") == "true", F.lit(False)).alias("side"), _get("$.message.content").alias("content"), F.from_json(_get("$.message.content"), _BLOCKS).alias("blocks"),
    )
    listed = F.coalesce(F.col("content").startswith("["), F.lit(False)) & F.col("blocks").isNotNull()
    joined = F.trim(F.array_join(F.filter(F.transform(F.filter("blocks", lambda b: b["type"] == "text"), lambda b: F.coalesce(b["text"], F.lit(""))), lambda t: t != ""), "\n"))
    plain = F.when(~(F.col("content").startswith(COMMAND_ECHO[0]) | F.col("content").startswith(COMMAND_ECHO[1])), F.trim("content"))
    text = F.when(listed, joined).when(F.col("role") == "user", plain)
    said = rows.filter("not side and role IN ('user', 'assistant')").withColumn("text", text).filter("text <> ''")
    early = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("line")))
    seen = rows.groupBy("path", "revision", "modified").agg(early("cwd").alias("cwd"), early("branch").alias("git_branch"), early("timestamp").alias("started_at"), F.max_by("timestamp", F.when(F.col("timestamp").isNotNull(), F.col("line"))).alias("ended_at"))
    folder = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    sessions = seen.select(
        F.lit(source).alias("source"), F.regexp_extract("path", r"([^/]+)\.jsonl$", 1).alias("external_session_id"), F.col("revision").alias("source_revision"), F.lit(parser_version).alias("parser_version"),
        project_slug(F.col("cwd"), folder).alias("project_slug"), "path", "modified", "started_at", "ended_at", "cwd", "git_branch",
    )
    return sessions, _numbered(said)


Source = Callable[[SparkSession, str], tuple[DataFrame, DataFrame]]


def configured(spark: SparkSession, sources: dict[str, tuple[Source, str, bool]], selected: set[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Sessions and messages of all chosen sources; ``sources`` maps a name to (reader, root, enabled).

    A name in ``selected`` is read even where it is not enabled; without ``selected`` the enabled ones are.
    """
    chosen = [read(spark, root) for name, (read, root, enabled) in sources.items() if (name in selected if selected is not None else enabled)]
    if not chosen:
        raise ValueError("no source is chosen")
    sessions, messages = chosen[0]
    for s, m in chosen[1:]:
        sessions, messages = sessions.unionByName(s), messages.unionByName(m)
    return sessions, messages

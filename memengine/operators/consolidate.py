"""Consolidation: which distillations are new, how many fit a batch, what the model's suggestions are bound to, the ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memengine.functions.text import MAX_MEMORY, json_body, preview_slug
from memengine.operators.distill import validate

MOST_SESSIONS, MOST_CHARS, GRACE_DAYS = 200, 200_000, 21
#: Ids of a range that a task numbers.
RANGE = 10_000


# fixed values: what a model answers to a batch
SUGGESTION = {"kind": {"type": "string", "enum": ["new", "update", "remove", "index"]}, "target_path": {"type": "string"}, "body": {"type": "string"}, "rationale": {"type": "string"}, "source_sessions": {"type": "array", "items": {"type": "string"}}}
SUGGESTIONS = {
    "type": "object", "required": ["suggestions"], "additionalProperties": False,
    "properties": {"suggestions": {"type": "array", "items": {"type": "object", "required": [*SUGGESTION], "additionalProperties": False, "properties": SUGGESTION}}},
}


def suggestions_of(completions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(suggestions, rejected): a row for each suggestion of the completions that fit SUGGESTIONS, with n, its place from 0; the
    other completions with their first fault. Columns besides the completion stay; a completion without suggestions has no rows."""
    valid, rejected = validate(completions, SUGGESTIONS)
    listed = F.from_json(json_body(F.col("completion")), "suggestions array<struct<kind:string,target_path:string,body:string,rationale:string,source_sessions:array<string>>>")["suggestions"]
    others = [c for c in completions.columns if c != "completion"]
    return valid.select(*others, F.posexplode(listed).alias("n", "s")).select(*others, "n", "s.*"), rejected


def collect_batch(distilled: DataFrame, sessions: DataFrame, ledger: DataFrame, since: str | None = None, limit: int | None = MOST_SESSIONS) -> DataFrame:
    """(session_id, ts, notes_json, dkey) of distillations that the ledger does not have, oldest activity first."""
    at = sessions.select("session_id", "ended_at", "started_at")
    rows = distilled.join(at, "session_id").select("session_id", F.coalesce("ended_at", "started_at", "distilled_at").alias("ts"), F.when(F.try_parse_json("notes_json").isNotNull(), F.col("notes_json")).otherwise("{}").alias("notes_json"), F.coalesce("distillation_key", F.concat(F.lit("legacy:"), "session_id")).alias("dkey"))
    open_rows = rows.join(ledger.select(F.col("distillation_key").alias("dkey")), "dkey", "left_anti")
    open_rows = open_rows if since is None else open_rows.filter(F.col("ts") > since)
    ordered = open_rows.orderBy("ts", "session_id")
    return (ordered if limit is None else ordered.limit(limit)).select("session_id", "ts", "notes_json", "dkey")


def block(session_id: Column, ts: Column, notes: Column) -> Column:
    return F.concat(F.lit("### session "), session_id.cast("string"), F.lit(" @ "), ts, F.lit("\n```json\n"), notes, F.lit("\n```\n"))


def fit_batch(batch: DataFrame, most: int = MOST_CHARS) -> DataFrame:
    """The rows, oldest first, whose blocks fit ``most`` characters together; the first always; none is cut.

    A block's length is that of its notes as they are stored. The batch has at most a few hundred rows, one window.
    """
    order = W.orderBy("ts", "session_id")
    sized = batch.withColumn("block_chars", F.length(block(F.col("session_id"), F.col("ts"), F.col("notes_json"))))
    run = sized.withColumns({"total_chars": F.sum("block_chars").over(order.rowsBetween(W.unboundedPreceding, 0)), "_n": F.row_number().over(order)})
    return run.filter((F.col("total_chars") <= most) | (F.col("_n") == 1)).drop("_n")


def is_idle(batch: DataFrame, memory: DataFrame) -> bool:
    """Nothing to do: no new distillations and no memory files."""
    return batch.isEmpty() and memory.isEmpty()


def memory_blob(memory: DataFrame, *group: str) -> DataFrame:
    """One text a group (or one in all) of memory files by name, cut at the limit with a note.

    Lengths alone tell which files begin before the limit; only their bodies are gathered.
    """
    gap = 7  # characters between two files
    sized = memory.select(*group, "path", (F.length("path") + F.length("body") + 12 + gap).alias("_size"))
    begins = F.coalesce(F.sum("_size").over(W.partitionBy(*group).orderBy("path").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shown = sized.withColumn("_begins", begins).filter(F.col("_begins") <= MAX_MEMORY + gap).select(*group, "path")
    rows = memory.join(shown, [*group, "path"], "left_semi").groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("path", "body"))).alias("f"))
    blob = F.array_join(F.transform("f", lambda f: F.concat(F.lit("### FILE: "), f["path"], F.lit("\n\n"), f["body"])), "\n\n---\n\n")
    cut = F.when(F.length(blob) > MAX_MEMORY, F.concat(F.substring(blob, 1, MAX_MEMORY), F.lit("\n\n... [TRUNCATED]"))).otherwise(blob)
    return rows.select(*group, cut.alias("memory"))


def drop_fresh_removals(suggestions: DataFrame, memory: DataFrame, now: Column, days: int = GRACE_DAYS) -> DataFrame:
    """Without removals of files that were touched less than ``days`` whole days ago; a file that is not there passes."""
    files = memory.select(F.col("path").alias("target_path"), F.col("modified").alias("_at"))
    age = F.floor((F.unix_seconds(now) - F.unix_seconds("_at")) / 86400)
    held = (F.col("kind") == "remove") & F.col("_at").isNotNull() & (age < days)
    return suggestions.join(files, "target_path", "left").filter(~held).select(*suggestions.columns)


def bind(suggestions: DataFrame, memory: DataFrame) -> DataFrame:
    """With the state of their target: base_sha256 and target_existed (1 or 0)."""
    files = memory.select(F.col("path").alias("target_path"), F.col("sha256").alias("base_sha256"))
    rows = suggestions.join(files, "target_path", "left")
    return rows.withColumn("target_existed", F.col("base_sha256").isNotNull().cast("int"))


def previews(suggestions: DataFrame, day: str, already: int = 0) -> DataFrame:
    """With sug_file, the name of each one's preview: numbers go on after the day's earlier ones, in order of id."""
    ranged = suggestions.withColumn("_range", F.floor(F.col("id") / RANGE))
    before = F.coalesce(F.sum("_rows").over(W.orderBy("_of").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = ranged.groupBy(F.col("_range").alias("_of")).agg(F.count("*").alias("_rows")).select("_of", before.alias("_before"))
    n = F.row_number().over(W.partitionBy("_range").orderBy("id")) + F.col("_before") + already
    name = F.concat(F.lit(f"{day}-"), F.when(n < 1000, F.lpad(n.cast("string"), 3, "0")).otherwise(n.cast("string")), F.lit("-"), "kind", F.lit("-"), preview_slug(F.replace(F.lower("target_path"), F.lit(".md"), F.lit(""))), F.lit(".md"))
    return ranged.join(offsets, F.col("_range").eqNullSafe(F.col("_of"))).withColumn("sug_file", name).select(*suggestions.columns, "sug_file")


def ledger_rows(fitted: DataFrame, run_id: str) -> DataFrame:
    return fitted.select(F.col("dkey").alias("distillation_key"), "session_id", F.lit(run_id).alias("run_id"))


def commit(store, suggestions: DataFrame, fitted: DataFrame, run_id: str, provider: str, model: str | None) -> int:
    """Suggestions, run and ledger become current together, in one commit of the store."""
    spark = store.spark
    state = store.state()
    more = lambda name, rows: store.read(name, state).unionByName(rows, allowMissingColumns=True) if name in state["tables"] else rows
    run = spark.createDataFrame([(run_id, provider, model)], "run_id string, provider string, model string")
    pending = suggestions.withColumns({"status": F.lit("pending"), "consolidation_run_id": F.lit(run_id)})
    return store.commit(suggestions=more("suggestions", pending), consolidation_runs=more("consolidation_runs", run), ledger=more("ledger", ledger_rows(fitted, run_id)))

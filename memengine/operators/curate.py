"""Curation: conflicts, safe targets, review prompts, checked decisions, and applying them in order."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memengine.functions.text import index_target, json_body
from memengine.operators.distill import validate
from memengine.operators.shared import cut, fold_sorted

INDEX_FILE = "MEMORY.md"
MOST_FIELD, MOST_PROMPT = 60_000, 240_000
_LINK = re.compile(r"\]\(([^)]+\.md)\)")


def safe_target(path: Column) -> Column:
    """The path below the root with . and .. resolved; null if it is absolute or leaves the root."""
    start = F.struct(F.array().cast("array<string>").alias("at"), F.lit(True).alias("ok"))

    def step(s: Column, part: Column) -> Column:
        up = F.struct(F.slice(s["at"], 1, F.greatest(F.size(s["at"]) - 1, F.lit(0))).alias("at"), (s["ok"] & (F.size(s["at"]) > 0)).alias("ok"))
        down = F.struct(F.concat(s["at"], F.array(part)).alias("at"), s["ok"].alias("ok"))
        return F.when(part.isin("", "."), s).when(part == "..", up).otherwise(down)

    end = F.aggregate(F.split(path, "/"), start, step)
    return F.when(~path.startswith("/") & end["ok"], F.array_join(end["at"], "/"))


def snapshots(suggestions: DataFrame, memory: DataFrame) -> DataFrame:
    """Suggestions with target, current_body, current_sha256, exists_now and conflict; nothing is read for unsafe targets."""
    files = memory.select(F.col("path").alias("target"), F.col("body").alias("_body"), F.col("sha256").alias("_sha"))
    rows = suggestions.withColumn("target", safe_target(F.col("target_path"))).join(files, "target", "left")
    safe, there = F.col("target").isNotNull(), F.col("_sha").isNotNull()
    base = F.col("base_sha256")
    conflict = F.when(~safe, True).otherwise((base.isNotNull() & ~base.eqNullSafe(F.col("_sha"))) | (base.isNull() & (F.coalesce("target_existed", F.lit(1)) == 0) & there))
    return rows.withColumns({"current_body": F.when(there, F.col("_body")).otherwise(""), "current_sha256": F.col("_sha"), "exists_now": there, "conflict": conflict}).drop("_body", "_sha")


def pending(suggestions: DataFrame, memory: DataFrame) -> DataFrame:
    """Open suggestions with their sessions as an array, and the state of their targets."""
    rows = snapshots(suggestions.filter("status = 'pending'"), memory)
    return rows.withColumn("sessions", F.filter(F.split(F.coalesce("source_sessions", F.lit("")), ","), lambda s: s != ""))


def review_prompts(snapshots: DataFrame, template: str, *group: str) -> DataFrame:
    """(group, prompt, fault): the suggestions of a group as one prompt; a field or prompt that is too long is a fault, never cut."""
    fields = ["id", "kind", "target_path", "body", "rationale", "source_sessions", "current_body", "current_sha256", "base_sha256"]
    long = F.greatest(*(F.coalesce(F.length(F.col(c).cast("string")), F.lit(0)) for c in fields))
    total = sum((F.coalesce(F.length(F.col(c).cast("string")), F.lit(0)) for c in fields), F.lit(0))
    # a prompt is longer than its fields: groups that are too long by those are never gathered
    sizes = snapshots.groupBy(*group).agg(F.max(long).alias("_longest"), F.sum(total).alias("_total"))
    fits = sizes.filter((F.col("_longest") <= MOST_FIELD) & (F.col("_total") <= MOST_PROMPT)).select(*(F.col(g).alias(f"_of_{g}") for g in group))
    same = F.lit(True)
    for g in group:
        same &= F.col(g).eqNullSafe(F.col(f"_of_{g}"))
    gathered = snapshots.join(fits, same, "left_semi").groupBy(*group).agg(F.to_json(F.array_sort(F.collect_list(F.struct(*fields)))).alias("_rows"))
    gathered = gathered.select(*(F.col(g).alias(f"_of_{g}") for g in group), "_rows")
    rows = sizes.join(gathered, same, "left")
    prompt = F.replace(F.lit(template), F.lit("{{suggestions}}"), F.col("_rows"))
    fault = F.when(F.col("_longest") > MOST_FIELD, F.lit("a field is too long")).when((F.col("_total") > MOST_PROMPT) | (F.length(prompt) > MOST_PROMPT), F.lit("the prompt is too long"))
    return rows.select(*group, F.when(fault.isNull(), prompt).alias("prompt"), fault.alias("fault"))


# fixed values: what a model answers to a review
DECISION = {"suggestion_id": {"type": "integer"}, "decision": {"type": "string", "enum": ["accept", "reject", "merge", "defer"]}, "reason": {"type": "string"}, "body": {"type": "string"}}
DECISIONS = {
    "type": "object", "required": ["decisions"], "additionalProperties": False,
    "properties": {"decisions": {"type": "array", "items": {"type": "object", "required": [*DECISION], "additionalProperties": False, "properties": DECISION}}},
}


def decisions_of(completions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(decisions, rejected): a row for each decision of the completions that fit DECISIONS, with n, its place from 0; the other
    completions with their first fault. An id that is no long is null, so that ``check_decisions`` finds it unknown."""
    valid, rejected = validate(completions, DECISIONS)
    listed = F.from_json(json_body(F.col("completion")), "decisions array<struct<suggestion_id:decimal(38,0),decision:string,reason:string,body:string>>")["decisions"]
    others = [c for c in completions.columns if c != "completion"]
    rows = valid.select(*others, F.posexplode(listed).alias("n", "d"))
    return rows.select(*others, "n", F.expr("try_cast(d.suggestion_id as long)").alias("suggestion_id"), "d.decision", "d.reason", "d.body"), rejected


def check_decisions(decisions: DataFrame, expected: DataFrame) -> DataFrame:
    """(id, fault) of every fault: missing, unknown and repeated ids, blank reasons, bodies that only a merge may have."""
    seen = decisions.groupBy(F.col("suggestion_id").alias("id")).agg(
        F.count("*").alias("n"), F.max(F.trim(F.coalesce("reason", F.lit(""))) == "").alias("blank"), F.max((F.col("decision") != "merge") & (F.coalesce("body", F.lit("")) != "")).alias("extra"), F.max(~F.coalesce(F.col("decision").isin("accept", "merge", "reject", "defer"), F.lit(False))).alias("odd"),
    )
    both = expected.select("id", F.lit(True).alias("asked")).distinct().join(seen, "id", "full_outer")
    fault = lambda when, text: F.when(when, F.lit(text))
    faults = F.array(fault(F.col("n").isNull(), "missing"), fault(F.col("asked").isNull(), "unknown"), fault(F.col("n") > 1, "duplicate"), fault(F.col("blank"), "blank reason"), fault(F.col("extra"), "body not allowed"), fault(F.col("odd"), "no such decision"))
    return both.select("id", F.explode(F.array_compact(faults)).alias("fault"))


def merge_index(existing: str, proposed: str) -> str:
    """The index as it is, and the proposed link lines whose file it does not have yet."""
    target = lambda line: m[1] if (m := _LINK.search(line)) else None
    have = {target(line) for line in existing.splitlines()} - {None}
    new = [line for line in proposed.splitlines() if target(line) and target(line) not in have]
    return existing.rstrip("\n") + "\n" + "\n".join(new) + "\n" if new else existing


def merged_indexes(rows: DataFrame, key: str, existing: str, proposed: str) -> DataFrame:
    """(key, merged): ``merge_index`` of each row as joins over lines."""
    lines = lambda c: F.filter(F.transform(F.split(F.coalesce(F.col(c), F.lit("")), "\n"), lambda x, i: F.struct(i.alias("i"), x.alias("line"), index_target(x).alias("file"))), lambda x: x["file"].isNotNull())
    have = F.transform(lines(existing), lambda x: x["file"])
    new = F.filter(lines(proposed), lambda x: ~F.array_contains(have, x["file"]))
    body = F.coalesce(F.col(existing), F.lit(""))
    added = F.concat(F.regexp_replace(body, r"\n+$", ""), F.lit("\n"), F.array_join(F.transform(new, lambda x: x["line"]), "\n"), F.lit("\n"))
    return rows.select(key, F.when(F.size(new) > 0, added).otherwise(body).alias("merged"))


def pruned_index(index: DataFrame, memory: DataFrame) -> DataFrame:
    """(root, body): each index without link lines whose file is missing from the root's ``memory(root, path)``."""
    lines = index.select("root", F.posexplode(F.split("body", "\n", -1)).alias("n", "line")).withColumn("file", index_target(F.col("line")))
    files = memory.select("root", F.col("path").alias("file"), F.lit(True).alias("there"))
    kept = lines.join(files, ["root", "file"], "left").filter("file is null or there")
    return kept.groupBy("root").agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("l")).select("root", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("body"))


def _apply(key: tuple, rows: Iterator[dict]) -> Iterator[tuple]:
    """Fold of one target's decisions in order of id; the last row's state is the target's new one."""
    text = lambda x: x or ""
    said, applied, same, body, there = None, False, None, "", False
    for r in rows:
        if said:
            yield *said, False
        else:
            body, there = text(r["live_body"]), r["live_exists"]
            same = body == text(r["current_body"]) and there == bool(r["exists_now"])
        wanted, reason = r["decision"], None
        if wanted == "reject":
            outcome = "rejected"
        elif wanted == "defer":
            outcome = "deferred"
        elif wanted == "merge" and r["kind"] == "remove":
            outcome, reason = "deferred", "merge of a removal"
        elif r["target"] is None:
            outcome, reason = "rejected", "unsafe target"
        elif r["kind"] == "remove" and r["target"] == INDEX_FILE:
            outcome, reason = "rejected", "protected target"
        elif not same:
            outcome, reason = "deferred", "target changed during curation"
        elif not applied and r["conflict"] and wanted == "accept":
            outcome, reason = "deferred", "initial conflict"
        else:
            proposal = text(r["body"] if wanted == "accept" else r["decision_body"])
            if r["kind"] == "remove":
                body, there = "", False
            else:
                body, there = (merge_index(body, proposal) if r["kind"] == "index" else proposal), True
            outcome, applied = "accepted", True
        said = (r["id"], r["target"], outcome, reason, applied, there, body if there else None)
    if said:
        yield *said, True


def apply_decisions(snapshots: DataFrame, decisions: DataFrame, memory: DataFrame) -> DataFrame:
    """(id, target, outcome, reason, written, exists_after, body_after, last) of each suggestion that has a decision.

    Targets are independent of each other; a target's suggestions are folded in order of id. ``memory`` is the state of
    now, which may differ from the snapshots'. ``written`` says that the target was written by then; the row that is
    ``last`` has the target's new state.
    """
    live = memory.select(F.col("path").alias("target"), F.col("body").alias("live_body"), F.lit(True).alias("live_exists"))
    rows = snapshots.join(decisions.select(F.col("suggestion_id").alias("id"), "decision", F.col("body").alias("decision_body")), "id").join(live, "target", "left")
    rows = rows.withColumns({"live_exists": F.coalesce("live_exists", F.lit(False)), "_group": F.coalesce("target", F.concat(F.lit("\0"), F.col("id").cast("string")))})
    used = rows.select("_group", "id", "kind", "target", "body", "decision", "decision_body", "current_body", "exists_now", "conflict", "live_body", "live_exists")
    return fold_sorted(used, ["_group"], ["id"], _apply, "id long, target string, outcome string, reason string, written boolean, exists_after boolean, body_after string, last boolean")


def constant_decisions(snapshots: DataFrame, decision: str, reason: str = "bulk") -> DataFrame:
    """One decision for all, as bulk acceptance or rejection is."""
    return snapshots.select(F.col("id").alias("suggestion_id"), F.lit(decision).alias("decision"), F.lit(reason).alias("reason"), F.lit("").alias("body"))


def next_memory(memory: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(path, body, sha256) after the outcomes, the index without links to files that are gone."""
    # the fold is read four times: its last states are kept, so that it runs once
    changed = cut(outcomes.filter("last and written").select(F.col("target").alias("path"), "exists_after", F.col("body_after").alias("body")))
    rest = memory.select("path", "body").join(changed.select("path"), "path", "left_anti").unionByName(changed.filter("exists_after").select("path", "body"))
    rooted = rest.withColumn("root", F.lit(0))
    index = pruned_index(rooted.filter(F.col("path") == INDEX_FILE).select("root", "body"), rooted).select(F.lit(INDEX_FILE).alias("path"), "body")
    return rest.filter(F.col("path") != INDEX_FILE).unionByName(index).withColumn("sha256", F.sha2("body", 256))



"""Registered queries over sessions, the document store, distillation, consolidation, curation and streams' batch twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memengine.functions import text as tx
from memengine.operators import consolidate, curate, distill, documents, evaluate, ingest, search
from memengine.operators import index as ix
from memengine.operators.shared import cut
from memengine.plans import recall_queries as rq
from memengine.plans import views as v
from memengine.streaming import chat, lifecycle

TEMPLATE = "Session of {{started_at}} in {{cwd}} ({{project_slug}}):\n{{transcript}}"


def messages_clean(spark, d) -> DataFrame:
    return v.messages(spark, d)


def session_rollup(spark, d) -> DataFrame:
    return v.sessions(spark, d)


def transcripts_rendered(spark, d) -> DataFrame:
    return documents.rendered_sessions(v.messages(spark, d)).select("session_id", F.sha2("transcript", 256).alias("sha256"), F.length("transcript").alias("n_chars"))


def transcript_truncated(spark, d) -> DataFrame:
    return documents.rendered_sessions(v.messages(spark, d)).select("session_id", F.sha2(tx.truncate_middle(F.col("transcript"), 400), 256).alias("sha256"))


def _known(spark, d):
    """An older snapshot: without every fifth session, every third of another revision, without parsers for some."""
    s = v.sessions(spark, d).filter("session_id % 5 <> 1")
    i = F.col("session_id")
    return s.withColumns({"source_revision": F.when(i % 3 == 0, F.lit("r0")).otherwise(F.col("source_revision")), "parser_version": F.when(i % 7 == 0, F.lit(None).cast("string")).otherwise(F.col("parser_version"))})


_KNOWN = """, known AS (SELECT session_id, CASE WHEN session_id % 3 = 0 THEN 'r0' ELSE source_revision END AS source_revision, CASE WHEN session_id % 7 = 0 THEN NULL ELSE parser_version END AS parser_version FROM sessions WHERE session_id % 5 <> 1),
changed AS (SELECT s.* FROM sessions s LEFT JOIN known k ON s.session_id = k.session_id WHERE k.session_id IS NULL OR s.source_revision IS DISTINCT FROM k.source_revision OR s.parser_version IS DISTINCT FROM k.parser_version)"""


def ingest_changes(spark, d) -> DataFrame:
    return ingest.changed_sessions(v.sessions(spark, d), _known(spark, d)).select("session_id", "source_revision", "total_chars")


def session_upsert(spark, d) -> DataFrame:
    new = ingest.changed_sessions(v.sessions(spark, d), _known(spark, d))
    return ingest.upsert(_known(spark, d), new, "session_id").select("session_id", "source_revision", "parser_version")


def source_counters(spark, d) -> DataFrame:
    parsed = v.sessions(spark, d)
    return ingest.counters(parsed, ingest.changed_sessions(parsed, _known(spark, d)))


def session_identity(spark, d) -> DataFrame:
    """Every fourth conversation is known under another id, and every sixth bare name is taken."""
    parsed = v.table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("external_session_id")).distinct()
    n = F.col("external_session_id").cast("long")
    parsed = parsed.withColumn("source", F.when(n % 2 == 0, F.lit("claude")).otherwise(F.lit("codex")))
    known = parsed.filter(n % 4 == 0).withColumn("session_id", F.concat(F.lit("k"), "external_session_id"))
    taken = parsed.filter(n % 6 == 0).select((n + 1).cast("string").alias("external_session_id"), F.lit("other").alias("source"), F.col("external_session_id").alias("session_id"))
    return ingest.assign_ids(parsed, known.select("external_session_id", "source", "session_id").union(taken)).select("source", "external_session_id", "session_id")


def legacy_backfill(spark, d) -> DataFrame:
    s = v.sessions(spark, d)
    i = F.col("session_id")
    old = s.withColumns({"source_revision": F.when(i % 2 == 0, F.col("source_revision")), "parser_version": F.when(i % 3 == 0, F.col("parser_version")), "external_session_id": F.lit(None).cast("string"), "session_id": i.cast("string"), "jsonl_mtime": i / 8})
    return ingest.backfill_sessions(old).select("session_id", "external_session_id", "source_revision", "parser_version")


def backfill_distilled(spark, d) -> DataFrame:
    s = v.sessions(spark, d).withColumn("session_id", F.col("session_id").cast("string"))
    i = F.col("session_id").cast("long")
    old = v.distilled(spark, d).withColumn("session_id", F.col("session_id").cast("string")).withColumns({"source_revision": F.lit(None).cast("string"), "provider": F.lit(None).cast("string"), "model": F.when(i % 2 == 0, F.lit("codex:x")).otherwise(F.lit("y")), "prompt_version": F.lit(None).cast("string")})
    return ingest.backfill_distilled(old, s).select("session_id", "distillation_key", "source_revision", "provider", "prompt_version")


def stable_ids(spark, d) -> DataFrame:
    docs = v.recall_documents(spark, d)
    return docs.select("doc_id", tx.stable_id(F.col("source_kind"), F.col("source_path")).alias("uuid"))


def _stored(spark, d):
    docs = v.recall_documents(spark, d).drop("scrubbed")
    n = F.substring("doc_id", 2, 9).try_cast("long")
    old = docs.filter(n % 10 != 1).withColumn("content_sha256", F.when(n % 10 == 2, F.lit("old")).otherwise(F.col("content_sha256")))
    gone = docs.filter(n % 10 == 3).withColumn("doc_id", F.concat(F.lit("x"), "doc_id"))
    return docs, old.unionByName(gone)


def doc_sync_plan(spark, d) -> DataFrame:
    docs, stored = _stored(spark, d)
    return documents.sync_plan(stored, docs, ["approved_memory", "distilled_summary"])


def doc_sync_report(spark, d) -> DataFrame:
    return documents.sync_report(doc_sync_plan(spark, d))


def doc_sync_applied(spark, d) -> DataFrame:
    docs, stored = _stored(spark, d)
    return documents.apply_sync(stored, docs, doc_sync_plan(spark, d)).select("doc_id", "content_sha256")


def synced_index(spark, d) -> DataFrame:
    """Terms of the index after three collections were synced at once; the index was not sound before."""
    docs, stored = _stored(spark, d)
    kinds = {k: docs.filter(F.col("source_kind") == k) for k in ("approved_memory", "distilled_summary", "raw_transcript")}
    _, _, index = documents.collect_and_sync(stored, kinds, ix.build_index(stored.filter("source_kind = 'raw_transcript'")))
    return index.term_statistics()


def _starts(spark, d):
    """Events of two policies, and what their starts have shown."""
    events = _lifecycle(spark, d).withColumns({"event": F.concat(F.lit("session-start:"), (F.col("n") % 2).cast("string")), "policy": F.concat(F.lit("v"), (F.floor(F.col("n") / 2) % 2 + 1).cast("string"))})
    shown = events.groupBy(F.col("session_id").cast("string").alias("session_id"), "event", "policy").agg(F.transform(F.array_sort(F.collect_set("n")), lambda n: F.concat(F.lit("d"), n)).alias("ids"))
    return lifecycle.replay(events), shown


def start_exclusions(spark, d) -> DataFrame:
    """What later sessions leave out under each policy: ids shown at starts that succeeded, kept in the state of the events."""
    return lifecycle.session_start_exclusions(lifecycle.with_selected(*_starts(spark, d))).select("session_id", "policy", F.array_join("excluded", ",").alias("excluded"))


def query_exclusions(spark, d) -> DataFrame:
    """Queries in the midst of the events: each sees the starts of its session that had succeeded before it."""
    e = v.table(spark, d, "events").filter("event_id % 3 = 0").select(F.col("event_id").alias("query_id"), F.col("user_id").alias("session_id"), F.col("event_id").alias("n"), F.array(F.lit("x")).alias("excluded"))
    answers, shown = _starts(spark, d)
    return lifecycle.exclude_shown(e, answers, shown, "v2", most=3).select("query_id", F.array_join("excluded", ",").alias("excluded"))


def _noted(spark, d):
    """Distillations with notes as models give them: six lists, nested values, an array at the top, none that can be read, none."""
    i, s = F.col("session_id"), F.col("session_id").cast("string")
    lists = F.concat(F.lit('{"summary":"of '), s, F.lit('","user_facts":["likes é, \\"a: b\\"","x"],"preferences":[],"projects":["'), F.lit("p"), s, F.lit('"],"references":["http://a/b?c=1,2"],"decisions":["d"] ,"open_threads":[]}'))
    nested = F.concat(F.lit('{"z":null,"a":[1,2.50,-3e2,{"y":true,"B":{}, "b":[[]]}],"n":'), s, F.lit(',"ü":"\\u00fc\\n"}'))
    notes = F.when(i % 6 == 1, nested).when(i % 6 == 2, F.lit('["b",{"d":1,"c":2},"a"]')).when(i % 6 == 3, F.lit("{oops")).when(i % 6 == 4, F.when(i % 4 == 0, F.lit("{}")).otherwise(F.lit('"text"'))).when(i % 6 == 5, F.lit(None).cast("string")).otherwise(lists)
    return v.distilled(spark, d).withColumn("notes_json", notes)


def distilled_documents(spark, d) -> DataFrame:
    return documents.distilled_documents(_noted(spark, d), v.sessions(spark, d)).select("content_sha256", "source_path", "project_slug", "updated_at", "source_version")


def transcript_documents(spark, d) -> DataFrame:
    return documents.transcript_documents(v.messages(spark, d), v.sessions(spark, d)).select("source_path", "project_slug", "updated_at", F.length("text").alias("n_chars"))


def status_counters(spark, d) -> DataFrame:
    return ingest.status_counters(v.sessions(spark, d), v.messages(spark, d), v.distilled(spark, d), v.suggestions(spark, d))


def distill_pending(spark, d) -> DataFrame:
    return ingest.sessions_needing_distill(v.sessions(spark, d), v.distilled(spark, d), 200).select("session_id", "total_chars", "started_at")


def distill_estimate(spark, d) -> DataFrame:
    return ingest.distill_estimate(ingest.sessions_needing_distill(v.sessions(spark, d), v.distilled(spark, d), 200))


def distill_prompts(spark, d) -> DataFrame:
    rows = distill.prompts(ingest.sessions_needing_distill(v.sessions(spark, d), v.distilled(spark, d), 200), v.messages(spark, d), TEMPLATE)
    return rows.select("session_id", "prompt_chars", F.sha2("prompt", 256).alias("prompt_sha256"))


def _completions(spark, d):
    """Notes of every document; four in five of them broken in one way."""
    docs = v.table(spark, d, "documents").select("doc_id", F.col("text").alias("t"))
    i = F.col("doc_id")
    lists = {n: F.array("t") for n in distill.NOTE_LISTS}
    whole = lambda **more: F.to_json(F.struct(F.concat(F.lit("about "), "t").alias("summary"), *(x.alias(n) for n, x in (lists | more).items())))
    short = F.to_json(F.struct(F.col("t").alias("summary"), *(x.alias(n) for n, x in lists.items() if n != "decisions")))
    odd = F.replace(whole(projects=F.array(F.lit("a"), F.lit("@@"))), F.lit('"@@"'), F.lit("1"))
    said = F.when(i % 5 == 0, whole()).when(i % 5 == 1, short).when(i % 5 == 2, whole(zzz=F.array("t"))).when(i % 5 == 3, odd).otherwise("oops")
    return docs.select(i.alias("session_id"), F.when(i % 10 == 0, F.concat(F.lit("```json\n"), said, F.lit("\n```"))).otherwise(said).alias("completion"))


def completion_validate(spark, d) -> DataFrame:
    valid, rejected = distill.validate(_completions(spark, d))
    return rejected.select("session_id", "fault").unionByName(valid.select("session_id", F.lit("").alias("fault")))


def _quoted(text) -> F.Column:
    """A text as JSON."""
    return F.regexp_extract(F.to_json(F.array(text)), r"(?s)^\[(.*)\]$", 1)


def _suggested(spark, d):
    """Suggestions about every document; four in five completions broken in one way."""
    docs, i = v.table(spark, d, "documents"), F.col("doc_id")
    one = F.format_string('{"kind":"new","target_path":"a%d.md","body":%s,"rationale":"r","source_sessions":["s%d"]}', i, _quoted("text"), i)
    put = lambda old, new: F.replace(one, F.lit(old), F.lit(new))
    items = F.when(i % 10 == 0, F.concat(one, F.lit(', {"source_sessions":[],"rationale":"","body":"é\\n","target_path":"MEMORY.md","kind":"index"}'))).when(i % 10 == 1, F.concat(one, F.lit(',{"kind":"new","target_path":"b","source_sessions":[]}')))
    items = items.when(i % 10 == 2, put('{"kind"', '{"z":1,"b":null,"kind"')).when(i % 10 == 3, put('"kind":"new"', '"kind":"drop"')).when(i % 10 == 4, put('"source_sessions":[', '"source_sessions":["a",3,')).when(i % 10 == 8, put('"rationale":"r"', '"rationale":null')).when(i % 10 == 9, F.lit('"a"'))
    said = F.when(i % 10 == 5, F.lit('{"suggestions":{}}')).when(i % 10 == 6, F.concat(F.lit("["), one, F.lit("]"))).when(i % 10 == 7, F.lit('{"items":[]}')).otherwise(F.concat(F.lit('{"suggestions":['), items, F.lit("]}")))
    return docs.select(i, F.when(i % 20 == 0, F.concat(F.lit("```\n"), said, F.lit("\n```"))).otherwise(said).alias("completion"))


def suggestions_validate(spark, d) -> DataFrame:
    rows, rejected = consolidate.suggestions_of(_suggested(spark, d))
    return rejected.select("doc_id", "fault").unionByName(rows.select("doc_id").distinct().withColumn("fault", F.lit("")))


def suggestions_load(spark, d) -> DataFrame:
    rows, _ = consolidate.suggestions_of(_suggested(spark, d))
    return rows.select("doc_id", "n", "kind", "target_path", F.sha2("body", 256).alias("body_sha256"), "rationale", F.array_join("source_sessions", ",").alias("sessions"))


def _reviewed(spark, d):
    """A decision on every document and the next one; most completions broken in one way."""
    docs, i = v.table(spark, d, "documents"), F.col("doc_id")
    fields = [("suggestion_id", F.when(i % 9 == 1, F.concat(i, F.lit(".0"))).when(i % 9 == 2, F.lit("true")).when(i % 9 == 5, F.lit("123456789012345678901")).otherwise(i.cast("string"))), ("decision", F.when(i % 9 == 3, F.lit('"later"')).otherwise(F.lit('"merge"'))), ("body", _quoted("text"))]
    one = F.concat(F.lit("{"), *(x for name, value in fields for x in (F.lit(f'"{name}": '), value, F.lit(", "))), F.when(i % 9 == 4, F.lit('"why": "x"}')).otherwise(F.lit('"reason": "fine"}')))
    both = F.concat(one, F.lit(',{"reason":"","body":"","decision":"defer","suggestion_id":'), i + 1, F.lit("}"))
    said = F.when(i % 9 == 6, F.lit('{"decisions":[]}')).when(i % 9 == 7, F.lit("null")).otherwise(F.concat(F.lit('{"decisions":['), both, F.lit("]}")))
    return docs.select(i, said.alias("completion"))


def decisions_validate(spark, d) -> DataFrame:
    valid, rejected = distill.validate(_reviewed(spark, d), curate.DECISIONS)
    return rejected.select("doc_id", "fault").unionByName(valid.select("doc_id", F.lit("").alias("fault")))


def decisions_load(spark, d) -> DataFrame:
    rows, _ = curate.decisions_of(_reviewed(spark, d))
    return rows.select("doc_id", "n", "suggestion_id", "decision", "reason", F.sha2("body", 256).alias("body_sha256"))


def _loaded(spark, d):
    valid, _ = distill.validate(_completions(spark, d))
    named = v.table(spark, d, "documents").select(F.col("doc_id").alias("session_id"), F.concat(F.lit("r"), "n_chars").alias("source_revision"), F.lit("p1").alias("parser_version"))
    return distill.load(valid, named, "2024-03-01T00:00:00Z", "v1", "local", None, "{}")


def completion_load(spark, d) -> DataFrame:
    return _loaded(spark, d).select("session_id", "distillation_key", "summary")


def findings(spark, d) -> DataFrame:
    return distill.findings(_loaded(spark, d))


def findings_usage(spark, d) -> DataFrame:
    return distill.usage(_loaded(spark, d))


def _ledger(spark, d):
    return v.distilled(spark, d).filter("session_id % 3 = 0 and distillation_key is not null").select("distillation_key", "session_id", F.lit("run").alias("run_id"))


def consolidate_batch(spark, d) -> DataFrame:
    return consolidate.collect_batch(v.distilled(spark, d), v.sessions(spark, d), _ledger(spark, d), since="2024-01-01T06:00:00Z", limit=60)


def batch_fit(spark, d) -> DataFrame:
    batch = consolidate.collect_batch(v.distilled(spark, d), v.sessions(spark, d), _ledger(spark, d))
    return consolidate.fit_batch(batch, 3000).select("session_id", "block_chars", "total_chars")


def ledger_seed(spark, d) -> DataFrame:
    keyed = v.distilled(spark, d).filter("distillation_key is not null")
    return ingest.seed_ledger(keyed, v.sessions(spark, d), _ledger(spark, d), "2024-01-02T12:00:00Z")


def memory_blob(spark, d) -> DataFrame:
    m = v.memory(spark, d).withColumn("root", F.floor(F.regexp_extract("path", "[0-9]+", 0).cast("long") / 500))
    return consolidate.memory_blob(m, "root").select("root", F.sha2("memory", 256).alias("sha256"))


def removal_gate(spark, d) -> DataFrame:
    now = F.timestamp_seconds(F.lit(1706745600))
    return consolidate.drop_fresh_removals(v.suggestions(spark, d), v.memory(spark, d), now).select("id", "kind", "target_path")


def suggestion_binding(spark, d) -> DataFrame:
    return consolidate.bind(v.suggestions(spark, d).drop("base_sha256", "target_existed"), v.memory(spark, d)).select("id", "base_sha256", "target_existed")


def suggestion_previews(spark, d) -> DataFrame:
    return consolidate.previews(v.suggestions(spark, d), "2024-02-01", 3).select("id", "sug_file")


def suggestion_conflicts(spark, d) -> DataFrame:
    return curate.pending(v.suggestions(spark, d), v.memory(spark, d)).select("id", "target", "current_sha256", "conflict", F.size("sessions").alias("n_sessions"))


def _decisions(spark, d):
    """Four in five suggestions get decisions of all kinds; some come twice, some are unknown, blank or have bodies."""
    i = F.col("doc_id")
    docs = v.table(spark, d, "documents").filter("doc_id % 10 <> 8 or doc_id % 101 = 1")
    made = docs.select(i.alias("suggestion_id"), F.element_at(F.array(*map(F.lit, ("accept", "merge", "reject", "defer", "accept"))), (i % 5 + 1).cast("int")).alias("decision"), F.when(i % 33 == 0, F.lit(" ")).otherwise(F.lit("fine")).alias("reason"), F.when((i % 5 == 1) | (i % 44 == 0), F.lit("merged body")).otherwise(F.lit("")).alias("body"))
    return made.filter("suggestion_id % 14 <> 0"), made.filter("suggestion_id % 70 = 6")


def decision_check(spark, d) -> DataFrame:
    made, again = _decisions(spark, d)
    return curate.check_decisions(made.union(again), v.suggestions(spark, d).filter("status = 'pending'"))


def curate_apply(spark, d) -> DataFrame:
    made, _ = _decisions(spark, d)
    snaps = curate.snapshots(v.suggestions(spark, d).filter("status = 'pending'"), v.memory(spark, d))
    return curate.apply_decisions(snaps, made, v.memory(spark, d)).select("id", "target", "outcome", "reason", "exists_after")


def curate_next_memory(spark, d) -> DataFrame:
    made, _ = _decisions(spark, d)
    snaps = curate.snapshots(v.suggestions(spark, d).filter("status = 'pending'"), v.memory(spark, d))
    return curate.next_memory(v.memory(spark, d), curate.apply_decisions(snaps, made, v.memory(spark, d)))


def review_prompts(spark, d) -> DataFrame:
    snaps = curate.snapshots(v.suggestions(spark, d), v.memory(spark, d)).withColumn("batch", F.floor(F.col("id") / 20))
    return curate.review_prompts(snaps, "Review:\n{{suggestions}}", "batch").select("batch", F.length("prompt").alias("prompt_chars"), "fault")


def _indexes(spark, d):
    """An index for a thousand ids of a source: lines of three in five documents, and what the others propose."""
    docs = v.table(spark, d, "documents").withColumn("source", F.concat_ws("/", "source", F.floor(F.col("doc_id") / 1000).cast("string")))
    line = lambda: F.concat(F.lit("- [t](m"), F.floor(F.col("doc_id") / 50).cast("string"), F.lit(".md) hook"))
    text = lambda rows, name: rows.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", line().alias("l")))), lambda x: x["l"]), "\n").alias(name))
    return text(docs.filter("doc_id % 5 < 3"), "existing").join(text(docs.filter("doc_id % 5 >= 3"), "proposed"), "source", "left")


_INDEXES = """
lines AS (SELECT source || '/' || CAST(doc_id // 1000 AS VARCHAR) AS source, doc_id, 'm' || CAST(doc_id // 50 AS VARCHAR) || '.md' AS file, doc_id % 5 < 3 AS old FROM documents),
idx AS (SELECT source, string_agg('- [t](' || file || ') hook', chr(10) ORDER BY doc_id) AS existing FROM lines WHERE old GROUP BY 1),
added AS (SELECT source, string_agg('- [t](' || file || ') hook', chr(10) ORDER BY doc_id) AS l FROM lines n WHERE NOT old AND NOT EXISTS (FROM lines o WHERE o.old AND o.source = n.source AND o.file = n.file) GROUP BY 1)"""


def index_merge(spark, d) -> DataFrame:
    return curate.merged_indexes(_indexes(spark, d), "source", "existing", "proposed").select("source", F.sha2("merged", 256).alias("sha256"))


def index_prune(spark, d) -> DataFrame:
    index = _indexes(spark, d).select(F.col("source").alias("root"), F.concat(F.lit("# Index\n"), "existing").alias("body"))
    docs = v.table(spark, d, "documents").filter("doc_id % 3 = 0")  # the files that are there
    files = docs.select(F.concat_ws("/", "source", F.floor(F.col("doc_id") / 1000).cast("string")).alias("root"), F.concat(F.lit("m"), F.floor(F.col("doc_id") / 50).cast("string"), F.lit(".md")).alias("path")).distinct()
    return curate.pruned_index(index, files).select("root", F.sha2("body", 256).alias("sha256"))


def eval_metrics(spark, d) -> DataFrame:
    docs, queries, index = rq._inputs(spark, d)
    found = rq.recall.rank_lexical(queries, docs, index)
    chosen = rq.select.select_candidates(found, queries, unique_sources=True).select("query_id", "doc_id", "slot", "content_sha256").persist()
    forbidden = queries.select("query_id", F.concat(F.lit("d"), F.lpad((F.col("query_id") * 20).cast("string"), 9, "0")).alias("doc_id"))
    return evaluate.metrics(chosen, v.judgements(spark, d, index).persist(), queries, forbidden)


def _sweep(spark, d) -> DataFrame:
    docs, queries, index = rq._inputs(spark, d)
    chosen = rq.select.select_candidates(rq.recall.rank_lexical(queries, docs, index), queries, unique_sources=True)
    turn = F.row_number().over(W.partitionBy("query_id", "source_kind", "project_slug").orderBy("position"))
    kept = chosen.select("query_id", "doc_id", "score", turn.alias("turn"), "source_kind", "project_slug").persist()
    return evaluate.threshold_sweep(kept, v.judgements(spark, d, index).persist())


def threshold_sweep(spark, d) -> DataFrame:
    return _sweep(spark, d).select("threshold", "mrr", "hit_3")


def calibrate(spark, d) -> DataFrame:
    return evaluate.calibrate(_sweep(spark, d), "held/out.json", "f" * 64).select("mode", "calibration_version", "threshold")


def message_search(spark, d) -> DataFrame:
    """First three words of every twentieth message, searched in all messages by stems."""
    m = cut(v.messages(spark, d)).withColumn("doc_id", F.concat_ws(":", "session_id", "seq"))  # read by seven stages, numbered once
    asked = m.filter("(session_id * 31 + seq) % 20 = 0").select(F.col("doc_id").alias("query_id"), F.array_join(F.slice(F.split("text", r"\s+"), 1, 3), " ").alias("query_text"))
    found = search.search_messages(asked, m, v.sessions(spark, d, m), ix.build_index(m, stemmed=True), k=5)
    return found.select("query_id", "rank", "doc_id", "role", "project_slug", "score", "snippet")


def session_summaries(spark, d) -> DataFrame:
    made = v.distilled(spark, d).withColumn("notes", F.col("notes_json"))
    return search.session_summaries(v.sessions(spark, d), made).select("session_id", "summary")


def chat_bundles(spark, d) -> DataFrame:
    c = v.table(spark, d, "conversations")
    rows = c.select(F.floor(F.col("conv_id") / 4).cast("string").alias("chat"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "role", "text", v.stamp(F.col("conv_id") * 60 + F.col("turn")).alias("ts"))
    return chat.bundle_chats(rows)


def _lifecycle(spark, d):
    e = v.table(spark, d, "events")
    action = F.when(F.col("event_type") == "error", "fail").when(F.col("event_type") == "purchase", "succeed").otherwise("claim")
    return e.select(F.col("user_id").alias("session_id"), F.lit("prompt").alias("event"), F.lit("v1").alias("policy"), F.col("event_id").alias("n"), action.alias("action"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), F.lit(None).cast("double").alias("token"))


def event_lifecycle(spark, d) -> DataFrame:
    return lifecycle.replay(_lifecycle(spark, d))


def latency_stats(spark, d) -> DataFrame:
    """Mean, median and 95th percentile of the events' values."""
    row = evaluate.latency(v.table(spark, d, "events").select(F.col("value").alias("ms")))
    return row.select(F.round("mean", 6).alias("mean"), "p50", "p95")


QUERIES = {f.__name__: f for f in (
    messages_clean, session_rollup, transcripts_rendered, transcript_truncated, ingest_changes, session_upsert, source_counters, session_identity, legacy_backfill, backfill_distilled, stable_ids, doc_sync_plan, doc_sync_report,
    doc_sync_applied, synced_index, start_exclusions, query_exclusions, distilled_documents, transcript_documents, status_counters, distill_pending, distill_estimate, distill_prompts, completion_validate, completion_load, suggestions_validate, suggestions_load, decisions_validate, decisions_load, findings, findings_usage, consolidate_batch, batch_fit, ledger_seed,
    memory_blob, removal_gate, suggestion_binding, suggestion_previews, suggestion_conflicts, decision_check, curate_apply, curate_next_memory, review_prompts, index_merge, index_prune, eval_metrics, threshold_sweep, calibrate,
    message_search, session_summaries, chat_bundles, event_lifecycle, latency_stats,
)}

_S, _D, _G = "WITH " + v.SESSIONS, "WITH " + v.DISTILLED, "WITH " + v.MEMORY + "," + v.SUGGESTIONS
_RENDERED = ", rendered AS (SELECT session_id, string_agg('--- ' || CASE WHEN role = 'user' THEN 'USER' ELSE 'ASSISTANT' END || ' [' || timestamp || '] ---' || chr(10) || text || chr(10), chr(10) ORDER BY seq) AS t FROM messages GROUP BY 1)"
_CUT = "CASE WHEN length(t) <= {0} THEN t ELSE left(t, {1}) || chr(10) || chr(10) || '... [TRUNCATED ' || CAST(length(t) - {0} AS VARCHAR) || ' chars in middle] ...' || chr(10) || chr(10) || right(t, {2}) END"
_PENDING = ", pending AS (SELECT s.* FROM sessions s LEFT JOIN distilled d ON s.session_id = d.session_id WHERE (d.session_id IS NULL OR d.source_revision <> s.source_revision) AND s.total_chars >= 200)"
_PLAN = "WITH " + v.DOCS + """, stored AS (
  SELECT doc_id, source_kind, CASE WHEN CAST(doc_id[2:] AS BIGINT) % 10 = 2 THEN 'old' ELSE content_sha256 END AS h FROM docs WHERE CAST(doc_id[2:] AS BIGINT) % 10 <> 1
  UNION ALL SELECT 'x' || doc_id, source_kind, content_sha256 FROM docs WHERE CAST(doc_id[2:] AS BIGINT) % 10 = 3),
plan AS (SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, coalesce(n.source_kind, o.source_kind) AS source_kind,
  CASE WHEN o.doc_id IS NULL THEN 'insert' WHEN n.doc_id IS NULL THEN CASE WHEN o.source_kind <> 'raw_transcript' THEN 'delete' ELSE 'keep' END WHEN o.h = n.content_sha256 THEN 'skip' ELSE 'update' END AS action
  FROM stored o FULL JOIN docs n ON o.doc_id = n.doc_id)"""
_LEDGER = ", ledger AS (SELECT distillation_key, session_id, 'run' AS run_id FROM distilled WHERE session_id % 3 = 0 AND distillation_key IS NOT NULL)"
_BATCH = _D + _LEDGER + """, batch AS (SELECT d.session_id, coalesce(s.ended_at, s.started_at, d.distilled_at) AS ts, notes_json, coalesce(distillation_key, 'legacy:' || CAST(d.session_id AS VARCHAR)) AS dkey
  FROM distilled d JOIN sessions s ON d.session_id = s.session_id WHERE NOT EXISTS (FROM ledger l WHERE l.distillation_key = coalesce(d.distillation_key, 'legacy:' || CAST(d.session_id AS VARCHAR))))"""
_FAULT = """CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN '$: missing required keys: decisions' WHEN 2 THEN '$: unexpected keys: zzz' WHEN 3 THEN '$.projects[1]: expected string' ELSE '$: no JSON' END"""
_FAULT_S = """(['', '$.suggestions[1]: missing required keys: body, rationale', '$.suggestions[0]: unexpected keys: b, z', '$.suggestions[0].kind: value ''drop'' is not in enum', '$.suggestions[0].source_sessions[1]: expected string', '$.suggestions: expected array',
  '$: expected object', '$: missing required keys: suggestions', '$.suggestions[0].rationale: expected string', '$.suggestions[0]: expected object'])[doc_id % 10 + 1]"""
_SNAP = _G + """, snap AS (SELECT s.*, m.body AS cur, m.sha256 AS cur_sha, m.path IS NOT NULL AS there,
  CASE WHEN s.target IS NULL THEN true ELSE (s.base_sha256 IS NOT NULL AND s.base_sha256 IS DISTINCT FROM m.sha256) OR (s.base_sha256 IS NULL AND s.target_existed = 0 AND m.path IS NOT NULL) END AS conflict
  FROM sugg s LEFT JOIN memory m ON m.path = s.target WHERE status = 'pending')"""
_DECIDED = """, dec0 AS (SELECT doc_id AS sid, (['accept', 'merge', 'reject', 'defer', 'accept'])[doc_id % 5 + 1] AS decision, CASE WHEN doc_id % 33 = 0 THEN ' ' ELSE 'fine' END AS reason, CASE WHEN doc_id % 5 = 1 OR doc_id % 44 = 0 THEN 'merged body' ELSE '' END AS body
  FROM documents WHERE doc_id % 10 <> 8 OR doc_id % 101 = 1), made AS (SELECT * FROM dec0 WHERE sid % 14 <> 0)"""
_JUDGED = rq._JUDGED
_EVAL = rq._ALL + _JUDGED + """, rel AS (SELECT DISTINCT query_id FROM judged), best AS (SELECT r.query_id, min(slot) AS best FROM rel r LEFT JOIN (SELECT query_id, slot FROM chosen JOIN judged USING (query_id, doc_id)) c ON r.query_id = c.query_id GROUP BY 1)"""
_SWEEP = rq._ALL + _JUDGED + """, marks AS (SELECT t.*, j.doc_id IS NOT NULL AS good FROM turns t LEFT JOIN judged j ON t.query_id = j.query_id AND t.doc_id = j.doc_id),
rel AS (SELECT DISTINCT query_id FROM judged), thresholds AS (SELECT 0.0::DOUBLE AS g UNION SELECT score FROM turns),
own AS (SELECT m.* FROM marks m JOIN rel USING (query_id)),
steps AS (SELECT DISTINCT query_id, score AS t FROM own),
slots AS (SELECT query_id, t, min(slot) FILTER (good) AS best FROM (SELECT s.query_id, s.t, good, row_number() OVER (PARTITION BY s.query_id, s.t ORDER BY turn, source_kind, project_slug) AS slot FROM steps s JOIN own o ON o.query_id = s.query_id AND o.score >= s.t) GROUP BY 1, 2),
places AS (SELECT g, r.query_id, (SELECT min(t) FROM steps s WHERE s.query_id = r.query_id AND s.t >= g) AS t FROM thresholds, rel r),
sweep AS (SELECT g AS threshold, round(avg(coalesce(1 / best, 0)), 9) AS mrr, round(avg(CASE WHEN best <= 3 THEN 1 ELSE 0 END), 9) AS hit_3 FROM places LEFT JOIN slots ON slots.query_id = places.query_id AND slots.t = places.t GROUP BY 1)"""

_EVENTS = """WITH RECURSIVE r AS (
        SELECT CAST(user_id AS VARCHAR) AS session_id, event_id % 4 AS part, event_id AS n, CASE event_type WHEN 'error' THEN 'fail' WHEN 'purchase' THEN 'succeed' ELSE 'claim' END AS action, epoch_us(ts) / 1e6 AS tm, row_number() OVER (PARTITION BY user_id, event_id % 4 ORDER BY event_id) AS k FROM events),
      f AS (
        SELECT session_id, part, n, k, CASE WHEN action = 'claim' THEN 'running' ELSE 'none' END AS status, CASE WHEN action = 'claim' THEN 1 ELSE 0 END AS attempts, tm AS started FROM r WHERE k = 1
        UNION ALL
        SELECT session_id, part, n, k, CASE WHEN NOT ok THEN status WHEN action = 'claim' THEN 'running' WHEN action = 'succeed' THEN 'succeeded' ELSE 'failed' END, CASE WHEN ok AND action = 'claim' THEN attempts + 1 ELSE attempts END, CASE WHEN ok AND action = 'claim' THEN tm ELSE started END
        FROM (SELECT r.session_id, r.part, r.n, r.action, r.k, r.tm, f.status, f.attempts, f.started, CASE WHEN r.action = 'claim' THEN f.status = 'none' OR (f.status = 'running' AND r.tm - f.started >= 10) OR (f.status = 'failed' AND f.attempts < 2) ELSE f.status = 'running' END AS ok FROM f JOIN r ON r.session_id = f.session_id AND r.part = f.part AND r.k = f.k + 1)),
      ended AS (SELECT session_id, part FROM f GROUP BY 1, 2 HAVING arg_max(status, n) = 'succeeded'),
      ids AS (SELECT r.session_id, 'v' || CAST(part // 2 + 1 AS VARCHAR) AS policy, 'd' || CAST(n AS VARCHAR) AS id FROM r JOIN ended USING (session_id, part) WHERE k <= 256)"""

ORACLE = {
    "latency_stats": "SELECT round(avg(value), 6) AS mean, median(value) AS p50, (list(value ORDER BY value))[greatest(1, CAST(floor(count(value) * 0.95) AS INTEGER))] AS p95 FROM events WHERE value IS NOT NULL",
    "messages_clean": "WITH " + v.MESSAGES + " SELECT * FROM messages",
    "session_rollup": _S + " SELECT * FROM sessions",
    "transcripts_rendered": "WITH " + v.MESSAGES + _RENDERED + " SELECT session_id, sha256(t) AS sha256, CAST(length(t) AS INTEGER) AS n_chars FROM rendered",
    "transcript_truncated": "WITH " + v.MESSAGES + _RENDERED + f" SELECT session_id, sha256({_CUT.format(400, 240, 160)}) AS sha256 FROM rendered",
    "ingest_changes": _S + _KNOWN + " SELECT session_id, source_revision, total_chars FROM changed",
    "session_upsert": _S + _KNOWN + " SELECT session_id, source_revision, parser_version FROM changed UNION ALL SELECT session_id, source_revision, parser_version FROM known WHERE session_id NOT IN (SELECT session_id FROM changed)",
    "source_counters": _S + _KNOWN + " SELECT 'chat' AS source, (SELECT count(*) FROM sessions) AS seen, count(*) AS ingested, CAST(sum(user_msg_count + asst_msg_count) AS BIGINT) AS messages FROM changed",
    "session_identity": """WITH p AS (SELECT DISTINCT conv_id AS n, CASE WHEN conv_id % 2 = 0 THEN 'claude' ELSE 'codex' END AS source FROM conversations), taken AS (SELECT CAST(n AS VARCHAR) AS id FROM p WHERE n % 6 = 0 UNION SELECT 'k' || CAST(n AS VARCHAR) FROM p WHERE n % 4 = 0)
      SELECT source, CAST(n AS VARCHAR) AS external_session_id, CASE WHEN n % 4 = 0 THEN 'k' || CAST(n AS VARCHAR) WHEN source = 'claude' AND CAST(n AS VARCHAR) NOT IN (SELECT id FROM taken) THEN CAST(n AS VARCHAR) ELSE source || ':' || CAST(n AS VARCHAR) END AS session_id FROM p""",
    "legacy_backfill": _S + " SELECT CAST(session_id AS VARCHAR) AS session_id, CAST(session_id AS VARCHAR) AS external_session_id, CASE WHEN session_id % 2 = 0 THEN source_revision ELSE 'legacy:' || printf('%.6f', session_id / 8) END AS source_revision, CASE WHEN session_id % 3 = 0 THEN parser_version ELSE 'claude-v1' END AS parser_version FROM sessions",
    "backfill_distilled": _D + " SELECT CAST(d.session_id AS VARCHAR) AS session_id, coalesce(distillation_key, 'legacy:' || CAST(d.session_id AS VARCHAR)) AS distillation_key, s.source_revision, CASE WHEN d.session_id % 2 = 0 THEN 'codex' ELSE 'claude' END AS provider, 'legacy' AS prompt_version FROM distilled d JOIN sessions s ON d.session_id = s.session_id",
    "stable_ids": "WITH " + v.DOCS + ", h AS (SELECT doc_id, sha1(unhex('e3f94d3f97695acb9cab5a29f8d2cae6') || encode(source_kind || ':' || source_path)) AS h FROM docs) SELECT doc_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || ('89ab')[(strpos('0123456789abcdef', h[17]) - 1) % 4 + 1] || h[18:20] || '-' || h[21:32] AS uuid FROM h",
    "doc_sync_plan": _PLAN + " SELECT * FROM plan WHERE action <> 'keep'",
    "doc_sync_report": _PLAN + " SELECT count(*) FILTER (action NOT IN ('delete', 'keep')) AS scanned, count(*) FILTER (action = 'insert') AS inserted, count(*) FILTER (action = 'update') AS updated, count(*) FILTER (action = 'delete') AS deleted, count(*) FILTER (action = 'skip') AS skipped, count(*) FILTER (action NOT IN ('delete', 'keep') AND source_kind = 'raw_transcript') AS raw FROM plan",
    "doc_sync_applied": _PLAN + " SELECT doc_id, content_sha256 FROM docs UNION ALL SELECT 'x' || doc_id, content_sha256 FROM docs WHERE CAST(doc_id[2:] AS BIGINT) % 10 = 3 AND source_kind = 'raw_transcript'",
    "start_exclusions": _EVENTS + " SELECT session_id, policy, string_agg(id, ',' ORDER BY id) AS excluded FROM ids GROUP BY 1, 2",
    "query_exclusions": _EVENTS + """, q AS (SELECT event_id AS query_id, CAST(user_id AS VARCHAR) AS session_id FROM events WHERE event_id % 3 = 0),
      seen AS (SELECT query_id, f.session_id, part FROM q JOIN f ON f.session_id = q.session_id AND f.n < query_id AND part >= 2 GROUP BY ALL HAVING arg_max(status, n) = 'succeeded'),
      shown AS (SELECT DISTINCT query_id, 'd' || CAST(n AS VARCHAR) AS id FROM seen JOIN r USING (session_id, part) WHERE k <= 3)
      SELECT query_id, 'x' || coalesce(',' || string_agg(id, ',' ORDER BY id), '') AS excluded FROM q LEFT JOIN shown USING (query_id) GROUP BY 1""",
    "synced_index": "WITH " + v.DOCS + r""", t AS (SELECT doc_id, unnest(regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}]+')) AS term FROM docs)
      SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM t GROUP BY 1""",
    "distilled_documents": _D + """, n AS (SELECT *, CAST(session_id AS VARCHAR) AS s, session_id % 6 AS m FROM distilled),
      t AS (SELECT n.*, project_slug, coalesce(distillation_key, 'legacy:' || s) AS k, CASE m
        WHEN 0 THEN '{"decisions": ["d"], "open_threads": [], "preferences": [], "projects": ["p' || s || '"], "references": ["http://a/b?c=1,2"], "summary": "of ' || s || '", "user_facts": ["likes é, \\"a: b\\"", "x"]}'
        WHEN 1 THEN '{"a": [1, 2.5, -300.0, {"B": {}, "b": [[]], "y": true}], "n": ' || s || ', "z": null, "ü": "ü\\n"}' WHEN 2 THEN '["b", {"c": 2, "d": 1}, "a"]' ELSE summary END AS text FROM n JOIN (SELECT session_id, project_slug FROM sessions) USING (session_id))
      SELECT sha256(text) AS content_sha256, 'distilled:' || k AS source_path, project_slug, strftime(TIMESTAMP '2024-01-01' + to_minutes(session_id * 60 + 5000), '%Y-%m-%dT%H:%M:%S') || CASE WHEN session_id % 3 = 0 THEN '.125000Z' ELSE 'Z' END AS updated_at, k AS source_version FROM t""",
    "transcript_documents": _S + _RENDERED + " SELECT 'transcript:chat:' || CAST(s.session_id AS VARCHAR) AS source_path, project_slug, started_at AS updated_at, CAST(length(rtrim(t, chr(10))) AS INTEGER) AS n_chars FROM rendered r JOIN sessions s ON r.session_id = s.session_id",
    "status_counters": "WITH " + v.DISTILLED[1:] + "," + v.SUGGESTIONS + """ SELECT (SELECT count(*) FROM sessions) AS sessions, (SELECT count(DISTINCT project_slug) FROM sessions) AS projects, (SELECT count(*) FROM messages) AS messages, (SELECT count(*) FROM distilled) AS distilled, (SELECT max(distilled_at) FROM distilled) AS last_distilled,
      count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'accepted') AS accepted, count(*) FILTER (status = 'rejected') AS rejected FROM sugg""",
    "distill_pending": _D + _PENDING + " SELECT session_id, total_chars, started_at FROM pending",
    "distill_estimate": _D + _PENDING + " SELECT count(*) AS sessions, CAST(sum(total_chars) AS BIGINT) AS total_chars, CAST(floor(sum(total_chars) / 4) AS BIGINT) AS input_tokens, count(*) * 500 AS output_tokens FROM pending",
    "distill_prompts": _D + _PENDING + _RENDERED + f", p AS (SELECT r.session_id, 'Session of ' || started_at || ' in ' || cwd || ' (' || project_slug || '):' || chr(10) || {_CUT.format(150000, 90000, 60000)} AS prompt FROM rendered r JOIN pending USING (session_id)) SELECT session_id, CAST(length(prompt) AS INTEGER) AS prompt_chars, sha256(prompt) AS prompt_sha256 FROM p",
    "completion_validate": f"SELECT doc_id AS session_id, {_FAULT} AS fault FROM documents",
    "suggestions_validate": f"SELECT doc_id, {_FAULT_S} AS fault FROM documents",
    "suggestions_load": """SELECT doc_id, CAST(0 AS INTEGER) AS n, 'new' AS kind, 'a' || CAST(doc_id AS VARCHAR) || '.md' AS target_path, sha256(text) AS body_sha256, 'r' AS rationale, 's' || CAST(doc_id AS VARCHAR) AS sessions FROM documents WHERE doc_id % 10 = 0
      UNION ALL SELECT doc_id, CAST(1 AS INTEGER), 'index', 'MEMORY.md', sha256('é' || chr(10)), '', '' FROM documents WHERE doc_id % 10 = 0""",
    "decisions_validate": """SELECT doc_id, CASE WHEN doc_id % 9 IN (1, 2) THEN '$.decisions[0].suggestion_id: expected integer' WHEN doc_id % 9 = 3 THEN '$.decisions[0].decision: value ''later'' is not in enum'
      WHEN doc_id % 9 = 4 THEN '$.decisions[0]: missing required keys: reason' WHEN doc_id % 9 = 7 THEN '$: expected object' ELSE '' END AS fault FROM documents""",
    "decisions_load": """SELECT doc_id, CAST(0 AS INTEGER) AS n, CASE WHEN doc_id % 9 <> 5 THEN doc_id END AS suggestion_id, 'merge' AS decision, 'fine' AS reason, sha256(text) AS body_sha256 FROM documents WHERE doc_id % 9 IN (0, 5, 8)
      UNION ALL SELECT doc_id, CAST(1 AS INTEGER), doc_id + 1, 'defer', '', sha256('') FROM documents WHERE doc_id % 9 IN (0, 5, 8)""",
    "completion_load": "SELECT doc_id AS session_id, sha256(concat_ws(chr(0), CAST(doc_id AS VARCHAR), 'r' || CAST(n_chars AS VARCHAR), 'p1', 'v1', 'local', '', '{}')) AS distillation_key, left('about ' || text, 500) AS summary FROM documents WHERE doc_id % 5 = 0",
    "findings": "SELECT doc_id AS session_id, unnest(['user_facts', 'preferences', 'projects', 'references', 'decisions', 'open_threads']) AS bucket, CAST(0 AS INTEGER) AS n, text FROM documents WHERE doc_id % 5 = 0",
    "findings_usage": "SELECT count(*) AS distilled, count(*) * 6 AS findings FROM documents WHERE doc_id % 5 = 0",
    "consolidate_batch": _BATCH + " SELECT * FROM batch WHERE ts > '2024-01-01T06:00:00Z' ORDER BY ts, session_id LIMIT 60",
    "batch_fit": _BATCH + """, b AS (SELECT * FROM batch ORDER BY ts, session_id LIMIT 200), s AS (SELECT session_id, ts, CAST(length('### session ' || CAST(session_id AS VARCHAR) || ' @ ' || ts || chr(10) || '```json' || chr(10) || notes_json || chr(10) || '```' || chr(10)) AS INTEGER) AS block_chars FROM b),
      r AS (SELECT *, CAST(sum(block_chars) OVER (ORDER BY ts, session_id) AS BIGINT) AS total_chars, row_number() OVER (ORDER BY ts, session_id) AS n FROM s) SELECT session_id, block_chars, total_chars FROM r WHERE total_chars <= 3000 OR n = 1""",
    "ledger_seed": _D + _LEDGER + " SELECT * FROM ledger UNION ALL SELECT distillation_key, d.session_id, 'legacy-watermark' FROM distilled d JOIN sessions s ON d.session_id = s.session_id WHERE distillation_key IS NOT NULL AND coalesce(s.ended_at, s.started_at) <= '2024-01-02T12:00:00Z' AND distillation_key NOT IN (SELECT distillation_key FROM ledger)",
    "memory_blob": "WITH " + v.MEMORY + """, blob AS (SELECT CAST(regexp_extract(path, '[0-9]+') AS BIGINT) // 500 AS root, string_agg('### FILE: ' || path || chr(10) || chr(10) || body, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY path) AS b FROM memory GROUP BY 1)
      SELECT root, sha256(CASE WHEN length(b) > 800000 THEN left(b, 800000) || chr(10) || chr(10) || '... [TRUNCATED]' ELSE b END) AS sha256 FROM blob""",
    "removal_gate": _G + " SELECT id, kind, target_path FROM sugg LEFT JOIN memory ON path = target_path WHERE NOT (kind = 'remove' AND path IS NOT NULL AND floor((1706745600 - modified) / 86400) < 21)",
    "suggestion_binding": _G + " SELECT id, sha256 AS base_sha256, CAST(path IS NOT NULL AS INTEGER) AS target_existed FROM sugg LEFT JOIN memory ON path = target_path",
    "suggestion_previews": "WITH " + v.SUGGESTIONS + " SELECT id, '2024-02-01-' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END || '-' || kind || '-' || trim(regexp_replace(replace(target_path, '.md', ''), '[^a-z0-9-]+', '-', 'g'), '-') || '.md' AS sug_file FROM (SELECT *, row_number() OVER (ORDER BY id) + 3 AS n FROM sugg)",
    "suggestion_conflicts": _SNAP + " SELECT id, target, cur_sha AS current_sha256, conflict, CAST(2 AS INTEGER) AS n_sessions FROM snap",
    "decision_check": "WITH " + v.SUGGESTIONS[1:] + _DECIDED + """, d AS (SELECT * FROM made UNION ALL SELECT * FROM dec0 WHERE sid % 70 = 6), e AS (SELECT id FROM sugg WHERE status = 'pending')
      SELECT id, 'missing' AS fault FROM e WHERE id NOT IN (SELECT sid FROM d) UNION ALL SELECT DISTINCT sid, 'unknown' FROM d WHERE sid NOT IN (SELECT id FROM e) UNION ALL SELECT sid, 'duplicate' FROM d GROUP BY sid HAVING count(*) > 1
      UNION ALL SELECT DISTINCT sid, 'blank reason' FROM d WHERE trim(reason) = '' UNION ALL SELECT DISTINCT sid, 'body not allowed' FROM d WHERE decision <> 'merge' AND body <> ''""",
    "curate_apply": _SNAP.replace("WITH ", "WITH RECURSIVE ", 1) + _DECIDED + """, rows AS (SELECT s.id, s.target, s.kind, decision, conflict, there, row_number() OVER (PARTITION BY coalesce(s.target, 'x' || CAST(s.id AS VARCHAR)) ORDER BY s.id) AS n, coalesce(s.target, 'x' || CAST(s.id AS VARCHAR)) AS g FROM snap s JOIN made ON sid = s.id),
      fold AS (
        SELECT n, g, id, target, o.outcome, o.reason, o.applied, CASE WHEN o.outcome = 'accepted' THEN kind <> 'remove' ELSE there END AS exists_after FROM (SELECT *, CASE
            WHEN decision = 'reject' THEN {'outcome': 'rejected', 'reason': NULL::VARCHAR, 'applied': false} WHEN decision = 'defer' THEN {'outcome': 'deferred', 'reason': NULL, 'applied': false}
            WHEN decision = 'merge' AND kind = 'remove' THEN {'outcome': 'deferred', 'reason': 'merge of a removal', 'applied': false} WHEN target IS NULL THEN {'outcome': 'rejected', 'reason': 'unsafe target', 'applied': false}
            WHEN conflict AND decision = 'accept' THEN {'outcome': 'deferred', 'reason': 'initial conflict', 'applied': false} ELSE {'outcome': 'accepted', 'reason': NULL, 'applied': true} END AS o FROM rows WHERE n = 1)
        UNION ALL
        SELECT n, g, id, target, o.outcome, o.reason, o.applied OR before, CASE WHEN o.outcome = 'accepted' THEN kind <> 'remove' ELSE was END FROM (SELECT r.*, f.applied AS before, f.exists_after AS was, CASE
            WHEN decision = 'reject' THEN {'outcome': 'rejected', 'reason': NULL::VARCHAR, 'applied': false} WHEN decision = 'defer' THEN {'outcome': 'deferred', 'reason': NULL, 'applied': false}
            WHEN decision = 'merge' AND kind = 'remove' THEN {'outcome': 'deferred', 'reason': 'merge of a removal', 'applied': false} WHEN r.target IS NULL THEN {'outcome': 'rejected', 'reason': 'unsafe target', 'applied': false}
            WHEN NOT f.applied AND conflict AND decision = 'accept' THEN {'outcome': 'deferred', 'reason': 'initial conflict', 'applied': false} ELSE {'outcome': 'accepted', 'reason': NULL, 'applied': true} END AS o FROM rows r JOIN fold f ON r.g = f.g AND r.n = f.n + 1)
      ) SELECT id, target, outcome, reason, exists_after FROM fold""",
    "index_merge": "WITH " + _INDEXES + " SELECT idx.source, sha256(CASE WHEN l IS NULL THEN existing ELSE existing || chr(10) || l || chr(10) END) AS sha256 FROM idx LEFT JOIN added ON idx.source = added.source",
    "index_prune": "WITH " + _INDEXES + ", files AS (SELECT DISTINCT source, file FROM lines WHERE doc_id % 3 = 0), k AS (SELECT l.source, string_agg('- [t](' || l.file || ') hook', chr(10) ORDER BY doc_id) AS body FROM lines l JOIN files f ON l.source = f.source AND l.file = f.file WHERE old GROUP BY 1) SELECT idx.source AS root, sha256('# Index' || coalesce(chr(10) || k.body, '')) AS sha256 FROM idx LEFT JOIN k ON idx.source = k.source",
    "eval_metrics": _EVAL + """ SELECT (SELECT avg(CASE WHEN best <= 1 THEN 1 ELSE 0 END) FROM best) AS hit_1, (SELECT avg(CASE WHEN best <= 3 THEN 1 ELSE 0 END) FROM best) AS hit_3, (SELECT avg(CASE WHEN best <= 5 THEN 1 ELSE 0 END) FROM best) AS hit_5, (SELECT avg(coalesce(1 / best, 0)) FROM best) AS mrr,
      (SELECT avg(CASE WHEN query_id IN (SELECT query_id FROM chosen) THEN 0 ELSE 1 END) FROM q WHERE query_id NOT IN (SELECT query_id FROM rel)) AS empty_correct, CAST(0 AS BIGINT) AS duplicates, (SELECT count(*) FROM q) AS n_queries,
      (SELECT count(*) FROM chosen WHERE doc_id = 'd' || lpad(CAST(query_id * 20 AS VARCHAR), 9, '0')) AS forbidden_count, CAST(1 AS DOUBLE) AS injected_precision, CAST(0 AS INTEGER) AS codepoints""",
    "threshold_sweep": _SWEEP + " SELECT * FROM sweep",
    "calibrate": _SWEEP + f" SELECT 'lexical' AS mode, sha256('{'f' * 64}:lexical:calibration-v1') AS calibration_version, threshold FROM sweep ORDER BY mrr DESC, hit_3 DESC, threshold LIMIT 1",
    "chat_bundles": """WITH RECURSIVE r AS (
        SELECT CAST(conv_id // 4 AS VARCHAR) AS chat, conv_id * 1000 + turn AS id, role, length(text) AS chars, strftime(TIMESTAMP '2024-01-01' + to_minutes(conv_id * 60 + turn), '%Y-%m-%dT%H:%M:%SZ') AS ts, row_number() OVER (PARTITION BY conv_id // 4 ORDER BY conv_id, turn) AS n FROM conversations),
      f AS (SELECT chat, n, n AS first_n, chars AS total FROM r WHERE n = 1 UNION ALL SELECT r.chat, r.n, CASE WHEN total >= 500 THEN r.n ELSE first_n END, CASE WHEN total >= 500 THEN chars ELSE total + chars END FROM f JOIN r ON r.chat = f.chat AND r.n = f.n + 1)
      SELECT f.chat, 'chat-' || CAST(min(id) AS VARCHAR) || '-' || CAST(max(id) AS VARCHAR) AS session_id, min(id) AS first_id, max(id) AS last_id, count(*) AS n_rows, count(*) FILTER (role = 'user') AS user_msg_count, count(*) FILTER (role <> 'user') AS asst_msg_count, CAST(any_value(total) AS BIGINT) AS total_chars, max(ts) AS started_at, max(ts) AS ended_at
      FROM f JOIN r ON r.chat = f.chat AND r.n BETWEEN first_n AND f.n WHERE total >= 500 GROUP BY f.chat, f.n""",
    "event_lifecycle": """WITH RECURSIVE r AS (
        SELECT CAST(user_id AS VARCHAR) AS session_id, event_id AS n, CASE event_type WHEN 'error' THEN 'fail' WHEN 'purchase' THEN 'succeed' ELSE 'claim' END AS action, epoch_us(ts) / 1e6 AS tm, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
      f AS (
        SELECT session_id, n, action, k, action = 'claim' AS granted, CASE WHEN action = 'claim' THEN 'running' ELSE 'none' END AS status, CASE WHEN action = 'claim' THEN 1 ELSE 0 END AS attempts, tm AS started FROM r WHERE k = 1
        UNION ALL
        SELECT session_id, n, action, k, ok, CASE WHEN NOT ok THEN status WHEN action = 'claim' THEN 'running' WHEN action = 'succeed' THEN 'succeeded' ELSE 'failed' END, CASE WHEN ok AND action = 'claim' THEN attempts + 1 ELSE attempts END, CASE WHEN ok AND action = 'claim' THEN tm ELSE started END
        FROM (SELECT r.session_id, r.n, r.action, r.k, r.tm, f.status, f.attempts, f.started, CASE WHEN r.action = 'claim' THEN f.status = 'none' OR (f.status = 'running' AND r.tm - f.started >= 10) OR (f.status = 'failed' AND f.attempts < 2) ELSE f.status = 'running' END AS ok FROM f JOIN r ON r.session_id = f.session_id AND r.k = f.k + 1))
      SELECT session_id, 'prompt' AS event, 'v1' AS policy, n, action, granted, status, CAST(attempts AS INTEGER) AS attempts, CAST(attempts AS INTEGER) AS token FROM f""",
    "session_summaries": _D + " SELECT s.session_id, summary FROM sessions s LEFT JOIN distilled d ON s.session_id = d.session_id",
}

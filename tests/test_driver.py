import json

from pyspark.sql import functions as F

from memengine.functions import text as tx
from memengine.operators import documents, driver
from memengine.operators import index as ix
from memengine.streaming import lifecycle

COLUMNS = "doc_id string, source_kind string, trust_level string, project_slug string, source_path string, updated_at string, text string"
NOTES = [
    ("n1", "approved_memory", "user_approved", "-lab-bench", "n1.md", "2025-05-02T00:00:00Z", "Calibrate the balance with the brass weights."),
    ("n2", "approved_memory", "user_approved", "-lab-bench", "n2.md", "2025-05-01T00:00:00Z", "Brass weights live in the second drawer."),
    ("n3", "distilled_summary", "model_distilled", "-kitchen", "distilled:n3", "2025-05-03T00:00:00Z", "Bread proves for an hour."),
]


def notes(spark, rows=NOTES):
    docs = spark.createDataFrame(rows, COLUMNS)
    return docs.withColumns({"content_sha256": F.sha2("text", 256), "source_version": F.lit("v1"), "scrubbed": tx.scrub(F.col("text"))})


def test_a_batch_from_ranking_to_answers(spark):
    docs = notes(spark)
    rows = [("a", "brass weights", "/lab/bench"), ("b", "bread", "/kitchen"), ("c", "zeppelin", "/elsewhere")]
    queries = spark.createDataFrame(rows, "query_id string, query_text string, cwd string").select(
        "*", F.array().cast("array<string>").alias("repository_roots"), F.array().cast("array<string>").alias("excluded"), F.lit(False).alias("allow_raw"), F.lit("prompt").alias("hook_event"), F.lit(1000).alias("budget"), F.lit("Asked").alias("event_name"))
    vector = lambda rows, key: spark.createDataFrame(rows, f"{key} string, vector array<double>")
    vectors = vector([("a", [0.0, 1.0]), ("b", None), ("c", [1.0, 0.0])], "query_id"), vector([("n1", [1.0, 0.0]), ("n2", [0.0, 1.0]), ("n3", [1.0, 1.0])], "doc_id")

    def scorer(text, texts):
        if text == "bread":
            raise ValueError("unavailable")
        return [0.0] * len(texts)

    plain = driver.run(queries, docs, ix.build_index(docs))
    told = {r.query_id: json.loads(r.line) for r in plain.diagnostics.collect()}
    assert told["a"]["mode"] == "lexical" and told["a"]["selected_ids"] == ["n1", "n2"] and told["c"] == {"query_id": "c", "mode": "lexical", "candidate_count": 0, "selected_count": 0, "codepoints": 0}
    done = driver.run(queries, docs, ix.build_index(docs), vectors, scorer)
    told = {r.query_id: json.loads(r.line) for r in done.diagnostics.collect()}
    assert told["a"]["mode"] == "combined" and told["a"]["selected_ids"] == ["n2", "n1"] and "fallback" not in told["a"]
    assert told["b"]["mode"] == "lexical" and told["b"]["fallback"] == "embedder-error" and told["b"]["selected_ids"] == ["n3"]
    out = {r.query_id: json.loads(r.output)["hookSpecificOutput"]["additionalContext"] for r in done.outputs.collect()}
    assert out["c"] == "" and "Brass weights live" in out["a"] and out["a"].index("second drawer") < out["a"].index("Calibrate")


def test_collections_are_synced_at_once(spark):
    stored = notes(spark, [NOTES[0], (*NOTES[1][:6], "Old words."), ("gone", *NOTES[1][1:]), ("raw", "raw_transcript", "untrusted_transcript", None, "transcript:x", "2025-05-01T00:00:00Z", "kept talk")]).drop("scrubbed")
    now = notes(spark).drop("scrubbed")
    kinds = {k: now.filter(F.col("source_kind") == k) for k in ("approved_memory", "distilled_summary")}
    for index in (ix.build_index(stored), ix.build_index(stored.limit(1))):
        after, report, new = documents.collect_and_sync(stored, kinds, index)
        assert sorted(r.doc_id for r in after.collect()) == ["n1", "n2", "n3", "raw"]
        assert report.first().asDict() == {"scanned": 3, "inserted": 1, "updated": 1, "deleted": 1, "skipped": 1, "raw": 0}
        whole = ix.build_index(after)
        assert {tuple(r) for r in new.term_statistics().collect()} == {tuple(r) for r in whole.term_statistics().collect()} and ix.index_health(after, new).first()["sound"]


def test_events_keep_what_they_showed(spark):
    asked = [("s", "session-start:a", "v", 1, "claim", 0.0, None), ("s", "session-start:a", "v", 2, "succeed", 1.0, None), ("s", "session-start:b", "v", 3, "claim", 2.0, None), ("s", "session-start:b", "v", 4, "fail", 3.0, None), ("t", "prompt", "v", 5, "claim", 4.0, None), ("t", "prompt", "v", 6, "succeed", 5.0, None)]
    answers = lifecycle.replay(spark.createDataFrame(asked, "session_id string, event string, policy string, n long, action string, at double, token double"))
    shown = spark.createDataFrame([("s", "session-start:a", "v", [f"d{i:03d}" for i in range(300)]), ("s", "session-start:b", "v", ["never"]), ("t", "prompt", "v", ["p"])], "session_id string, event string, policy string, ids array<string>")
    state = lifecycle.with_selected(answers, shown)
    assert {(r.event, r.status, r.selected_ids_json is None) for r in state.collect()} == {("session-start:a", "succeeded", False), ("session-start:b", "failed", True), ("prompt", "succeeded", False)}
    assert {r.session_id: r.excluded for r in lifecycle.session_start_exclusions(state).collect()} == {"s": [f"d{i:03d}" for i in range(256)]}


def test_a_query_sees_the_starts_before_it(spark):
    asked = [("s", "session-start:a", "v1", 10, "claim"), ("s", "session-start:a", "v1", 20, "succeed"), ("s", "session-start:b", "v1", 22, "claim"), ("s", "session-start:b", "v1", 24, "fail"), ("s", "session-start:b", "v1", 26, "claim"), ("s", "session-start:b", "v1", 40, "succeed"), ("s", "session-start:a", "v2", 11, "claim"), ("s", "session-start:a", "v2", 12, "succeed"), ("s", "prompt", "v1", 13, "claim"), ("s", "prompt", "v1", 14, "succeed")]
    answers = lifecycle.replay(spark.createDataFrame([(*r, float(r[3]), None) for r in asked], "session_id string, event string, policy string, n long, action string, at double, token double"))
    shown = spark.createDataFrame([("s", "session-start:a", "v1", ["a1", "a2", "a3"]), ("s", "session-start:b", "v1", ["b1", "a1"]), ("s", "session-start:a", "v2", ["other"]), ("s", "prompt", "v1", ["p"])], "session_id string, event string, policy string, ids array<string>")
    queries = spark.createDataFrame([(1, "s", 15, ["x"]), (2, "s", 20, None), (3, "s", 21, ["x", "a2"]), (4, "s", 30, []), (5, "s", 41, ["x"]), (6, "t", 99, None), (7, "s", None, ["x"])], "query_id int, session_id string, n long, excluded array<string>")
    got = {r.query_id: r.excluded for r in lifecycle.exclude_shown(queries, answers, shown, "v1", most=2).collect()}
    assert got == {1: ["x"], 2: [], 3: ["x", "a2", "a1"], 4: ["a1", "a2"], 5: ["x", "a1", "a2", "b1"], 6: [], 7: ["x"]}
    assert {r.query_id: r.excluded for r in lifecycle.exclude_shown(queries.drop("excluded"), answers, shown, "v2").collect()}[1] == ["other"]

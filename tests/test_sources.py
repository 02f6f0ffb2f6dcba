import json

import pytest
from pyspark.sql import functions as F

from memengine.operators import ingest
from memengine.sources import files, transcripts
from memengine.sources.store import Store


def write(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"\n".join(r if isinstance(r, bytes) else json.dumps(r).encode() for r in rows) + b"\n")


def item(role, text, at, kind=None, phase=None, item_id=None):
    return {"type": "response_item", "timestamp": at, "payload": {"type": "message", "role": role, "phase": phase, "id": item_id, "content": [{"type": kind or ("input_text" if role == "user" else "output_text"), "text": text}]}}


@pytest.fixture(scope="module")
def rollout(tmp_path_factory):
    root = tmp_path_factory.mktemp("rollout")
    meta = {"type": "session_meta", "timestamp": "2024-01-01T00:00:00Z", "payload": {"session_id": "s1", "cwd": "/home/a/api"}}
    write(root / "2024" / "a.jsonl", [
        {"type": "event", "timestamp": "2023-12-31T00:00:00Z"}, meta, item("user", "# AGENTS.md instructions for x", "2024-01-01T00:00:01Z"), item("user", " hello ", "2024-01-01T00:00:02Z"),
        b"not json", b'"text"', item("assistant", "thinking", "2024-01-01T00:00:03Z", phase="commentary", item_id="i1"), item("assistant", "first", "2024-01-01T00:00:04Z", phase="final_answer", item_id="i1"),
        item("assistant", "again", "2024-01-01T00:00:05Z", phase="final_answer", item_id="i1"), b'{"type": "x", "bad": "\xff"}', {"type": "reasoning", "timestamp": "2024-01-01T00:00:09Z"},
    ])
    write(root / "b.jsonl", [{"type": "session_meta", "payload": {"id": "sub", "source": {"subagent": "x"}}}, item("user", "hidden", None)])
    write(root / "c.jsonl", [{"type": "session_meta", "payload": {"id": "t", "thread_source": "subagent"}}])
    write(root / "d.jsonl", [item("user", "no meta", None)])
    write(root / "e.jsonl", [{"type": "session_meta", "payload": {"source": "cli"}}, item("user", "x", "2024-02-01T00:00:00Z")])
    return root


def test_rollout(spark, rollout):
    sessions, messages = transcripts.rollout_sessions(spark, f"file://{rollout}")
    got = {r.external_session_id: r for r in sessions.collect()}
    assert set(got) == {"s1", "e"}
    s = got["s1"]
    assert (s.project_slug, s.started_at, s.ended_at, s.cwd) == ("-home-a-api", "2024-01-01T00:00:00Z", "2024-01-01T00:00:09Z", "/home/a/api")
    assert got["e"].project_slug == "codex" and got["e"].started_at == "2024-02-01T00:00:00Z"
    said = [(r.seq, r.role, r.text) for r in messages.orderBy("path", "seq").collect() if r.path.endswith("a.jsonl")]
    assert said == [(1, "user", "hello"), (2, "assistant", "first")]


def test_projects(spark, tmp_path):
    rows = [
        {"type": "user", "timestamp": "2024-01-01T00:00:00Z", "cwd": "/w/p", "gitBranch": "main", "message": {"content": "hi there"}}, {"type": "user", "message": {"content": "<command-name>x"}},
        {"type": "assistant", "timestamp": "2024-01-01T00:00:01Z", "message": {"content": [{"type": "text", "text": "a"}, {"type": "tool_use"}, {"type": "text", "text": ""}, {"type": "text", "text": "b"}]}},
        {"type": "assistant", "message": {"content": "plain"}}, {"type": "user", "isSidechain": True, "timestamp": "2024-01-01T00:00:05Z", "message": {"content": "side"}}, {"type": "summary"},
    ]
    write(tmp_path / "-w-p" / "abc.jsonl", rows)
    write(tmp_path / "-w-p" / "deep" / "no.jsonl", rows)
    sessions, messages = transcripts.project_sessions(spark, f"file://{tmp_path}")
    s = sessions.collect()
    assert [(r.external_session_id, r.cwd, r.git_branch, r.project_slug, r.started_at, r.ended_at) for r in s] == [("abc", "/w/p", "main", "-w-p", "2024-01-01T00:00:00Z", "2024-01-01T00:00:05Z")]
    assert [(r.seq, r.role, r.text) for r in messages.orderBy("seq").collect()] == [(1, "user", "hi there"), (2, "assistant", "a\nb")]


def test_sources_by_name(spark, rollout):
    root = f"file://{rollout}"
    sources = {"one": (transcripts.rollout_sessions, root, False), "two": (transcripts.rollout_sessions, root, True)}
    assert transcripts.configured(spark, sources)[0].count() == 2
    assert transcripts.configured(spark, sources, {"one", "two"})[0].count() == 4
    with pytest.raises(ValueError):
        transcripts.configured(spark, sources, {"none"})


def test_ingest_is_idempotent_and_takes_grown_files(spark, rollout):
    parsed, said = transcripts.rollout_sessions(spark, f"file://{rollout}")
    none = spark.createDataFrame([], "session_id string, source string, external_session_id string, source_revision string, parser_version string, project_slug string, started_at string, ended_at string, cwd string, git_branch string, total_chars long, user_msg_count long, asst_msg_count long")
    empty = spark.createDataFrame([], "seq long, role string, timestamp string, text string, session_id string")
    sessions, messages, counts = ingest.ingest(parsed, said, none, empty)
    assert {r.session_id for r in sessions.collect()} == {"codex:s1", "codex:e"} and messages.count() == 3
    assert counts.first().asDict() == {"source": "codex", "seen": 2, "ingested": 2, "messages": 3}
    again = ingest.ingest(parsed, said, sessions, messages)
    assert again[2].first().ingested == 0 and again[1].count() == 3 and again[0].count() == 2
    grown = sessions.withColumn("source_revision", F.concat("source_revision", F.lit("x")))
    assert ingest.ingest(parsed, said, grown, messages)[2].first().ingested == 2
    assert ingest.ingest(parsed, said, sessions, messages, force=True)[2].first().ingested == 2


def test_memory_files(spark, tmp_path):
    for name, body in {"a.md": b"one\r\ntwo", "sub/b.md": b"x", ".hidden": b"x", ".suggestions/c.md": b"x", "memory-backups/d.md": b"x", "e.tmp": b"x", "f~": b"x", "bad.md": b"\xff\xfe"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(body)
    found = {r.path: r.body for r in files.memory_files(spark, f"file://{tmp_path}").collect()}
    assert found == {"a.md": "one\ntwo", "sub/b.md": "x"}
    docs = files.memory_documents(files.memory_files(spark, f"file://{tmp_path}"), "2024-01-01T00:00:00Z").collect()
    assert {d.source_path for d in docs} == {"a.md", "sub/b.md"} and all(len(d.doc_id) == 36 for d in docs)


def test_payloads(spark):
    rows = [
        (1, "UserPromptSubmit", '{"session_id":"s","cwd":"/w","prompt":"hi"}'), (2, "UserPromptSubmit", '{"session_id":"s","cwd":"/w"}'), (3, "SessionStart", '{"session_id":"s","cwd":"/w","repository_roots":["/r"],"source":"resume"}'),
        (4, "SessionStart", '{"cwd":"/w"}'), (5, "SessionStart", "[1]"), (6, "SessionStart", None),
    ]
    good, bad = files.payload_queries(spark.createDataFrame(rows, "query_id int, event_name string, payload string"))
    assert [(r.query_id, r.query_text, r.hook_event, r.budget) for r in good.orderBy("query_id").collect()] == [(1, "hi", "prompt", 4000), (3, "/w /r", "session-start:resume", 6000)]
    assert [(r.query_id, r.reason) for r in bad.orderBy("query_id").collect()] == [(2, "prompt is required"), (4, "session_id and cwd are required"), (5, "payload must be an object"), (6, "payload must be an object")]


def test_store_commits_tables_together(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    assert store.state()["version"] == 0
    df = spark.range(3)
    assert store.commit(a=df, b=df) == 1
    pinned = store.state()
    for n in range(4):
        store.commit(a=spark.range(10 + n))
    assert store.read("a").count() == 13 and store.read("b").count() == 3 and store.read("a", pinned).count() == 3
    assert store.keep(2) == [4, 5] and store.read("a").count() == 13 and store.read("b").count() == 3
    assert len([p for p in (tmp_path / "store" / "a").iterdir() if p.is_dir()]) == 2

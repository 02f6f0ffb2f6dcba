import json

from memengine.functions.schema import first_fault
from memengine.operators import consolidate, curate, distill, documents
from pyspark.sql import functions as F


def slow(value, schema, path="$"):
    """The first fault, by a walk of the parsed value."""
    kinds = {"object": dict, "array": list, "string": str, "integer": int, "number": (int, float), "boolean": bool}
    kind = schema.get("type")
    if kind and (not isinstance(value, kinds[kind]) or isinstance(value, bool) and kind in ("integer", "number")):
        return f"{path}: expected {kind}"
    if kind == "object":
        missing = [k for k in schema.get("required", []) if k not in value]
        extra = sorted(value.keys() - schema.get("properties", {}).keys()) if schema.get("additionalProperties") is False else []
        if missing or extra:
            return f"{path}: missing required keys: {', '.join(missing)}" if missing else f"{path}: unexpected keys: {', '.join(extra)}"
        found = [slow(value[k], s, f"{path}.{k}") for k, s in schema.get("properties", {}).items() if k in value]
    else:
        found = [slow(x, schema["items"], f"{path}[{i}]") for i, x in enumerate(value)] if kind == "array" and schema.get("items") else []
    if "enum" in schema and value not in schema["enum"]:
        found.append(f"{path}: value '{value}' is not in enum")
    return next((f for f in found if f), None)


def faults(spark, texts, schema):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(2)
    return [r.f for r in rows.select("i", first_fault(F.col("t"), schema).alias("f")).orderBy("i").collect()]


def test_every_schema_by_a_walk(spark):
    note = {"summary": "s", **{n: ["x"] for n in distill.NOTE_LISTS}}
    idea = {"kind": "new", "target_path": "a", "body": "b", "rationale": "", "source_sessions": []}
    said = {"suggestion_id": 1, "decision": "merge", "reason": "r", "body": ""}
    odd = {"type": "object", "properties": {"b": {"type": "boolean"}, "x": {"type": "number"}, "any": {}, "list": {"type": "array"}, "deep": {"type": "array", "items": {"type": "array", "items": {"type": "integer"}}}}}
    cases = {
        "notes": (distill.NOTES, [note, note | {"summary": None}, note | {"zz": 1, "a": 2}, {}, [], "x", 3, None, True, note | {"projects": ["a", 1]}, note | {"decisions": {}}, note | {"user_facts": [["x"]]}]),
        "ideas": (consolidate.SUGGESTIONS, [{"suggestions": v} for v in ([], [idea], [idea, idea | {"kind": "New"}], [idea | {"kind": 4}], [idea | {"source_sessions": ["a", None]}], [{}], [idea | {"é": 1}], "no", [[]], [idea, None])]),
        "decisions": (curate.DECISIONS, [{"decisions": [said, said | more]} for more in ({}, {"suggestion_id": 1.0}, {"suggestion_id": True}, {"suggestion_id": "1"}, {"suggestion_id": 10**25}, {"suggestion_id": -3}, {"suggestion_id": None}, {"suggestion_id": 1e3}, {"decision": "keep"}, {"reason": 1}, {"body": []})] + [{"decisions": [{k: said[k] for k in said if k != "body"}]}]),
        "others": (odd, [{}, {"b": 1}, {"b": False, "x": 1.5}, {"x": True}, {"x": 3}, {"any": [1], "more": 2}, {"list": [1, "a"]}, {"list": {}}, {"deep": [[1, 2], [3, 4.0]]}, {"deep": [[], 1]}, {"deep": [[1], []]}]),
    }
    for schema, values in cases.values():
        want = [slow(v, schema) for v in values]
        assert faults(spark, [json.dumps(v) for v in values], schema) == want and len(set(want)) > 4
        assert faults(spark, ["```json\n" + json.dumps(values[0], indent=1) + "\n```", None, "", "{", '{"a":1,"a":2}'], schema)[1:] == ["$: no JSON"] * 4


def test_rows_of_completions(spark):
    ideas = json.dumps({"suggestions": [{"kind": "new", "target_path": "a.md", "body": "b\né", "rationale": "r", "source_sessions": ["1", "2"]}] * 2})
    rows, rejected = consolidate.suggestions_of(spark.createDataFrame([("r1", ideas, 5), ("r2", "[]", 6), ("r3", '{"suggestions": []}', 7)], "run_id string, completion string, kind int").withColumnRenamed("kind", "batch"))
    assert [tuple(r) for r in rows.orderBy("n").collect()] == [("r1", 5, i, "new", "a.md", "b\né", "r", ["1", "2"]) for i in (0, 1)]
    assert [(r.run_id, r.fault) for r in rejected.collect()] == [("r2", "$: expected object")]
    said = json.dumps({"decisions": [{"suggestion_id": 7, "decision": "accept", "reason": "r", "body": ""}, {"suggestion_id": 10**30, "decision": "defer", "reason": "", "body": "x"}]})
    rows, rejected = curate.decisions_of(spark.createDataFrame([(said,), (None,)], "completion string"))
    assert [tuple(r) for r in rows.orderBy("n").collect()] == [(0, 7, "accept", "r", ""), (1, None, "defer", "", "x")] and rejected.count() == 1
    found = curate.check_decisions(rows, spark.createDataFrame([(7,), (8,)], "id long"))
    assert {(r.id, r.fault) for r in found.collect()} == {(8, "missing"), (None, "unknown"), (None, "blank reason"), (None, "body not allowed")}


def test_notes_are_canonical(spark):
    values = [{"summary": "s", "user_facts": ["likes é"], "projects": []}, ["a", "b"], {"n": 1, "x": 1.0, "y": -2.50e3, "z": None}, {"b": {"d": [1, {"z": 1, "a": []}], "c": "x: y, \"q\" \\ \n\u001f "}, "A": True}, [[]], {}, [], "text", 3, None, {"é": "ü", "z": "日本"}]
    texts = [json.dumps(v) for v in values] + [None, "", "{", "nul", "[" * 20_000]
    want = [json.dumps(v, ensure_ascii=False, sort_keys=True) if isinstance(v, (dict, list)) and v else None for v in values] + [None] * 5
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, notes_json string")
    assert [r.t for r in rows.select("i", documents.canonical_notes("notes_json").alias("t")).orderBy("i").collect()] == want
    made = rows.select(F.col("i").alias("session_id"), "notes_json", F.when(F.col("i") % 2 == 0, "sum").alias("summary"), F.when(F.col("i") != 3, F.lit("k")).when(F.col("i") == 99, "").alias("distillation_key"), F.lit("2024-01-01").alias("distilled_at"))
    docs = documents.distilled_documents(made, rows.select(F.col("i").alias("session_id"), F.lit("p").alias("project_slug"))).collect()
    assert sorted(r.text for r in docs) == sorted(t or "sum" for i, t in enumerate(want) if t or i % 2 == 0)
    assert {r.source_version for r in docs} == {"k", "legacy:3"}

"""Checks of JSON texts against a subset of JSON Schema, compiled to one column: the first thing wrong, or null.

The subset is ``type`` (object, array, string, integer, number, boolean), ``required``, ``properties``,
``additionalProperties: False``, ``items`` and ``enum``. Faults come in the order in which a reader meets them: the type, missing keys
as they are listed, unexpected keys by name, then each property and each item in turn, and at last the enum. An integer
is a number without a point or exponent; true and false are no numbers. Other words of a schema say nothing here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from memengine.functions.text import json_body

#: What a VARIANT's own schema says of each scalar type.
_SCALARS = {"string": "^STRING$", "integer": r"^(BIGINT|DECIMAL\(\d+,0\))$", "number": "^(BIGINT|DECIMAL|DOUBLE|FLOAT)", "boolean": "^BOOLEAN$"}


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _says(path: Column, what: str) -> Column:
    return F.concat(path, F.lit(": " + what))


def _has_integers(schema: dict) -> bool:
    inside = [*schema.get("properties", {}).values(), *([schema["items"]] if schema.get("items") else [])]
    return schema.get("type") == "integer" or any(map(_has_integers, inside))


def _parts(raw: Column | None, schema: dict, kind: str) -> Column | None:
    """The JSON texts of what is inside, where an integer is sought: a VARIANT does not tell 1.0 from 1."""
    return F.from_json(raw, kind) if raw is not None and _has_integers(schema) else None


def _object(value: Column, schema: dict, path: Column, raw: Column | None) -> Column:
    known, required, texts = schema.get("properties", {}), schema.get("required", []), _parts(raw, schema, "map<string,string>")

    def checks(fields: Column) -> Column:
        keys = F.map_keys(fields)
        fault = F.when(fields.isNull(), _says(path, "expected object"))
        if required:
            missing = F.array_except(F.array(*map(F.lit, required)), keys)
            fault = fault.when(F.size(missing) > 0, F.concat(_says(path, "missing required keys: "), F.array_join(missing, ", ")))
        if schema.get("additionalProperties") is False:
            extra = F.array_sort(F.array_except(keys, F.array(*map(F.lit, known)).cast("array<string>")))
            fault = fault.when(F.size(extra) > 0, F.concat(_says(path, "unexpected keys: "), F.array_join(extra, ", ")))
        below = []
        for name, child in known.items():
            text = F.element_at(texts, F.lit(name)) if texts is not None else None
            below.append(F.when(F.map_contains_key(fields, F.lit(name)), first_fault_of(F.element_at(fields, F.lit(name)), child, F.concat(path, F.lit(f".{name}")), text)))
        return fault.otherwise(F.coalesce(*below, F.lit(None).cast("string")))

    return _let(F.try_variant_get(value, "$", "map<string,variant>"), checks)


def _array(value: Column, schema: dict, path: Column, raw: Column | None) -> Column:
    texts = _parts(raw, schema, "array<string>")

    def checks(items: Column) -> Column:
        fault = F.when(items.isNull(), _says(path, "expected array"))
        if not schema.get("items"):
            return fault
        text = (lambda i: F.get(texts, i)) if texts is not None else lambda i: None
        below = F.transform(items, lambda x, i: first_fault_of(x, schema["items"], F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), text(i)))
        return fault.otherwise(F.get(F.filter(below, lambda x: x.isNotNull()), F.lit(0)))

    return _let(F.try_variant_get(value, "$", "array<variant>"), checks)


def first_fault_of(value: Column, schema: dict, path: Column, raw: Column | None = None) -> Column:
    """The first fault of a VARIANT that stands at ``path``, ``raw`` being its text; a null inside arrays and objects is JSON's
    null, which has no type."""
    kind = schema.get("type")
    if kind == "object":
        fault = _object(value, schema, path, raw)
    elif kind == "array":
        fault = _array(value, schema, path, raw)
    elif kind in _SCALARS:
        right = F.coalesce(F.schema_of_variant(value), F.lit("VOID")).rlike(_SCALARS[kind])
        if kind == "integer" and raw is not None:
            right &= ~F.coalesce(raw.rlike("[.eE]"), F.lit(False))
        fault = F.when(~right, _says(path, f"expected {kind}"))
    else:
        fault = F.lit(None).cast("string")
    if "enum" in schema:
        said = F.try_variant_get(value, "$", "string")
        outside = F.when(~F.coalesce(said.isin([str(x) for x in schema["enum"]]), F.lit(False)), F.concat(_says(path, "value '"), F.coalesce(said, F.lit("null")), F.lit("' is not in enum")))
        fault = F.coalesce(fault, outside)
    return fault


def first_fault(completion: Column, schema: dict) -> Column:
    """The first thing wrong with a completion, null if nothing is. A code fence around the JSON is no fault; a null completion,
    and an object that has a key twice, are no JSON."""
    body = json_body(F.coalesce(completion, F.lit("")))
    return _let(F.struct(body.alias("t"), F.try_parse_json(body).alias("v")), lambda x: F.when(x["v"].isNull(), F.lit("$: no JSON")).otherwise(first_fault_of(x["v"], schema, F.lit("$"), x["t"])))

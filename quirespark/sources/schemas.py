"""Schemas of manifests and entity annotations, and a validator for the JSON Schema keywords they use.

:func:`violations` checks one parsed value, :func:`column_violations` a column of JSON texts on the executors.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from datetime import datetime
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirespark.functions.text import FORMATS
from quirespark.operators.extraction import ENTITY_TYPES

# Names, patterns and bounds of the two contracts.
SPLITS = ("training", "validation", "test")
TASKS = ("ocr_detection", "ocr_recognition", "document_classification", "semantic_extraction")
SPLIT_METHODS = ("source_provided", "grouped", "manual")
VERSION, LONGEST_NAME, LONGEST_ID, LONGEST_NOTE = "1.0.0", 128, 256, 1000
KEY_PATTERN = "^[a-z][a-z0-9_]*$"
MEDIA_PATTERN = "^[a-z0-9!#$&^_.+-]+/[a-z0-9!#$&^_.+-]+$"
TIME_PATTERN = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]+)?(?:Z|[+-][0-9]{2}:[0-9]{2})$"


def _object(required: dict[str, Any], optional: dict[str, Any] | None = None, **more: Any) -> dict[str, Any]:
    return {"type": "object", "additionalProperties": False, "required": list(required), "properties": required | (optional or {}), **more}


def _text(longest: int | None = None, **more: Any) -> dict[str, Any]:
    return {"type": "string", "minLength": 1} | ({"maxLength": longest} if longest else {}) | more


def _named(pattern: str, longest: int | None = None) -> dict[str, Any]:
    return {"type": "string", "pattern": pattern} | ({"maxLength": longest} if longest else {})


def _list(items: dict[str, Any], least: int = 0, unique: bool = False) -> dict[str, Any]:
    return {"type": "array", "items": items} | ({"minItems": least} if least else {}) | ({"uniqueItems": True} if unique else {})


def _whole(least: int) -> dict[str, Any]:
    return {"type": "integer", "minimum": least}


def manifest_schema() -> dict[str, Any]:
    """The contract of a dataset manifest."""
    artifact = _object({"uri": _text(), "sha256": _named("^[a-f0-9]{64}$"), "media_type": _named(MEDIA_PATTERN)}, {"size_bytes": _whole(0)})
    keys = _list(_named(KEY_PATTERN), unique=True)
    groups = {"type": "object", "minProperties": 1, "propertyNames": {"pattern": KEY_PATTERN}, "additionalProperties": _text(LONGEST_ID)}
    strategy = _object({"method": {"enum": list(SPLIT_METHODS)}}, {"grouping_keys": keys, "random_seed": _whole(0), "notes": _text(LONGEST_NOTE)})
    strategy["allOf"] = [{"if": {"properties": {"method": {"const": "grouped"}}, "required": ["method"]}, "then": {"required": ["grouping_keys"], "properties": {"grouping_keys": {"minItems": 1}}}}]
    record = _object({"id": _named(f"^{FORMATS['identifier']}$", LONGEST_ID), "split": {"enum": list(SPLITS)}, "document": artifact}, {"cohorts": _list(_named(KEY_PATTERN), unique=True), "groups": groups, "annotation": artifact})
    source = _object({"name": _text(LONGEST_NAME), "version": _text(LONGEST_NAME)}, {"uri": _text(), "license": _text(LONGEST_NAME)})
    return _object(
        {
            "schema_version": {"const": VERSION}, "name": _named(f"^{FORMATS['slug']}$", LONGEST_NAME), "version": _named(f"^{FORMATS['semver']}$"),
            "created_at": {"type": "string", "format": "date-time", "pattern": TIME_PATTERN}, "tasks": _list({"enum": list(TASKS)}, 1, True),
            "sources": _list(source, 1), "split_strategy": strategy, "records": _list(record, 1),
        },
        {"description": _text(LONGEST_NOTE)},
    )


def annotation_schema(types: tuple[str, ...] = ENTITY_TYPES) -> dict[str, Any]:
    """The contract of an entity annotation; labels are those of the entity types."""
    box = _object({"x_min": {"type": "number", "minimum": 0}, "y_min": {"type": "number", "minimum": 0}, "x_max": {"type": "number", "exclusiveMinimum": 0}, "y_max": {"type": "number", "exclusiveMinimum": 0}})
    token = _object({"token_index": _whole(0), "text": _text(), "bounding_box": box, "label": {"enum": ["O", *(f"{p}-{t}" for t in types for p in "BI")]}})
    page = _object({"page_index": _whole(0), "image_width": _whole(1), "image_height": _whole(1), "tokens": _list(token, 1)})
    versions = {k: {"const": VERSION} for k in ("schema_version", "label_schema_version", "source_ocr_schema_version")}
    return _object(versions | {"document_id": _text(LONGEST_ID), "pages": _list(page, 1)})


def _is(value: Any, kind: str) -> bool:
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    return {"object": isinstance(value, dict), "array": isinstance(value, list), "string": isinstance(value, str), "number": number, "integer": number and float(value).is_integer() if number and value - value == 0 else False, "boolean": isinstance(value, bool), "null": value is None}[kind]


def _same(a: Any, b: Any) -> bool:
    """Equality of JSON values: true isn't 1."""
    if isinstance(a, bool) != isinstance(b, bool) or isinstance(a, list) != isinstance(b, list) or isinstance(a, dict) != isinstance(b, dict):
        return False
    if isinstance(a, list):
        return len(a) == len(b) and all(map(_same, a, b))
    if isinstance(a, dict):
        return a.keys() == b.keys() and all(_same(v, b[k]) for k, v in a.items())
    return a == b


def _repeats(values: list) -> bool:
    seen = [json.dumps(v, sort_keys=True) for v in values]
    return len(set(seen)) != len(seen) or any(_same(a, b) for k, a in enumerate(values) for b in values[:k] if isinstance(a, float) or isinstance(b, float))


def _date_time(value: str) -> bool:
    try:
        datetime.fromisoformat(value.upper().replace("Z", "+00:00"))
    except ValueError:
        return False
    return True


#: Keyword -> whether a value (of the type it applies to) breaks it.
_CHECKS = {
    "const": (None, lambda v, x: not _same(v, x)), "enum": (None, lambda v, x: not any(_same(v, y) for y in x)),
    "pattern": (str, lambda v, x: not re.search(x, v)), "minLength": (str, lambda v, x: len(v) < x), "maxLength": (str, lambda v, x: len(v) > x),
    "format": (str, lambda v, x: x == "date-time" and not _date_time(v)), "minimum": (float, lambda v, x: v < x), "exclusiveMinimum": (float, lambda v, x: v <= x),
    "minItems": (list, lambda v, x: len(v) < x), "uniqueItems": (list, lambda v, x: x and _repeats(v)), "minProperties": (dict, lambda v, x: len(v) < x),
}


def check_schema(schema: Any, where: str = "$") -> None:
    """Raises for a schema that isn't an object, uses a keyword that isn't known here, or holds a bad pattern."""
    if not isinstance(schema, dict):
        raise ValueError(f"{where} must be an object")
    known = {*_CHECKS, "type", "items", "properties", "required", "additionalProperties", "propertyNames", "allOf", "if", "then", "title", "description", "$schema", "$id"}
    if extra := schema.keys() - known:
        raise ValueError(f"{where} uses {sorted(extra)}")
    if "pattern" in schema:
        re.compile(schema["pattern"])
    parts = [(k, schema[k]) for k in ("items", "propertyNames", "if", "then") if k in schema] + [(f"properties.{k}", v) for k, v in schema.get("properties", {}).items()] + [(f"allOf[{k}]", v) for k, v in enumerate(schema.get("allOf", []))]
    if isinstance(schema.get("additionalProperties"), dict):
        parts.append(("additionalProperties", schema["additionalProperties"]))
    for k, v in parts:
        check_schema(v, f"{where}.{k}")


def _walk(value: Any, schema: dict[str, Any], path: tuple) -> Iterator[tuple[tuple, str]]:
    if "type" in schema and not _is(value, schema["type"]):
        yield path, "type"
    for key, (kind, broken) in _CHECKS.items():
        if key in schema and (kind is None or (_is(value, "number") if kind is float else isinstance(value, kind))) and broken(value, schema[key]):
            yield path, key
    if isinstance(value, dict):
        yield from ((path, "required") for k in schema.get("required", []) if k not in value)
        own, rest = schema.get("properties", {}), schema.get("additionalProperties", True)
        for k, v in value.items():
            if k in own:
                yield from _walk(v, own[k], (*path, k))
            elif isinstance(rest, dict):
                yield from _walk(v, rest, (*path, k))
        if rest is False and value.keys() - own.keys():
            yield path, "additionalProperties"
        if "propertyNames" in schema:
            for k in value:
                yield from ((path, key) for _, key in _walk(k, schema["propertyNames"], ()))
    if isinstance(value, list) and "items" in schema:
        for k, v in enumerate(value):
            yield from _walk(v, schema["items"], (*path, k))
    for part in schema.get("allOf", []):
        yield from _walk(value, part, path)
    if "if" in schema and "then" in schema and next(_walk(value, schema["if"], ()), None) is None:
        yield from _walk(value, schema["then"], path)


def json_path(parts: tuple) -> str:
    """``$.records[0].id`` of ``("records", 0, "id")``."""
    return "$" + "".join(f"[{p}]" if isinstance(p, int) else f".{p}" for p in parts)


def violations(value: Any, schema: dict[str, Any]) -> list[tuple[str, str]]:
    """``(location, keyword)`` of everything in a value that breaks the schema, in order of the locations' parts as texts."""
    found = sorted(_walk(value, schema, ()), key=lambda x: tuple(map(str, x[0])))
    return [(json_path(path), key) for path, key in found]


def column_violations(rows: DataFrame, column: str, schema: dict[str, Any], unreadable: str, *keys: str) -> DataFrame:
    """``keys, code, location, keyword`` of JSON texts (or their bytes in UTF-8) that break the schema, one row each violation. A text that can't be parsed, a null or
    one that isn't an object has one row with the code ``unreadable`` at ``$`` and no keyword; others have ``schema_violation``."""
    check_schema(schema)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema.fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, *own in batch[[column, *keys]].itertuples(index=False):
                try:
                    value = json.loads(bytes(text).decode() if isinstance(text, (bytes, bytearray, memoryview)) else text)
                    if not isinstance(value, dict):
                        raise TypeError
                    out += [(*own, "schema_violation", *v) for v in violations(value, schema)]
                except (TypeError, ValueError, RecursionError):
                    out.append((*own, unreadable, "$", None))
            yield pd.DataFrame(out, columns=[*keys, "code", "location", "keyword"])

    return rows.select(*keys, F.col(column)).mapInPandas(run, ", ".join([*fields, "code string, location string, keyword string"]))

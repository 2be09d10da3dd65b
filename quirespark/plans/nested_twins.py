"""SQL (DuckDB) that gives the flat tables of nested records, for the payload forms of the test data."""

from __future__ import annotations

from quirespark.functions.geometry import CORNERS


def _chain(start: str, first: str, step: str, times: int) -> str:
    """Tables ``{start}0`` to ``{start}{times}``, each a step (an expression of ``v``) further than the one before."""
    parts = [f"{start}0 AS (SELECT raw_id, {first})"]
    return ", ".join([parts[0], *[f"{start}{k + 1} AS (SELECT raw_id, {step} AS v FROM {start}{k})" for k in range(times)]])


def _whole(x: str) -> str:
    """A whole number given as number or text."""
    text = f"({x} ->> '$')"
    return f"CASE WHEN json_type({x}) IN ('BIGINT', 'UBIGINT') THEN try_cast({text} AS INT) WHEN json_type({x}) = 'VARCHAR' AND regexp_full_match({text}, '\\s*[+-]?\\d+(\\.0*)?\\s*') THEN try_cast(try_cast(trim({text}) AS DOUBLE) AS INT) WHEN json_type({x}) = 'DOUBLE' AND try_cast({text} AS DOUBLE) = floor(try_cast({text} AS DOUBLE)) THEN try_cast(try_cast({text} AS DOUBLE) AS INT) END"


def _members(x: str, own: tuple[str, ...]) -> str:
    """List of ``key, v`` of a collection: a list, one member, or an object keyed by index."""
    single = " OR ".join(f"json_exists({x}, '$.{k}')" for k in own)
    none = "[]::STRUCT(key INT, v JSON)[]"
    keyed = f"list_transform(list_sort(list_transform(json_keys({x}), lambda k: {{'n': try_cast(k AS INT), 'k': k}})), lambda y: {{'key': y.n, 'v': json_extract({x}, '$.\"' || y.k || '\"')}})"
    return f"CASE json_type({x}) WHEN 'ARRAY' THEN list_transform(from_json({x}, '[\"JSON\"]'), lambda y: {{'key': NULL::INT, 'v': y}}) WHEN 'OBJECT' THEN CASE WHEN {single} THEN [{{'key': NULL::INT, 'v': {x}}}] ELSE {keyed} END ELSE {none} END"


_VALID = "CASE WHEN json_valid(payload) THEN payload::JSON END AS v FROM (SELECT DISTINCT raw_id, payload FROM annotation_raw WHERE raw_id IS NOT NULL)"
_TEXTS = _chain("s", _VALID, "CASE WHEN json_type(v) = 'VARCHAR' THEN CASE WHEN json_valid(v ->> '$') THEN (v ->> '$')::JSON END ELSE v END", 4)
_WRAPS = _chain("r", "v FROM s4", "CASE WHEN json_type(v) = 'OBJECT' AND NOT json_exists(v, '$.pages') AND json_type(v -> '$.res') = 'OBJECT' THEN v -> '$.res' ELSE v END", 4)
# fields that tell a single member from an object keyed by index
_PAGE = ("page_index", "image_width", "tokens", "lines", "blocks", "paragraphs", "regions")
_TOKEN = ("text", "token_index", "bounding_box")
_NUMBER = "CASE WHEN json_type({0}) IN ('BIGINT', 'UBIGINT', 'DOUBLE', 'VARCHAR') THEN try_cast({0} ->> '$' AS DOUBLE) END"
_TEXT = "CASE WHEN json_type({0}) <> 'NULL' THEN {0} ->> '$' END"
_KEPT = "list_filter({0}, lambda y: json_type(y.v) = 'OBJECT')"

NESTED = f"""WITH {_TEXTS}, {_WRAPS}, docs AS (SELECT raw_id, v FROM r4 WHERE json_type(v) = 'OBJECT'),
listed AS (SELECT raw_id, {_members("v -> '$.pages'", _PAGE)} AS m FROM docs),
pages0 AS (SELECT raw_id, (i - 1)::INT AS page_ordinal, m[i].key AS key, m[i].v AS p FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM listed) WHERE json_type(m[i].v) = 'OBJECT'),
pages AS (SELECT raw_id, page_ordinal, coalesce({_whole("p -> '$.page_index'")}, key, page_ordinal) AS page_index, p FROM pages0),
held AS (SELECT raw_id, page_ordinal, page_index, {_members("p -> '$.tokens'", _TOKEN)} || coalesce(flatten(list_transform({_KEPT.format(_members("p -> '$.lines'", ("tokens", "lines")))}, lambda l: {_members("l.v -> '$.tokens'", _TOKEN)})), []) AS m FROM pages),
tokens0 AS (SELECT raw_id, page_ordinal, page_index, (i - 1)::INT AS token_ordinal, m[i].key AS key, m[i].v AS t FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM held) WHERE json_type(m[i].v) = 'OBJECT'),
tokens1 AS (SELECT raw_id, page_ordinal, page_index, token_ordinal, coalesce({_whole("t -> '$.token_index'")}, key, token_ordinal) AS token_index, {_TEXT.format("(t -> '$.text')")} AS text, {_TEXT.format("(t -> '$.label')")} AS label, t -> '$.bounding_box' AS b FROM tokens0),
boxed AS (SELECT *, CASE json_type(b) WHEN 'OBJECT' THEN len(json_keys(b)) > 0 WHEN 'ARRAY' THEN json_array_length(b) > 0 WHEN 'VARCHAR' THEN trim(b ->> '$') <> '' WHEN 'NULL' THEN false ELSE b IS NOT NULL END AS has_box FROM tokens1),
flat AS (SELECT * EXCLUDE b, CASE WHEN NOT has_box THEN NULL
  WHEN json_type(b) = 'OBJECT' THEN [{", ".join(_NUMBER.format(f"(b -> '$.{c}')") for c in CORNERS)}]
  WHEN json_type(b) = 'ARRAY' AND json_type(b -> '$[0]') <> 'ARRAY' THEN list_transform(range(0, 4), lambda k: try_cast(json_extract_string(b, '$[' || k || ']') AS DOUBLE))
  WHEN json_type(b) = 'ARRAY' THEN [{", ".join(f"list_{'min' if c.endswith('min') else 'max'}(list_transform(range(0, json_array_length(b)::BIGINT), lambda k: try_cast(json_extract_string(b, '$[' || k || '][{0 if c[0] == 'x' else 1}]') AS DOUBLE)))" for c in CORNERS)}] END AS c FROM boxed)"""

_FIELDS = ", ".join(_TEXT.format(f"(v -> '$.{c}')") + f" AS {c}" for c in ("document_id", "schema_version", "label_schema_version"))
SQL = {
    "p2_found": f"{NESTED} SELECT DISTINCT raw_id, page_index, token_index FROM flat WHERE has_box AND label <> ''",
    "p2_document_rows": f"{NESTED} SELECT raw_id, {_FIELDS} FROM docs",
    "p2_page_rows": f"{NESTED} SELECT raw_id, page_ordinal, page_index, {_NUMBER.format("(p -> '$.image_width')")} AS image_width, {_NUMBER.format("(p -> '$.image_height')")} AS image_height FROM pages",
    "p2_token_rows": f"{NESTED} SELECT raw_id, page_ordinal, page_index, token_ordinal, token_index, text, label, c[1] AS x_min, c[2] AS y_min, c[3] AS x_max, c[4] AS y_max, coalesce(has_box, false) AS has_box FROM flat",
    "p2_unreadable": f"WITH {_TEXTS}, {_WRAPS} SELECT raw_id, CASE WHEN v IS NULL THEN CASE WHEN missing THEN 'missing' ELSE 'not JSON' END ELSE 'not an object' END AS reason FROM r4 JOIN (SELECT raw_id, bool_and(payload IS NULL) AS missing FROM annotation_raw GROUP BY raw_id) USING (raw_id) WHERE coalesce(json_type(v), '') <> 'OBJECT'",
}

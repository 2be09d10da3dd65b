from __future__ import annotations

import json

from quirespark.operators.nested import NestedTables, corners, read_payload, unreadable, whole_number

BOX = {"x_min": 1, "y_min": 2, "x_max": 3, "y_max": 4}


def tables(spark, payloads):
    rows = [(k, p if p is None or isinstance(p, str) else json.dumps(p)) for k, p in enumerate(payloads)]
    df = spark.createDataFrame(rows, "raw_id long, payload string").selectExpr("*", "'x' AS hash", "'y' AS kind")  # clashing names
    return NestedTables(df), df


def found(t):
    return sorted(tuple(r) for r in t.labelled_tokens().collect())


def test_boxes_and_numbers_in_any_form():
    same = (1.0, 2.0, 3.0, 4.0)
    for b in (BOX, [1, 2, 3, 4], ["1", "2", "3", "4"], [[1, 2], [3, 2], [3, 4], [1, 4]], [1, 2, 3, 2, 3, 4, 1, 4], "1,2,3,4", {"x": 1, "y": 2, "width": 2, "height": 2}, [{"x": 1, "y": 2}, {"x": 3, "y": 4}]):
        assert corners(b) == same, b
    assert [corners(b) for b in (None, {}, [], " ")] == [None] * 4
    assert corners({"left": 1}) == (None,) * 4
    assert [whole_number(v) for v in (3, "3", "3.0", 3.0, "x", True, 3.5, None, 1 << 40)] == [3, 3, 3, 3, None, None, None, None, None]


def test_forms_of_payloads(spark):
    token = lambda **k: {"text": "a", "label": "O", "bounding_box": BOX} | k
    page = {"page_index": "2", "tokens": [token(token_index="5"), token()]}
    payloads = [
        {"pages": [page]}, json.dumps(json.dumps({"pages": [page]})), {"res": {"res": {"pages": page}}}, {"pages": {"7": {"tokens": {"4": token(), "3": token(token_index=9)}}}},
        {"pages": [{"lines": [{"tokens": [token(), token()]}, {"tokens": [token()]}], "review": {"tokens_checked": [token()]}}, None, {"tokens": None}]},
        {"pages": [{"tokens": [token(label=None), token(label=""), token(bounding_box={}), token(bounding_box=[]), token(extra=[token()])]}]},
        {}, "[]", "null", "{", None, "", {"pages": None},
    ]
    t, raw = tables(spark, payloads)
    one = [(2, 5), (2, 1)]
    want = sorted([(k, *x) for k in (0, 1, 2) for x in one] + [(3, 7, 4), (3, 7, 9)] + [(4, 0, 0), (4, 0, 1), (4, 0, 2)] + [(5, 0, 4)])
    assert found(t) == want
    assert sorted(r["raw_id"] for r in unreadable(raw).collect()) == [7, 8, 9, 10, 11]
    assert t.documents().count() == 8 and t.pages().count() == 7


def test_equal_objects_are_stored_once_and_every_occurrence_stays(spark):
    token = {"token_index": 0, "text": "a", "label": "O", "bounding_box": BOX}
    page = {"page_index": 0, "tokens": [token, token | {"token_index": 1}]}
    t, _ = tables(spark, [{"document_id": "d", "pages": [page, page | {"page_index": 1}]}, {"pages": [page]}, {"document_id": "d", "pages": [page, page | {"page_index": 1}]}])
    assert [t.objects(k).count() for k in ("box", "token", "page", "document")] == [1, 1, 1, 2]
    assert [t.bridge(k).count() for k in ("box", "token", "page", "document")] == [1, 2, 3, 3]
    assert t.token_places().count() == 10 and t.tokens().where("x_max = 3.0 AND has_box").count() == 10
    assert {r["kind"]: r["occurrences"] for r in t.sharing().collect()} == {"document": 3, "page": 5, "token": 10, "box": 10}


def test_rows_sent_twice_and_empty_tables(spark):
    payload = json.dumps({"pages": [{"tokens": [{"text": "a", "label": "O", "bounding_box": BOX}]}]})
    df = spark.createDataFrame([(1, payload), (1, payload), (None, payload)], "raw_id long, payload string")
    assert found(NestedTables(df)) == [(1, 0, 0)]
    none = NestedTables(df.limit(0))
    assert found(none) == [] and none.tokens().count() == 0 and none.sharing().count() == 0


def test_round_trip_of_a_deep_and_long_payload(spark):
    tokens = [{"token_index": k, "text": "w" * (k % 50), "label": "O", "bounding_box": [k, 0, k + 1, 1]} for k in range(20_000)]
    t, _ = tables(spark, [{"document_id": "d", "pages": [{"page_index": 0, "tokens": tokens}]}, "[" * 100_000])
    back = [(r["token_index"], r["text"], r["x_min"]) for r in t.tokens().orderBy("token_index").select("token_index", "text", "x_min").collect()]
    assert back == [(x["token_index"], x["text"], float(x["bounding_box"][0])) for x in tokens]


def test_texts_that_utf8_cannot_hold(spark):
    t, _ = tables(spark, ['{"pages": [{"tokens": [{"text": "a\\ud800", "label": "O", "bounding_box": [1, 2, 3, 4]}]}]}'])
    assert [r["text"] for r in t.tokens().collect()] == ["a?"]


def test_read_payload_unwraps():
    assert read_payload('{"res": "{\\"pages\\": []}"}') == {"pages": []}

from __future__ import annotations

import itertools
import math
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quirespark.operators import bio, calibration, classification, detection, entities, extraction, layout, manifest, monitoring, pipeline, recognition, tokens


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


PAGE = "document_id string, page_index int, text string"


def test_classifier_needs_whole_phrases_on_one_page(spark):
    pages = [("a", 0, "INVOICE; bill-to: x Invoice Date"), ("b", 0, "already invoiced"), ("c", 0, "amount"), ("c", 1, "due"), ("d", 0, None), ("d", 1, "")]
    got = {r["document_id"]: r for r in classification.classify(spark.createDataFrame(pages, PAGE)).collect()}
    assert got["a"]["label"] == "INVOICE" and got["a"]["decision_score"] == 0.5 and got["a"]["matched_signals"] == ["invoice", "invoice date", "bill to"]
    assert [got[k]["decision_score"] for k in "bcd"] == [0, 0, 0]
    assert classification.classify(spark.createDataFrame([], PAGE)).count() == 0


def test_extraction_keeps_values_and_tokens(spark):
    pages = [
        ("a", 0, "Invoice No: INV-123 x Grand Total: $ 1,234.50 USD"), ("a", 1, "Invoice No: INV-123"), ("b", 0, "Amount Due: 10 Invoice Date: 1/2/24"),
        ("c", 0, "amount due ₹ 99"), ("d", 0, None), ("e", 0, "invoice # AB1 invoice # AB1"), ("f", 0, "\ue000 invoice # AB1"), ("g", 0, "invoice number"),
    ]
    got = rows(extraction.entities(spark.createDataFrame(pages, PAGE)).select("document_id", "page_index", "entity_type", "raw_value", "first_token", "last_token"), "document_id", "page_index", "first_token")
    assert got == [
        ("a", 0, "INVOICE_NUMBER", "INV-123", 2, 2), ("a", 0, "TOTAL_AMOUNT", "$ 1,234.50 USD", 6, 8), ("a", 1, "INVOICE_NUMBER", "INV-123", 2, 2),
        ("b", 0, "TOTAL_AMOUNT", "10 Inv", 2, 3), ("b", 0, "INVOICE_DATE", "1/2/24", 5, 5), ("c", 0, "TOTAL_AMOUNT", "₹ 99", 2, 3), ("e", 0, "INVOICE_NUMBER", "AB1", 2, 2), ("e", 0, "INVOICE_NUMBER", "AB1", 5, 5), ("f", 0, "INVOICE_NUMBER", "AB1", 3, 3),
    ]


def test_extraction_rules_beside_the_native_form(spark):
    rule = (extraction.Rule("middle", "SELLER_NAME", r"by (?P<value>[A-Z]\w+) Ltd"),)
    assert rule[0].tail() is None
    assert rows(extraction.entities(spark.createDataFrame([("a", 0, "sold by Acme Ltd")], PAGE), rule)) == [("a", 0, "SELLER_NAME", "Acme", "middle", [2], 2, 2, 1)]
    native = extraction.spans(spark.createDataFrame([("a", 0, "x Invoice No: INV-123 y")], PAGE)).collect()
    assert [(r["start"], r["value"]) for r in native] == [(14, "INV-123")]
    with pytest.raises(ValueError):
        extraction.Rule("none", "SELLER_NAME", "x(y)")


def test_entities_refer_to_the_tokens_their_values_touch(spark):
    texts = {"a": ["Invoice No:", "INV-123", "x"], "b": ["pay", "Amount Due: $ 12", "USD now"], "c": ["Invoice", None, "", "Date", "1/2", "/24"], "d": ["\ue000", "invoice # AB1", "\ue001"], "e": ["invoice #", "AB1 invoice", "# AB1"]}
    t = spark.createDataFrame([(d, 0, 10 + k, w) for d, own in texts.items() for k, w in enumerate(own)], "document_id string, page_index int, token_index int, text string")
    got = rows(extraction.entities(tokens.page_texts(t, with_tokens=True)).select("document_id", "raw_value", "token_references"), "document_id", "raw_value", "token_references")
    assert got == [("a", "INV-123", [11]), ("b", "$ 12 USD", [11, 12]), ("c", "1/2", [14]), ("d", "AB1", [11]), ("e", "AB1", [11]), ("e", "AB1", [12])] or got == [
        ("a", "INV-123", [11]), ("b", "$ 12 USD", [11, 12]), ("d", "AB1", [11]), ("e", "AB1", [11]), ("e", "AB1", [12])
    ]
    found = {r["document_id"]: r for r in pipeline.infer_tokens(t).collect()}
    assert [e["token_references"] for e in found["b"]["entities"]] == [[11, 12]] and found["b"]["decision_score"] > 0 and len(found) == 5
    both = pipeline.infer_tokens(t, extract=lambda p: extraction.entities(p))  # a stage of one's own
    assert sorted(map(str, both.collect())) == sorted(map(str, found.values()))


RULE_TEXTS = st.text(alphabet="iInNvVoOcCeE:#-. \u0085\u00a0\u001c\u001f\t\n12A\u0130\u017f\u00e9_\ue000", max_size=25)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(RULE_TEXTS, RULE_TEXTS), min_size=1, max_size=20))
def test_the_jvm_finds_what_python_finds(spark, pairs):
    texts = [f"{a}Invoice No{b}A12{a}" for a, b in pairs] + ["invoice no:\x1cA123", "\u00e9invoice no A12", "_invoice no A12", "invoice no\u2003A12"]
    rules = (extraction.RULES[0], extraction.Rule("w", "SELLER_NAME", r"\bno(?P<value>\W*[\w\s]{1,4}.)"))
    assert all(r.tail() for r in rules)
    want = sorted((str(k), n, j, m.start("value"), m.group("value")) for k, t in enumerate(texts) for n, r in enumerate(rules) for j, m in enumerate(re.compile(r.pattern, re.I).finditer(t)))
    got = rows(extraction.spans(spark.createDataFrame([(str(k), 0, t) for k, t in enumerate(texts)], PAGE), rules).select("document_id", "rule", "match", "start", "value"))
    assert sorted(got) == want


def test_words_that_surely_begin_a_match():
    begins = extraction._begins_word
    assert begins("ab") and begins(r"(?:total\s+a|grand)x") and begins(r"(?:p\.?o\.?|(?:a|b)c)")
    assert not any(map(begins, ("", "a?b", "(?:a|b?)x", "(?:ab)?c", "(?:ab", r"\wa", "(?:ab|)c", "[a]b")))


def test_rules_that_the_jvm_treats_differently_stay_in_python():
    for pattern in (r"a$(?P<value>b)", r"(?=a)(?P<value>b)", r"(a)(?P<value>\1)", r"[\W](?P<value>b)", r"a(?P<value>b)c", r"a(?P<value>b\Z)", r"(?P<value>b)(?P<x>c)"):
        assert extraction.Rule("r", "SELLER_NAME", pattern).tail() is None, pattern


TOKEN = "document_id string, page_index int, token_index int, text string, label string"


def test_bio_sequences_and_spans(spark):
    labels = bio.vocabulary(spark)
    assert bio.vocabulary_issues(labels).count() == 0
    t = [("a", 0, i, w, x) for i, (w, x) in enumerate([("Example", "B-SELLER_NAME"), ("Supplies", "I-SELLER_NAME"), ("x", "O"), ("1", "B-INVOICE_NUMBER"), ("2", "B-INVOICE_NUMBER"), (None, "I-INVOICE_NUMBER")])]
    t += [("b", 0, 0, "x", "I-SELLER_NAME"), ("c", 0, 0, "x", "B-SELLER_NAME"), ("c", 0, 1, "y", "I-INVOICE_NUMBER"), ("d", 0, 0, "x", "I-SELLER_NAME"), ("d", 0, 1, "x", "WHAT"), ("e", 0, 0, "x", None)]
    df = spark.createDataFrame(t, TOKEN)
    assert rows(bio.sequence_issues(df, labels).select("document_id", "token_index", "issue"), "document_id") == [("b", 0, "invalid_transition"), ("c", 1, "invalid_transition"), ("d", 1, "unknown_label"), ("e", 0, "unknown_label")]
    assert rows(bio.spans(df, labels).select("entity_type", "raw_value", "first_token", "last_token"), "first_token") == [("SELLER_NAME", "Example Supplies", 0, 1), ("INVOICE_NUMBER", "1", 3, 3), ("INVOICE_NUMBER", "2 ", 4, 5)]
    bad = spark.createDataFrame([(0, "O", "O", None), (2, "B-X", "B", "X"), (3, "X", "I", "Y")], "id int, name string, prefix string, entity_type string")
    assert {r["issue"] for r in bio.vocabulary_issues(bad).collect()} == {"invalid_name", "incomplete_pair", "non_contiguous_ids"}


def test_tokens_offsets_gaps_and_engine_payloads(spark):
    df = spark.createDataFrame([("a", 0, 0, "ab", None), ("a", 0, 1, None, None), ("a", 0, 3, "c", None)], TOKEN)
    assert rows(tokens.offsets(df).select("token_index", "start", "end"), "token_index") == [(0, 0, 2), (1, 3, 3), (3, 4, 5)]
    assert rows(tokens.page_texts(df)) == [("a", 0, "ab  c")]
    assert rows(tokens.gaps(df)) == [("a", 0, 3, 2)]
    schema = "document_id string, result_index int, page_index int, rec_texts array<string>, rec_scores array<double>, rec_boxes array<array<double>>, rec_polys array<array<array<double>>>"
    poly = [[10.0, 20.0], [52.0, 18.0], [50.0, 32.0]]
    pages = spark.createDataFrame([("a", 4, None, [" ", "x", "", "y"], [0.1, 0.2, 0.3, 0.4], None, [poly] * 4), ("a", 0, 5, ["z"], [0.5], [[1.0, 2.0, 3.0, 4.0]], [poly] * 9)]
        # two texts with one polygon, wrong boxes beside polygons that fit, a confidence above 1, an empty box, a null text
        + [(d, k, None, *x) for k, (d, x) in enumerate([("b", (["z"], [], None, None)), ("c", (["z"], [7.0], [[1.0, 2.0, 3.0, 4.0]], None)), ("d", (["z", "y"], [0.5, 0.5], None, [poly])), ("e", (["z"], [0.5], [], [poly])), ("f", (["z"], [0.5], [[1.0, 2.0, 1.0, 4.0]], None)), ("g", ([None], [0.5], [[1.0, 2.0, 3.0, 4.0]], None)), ("h", (["z"], [0.5], [[1.0, 2.0, 3.0]], None)), ("i", ([], [], [], None))])], schema)
    got = rows(tokens.from_engine(pages).select("page_index", "token_index", "text", "bounding_box.x_min", "bounding_box.y_max", "confidence"), "page_index", "token_index")
    assert got == [(4, 0, "x", 10.0, 32.0, 0.2), (4, 1, "y", 10.0, 32.0, 0.4), (5, 0, "z", 1.0, 4.0, 0.5)]
    assert {(r["document_id"], r["issue"]) for r in tokens.engine_issues(pages).collect()} == {("b", "missing_array"), ("c", "invalid_confidence"), ("d", "length_mismatch"), ("e", "length_mismatch"), ("f", "invalid_geometry"), ("g", "invalid_text"), ("h", "invalid_geometry")}
    payloads = ['{"res": {"page_index": 3, "rec_texts": ["x"], "rec_scores": [0.5], "rec_boxes": [[1, 2, 3, 4]]}}', '{"rec_texts": ["x", " "], "rec_scores": [1, 0], "rec_boxes": [[[1, 2], [3, 2], [3, 4]], [[0, 0]]]}', '{"rec_texts": ["x"], "rec_scores": [0.5], "rec_polys": [[[1, 2], [3, 2], [3, 4]]]}', '{"rec_texts": "x"}', "[]", "{"]
    results = tokens.engine_pages(spark.createDataFrame([("p", k, p) for k, p in enumerate(payloads)], "document_id string, result_index int, payload string"))
    assert rows(tokens.from_engine(results).select("page_index", "token_index", "bounding_box.x_min", "bounding_box.y_max"), "page_index") == [(1, 0, 1.0, 4.0), (2, 0, 1.0, 4.0), (3, 0, 1.0, 4.0)]
    assert [r["issue"] for r in tokens.engine_issues(results).orderBy("result_index").collect()] == ["missing_array"] * 3
    names = tokens.with_document_ids(spark.createDataFrame([("file:/a/b.pdf", None), ("c.png", "own"), ("/x/d", "")], "path string, document_id string"))
    assert [r["document_id"] for r in names.collect()] == ["b.pdf", "own", "d"]


def brute_matching(options):
    refs = sorted({r for o in options for r in o})
    return max((sum(r is not None and r in o for o, r in zip(options, p)) for k in range(1) for p in itertools.permutations(refs + [None] * len(options), len(options))), default=0) if options else 0


def test_matching_is_of_maximum_size():
    random.seed(3)
    for _ in range(120):
        options = [random.sample(range(4), random.randint(0, 3)) for _ in range(random.randint(0, 4))]
        got = detection.assign(options)
        assert len({r for r, _ in got}) == len(got) == len({p for _, p in got}) and all(r in options[p] for r, p in got)
        assert len(got) == brute_matching(options)
    assert len(detection.assign([[k, k + 1] for k in range(3000)] + [[0]])) == 3001


def test_detection_metrics(spark):
    b = lambda x: (float(x), 0.0, float(x) + 10, 10.0)
    schema = "sample_id string, reference_boxes array<struct<x_min:double,y_min:double,x_max:double,y_max:double>>, predicted_boxes array<struct<x_min:double,y_min:double,x_max:double,y_max:double>>, cohorts array<string>"
    df = spark.createDataFrame([("a", [b(0), b(30)], [b(0), b(1), b(60)], ["x"]), ("b", [], [], ["y"]), ("c", None, [b(0)], None)], schema)
    got = {r["cohort"]: r for r in detection.metrics(df).collect()}
    assert (got["x"]["true_positives"], got["x"]["false_positives"], got["x"]["false_negatives"]) == (1, 2, 1)
    assert got["y"]["precision"] is None and got["y"]["f1"] is None
    assert (got[None]["false_positives"], got[None]["sample_count"]) == (3, 3)
    with pytest.raises(ValueError):
        detection.matched(df, 0)


def test_recognition_metrics_and_ranking(spark):
    schema = "sample_id string, reference string, prediction string, identifier_type string, cohorts array<string>"
    df = spark.createDataFrame([("1", "INV-001", "INV-OO1", "INVOICE_NUMBER", ["c1"]), ("2", "hello world", "hello world", None, ["c2", "c2"]), ("3", "a", None, None, ["c1"])], schema)
    got = {r["cohort"]: r for r in recognition.metrics(df).collect()}
    assert got[None]["character_edits"] == 2 and got[None]["cer"] == pytest.approx(2 / 18) and got[None]["wer"] == pytest.approx(1 / 3) and got[None]["identifier_exact_match_rate"] == 0
    assert got["c2"]["identifier_exact_match_rate"] is None and got["c2"]["sample_count"] == 1
    observed = recognition.observations(df)
    assert rows(recognition.ranking(observed).where("cohort IS NULL").select("category", "affected_samples", "occurrences", "rank"), "rank") == [("character_substitution", 1, 2, 1), ("identifier_mismatch", 1, 1, 2)]
    assert {r["cohort"]: r["affected_samples"] for r in recognition.slice_sizes(df, observed).collect()} == {None: 1, "c1": 1, "c2": 0}


def test_classification_metrics(spark):
    schema = "sample_id string, reference string, prediction string, cohorts array<string>"
    i, n = classification.LABELS
    df = spark.createDataFrame([("1", i, i, ["x"]), ("2", i, n, ["x"]), ("3", n, i, []), ("4", n, n, None), ("5", i, i, ["y"])], schema)
    four = df.where("sample_id != '5'")
    s = {r["cohort"]: r for r in classification.summary(four).collect()}
    assert s[None]["accuracy"] == 0.5 and s[None]["macro_f1"] == 0.5
    m = {(r["cohort"], r["label"]): r for r in classification.class_metrics(df).collect()}
    assert m["y", n]["f1"] is None and {r["cohort"]: r["macro_f1"] for r in classification.summary(df).collect()}["y"] == 1.0
    assert classification.confusion(df).where("cohort = 'y'").count() == 4


def test_entity_metrics(spark):
    schema = "sample_id string, side string, entity_type string, raw_value string, page_index int, first_token int, last_token int, cohorts array<string>"
    r, p = "reference", "predicted"
    df = spark.createDataFrame([("s", r, "A", "x y", 0, 0, 1, ["c"]), ("s", p, "A", "x y", 0, 0, 1, ["c"]), ("s", r, "B", "z", 0, 3, 3, ["c"]), ("s", p, "B", "z", 0, 3, 4, ["c"]), ("t", r, "A", "q", 0, 0, 0, []), ("t", p, "B", "q", 0, 0, 0, [])], schema)
    key = lambda f: {(x["cohort"], x["entity_type"]): x for x in f(df).collect()}
    t, e, f = key(entities.token_metrics), key(entities.span_metrics), key(entities.field_metrics)
    assert (t["c", "ALL"]["true_positives"], t["c", "ALL"]["false_positives"], t["c", "ALL"]["false_negatives"]) == (3, 1, 0)
    assert (e["c", "ALL"]["true_positives"], e["c", "ALL"]["false_positives"]) == (1, 1)
    assert e["c", "B"]["f1"] == 0.0
    assert (f["c", "ALL"]["exact"], f["c", "ALL"]["fields"]) == (2, 2) and (f[None, "ALL"]["exact"], f[None, "ALL"]["fields"]) == (2, 4)
    twice = df.where("sample_id = 's'").unionByName(df.where("first_token = 3 AND side = 'reference'"))
    assert rows(entities.overlapping(twice)) == [("s", "reference", 0, 3, 2)]


def logits(spark, data):
    return spark.createDataFrame([(str(k), z, y, ["c"]) for k, (z, y) in enumerate(data)], "sample_id string, logits array<double>, target_index int, cohorts array<string>")


def mean_nll(data, t):
    return sum(math.log(sum(math.exp((v - max(z)) / t) for v in z)) + (max(z) - z[y]) / t for z, y in data) / len(data)


def test_calibration(spark):
    df = logits(spark, [([0.0, 0.0], 0), ([0.0, 0.0], 1)])
    m = calibration.metrics(df, bins=5).where("cohort IS NULL").first()
    assert m["brier"] == 0.5 and m["accuracy"] == 0.5 and m["ece"] == 0
    bins = calibration.reliability(df, bins=5).collect()
    assert len(bins) == 5 and sum(b["sample_count"] for b in bins) == 2 and [b["accuracy"] for b in bins if not b["sample_count"]] == [None] * 4
    data = [([4.0, 0.0], 0)] * 7 + [([4.0, 0.0], 1)] * 3
    fit = calibration.fit_temperature(logits(spark, data))
    best = min((mean_nll(data, math.exp(x / 2000)), math.exp(x / 2000)) for x in range(-5000, 4600))
    assert fit.temperature == pytest.approx(best[1], rel=1e-3) and fit.nll_after == pytest.approx(best[0], abs=1e-7) and fit.temperature > 1
    assert calibration.fit_temperature(logits(spark, [([0.2, 0.0], 0)] * 9 + [([0.2, 0.0], 1)])).temperature < 1
    with pytest.raises(ValueError):
        calibration.check_samples(logits(spark, [([0.0, 1.0], 2)]))
    with pytest.raises(ValueError):
        calibration.check_samples(logits(spark, []))


BOX = "struct<x_min:double,y_min:double,x_max:double,y_max:double>"


def test_annotation_issues(spark):
    schema = f"document_id string, page_index int, token_index int, text string, bounding_box {BOX}, label string, image_width int, image_height int"
    df = spark.createDataFrame([("a", 1, 0, " ", (0.0, 0.0, 200.0, 10.0), "I-SELLER_NAME", 100, 100), ("a", 1, 2, "x", (5.0, 0.0, 5.0, 10.0), "O", 100, 100), ("a", 1, 3, "y", None, "O", 100, 100)], schema)
    got = rows(layout.annotation_issues(df, bio.vocabulary(spark)).select("code", "token_index"), "code", "token_index")
    assert got == [("blank_token_text", 0), ("box_outside_page", 0), ("invalid_bio_sequence", 0), ("invalid_bounding_box", 2), ("invalid_bounding_box", 3), ("non_contiguous_page_index", None), ("non_contiguous_token_index", 2), ("non_contiguous_token_index", 3)]


def test_alignment(spark):
    z = lambda n: F.array(*[F.struct(*[F.lit(k).alias(c) for c in ("x_min", "y_min", "x_max", "y_max")]) for k in range(1, n + 1)])
    ids = F.array(*[F.lit(v).cast("int") for v in (None, 0, None, 0, 1, None)])
    out = spark.range(1).select(layout.aligned(ids, z(2), F.array(F.lit(1), F.lit(0)), F.array(F.lit(2), F.lit(0))).alias("p")).first()["p"]
    assert [x["label_id"] for x in out] == [-100, 1, -100, 2, 0, -100] and out[0]["box"]["x_min"] == 0 and out[4]["box"]["x_min"] == 2
    issue = lambda v, n, cut: spark.range(1).select(layout.encoding_issue(F.array(*[F.lit(x).cast("int") for x in v]), F.array(*[F.lit("w")] * n), F.lit(cut)).alias("x")).first()["x"]
    assert [issue((None, 0, 1), 2, False), issue((0, 2), 3, False), issue((1, 0), 2, False), issue((0,), 2, False), issue((0,), 2, True), issue((0, 1), 2, True), issue((5,), 2, False)] == [None, "skipped_word", "decreasing", "missing_words", None, "nothing_truncated", "outside_page"]


def test_manifest_checks(spark):
    art = "struct<uri:string,sha256:string,media_type:string,size_bytes:bigint>"
    schema = f"manifest_name string, pos long, id string, split string, groups map<string,string>, document {art}, annotation {art}"
    good = ("a.txt", "2cf24dba5fb0a30e26e83b2ac5b9e29e1b161e5c1fa7425e73043362938b9824", "text/plain", 5)
    note = lambda u: (u, "0" * 64, "application/json", None)
    data = [("m", 0, "r0", "train", {"k": "g"}, good, None), ("m", 1, "r1", "train", {"k": "g"}, good, note("b.json")), ("m", 2, "r2", "test", {"k": "g"}, ("..%2Fx", "", "", None), note("e.json")), ("m", 3, "r2", "test", None, ("none", "", "", None), note("c.json")), ("m", 4, "r4", "train", {"k": "g"}, ("s3://x", "", "", None), note("n.json"))]
    heads = spark.createDataFrame([("m", ("grouped", ["k"]))], "name string, split_strategy struct<method:string,grouping_keys:array<string>>")
    files = spark.createDataFrame([("a.txt", b"hello"), ("b.json", b"{"), ("e.json", b" {} "), ("c.json", b""), ("n.json", b'{"a": NaN}')], "path string, content binary")
    df = spark.createDataFrame(data, schema)
    got = rows(manifest.issues(df, heads, files).select("phase", "pos", "code"), "phase", "pos", "code")
    assert got == [
        (1, 1, "duplicate_artifact"), (1, 3, "duplicate_record_id"), (2, 2, "split_leakage"), (2, 3, "missing_group_value"),
        (3, 1, "checksum_mismatch"), (3, 1, "corrupt_annotation"), (3, 2, "checksum_mismatch"), (3, 2, "empty_annotation"), (3, 2, "unsupported_artifact_uri"),
        (3, 3, "checksum_mismatch"), (3, 3, "empty_artifact"), (3, 3, "missing_artifact"), (3, 4, "checksum_mismatch"), (3, 4, "unsupported_artifact_uri"),
    ]
    assert rows(manifest.split_leaks(df, heads).select("pos", "first_id")) == [(2, "r1")]
    with pytest.raises(manifest.DatasetValidationError):
        manifest.assert_valid(manifest.issues(df, heads))
    manifest.assert_valid(manifest.issues(df.limit(0), heads))


def test_pipeline_and_telemetry(spark):
    t = [("a", 0, k, w) for k, w in enumerate("Invoice No: INV-1 tax subtotal".split())] + [("b", 0, 0, "x")]
    df = spark.createDataFrame(t, "document_id string, page_index int, token_index int, text string").withColumn("confidence", F.lit(0.5))
    found = pipeline.infer_tokens(df)
    got = {r["document_id"]: r for r in found.collect()}
    assert got["a"]["label"] == "INVOICE" and got["a"]["entities"][0]["raw_value"] == "INV-1" and got["b"]["entities"] == []
    records = pipeline.telemetry(found, df)
    assert records.count() == 8 and records.where("document_id IS NOT NULL").count() == 0
    assert rows(records.where("stage = 'ocr'").select("output_count", "mean_confidence"), "output_count") == [(1, 0.5), (5, 0.5)]


def test_monitoring_contract(spark):
    schema = "record_id int, stage string, status string, duration_seconds double, model_name string, model_version string, model_source string, output_count long, output_categories array<string>, mean_confidence double, error_type string"
    ok = ("ocr", "SUCCESS", 1.0, "m", "1", "s", 1, ["a"], 0.5, None)
    bad = [(1, *ok), (2, *ok[:2], -1.0, *ok[3:]), (3, *ok[:3], None, *ok[4:]), (4, *ok[:6], 1, ["a", "a"], 2.0, "E"), (5, "ocr", "ERROR", 1.0, None, None, None, 1, [], None, None)]
    got = rows(monitoring.record_issues(spark.createDataFrame(bad, schema)), "record_id", "issue")
    assert got == [(2, "invalid_duration"), (3, "partial_model_identity"), (4, "duplicate_categories"), (4, "invalid_confidence"), (4, "success_with_error_type"), (5, "error_with_outputs"), (5, "missing_error_type")]


def test_monitoring_window_p95(spark, monkeypatch):
    from quirespark.plans import catalogue

    df = spark.createDataFrame([(k / 100, "OCR", "SUCCESS") for k in range(1, 101)], "duration_seconds double, stage string, status string").withColumn("ts", F.timestamp_seconds(F.lit(0)))
    monkeypatch.setattr(catalogue.fx, "monitoring", lambda s, d: df)
    assert [(r["records"], r["errors"], r["p95_duration"]) for r in catalogue.queries()["monitoring_window_p95"](spark, "").collect()] == [(100, 0, 0.95)]


def test_hot_keys(spark):
    from quirespark.operators import keys

    rng = random.Random(1)
    data = [(rng.choice(["hot", "hot", "a", "b"]), k, rng.choice([None, f"v{k}"])) for k in range(300)] + [(None, 999, "x")]
    df = spark.createDataFrame(data, "k string, pos long, v string")
    want = sorted((k, p, min(q for j, q, _ in data if j == k)) for k, p, _ in data if k)
    for hub in (10**6, 5):  # light keys, hubs
        assert rows(keys.with_least(df, ["k"], "pos", "m", 300, hub).select("k", "pos", "m"), "k", "pos") == want
    last = {}
    seen = []
    for k, p, v in data:
        if k:
            seen.append((k, p, last.get(k)))
            last[k] = v or last.get(k)
    for block in (4, 10**6):
        assert rows(keys.with_last_before(df, ["k"], "pos", F.col("v"), "m", block).select("k", "pos", "m"), "k", "pos") == sorted(seen)

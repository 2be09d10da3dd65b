from __future__ import annotations

import copy
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from quirespark import cli, session
from quirespark.operators import bio, calibration, classification, contracts, entities, extraction, layout, manifest, pipeline
from quirespark.plans import reports
from quirespark.sources import config, readers, schemas, writers

ARTIFACT = {"uri": "a.json", "sha256": "0" * 64, "media_type": "application/json"}
MANIFEST = {
    "schema_version": "1.0.0", "name": "set-1", "version": "1.0.0", "created_at": "2024-01-02T03:04:05Z", "tasks": ["ocr_detection"], "sources": [{"name": "s", "version": "1"}],
    "split_strategy": {"method": "grouped", "grouping_keys": ["site"]}, "records": [{"id": "r.1", "split": "test", "document": ARTIFACT, "groups": {"site": "x"}}],
}
TOKEN = {"token_index": 0, "text": "a", "bounding_box": {"x_min": 0, "y_min": 0, "x_max": 1, "y_max": 1.5}, "label": "O"}
ANNOTATION = {"schema_version": "1.0.0", "label_schema_version": "1.0.0", "source_ocr_schema_version": "1.0.0", "document_id": "d", "pages": [{"page_index": 0, "image_width": 1, "image_height": 1, "tokens": [TOKEN]}]}


def changed(value, path, new):
    value = copy.deepcopy(value)
    at = value
    for p in path[:-1]:
        at = at[p]
    if new is ...:
        del at[path[-1]]
    else:
        at[path[-1]] = new
    return value


@pytest.mark.parametrize(("path", "new", "want"), [
    (("name",), ..., [("$", "required")]), (("name",), "Set", [("$.name", "pattern")]), (("name",), 3, [("$.name", "type")]), (("more",), 1, [("$", "additionalProperties")]), (("version",), "1.0", [("$.version", "pattern")]),
    (("created_at",), "2024-13-02T03:04:05Z", [("$.created_at", "format")]), (("created_at",), "2024-01-02 03:04", [("$.created_at", "pattern")]), (("tasks",), [], [("$.tasks", "minItems")]), (("tasks",), ["x", "ocr_detection", "ocr_detection"], [("$.tasks", "uniqueItems"), ("$.tasks[0]", "enum")]),
    (("split_strategy", "grouping_keys"), ..., [("$.split_strategy", "required")]), (("split_strategy", "grouping_keys"), [], [("$.split_strategy.grouping_keys", "minItems")]), (("split_strategy", "method"), "manual", []), (("split_strategy", "random_seed"), -1, [("$.split_strategy.random_seed", "minimum")]),
    (("records", 0, "groups"), {}, [("$.records[0].groups", "minProperties")]), (("records", 0, "groups", "Bad"), "x", [("$.records[0].groups", "pattern")]), (("records", 0, "groups", "site"), "", [("$.records[0].groups.site", "minLength")]), (("records", 0, "document", "size_bytes"), 1.5, [("$.records[0].document.size_bytes", "type")]),
    (("records", 0, "document", "size_bytes"), 2.0, []), (("records", 0, "document", "size_bytes"), True, [("$.records[0].document.size_bytes", "type")]), (("records", 0, "cohorts"), ["a", "a"], [("$.records[0].cohorts", "uniqueItems")]), (("records",), {}, [("$.records", "type")]), (("description",), "", [("$.description", "minLength")]),
])
def test_manifest_schema(path, new, want):
    schema = schemas.manifest_schema()
    schemas.check_schema(schema)
    assert schemas.violations(MANIFEST, schema) == []
    assert schemas.violations(changed(MANIFEST, path, new), schema) == want


def test_annotation_schema_and_its_order():
    schema = schemas.annotation_schema()
    assert schemas.violations(ANNOTATION, schema) == []
    bad = changed(changed(changed(ANNOTATION, ("pages", 0, "tokens"), [changed(TOKEN, ("label",), "B-X")] * 11), ("document_id",), "d" * 257), ("pages", 0, "image_width"), 0)
    got = schemas.violations(bad, schema)
    assert got[0] == ("$.document_id", "maxLength") and got[1] == ("$.pages[0].image_width", "minimum")
    assert [x[0] for x in got[2:5]] == ["$.pages[0].tokens[0].label", "$.pages[0].tokens[1].label", "$.pages[0].tokens[10].label"]  # parts are ordered as texts
    assert schemas.violations(changed(ANNOTATION, ("pages", 0, "tokens", 0, "bounding_box", "x_max"), 0), schema) == [("$.pages[0].tokens[0].bounding_box.x_max", "exclusiveMinimum")]
    for bad in ([], {"oneOf": []}, {"properties": {"a": {"pattern": "("}}}):
        with pytest.raises(Exception):  # noqa: B017, PT011
            schemas.check_schema(bad)


def test_files_of_manifests_and_annotations(spark, tmp_path):
    content = {"a.json": b'{"a": 1}', "b.json": b""}
    for name, data in content.items():
        (tmp_path / "root").mkdir(exist_ok=True)
        (tmp_path / "root" / name).write_bytes(data)
    good = changed(MANIFEST, ("records",), [{"id": f"r{k}", "split": s, "groups": {"site": "x"}, "document": ARTIFACT | {"uri": u, "sha256": hashlib.sha256(content[u]).hexdigest()}} for k, (s, u) in enumerate([("test", "a.json"), ("training", "b.json")])])
    (tmp_path / "m").mkdir()
    for name, text in {"good": json.dumps(good), "nested": json.dumps(changed(good, ("records", 0, "document", "more"), 1)), "list": "[]", "bad": "{", "none": ""}.items():
        (tmp_path / "m" / f"{name}.json").write_text(text)
    got = {(r["path"].rsplit("/", 1)[1], r["phase"], r["code"], r["location"]) for r in readers.validate_manifests(spark, str(tmp_path / "m"), str(tmp_path / "root")).collect()}
    assert got == {
        ("good.json", 2, "split_leakage", "$.records[1].groups.site"), ("good.json", 3, "empty_artifact", "$.records[1].document"), ("nested.json", 0, "schema_violation", "$.records[0].document"), ("list.json", 0, "invalid_manifest_file", "$"),
        ("bad.json", 0, "invalid_manifest_file", "$"), ("none.json", 0, "invalid_manifest_file", "$"),
    }
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.json").write_text(json.dumps(changed(ANNOTATION, ("pages", 0, "tokens", 0, "extra"), 1)))
    assert [tuple(r)[1:] for r in readers.annotation_file_issues(spark, str(tmp_path / "a")).collect()] == [("schema_violation", "$.pages[0].tokens[0]", "additionalProperties")]


def test_typed_manifest_tables(spark):
    artifact = "struct<uri:string,sha256:string,media_type:string,size_bytes:bigint>"
    rows = [
        ("a", 0, "r1", "test", ["ok", "ok", None, "No"], {"k": "v", "Bad": None}, ("u", "0" * 64, "a/b", -1), None), ("a", 1, None, "dev", None, {}, None, ("", "x", None, None)), ("a", 2, "-", None, [], None, ("u", None, "a/b", 0), None),
    ]
    records = spark.createDataFrame(rows, f"manifest_name string, pos long, id string, split string, cohorts array<string>, groups map<string,string>, document {artifact}, annotation {artifact}").withColumn("location", F.lit("clash"))
    head = "schema_version string, name string, version string, created_at string, tasks array<string>, sources array<struct<name:string,version:string,license:string>>, split_strategy struct<method:string,grouping_keys:array<string>,random_seed:bigint>"
    heads = spark.createDataFrame([("2", "a", "1", None, ["x", "x"], [], ("grouped", [], -1)), ("1.0.0", "B", "1.0.0", "t", ["ocr_detection"], [("", None, None), None], ("grouped", None, 0)), (None,) * 7], head)
    got = {(r["manifest_name"], r["location"], r["keyword"]) for r in manifest.schema_issues(records, heads).collect()}
    at = lambda k: f"$.records[{k}]"
    assert {x[1:] for x in got if x[0] == "a" and "records" in x[1]} == {
        (f"{at(0)}.cohorts", "uniqueItems"), (f"{at(0)}.cohorts[2]", "type"), (f"{at(0)}.cohorts[3]", "pattern"), (f"{at(0)}.groups", "pattern"), (f"{at(0)}.groups.Bad", "type"), (f"{at(0)}.document.size_bytes", "minimum"),
        (at(1), "required"), (f"{at(1)}.split", "enum"), (f"{at(1)}.groups", "minProperties"), (f"{at(1)}.annotation", "required"), (f"{at(1)}.annotation.uri", "minLength"), (f"{at(1)}.annotation.sha256", "pattern"), (f"{at(2)}.id", "pattern"), (at(2), "required"), (f"{at(2)}.document", "required"),
    }
    assert {x[1:] for x in got if x[0] == "a" and "records" not in x[1]} == {("$.schema_version", "const"), ("$.version", "pattern"), ("$", "required"), ("$.tasks", "uniqueItems"), ("$.tasks[0]", "enum"), ("$.tasks[1]", "enum"), ("$.sources", "minItems"), ("$.split_strategy.grouping_keys", "minItems"), ("$.split_strategy.random_seed", "minimum")}
    assert {x[1:] for x in got if x[0] == "B"} == {("$.name", "pattern"), ("$.sources[0]", "required"), ("$.sources[0].name", "minLength"), ("$.sources[1]", "type"), ("$.split_strategy", "required"), ("$.records", "minItems")}
    both = manifest.issues(records, heads, schema=True)
    assert {r["phase"] for r in both.collect()} == {0}  # a manifest that breaks its schema has no other issues
    assert manifest.schema_issues(records.limit(0), heads.limit(0)).count() == 0
    ordered = both.where("manifest_name = 'a'").orderBy(manifest.path_parts(F.col("location"))).select("location").collect()
    assert ordered[0]["location"] == "$" and ordered[1]["location"].startswith("$.records[0]")


def test_artifact_paths_and_json(spark):
    artifact = "struct<uri:string,sha256:string,media_type:string,size_bytes:bigint>"
    files = {"a/y.json": b'{"a": 1, "a": NaN}', "blank.json": b'" "', "hollow.json": b" [ ] ", "bom.json": b'\xef\xbb\xbf{"a": 1}', "utf16.json": '{"a": 1}'.encode("utf-16"), "cut.json": b"[1,]", "zero.json": b"", "a b+c.json": b"0", "image.json": b"\x89PNG"}
    want = {
        "./a/y.json": [], "b/../a/y.json": [], "a//y.json": [], "a/y.json/": [], "a%2Fy.json": [], "?x": ["unsupported_artifact_uri"], "a/y.json?": [], "a/y.json#": [], "a/y.json#x": ["unsupported_artifact_uri"], "../a/y.json": ["unsupported_artifact_uri"], "a/../../y": ["unsupported_artifact_uri"],
        "file:a": ["unsupported_artifact_uri"], "//h/a": ["unsupported_artifact_uri"], "/a/y.json": ["unsupported_artifact_uri"], "a\\y.json": ["unsupported_artifact_uri"], "": ["unreadable_artifact"], ".": ["unreadable_artifact"], "a": ["unreadable_artifact"], "x" * 300: ["unreadable_artifact"], "x/" * 3000: ["unreadable_artifact"],
        "absent.json": ["missing_artifact"], "a%20b+c.json": [], "blank.json": [], "hollow.json": ["empty_annotation"], "bom.json": [], "utf16.json": [], "cut.json": ["corrupt_annotation"], "zero.json": ["empty_artifact"], "image.json": ["corrupt_annotation"], "%zz": ["missing_artifact"],
    }
    sums = {u: hashlib.sha256(files.get(n, b"")).hexdigest() for u, n in zip(want, ["a/y.json"] * 8) } | {u: hashlib.sha256(c).hexdigest() for u, c in files.items()} | {"a%20b+c.json": hashlib.sha256(b"0").hexdigest()}
    records = spark.createDataFrame([("m", k, str(k), None, (u, sums.get(u, "0"), "application/json", None)) for k, u in enumerate(want)], f"manifest_name string, pos long, id string, document {artifact}, annotation {artifact}")
    contents = spark.createDataFrame([(p, bytearray(c)) for p, c in files.items()], "path string, content binary")
    got = {u: [] for u in want}
    for r in manifest.artifact_issues(records, contents).collect():
        got[r["uri"]].append(r["code"])
    assert got == want or {u: (got[u], want[u]) for u in want if got[u] != want[u]} == {}


def test_contracts(spark):
    box = "struct<x_min:double,y_min:double,x_max:double,y_max:double>"
    good = (0.0, 0.0, 1.0, 1.0)
    rows = [("d", 0, 0, "a", good, None), ("d", 0, 2, " ", good, 1.5), ("d", 0, 3, "b", None, float("nan")), (" ", -1, 0, "c", good, 1.0)]
    got = {(r["token_index"], r["issue"]) for r in contracts.ocr_token_issues(spark.createDataFrame(rows, f"document_id string, page_index int, token_index int, text string, bounding_box {box}, confidence double")).collect()}
    assert got == {(2, "blank_text"), (2, "non_contiguous_tokens"), (2, "invalid_confidence"), (3, "invalid_box"), (3, "invalid_confidence"), (0, "blank_document_id"), (0, "invalid_page_index")}
    pages = spark.createDataFrame([("a", 0), ("a", 2), ("a", 2), ("a", 3), ("b", 0)], "document_id string, page_index int")
    assert [tuple(r) for r in contracts.page_gaps(pages).collect()] == [("a", 2, "non_contiguous_pages")]
    decisions = spark.createDataFrame([("a", "INVOICE", 0.3, 0.3, ["x"]), ("b", "INVOICE", 0.2, 0.3, ["x", "x"]), ("c", "X", None, 0.0, [""])], "document_id string, label string, decision_score double, decision_threshold double, matched_signals array<string>")
    got = {(r["document_id"], r["issue"]) for r in contracts.classification_issues(decisions).collect()}
    assert got == {("b", "label_disagrees"), ("b", "repeated_signal"), ("c", "unknown_label"), ("c", "invalid_score"), ("c", "invalid_threshold"), ("c", "empty_signal")}
    spans = spark.createDataFrame([("d", 0, "X", "a", 0, 1, [0, 1]), ("d", 0, "X", " ", 2, 1, [2]), ("d", 0, None, "a", 3, 5, [3, 5])], "document_id string, page_index int, entity_type string, raw_value string, first_token int, last_token int, token_references array<int>")
    assert {(r["first_token"], r["issue"]) for r in contracts.span_issues(spans).collect()} == {(2, "blank_value"), (2, "invalid_tokens"), (3, "unknown_entity_type"), (3, "not_contiguous")}
    assert contracts.entity_issues(extraction.entities(spark.createDataFrame([("a", 0, "invoice # AB1")], "document_id string, page_index int, text string"))).count() == 0


def test_tokenizers_are_plugged_in_and_checked(spark):
    box = "struct<x_min:double,y_min:double,x_max:double,y_max:double>"
    rows = [("d", p, k, "word" * (k + 1), (0.0, 0.0, 5.0, 5.0), "B-SELLER_NAME" if k == 0 else "I-SELLER_NAME", 10, 10) for p in range(2) for k in range(3)]
    tokens = spark.createDataFrame(rows, f"document_id string, page_index int, token_index int, text string, bounding_box {box}, label string, image_width int, image_height int")
    labels = bio.vocabulary(spark)
    assert [r["n_pieces"] for r in layout.page_features(tokens, labels).collect()] == [8, 8]
    assert [(r["n_pieces"], r["truncated"]) for r in layout.page_features(tokens, labels, max_length=5).collect()] == [(5, True)] * 2
    one = lambda ids, cut: lambda words, most: F.struct(F.array(*[F.lit(x).cast("int") for x in ids]).alias("word_ids"), F.lit(cut).alias("truncated"))
    for ids, cut, issue in (([None, 0, 1, 2, None], False, None), ([0] * 600, False, "exceeds_max_length"), ([], False, "empty_output"), ([None], False, "no_source_words"), ([0, 2], True, "skipped_word"), ([0, 3], False, "outside_page"), ([1, 0], True, "decreasing"), ([0, 1], False, "missing_words"), ([0, 1, 2], True, "nothing_truncated")):
        issues = layout.feature_issues(tokens, labels, tokenizer=one(ids, cut)).collect()
        assert {r["issue"] for r in issues} == ({issue} if issue else set())
        assert layout.page_features(tokens, labels, tokenizer=one(ids, cut)).count() == (0 if issue else 2)


def test_entities_of_every_type_and_sample(spark):
    samples = spark.createDataFrame([("a", ["x"]), ("b", ["y"]), ("c", None)], "sample_id string, cohorts array<string>")
    spans = spark.createDataFrame([("a", s, "SELLER_NAME", "v", 0, 0, 1, ["wrong"]) for s in ("reference", "predicted")] + [("gone", "reference", "SELLER_NAME", "v", 0, 0, 1, None)], "sample_id string, side string, entity_type string, raw_value string, page_index int, first_token int, last_token int, cohorts array<string>")
    got = {(r["cohort"], r["entity_type"]): r for r in entities.evaluation(samples, spans).collect()}
    assert len(got) == 3 * 6 and got[None, "ALL"]["sample_count"] == 3 and got[None, "ALL"]["token_true_positives"] == 2 and got["y", "SELLER_NAME"]["entity_false_negatives"] == 0
    assert got["y", "ALL"]["exact_match_rate"] is None and got["x", "SELLER_NAME"]["exact_match_rate"] == 1.0 and got[None, "TOTAL_AMOUNT"]["entity_f1"] is None


LOGITS = "sample_id string, logits array<double>, target_index int, cohorts array<string>"


def test_calibration_artifact(spark):
    samples = spark.createDataFrame([(str(k), [3.0 * (k % 4 != 0), 3.0 * (k % 4 == 0)], k % 2, ["c"]) for k in range(40)], LOGITS)
    origin = {"base_model_name": "m", "base_model_version": "1", "calibration_dataset_name": "d", "calibration_dataset_version": "1.0.0", "source_commit": "b" * 64, "config_version": "1.0.0"}
    a = calibration.fitted_artifact(samples, origin)
    assert a.metrics_after["nll"] <= a.metrics_before["nll"] and len(a.to_dict()["metrics_after"]["reliability_bins"]) == 15 and json.dumps(a.to_dict())
    for bad in ({"temperature": a.temperature + 1}, {"method": "x"}, {"base_model_name": " "}, {"source_commit": "b"}, {"metrics_before": a.metrics_before | {"sample_count": 1}}):
        with pytest.raises(ValueError):
            calibration.Artifact(**(a.__dict__ | bad))
    uneven = samples.unionByName(spark.createDataFrame([("x", [1.0, 2.0, 3.0], 0, None)], LOGITS))
    infinite = spark.createDataFrame([("x", [1.0, float("inf")], 0, None)], LOGITS)
    for wrong in (samples.limit(0), uneven, infinite):
        for measure in (calibration.metrics, calibration.reliability, calibration.fit_temperature):
            with pytest.raises(ValueError):
                measure(wrong)
    with pytest.raises(ValueError):
        calibration.metrics(samples, bins=1)


ORIGIN = reports.Provenance("set-1", "1.0.0", "m", "2", "a" * 40)


def test_the_five_reports(spark):
    rec = spark.createDataFrame([("1", "ab", "ax", None, ["z"]), ("2", "ab", "ab", "ID", [])], "sample_id string, reference string, prediction string, identifier_type string, cohorts array<string>")
    box = "array<struct<x_min:double,y_min:double,x_max:double,y_max:double>>"
    det = spark.createDataFrame([("1", [(0.0, 0.0, 1.0, 1.0)], [], ["y"])], f"sample_id string, reference_boxes {box}, predicted_boxes {box}, cohorts array<string>")
    got = reports.as_dict(reports.report("ocr", ORIGIN, reports.ocr_sections(rec, det, 0.7)))
    assert [s["cohort"] for s in got["slices"]] == ["y", "z"] and got["aggregate"]["detection"][0]["iou_threshold"] == 0.7 and got["slices"][0]["recognition"] is None
    assert list(reports.ocr_sections(rec)) == ["recognition"] and list(reports.ocr_sections(None, det)) == ["detection"]
    errors = reports.as_dict(reports.report("errors", ORIGIN, reports.error_sections(rec, det)))["aggregate"]
    assert {e["category"] for e in errors["errors"]} == {"character_substitution", "missed_region"} and errors["samples"][0]["affected_samples"] == 2
    lab = spark.createDataFrame([("1", "INVOICE", "NOT_INVOICE", ["c"])], "sample_id string, reference string, prediction string, cohorts array<string>")
    assert len(reports.as_dict(reports.report("classification", ORIGIN, reports.classification_sections(lab)))["aggregate"]["confusion"]) == 4
    cal = spark.createDataFrame([("1", [1.0, 0.0], 0, ["c"])], LOGITS)
    got = reports.as_dict(reports.report("calibration", ORIGIN, reports.calibration_sections(cal, 2.0)))
    assert got["aggregate"]["metrics"][0]["temperature"] == 2.0 and len(got["aggregate"]["reliability"]) == 15
    samples = spark.createDataFrame([("a", ["x"])], "sample_id string, cohorts array<string>")
    spans = spark.createDataFrame([], "sample_id string, side string, entity_type string, raw_value string, page_index int, first_token int, last_token int, cohorts array<string>")
    got = reports.as_dict(reports.report("entities", ORIGIN, reports.entity_sections(samples, spans)))
    assert len(got["aggregate"]["entities"]) == 6 and got["aggregate"]["entities"][0]["sample_count"] == 1
    flat = {(r["section"], r["place"], r["measure"]): r["value"] for r in reports.flat(reports.classification_sections(lab)).where("cohort IS NULL").collect()}
    assert flat["confusion", "INVOICE|NOT_INVOICE", "sample_count"] == 1 and ("classes", "INVOICE", "precision") not in flat
    for empty in (lambda: reports.ocr_sections(rec.limit(0), None), lambda: reports.classification_sections(lab.limit(0)), lambda: reports.entity_sections(samples.limit(0), spans), lambda: reports.calibration_sections(cal.limit(0), 1.0), lambda: reports.error_sections(None, det.limit(0))):
        with pytest.raises(ValueError, match="needs"):
            empty()


def test_failures_and_foreign_rows(spark):
    failed = spark.createDataFrame([("a", "ocr", "ValueError", -1.0), ("b", "pipeline", " ", None)], "document_id string, stage string, error_type string, duration_seconds double")
    got = sorted((r["stage"], r["status"], r["error_type"], r["duration_seconds"], r["document_id"]) for r in pipeline.failures(failed).collect())
    assert got == [("ocr", "ERROR", "ValueError", 0.0, None), ("pipeline", "ERROR", "Exception", 0.0, None), ("pipeline", "ERROR", "ValueError", 0.0, None)]
    pages = spark.createDataFrame([("a", 0, "invoice tax")], "document_id string, page_index int, text string")
    strange = lambda p: classification.classify(p).withColumn("document_id", F.lit("other"))
    assert pipeline.foreign_rows(pages, strange(pages)).count() == 1 and pipeline.infer(pages, classify=strange).count() == 0


SETTINGS = """schema_version = "1.0.0"
[pipeline]
paddleocr_version = "3"
paddlepaddle_version = "2"
ocr_version = "v"
detection_model_name = "d"
recognition_model_name = "r"
model_source = "s"
language = "en"
device = "cpu"
engine = "e"
use_doc_orientation_classify = false
use_doc_unwarping = false
use_textline_orientation = true
text_rec_score_threshold = 0.5
"""


def test_engine_options_and_command_line(spark, tmp_path, capsys):
    (tmp_path / "c.toml").write_text(SETTINGS)
    settings = config.ocr_settings(tmp_path / "c.toml")
    assert config.engine_options(settings)["lang"] == "en" and len(config.engine_options(settings)) == 10
    assert config.checked_engine(dict, settings, {"paddleocr": "3", "paddlepaddle": "2"})["device"] == "cpu"
    with pytest.raises(RuntimeError):
        config.checked_engine(dict, settings, {"paddleocr": "4", "paddlepaddle": "2"})
    page = {"res": {"rec_texts": ["a", " "], "rec_scores": [0.5, 0.1], "rec_boxes": [[1, 2, 3, 4], [0, 0, 1, 1]]}}
    (tmp_path / "doc.txt").write_text(json.dumps(page) + "\n" + json.dumps(page))
    run = ["ocr", str(tmp_path / "doc.txt"), "--config", str(tmp_path / "c.toml")]
    assert cli.main([*run, "--output", str(tmp_path / "new" / "o.json")]) == 0
    got = json.loads((tmp_path / "new" / "o.json").read_text())
    assert got["document_id"] == "doc.txt" and [p["page_index"] for p in got["pages"]] == [0, 1] and got["model"]["name"] == "d+r" and got["pages"][1]["tokens"][0] == {"text": "a", "bounding_box": {"x_min": 1.0, "y_min": 2.0, "x_max": 3.0, "y_max": 4.0}, "confidence": 0.5, "page_index": 1, "token_index": 0}
    assert cli.main([*run, "--output", str(tmp_path / "new" / "o.json")]) == 1 and "FileExistsError" in capsys.readouterr().err
    assert cli.main([*run, "--document-id", "own"]) == 0 and json.loads(capsys.readouterr().out)["document_id"] == "own"
    (tmp_path / "doc.txt").write_text('{"rec_texts": []}')
    assert cli.main(run) == 1


def test_canonical_json(spark):
    model = {"name": "m", "version": "1", "source": "s"}
    pages = spark.createDataFrame([("a", 0, "invoice # AB1 tax")], "document_id string, page_index int, text string")
    one = json.loads(writers.classification_json(classification.classify(pages), model).first()["json"])
    assert one["label"] == "INVOICE" and one["model"] == model and one["schema_version"] == "1.0.0"
    two = json.loads(writers.extraction_json(pipeline.infer(pages), model).first()["json"])
    assert two["entities"] == [{"entity_type": "INVOICE_NUMBER", "raw_value": "AB1", "token_references": [{"page_index": 0, "token_index": 2}], "rule_id": "invoice_number_label_v1"}]


def test_written_tables_are_released_and_broadcasts_checked(spark, tmp_path):
    df = session.written(spark.range(10), "x")
    path = df._quire_path.removeprefix("file://")
    import os

    assert os.path.exists(path) and df.count() == 10
    session.release(df, spark.range(1))
    assert not os.path.exists(path)
    wide = spark.range(10).withColumn("t", F.repeat(F.lit("x"), 1000))
    hinted = lambda d: "Broadcast" in d._jdf.queryExecution().analyzed().toString() or "broadcast" in d._jdf.queryExecution().analyzed().toString()
    assert hinted(session.maybe_broadcast(wide)) and not hinted(session.maybe_broadcast(wide, size=5000)) and not hinted(session.maybe_broadcast(wide, rows=9))

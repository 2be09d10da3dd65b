from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from quirespark.operators import monitoring
from quirespark.sources import config, readers, writers
from quirespark.streaming import telemetry

KEYWORDS = """schema_version = "1.0.0"
[classifier]
model_name = "m"
model_version = "1.0.0"
model_source = "s"
decision_threshold = 0.3
invoice_signals = ["Invoice", "Bill-To"]
"""


def file(tmp_path, text, name="c.toml"):
    (tmp_path / name).write_text(text, encoding="utf-8")
    return tmp_path / name


def test_strict_configuration(tmp_path):
    rules = config.keyword_rules(file(tmp_path, KEYWORDS))
    assert rules.signals == ("invoice", "bill to") and rules.threshold == 0.3
    for bad in (KEYWORDS + "more = 1\n", KEYWORDS.replace("0.3", "true"), KEYWORDS.replace('"Bill-To"', '"INVOICE!"'), KEYWORDS.replace("1.0.0", "2.0.0", 1), KEYWORDS.replace("0.3", "1.5")):
        with pytest.raises((ValueError, TypeError)):
            config.keyword_rules(file(tmp_path, bad))
    rule = 'schema_version = "1.0.0"\n[extractor]\nmodel_name = "m"\nmodel_version = "1"\nmodel_source = "s"\n[[rules]]\nrule_id = "r"\nentity_type = "SELLER_NAME"\npattern = \'\'\'by (?P<value>x)\'\'\'\n'
    assert config.extraction_rules(file(tmp_path, rule))[0].rule_id == "r"
    for bad in (rule.replace("SELLER_NAME", "OTHER"), rule.replace("?P<value>", ""), rule + rule[rule.index("[[") :]):
        with pytest.raises(ValueError):
            config.extraction_rules(file(tmp_path, bad))
    t = 'schema_version = "1.0.0"\nmethod = "temperature_scaling"\nminimum_temperature = 0.05\nmaximum_temperature = 10.0\noptimization_iterations = 100\nreliability_bin_count = 15\n'
    assert config.temperature_settings(file(tmp_path, t))["reliability_bin_count"] == 15
    with pytest.raises(ValueError):
        config.temperature_settings(file(tmp_path, t.replace("0.05", "1.5")))
    lay = 'schema_version = "1.0.0"\nmax_length = 512\nbounding_box_scale = 1000\nignore_label_id = -100\nsubword_label_policy = "propagate_bio"\ntruncation_side = "right"\n'
    assert config.layout_settings(file(tmp_path, lay))["max_length"] == 512
    with pytest.raises(ValueError):
        config.layout_settings(file(tmp_path, lay.replace("right", "left")))


def test_vocabulary_file(spark, tmp_path):
    labels = [{"id": 0, "name": "O", "prefix": "O", "entity_type": None}, {"id": 1, "name": "B-X", "prefix": "B", "entity_type": "X"}, {"id": 2, "name": "I-X", "prefix": "I", "entity_type": "X"}]
    assert config.label_vocabulary(spark, file(tmp_path, json.dumps({"schema_version": "1.0.0", "labels": labels}))).count() == 3
    with pytest.raises(ValueError):
        config.label_vocabulary(spark, file(tmp_path, json.dumps({"schema_version": "1.0.0", "labels": labels[:2]})))


def test_readers(spark, tmp_path):
    box = {"x_min": 0, "y_min": 0, "x_max": 1, "y_max": 1}
    doc = {"schema_version": "1.0.0", "label_schema_version": "1.0.0", "source_ocr_schema_version": "1.0.0", "document_id": "d", "odd": 1, "pages": [{"page_index": 0, "image_width": 10, "image_height": 10, "tokens": [{"token_index": 0, "text": "é", "bounding_box": box, "label": "O"}]}]}
    (tmp_path / "a").mkdir()
    file(tmp_path / "a", json.dumps(doc, indent=1), "d.json")
    file(tmp_path / "a", "{", "bad.json")
    rows = readers.json_documents(spark, str(tmp_path / "a"), readers.ANNOTATION)
    assert [r["document_id"] for r in rows.collect() if r["corrupt"] is not None] == [None]
    assert [r["text"] for r in readers.annotation_tokens(rows).collect()] == ["é"]
    assert [r["field"] for r in readers.unknown_fields(spark, str(tmp_path / "a" / "d.json"), readers.ANNOTATION).collect()] == ["odd"]
    file(tmp_path / "a", "x", "P.PDF")
    assert readers.document_files(spark, str(tmp_path / "a")).count() == 1
    assert {r["path"] for r in readers.artifact_contents(spark, str(tmp_path)).collect()} == {"a/d.json", "a/bad.json", "a/P.PDF"}


def test_json_keeps_nulls_and_times_have_no_needless_fraction(spark, tmp_path):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    writers.write_json(df, str(tmp_path / "out"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "out")).collect()] == ['{"a":1,"b":null}']
    with pytest.raises(Exception, match="(?i)exist"):
        writers.write_json(df, str(tmp_path / "out"))
    times = spark.sql("SELECT timestamp'2024-01-02 03:04:05' AS a, timestamp'2024-01-02 03:04:05.000120' AS b").select(writers.iso_utc(F.col("a")), writers.iso_utc(F.col("b"))).first()
    assert tuple(times) == ("2024-01-02T03:04:05Z", "2024-01-02T03:04:05.000120Z")
    with pytest.raises(FileExistsError):
        writers.write_exclusive({}, file(tmp_path, "{}", "x.json"))


def test_bundles(tmp_path):
    m = {"model_name": "m-1", "model_version": "1.0.0", "config_version": "1.0.0", "output_schema_version": "1.0.0", "source_commit": "a" * 40, "model_family": "f", "output_schema_name": "s", "evaluation_report_uri": "r.json", "task": "ocr"}
    w = file(tmp_path, "weights", "w.bin")
    got = writers.export_bundle(tmp_path / "b", m, {"model": w})
    assert got["artifacts"][0]["sha256"] == hashlib.sha256(b"weights").hexdigest()
    with pytest.raises(FileExistsError):
        writers.export_bundle(tmp_path / "b", m, {"model": w})
    (tmp_path / "b" / "w.bin").write_text("weighty", encoding="utf-8")
    with pytest.raises(ValueError, match="checksum"):
        writers.validate_bundle(tmp_path / "b")
    manifest = json.loads((tmp_path / "b" / "bundle.json").read_text())
    manifest["artifacts"][0]["filename"] = "..%2Fw.bin"
    (tmp_path / "b" / "bundle.json").write_text(json.dumps(manifest))
    with pytest.raises(ValueError, match="outside"):
        writers.validate_bundle(tmp_path / "b")
    with pytest.raises(ValueError):
        writers.export_bundle(tmp_path / "c", m | {"model_name": "M"}, {"model": w})
    for bad in ({"task": "x"}, {"dataset_name": "d"}, {"dataset_name": "d", "dataset_version": "1"}, {"training_run_id": " "}, {"model_family": ""}, {"source_commit": "x"}, {"more": 1}):
        with pytest.raises(ValueError):
            writers.check_metadata(m | bad)
    writers.check_metadata(m | {"dataset_name": "d", "dataset_version": "1.0.0", "training_run_id": "r"})
    for source in ({"weights": w}, {"model": (w, "binary")}):
        with pytest.raises(ValueError):
            writers.export_bundle(tmp_path / "c", m, source)
    assert not (tmp_path / "c").exists()


def test_stream_gives_the_batch_result(spark, tmp_path):
    rows = spark.sql("SELECT id AS record_id, timestamp_seconds(1700000000 + id * 600) AS ts, 'ocr' AS stage, IF(id % 5 = 0, 'ERROR', 'SUCCESS') AS status, CAST(id AS DOUBLE) AS duration_seconds FROM range(40)")
    rows.where("record_id < 30").write.parquet(str(tmp_path / "in"))
    q = telemetry.start_windows(telemetry.stream(spark, str(tmp_path / "in")), "w", checkpoint=str(tmp_path / "cp"))
    q.processAllAvailable()
    rows.where("record_id >= 30").write.mode("append").parquet(str(tmp_path / "in"))
    q.processAllAvailable()
    q.processAllAvailable()
    q.stop()
    batch = {(r["window_start"], r["records"], r["errors"]) for r in monitoring.windowed(rows).collect()}
    live = {(r["window_start"], r["records"], r["errors"]) for r in spark.table("w").collect()}
    assert live and live < batch
    s = telemetry.start_sink(telemetry.stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp2"))
    s.processAllAvailable()
    s.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 40


def test_records_reach_a_sink_of_ones_own(spark, tmp_path):
    schema = "record_id long, status string, duration_seconds double, model_name string, model_version string, model_source string, output_count long, mean_confidence double, output_categories array<string>, error_type string"
    rows = [(k, "SUCCESS", -1.0 if k == 3 else 1.0, None, None, None, None, None, [], None) for k in range(5)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    got = []
    q = telemetry.start_hook(telemetry.stream(spark, str(tmp_path / "in"), schema), lambda batch, number: got.extend((number, r["record_id"]) for r in batch.collect()), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert sorted(got) == [(0, 0), (0, 1), (0, 2), (0, 4)]

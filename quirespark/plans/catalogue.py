"""The named queries of the core. Each takes the session and a data directory; ``twins`` holds the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirespark.functions import text as tx
from quirespark.functions.distance import char_edits, word_edits
from quirespark.functions.geometry import first_max, overlap, softmax
from quirespark.operators import bio, calibration, classification, contracts, detection, entities, extraction, layout, manifest, monitoring, pipeline, recognition, tokens
from quirespark.operators.nested import KINDS, NestedTables, unreadable
from quirespark.plans import fixtures as fx
from quirespark.plans import nested_twins, reports, twins
from quirespark.session import table
from quirespark.sources import schemas, writers


def _nested(spark, d, *kinds):
    return NestedTables(table(spark, d, "annotation_raw"), kinds)


def _stored_objects(spark, d):
    t, out = _nested(spark, d, *KINDS), None
    for k, own in KINDS.items():
        one = t.objects(k).select(F.lit(k).alias("kind"), "hash", F.to_json(F.struct(*own), {"ignoreNullFields": "false"}).alias("fields"))
        out = one if out is None else out.unionByName(one)
    return out


def _bridges(spark, d):
    t, out = _nested(spark, d, *KINDS), None
    for k in KINDS:
        one = t.bridge(k).select(F.lit(k).alias("kind"), "parent", "ordinal", "index", "hash")
        out = one if out is None else out.unionByName(one)
    return out


def _labels(spark, d):
    return table(spark, d, "semantic_labels_v1")


def _rounded(df, *columns, digits=8):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _classified_pages(spark, d):
    c = classification.classify(fx.ocr_pages(spark, d))
    return _rounded(c.withColumn("matched_signals", F.array_join("matched_signals", "|")), "decision_score")


def _corpus_classes(spark, d):
    rules = classification.KeywordRules(("the report", "reported from", "without the", "according to"), 0.5, ("NARRATIVE", "OTHER"))
    pages = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("document_id"), "text")
    c = classification.classify(pages, rules)
    return _rounded(c.withColumn("matched_signals", F.array_join("matched_signals", "|")), "decision_score")


def _normalized(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.normalised(F.col("text")).alias("normalized"))


def _edit_rows(spark, d):
    r = fx.recognition(spark, d)
    a, b = F.col("reference"), F.col("prediction")
    return r.select("sample_id", char_edits(a, b).alias("char_edits"), word_edits(a, b).alias("word_edits"))


def _recognition(spark, d):
    return _rounded(recognition.metrics(fx.recognition(spark, d)), "cer", "wer", "exact_match_rate", "identifier_exact_match_rate")


def _edit_counts(spark, d):
    return recognition.with_edits(fx.recognition(spark, d)).select("sample_id", "substitutions", "insertions", "deletions", "category")


def _observed(spark, d):
    return recognition.observations(fx.recognition(spark, d)).unionByName(detection.observations(fx.detection(spark, d)))


def _error_slices(spark, d):
    samples = fx.recognition(spark, d).select("sample_id", "cohorts").unionByName(fx.detection(spark, d).select("sample_id", "cohorts"))
    return recognition.slice_sizes(samples, _observed(spark, d))


def _ious(spark, d):
    return _rounded(detection.candidates(fx.detection(spark, d), 0.1), "iou")


def _matches(spark, d):
    m = detection.matched(fx.detection(spark, d))
    return m.select("sample_id", F.explode("matches").alias("m")).select("sample_id", "m.*")


def _detection(spark, d):
    return _rounded(detection.metrics(fx.detection(spark, d)), "precision", "recall", "f1")


def _spans(spark, d):
    return bio.spans(fx.tokens(spark, d), _labels(spark, d))


def _eval_spans(spark, d):
    return fx.spans_of(_spans(spark, d))


def _prf(df):
    return _rounded(df, "precision", "recall", "f1")


def _softmax(spark, d):
    p = fx.calibration(spark, d).select("vec_id", softmax(F.col("logits")).alias("p"))
    return p.select("vec_id", F.round(F.array_max("p"), 8).alias("confidence"), first_max(F.col("p")).alias("predicted_index"))


def _calibration(spark, d):
    return _rounded(calibration.metrics(fx.calibration(spark, d)), "nll", "ece", "brier", "mean_confidence", "accuracy")


def _reliability(spark, d):
    return _rounded(calibration.reliability(fx.calibration(spark, d)), "lower_bound", "upper_bound", "mean_confidence", "accuracy")


def _temperature(spark, d):
    fit = calibration.fit_temperature(fx.calibration(spark, d))
    return spark.createDataFrame([(round(fit.temperature, 5), round(fit.nll_before, 8), round(fit.nll_after, 8))], "temperature double, nll_before double, nll_after double")


def _pieces(spark, d):
    f = layout.page_features(fx.tokens(spark, d), _labels(spark, d))
    return f.select("document_id", "page_index", "truncated", F.posexplode("pieces").alias("piece", "p")).select("document_id", "page_index", "truncated", "piece", "p.box.*", "p.label_id")


def _features(spark, d):
    f = layout.page_features(fx.tokens(spark, d), _labels(spark, d))
    x = F.aggregate("pieces", F.lit(0).cast("long"), lambda a, p: a + p["box"]["x_min"])
    y = F.aggregate("pieces", F.lit(0).cast("long"), lambda a, p: a + p["label_id"])
    return f.select("document_id", "page_index", F.col("n_pieces").cast("long").alias("n_pieces"), "truncated", x.alias("x_sum"), y.alias("label_sum"))


def _manifest(spark, d):
    return table(spark, d, "manifest"), table(spark, d, "manifest_head")


def _references(spark, d):
    found = extraction.entities(tokens.page_texts(fx.tokens(spark, d), with_tokens=True))
    return found.select("document_id", "page_index", "entity_type", "raw_value", "rule_id", "n_tokens", F.explode("token_references").alias("token_index"))


def _inference(spark, d):
    return pipeline.infer(fx.ocr_pages(spark, d)).select("document_id", "label", F.size("entities").cast("long").alias("n_entities"), F.array_join(F.array_sort(F.transform("entities", lambda e: F.concat(e["entity_type"], F.lit("="), e["raw_value"]))), "|").alias("entities"))


def _telemetry(spark, d):
    pages = fx.ocr_pages(spark, d)
    rows = pages.select("document_id", F.posexplode(F.split("text", " ")).alias("k", "text")).withColumn("confidence", (F.col("k") % 4) / 4.0)
    t = pipeline.telemetry(pipeline.infer(pages), rows, {"ocr": 0.25, "pipeline": -1.0}, with_ids=True)
    return _rounded(t.withColumn("output_categories", F.array_join("output_categories", "|")), "mean_confidence")


def _failures(spark, d):
    k = F.col("event_id") % 3
    stage = F.when(k == 0, "ocr").when(k == 1, "extraction").otherwise("pipeline")
    failed = table(spark, d, "events").where("event_type = 'error'").select(F.col("event_id").cast("string").alias("document_id"), stage.alias("stage"), F.when(k == 0, "ValueError").when(k == 1, " ").alias("error_type"), (F.col("value") - 50).alias("duration_seconds"))
    return pipeline.failures(failed, with_ids=True).select("document_id", "stage", "status", F.round("duration_seconds", 6).alias("duration_seconds"), "error_type", F.size("output_categories").alias("categories"))


def _schema_errors(spark, d):
    return manifest.schema_issues(*_manifest(spark, d)).withColumn("parts", F.concat_ws("/", manifest.path_parts(F.col("location"))))


def _report_calibration(spark, d):
    return _values(reports.flat(reports.calibration_sections(fx.calibration(spark, d), 2.0)))


def _values(df):
    return _rounded(df, "value")


def _engine_tokens(spark, d):
    t = tokens.from_engine(tokens.engine_pages(fx.view(spark, d, fx.ENGINE_RESULTS, "orders")))
    return t.select("document_id", "page_index", "token_index", "text", "bounding_box.*", "confidence")


def _payload_schema(spark, d):
    rows = table(spark, d, "annotation_raw").where("raw_id IS NOT NULL").select("raw_id", "payload").distinct()
    return schemas.column_violations(rows, "payload", schemas.annotation_schema(), "invalid_annotation_file", "raw_id")


def _windows_p95(spark, d):
    w = monitoring.windowed(fx.monitoring(spark, d), "1 day")
    return _rounded(w.withColumn("window_start", writers.iso_utc(F.col("window_start"))), "mean_duration", "p95_duration", digits=6)


def _windows(spark, d):
    w = monitoring.windowed(fx.monitoring(spark, d), "1 day").drop("p95_duration")
    return _rounded(w.withColumn("window_start", writers.iso_utc(F.col("window_start"))), "mean_duration", digits=6)


def _engine(spark, d):
    t = tokens.from_engine(fx.engine_pages(spark, d))
    return t.select("document_id", "page_index", "token_index", "text", "bounding_box.*", F.round("confidence", 8).alias("confidence"))


def _box_pairs(spark, d):
    b = fx.view(spark, d, fx.BOXES, "lineitem")
    box = lambda x: F.struct(x.alias("x_min"), F.lit(0.0).alias("y_min"), (x + 10).alias("x_max"), F.lit(10.0).alias("y_max"))
    return b.select("sample_id", "n", F.round(overlap(box(F.col("x")), box(F.col("x") + F.col("shift"))), 8).alias("iou"))


def queries() -> dict:
    """Name -> callable of (session, directory)."""
    return {
        "label_distribution": lambda s, d: classification.classify(fx.ocr_pages(s, d)).groupBy("label").agg(F.count("*").alias("documents")),
        "keyword_classify": _classified_pages,
        "keyword_classify_documents": _corpus_classes,
        "normalize_text": _normalized,
        "extract_entities": lambda s, d: extraction.entities(fx.ocr_pages(s, d)).drop("token_references"),
        "extract_token_references": _references,
        "extract_field_coverage": lambda s, d: extraction.entities(fx.ocr_pages(s, d)).groupBy("entity_type").agg(F.countDistinct("document_id").alias("documents"), F.count("*").alias("entities")),
        "page_texts": lambda s, d: tokens.page_texts(fx.tokens(s, d)),
        "token_offsets": lambda s, d: tokens.offsets(fx.tokens(s, d)),
        "contiguity_check": lambda s, d: tokens.gaps(fx.tokens(s, d)),
        "engine_payload_tokens": _engine,
        "bio_validate": lambda s, d: bio.sequence_issues(fx.tokens(s, d), _labels(s, d)),
        "bio_reconstruct": _spans,
        "vocabulary_check": lambda s, d: bio.vocabulary_issues(fx.view(s, d, fx.LABEL_FAULTS, "semantic_labels_v1")),
        "engine_result_tokens": _engine_tokens,
        "engine_issues": lambda s, d: tokens.engine_issues(tokens.engine_pages(fx.view(s, d, fx.ENGINE_RESULTS, "orders"))),
        "ocr_contract_issues": lambda s, d: contracts.ocr_token_issues(fx.ocr_rows(s, d)),
        "page_contract_issues": lambda s, d: contracts.page_gaps(fx.view(s, d, fx.PAGE_GAPS, "annotation_token")),
        "classification_contract_issues": lambda s, d: contracts.classification_issues(fx.decisions(s, d)),
        "entity_contract_issues": lambda s, d: contracts.entity_issues(fx.entity_rows(s, d)),
        "span_contract_issues": lambda s, d: contracts.span_issues(_spans(s, d), extraction.ENTITY_TYPES),
        "entity_evaluation": lambda s, d: _rounded(entities.evaluation(fx.entity_samples(s, d), _eval_spans(s, d)), "token_precision", "token_recall", "token_f1", "entity_precision", "entity_recall", "entity_f1", "exact_match_rate"),
        "entity_token_prf": lambda s, d: _prf(entities.token_metrics(_eval_spans(s, d))),
        "entity_span_prf": lambda s, d: _prf(entities.span_metrics(_eval_spans(s, d))),
        "entity_field_exact": lambda s, d: _rounded(entities.field_metrics(_eval_spans(s, d)), "exact_match_rate"),
        "entity_overlaps": lambda s, d: entities.overlapping(_eval_spans(s, d)),
        "classification_confusion": lambda s, d: classification.confusion(fx.classified(s, d)),
        "classification_class_metrics": lambda s, d: _prf(classification.class_metrics(fx.classified(s, d))),
        "classification_summary": lambda s, d: _rounded(classification.summary(fx.classified(s, d)), "accuracy", "macro_f1"),
        "edit_distances": _edit_rows,
        "recognition_metrics": _recognition,
        "edit_op_counts": _edit_counts,
        "ocr_error_ranking": lambda s, d: recognition.ranking(_observed(s, d)),
        "ocr_error_slices": _error_slices,
        "iou_pairs": _box_pairs,
        "iou_candidates": _ious,
        "region_matching": _matches,
        "detection_metrics": _detection,
        "box_normalize": lambda s, d: layout.grid_boxes(fx.tokens(s, d)),
        "subword_align": _features,
        "subword_pieces": _pieces,
        "feature_issues": lambda s, d: layout.feature_issues(fx.tokens(s, d), _labels(s, d)),
        "annotation_schema_issues": lambda s, d: layout.schema_issues(fx.tokens(s, d), _labels(s, d).where("id <= 10")),
        "annotation_version_issues": lambda s, d: layout.version_issues(table(s, d, "annotation_token"), table(s, d, "annotation_batch")),
        "annotation_payload_issues": _payload_schema,
        "annotation_issues": lambda s, d: layout.annotation_issues(fx.tokens(s, d), _labels(s, d)),
        "softmax": _softmax,
        "calibration_metrics": _calibration,
        "reliability_bins": _reliability,
        "temperature_fit": _temperature,
        "manifest_duplicate_ids": lambda s, d: manifest.duplicate_ids(table(s, d, "manifest")),
        "manifest_duplicate_artifacts": lambda s, d: manifest.duplicate_artifacts(table(s, d, "manifest")),
        "manifest_missing_groups": lambda s, d: manifest.missing_groups(*_manifest(s, d)),
        "manifest_split_leaks": lambda s, d: manifest.split_leaks(*_manifest(s, d)),
        "manifest_issues": lambda s, d: manifest.issues(*_manifest(s, d)),
        "manifest_schema_issues": _schema_errors,
        "manifest_artifacts": lambda s, d: manifest.artifact_issues(*fx.artifact_tables(s, d)),
        "monitoring_summary": lambda s, d: _rounded(monitoring.summary(fx.monitoring(s, d)), "mean_duration", "max_duration", "mean_confidence", "error_rate", digits=6),
        "monitoring_categories": lambda s, d: monitoring.categories(fx.monitoring(s, d)),
        "monitoring_issues": lambda s, d: monitoring.record_issues(fx.monitoring_faults(s, d)),
        "monitoring_window": _windows,
        "monitoring_window_p95": _windows_p95,
        "pipeline_inference": _inference,
        "pipeline_records": _telemetry,
        "pipeline_failures": _failures,
        "report_ocr": lambda s, d: _values(reports.flat(reports.ocr_sections(fx.recognition(s, d), fx.detection(s, d)))),
        "report_classification": lambda s, d: _values(reports.flat(reports.classification_sections(fx.classified(s, d)))),
        "report_entities": lambda s, d: _values(reports.flat(reports.entity_sections(fx.entity_samples(s, d), _eval_spans(s, d)))),
        "report_calibration": _report_calibration,
        "report_errors": lambda s, d: _values(reports.flat(reports.error_sections(fx.recognition(s, d), fx.detection(s, d)))),
        "bundle_manifest": lambda s, d: writers.bundle_digest(table(s, d, "documents").select(F.lit("text").alias("role"), F.col("doc_id").cast("string").alias("filename"), F.col("text").cast("binary").alias("content"))),
        "p2_found": lambda s, d: _nested(s, d).labelled_tokens(),
        "p2_documents": lambda s, d: _nested(s, d).documents(),
        "p2_pages": lambda s, d: _nested(s, d).pages(),
        "p2_tokens": lambda s, d: _nested(s, d, "token", "box").tokens(),
        # the flat tables without hashes and other fields, for comparison with SQL
        "p2_document_rows": lambda s, d: _nested(s, d).documents().drop("document", "extra"),
        "p2_page_rows": lambda s, d: _nested(s, d).pages().drop("page", "extra"),
        "p2_token_rows": lambda s, d: _nested(s, d, "token", "box").tokens().drop("token", "extra"),
        "p2_objects": _stored_objects,
        "p2_bridges": _bridges,
        "p2_sharing": lambda s, d: _nested(s, d, "token", "box").sharing(),
        "p2_unreadable": lambda s, d: unreadable(table(s, d, "annotation_raw")),
    }


def oracle_sql() -> dict[str, str]:
    return twins.SQL | nested_twins.SQL

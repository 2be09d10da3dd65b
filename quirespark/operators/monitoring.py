"""Inference telemetry: records, contract checks, aggregates. Records are rows ``ts, stage, status, duration_seconds, document_id,
model_name, model_version, model_source, output_count, output_categories, mean_confidence, error_type``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirespark.functions.geometry import ratio
from quirespark.functions.text import is_blank


def record_issues(records: DataFrame) -> DataFrame:
    """``records``' ``record_id`` with an ``issue`` each time one breaks the contract."""
    blank = lambda c: F.col(c).isNull() | is_blank(F.col(c))
    model = [F.col(c).isNull() for c in ("model_name", "model_version", "model_source")]
    error, d = F.col("status") == "ERROR", F.col("duration_seconds")
    outputs = F.col("output_count").isNotNull() | F.col("mean_confidence").isNotNull() | (F.coalesce(F.size("output_categories"), F.lit(0)) > 0)
    issues = F.array(
        F.when(d.isNull() | F.isnan(d) | (d < 0) | (d == float("inf")), "invalid_duration"),
        F.when((model[0] | model[1] | model[2]) & ~(model[0] & model[1] & model[2]), "partial_model_identity"),
        F.when(F.col("output_count") < 0, "negative_output_count"),
        F.when((F.col("mean_confidence") < 0) | (F.col("mean_confidence") > 1) | F.isnan("mean_confidence"), "invalid_confidence"),
        F.when(F.size(F.array_distinct("output_categories")) != F.size("output_categories"), "duplicate_categories"),
        F.when(error & blank("error_type"), "missing_error_type"), F.when(error & outputs, "error_with_outputs"),
        F.when(~error & F.col("error_type").isNotNull(), "success_with_error_type"),
    )
    return records.select("record_id", F.explode(F.array_compact(issues)).alias("issue"))


def summary(records: DataFrame) -> DataFrame:
    """``stage, records, errors, error_rate, outputs, mean_duration, max_duration, mean_confidence`` per stage."""
    error = F.col("status") == "ERROR"
    sums = records.groupBy("stage").agg(F.count("*").alias("records"), F.count_if(error).alias("errors"), F.sum("output_count").alias("outputs"), F.avg("duration_seconds").alias("mean_duration"), F.max("duration_seconds").alias("max_duration"), F.avg("mean_confidence").alias("mean_confidence"))
    return sums.withColumn("error_rate", ratio(F.col("errors"), F.col("records")))


def categories(records: DataFrame) -> DataFrame:
    """``stage, category, records``: how often each output category occurs."""
    return records.select("stage", F.explode(F.array_distinct("output_categories")).alias("category")).groupBy("stage", "category").agg(F.count("*").alias("records"))


def windowed(records: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """``window_start, stage, records, errors, mean_duration, p95_duration``: an extension of the reference for batch and streams; in a stream, rows later than ``late`` are dropped."""
    if records.isStreaming:
        records = records.withWatermark("ts", late)
    w = records.groupBy(F.window("ts", size).alias("w"), "stage").agg(F.count("*").alias("records"), F.count_if(F.col("status") == "ERROR").alias("errors"), F.avg("duration_seconds").alias("mean_duration"), F.percentile_approx("duration_seconds", 0.95).alias("p95_duration"))
    return w.select(F.col("w.start").alias("window_start"), "stage", "records", "errors", "mean_duration", "p95_duration")

"""Metric reports: total, sorted cohort slices and provenance as one JSON document a report. Only aggregates enter a report, never texts or sample ids."""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirespark.functions.text import FORMATS
from quirespark.operators import calibration, classification, detection, entities, recognition


@dataclass(frozen=True)
class Provenance:
    """Where evaluated samples and predictions come from."""

    dataset_name: str
    dataset_version: str
    model_name: str
    model_version: str
    source_commit: str
    config_version: str = "1.0.0"

    def __post_init__(self) -> None:
        for field, kind in (("dataset_name", "slug"), ("dataset_version", "semver"), ("config_version", "semver"), ("source_commit", "commit")):
            if not isinstance(getattr(self, field), str) or not re.fullmatch(FORMATS[kind], getattr(self, field)):
                raise ValueError(f"{field} must be a {kind}")
        for field in ("model_name", "model_version"):
            if not isinstance(getattr(self, field), str) or not getattr(self, field).strip():
                raise ValueError(f"{field} must not be blank")


def report(kind: str, provenance: Provenance, sections: dict[str, DataFrame]) -> DataFrame:
    """One row ``kind, report``: JSON with the provenance, the ``aggregate`` and the ``slices`` of every section.

    A section is a table with ``cohort`` (null: the total) and measures, one or more rows a cohort. Slices are in order of cohort, their rows in order of
    content. A cohort that a section lacks has null there; undefined measures are written as null."""
    joined = None
    for name, df in sections.items():
        measures = [c for c in df.columns if c != "cohort"]
        rows = df.groupBy("cohort").agg(F.sort_array(F.collect_list(F.struct(*measures))).alias(name))  # as many rows as the slice has measures
        if joined is None:
            joined = rows
        else:
            rows = rows.withColumnRenamed("cohort", "_c")
            joined = joined.join(rows, F.col("cohort").eqNullSafe(F.col("_c")), "full_outer").withColumn("cohort", F.coalesce("cohort", "_c")).drop("_c")
    one = F.struct("cohort", *sections)
    grouped = joined.agg(F.sort_array(F.collect_list(F.when(F.col("cohort").isNotNull(), one))).alias("slices"), F.first(F.when(F.col("cohort").isNull(), F.struct(*sections)), ignorenulls=True).alias("aggregate"))
    origin = F.struct(*[F.lit(v).alias(k) for k, v in asdict(provenance).items()])
    body = F.struct(F.lit("1.0.0").alias("schema_version"), origin.alias("provenance"), "aggregate", "slices")
    return grouped.select(F.lit(kind).alias("kind"), F.to_json(body, {"ignoreNullFields": "false"}).alias("report"))


def _some(**inputs: DataFrame | None) -> dict[str, DataFrame]:
    """The inputs that are there; an error if none of them has a row."""
    given = {k: v for k, v in inputs.items() if v is not None and not v.isEmpty()}
    if not given:
        raise ValueError(f"a report needs {' or '.join(k.replace('_', ' ') for k in inputs)}")
    return given


def ocr_sections(recognition_samples: DataFrame | None = None, detection_samples: DataFrame | None = None, least_iou: float = detection.LEAST_IOU) -> dict[str, DataFrame]:
    """``recognition`` and ``detection`` of the samples there are; the second repeats its threshold."""
    given = _some(recognition_samples=recognition_samples, detection_samples=detection_samples)
    out = {}
    if "recognition_samples" in given:
        out["recognition"] = recognition.metrics(given["recognition_samples"])
    if "detection_samples" in given:
        out["detection"] = detection.metrics(given["detection_samples"], least_iou).withColumn("iou_threshold", F.lit(float(least_iou)))
    return out


def classification_sections(samples: DataFrame) -> dict[str, DataFrame]:
    """``summary``, ``classes`` and the whole ``confusion`` table."""
    _some(samples=samples)
    return {"summary": classification.summary(samples), "classes": classification.class_metrics(samples), "confusion": classification.confusion(samples)}


def entity_sections(samples: DataFrame, spans: DataFrame) -> dict[str, DataFrame]:
    """``entities``: all levels of every type, zeros where nothing is."""
    _some(samples=samples)
    return {"entities": entities.evaluation(samples, spans)}


def calibration_sections(samples: DataFrame, temperature: float, bins: int = calibration.BINS) -> dict[str, DataFrame]:
    """``metrics`` at the fitted temperature, and the ``reliability`` bins of all samples."""
    _some(samples=samples)
    reliability = calibration.reliability(samples, temperature, bins).withColumn("cohort", F.lit(None).cast("string"))
    return {"metrics": calibration.metrics(samples, temperature, bins).withColumn("temperature", F.lit(float(temperature))), "reliability": reliability}


def error_sections(recognition_samples: DataFrame | None = None, detection_samples: DataFrame | None = None, least_iou: float = detection.LEAST_IOU) -> dict[str, DataFrame]:
    """``errors`` by rank and ``samples`` evaluated and affected."""
    given = _some(recognition_samples=recognition_samples, detection_samples=detection_samples)
    observed = samples = None
    for name, observe in (("recognition_samples", recognition.observations), ("detection_samples", lambda d: detection.observations(d, least_iou))):
        if name in given:
            own, size = observe(given[name]), given[name].select("sample_id", "cohorts")
            observed, samples = (own, size) if observed is None else (observed.unionByName(own), samples.unionByName(size))
    return {"errors": recognition.ranking(observed), "samples": recognition.slice_sizes(samples, observed)}


def flat(sections: dict[str, DataFrame]) -> DataFrame:
    """``section, cohort, place, measure, value`` of every measure that is a number and isn't null: a report as one narrow table. ``place`` tells the rows of a slice apart: its texts and whole numbers named
    label, reference, prediction, entity_type, stage, category or bin, joined by a bar; empty where there is one row."""
    keys = ("label", "reference", "prediction", "entity_type", "stage", "category", "bin")
    out = None
    for name, df in sections.items():
        own = [c for c in keys if c in df.columns]
        measures = [c for c, kind in df.dtypes if c not in ("cohort", *own) and kind in ("int", "bigint", "double")]
        pairs = F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in measures])
        rows = df.select(F.lit(name).alias("section"), "cohort", F.concat_ws("|", *[F.col(c).cast("string") for c in own]).alias("place"), F.explode(pairs).alias("m")).select("section", "cohort", "place", "m.measure", "m.value").where("value IS NOT NULL")
        out = rows if out is None else out.unionByName(rows)
    return out


def as_dict(frame: DataFrame) -> dict[str, Any]:
    """The report as a Python value."""
    import json

    return json.loads(frame.first()["report"])

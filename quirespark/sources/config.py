"""Strict configuration files and vocabularies, read by the driver: unknown or missing keys, wrong types and values are errors."""

from __future__ import annotations

import json
import tomllib
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from quirespark.operators.bio import vocabulary_issues
from quirespark.operators.classification import KeywordRules
from quirespark.operators.extraction import ENTITY_TYPES, Rule

VERSION = "1.0.0"


def _keys(value: Any, expected: set[str], where: str) -> dict:
    if not isinstance(value, dict):
        raise TypeError(f"{where} must be a table")
    if extra := value.keys() - expected:
        raise ValueError(f"{where} has unexpected keys {sorted(extra)}")
    if missing := expected - value.keys():
        raise ValueError(f"{where} lacks {sorted(missing)}")
    return value


def _toml(path: str | Path, keys: set[str]) -> dict:
    with open(path, "rb") as f:
        root = _keys(tomllib.load(f), keys | {"schema_version"}, "the file")
    if root["schema_version"] != VERSION:
        raise ValueError(f"schema_version must be {VERSION}")
    return root


def _number(value: Any, low: float, high: float, where: str, whole: bool = False) -> Any:
    if isinstance(value, bool) or not isinstance(value, int if whole else (int, float)):
        raise TypeError(f"{where} must be a number")
    if not low <= value <= high:
        raise ValueError(f"{where} must lie in [{low}, {high}]")
    return value


def _text(value: Any, where: str) -> str:
    if not isinstance(value, str):
        raise TypeError(f"{where} must be a string")
    if not value.strip():
        raise ValueError(f"{where} must not be blank")
    return value


def keyword_rules(path: str | Path) -> KeywordRules:
    """Signals and threshold of the keyword classifier."""
    c = _keys(_toml(path, {"classifier"})["classifier"], {"model_name", "model_version", "model_source", "decision_threshold", "invoice_signals"}, "classifier")
    for k in ("model_name", "model_version", "model_source"):
        _text(c[k], k)
    if not isinstance(c["invoice_signals"], list) or not c["invoice_signals"]:
        raise ValueError("invoice_signals must be a list of signals")
    signals = tuple(" ".join("".join(x if x.isalnum() or x == "_" else " " for x in _text(s, "signal").casefold()).split()) for s in c["invoice_signals"])
    if len(set(signals)) != len(signals) or "" in signals:
        raise ValueError("signals must be unique and hold a word once they are normalised")
    t = _number(c["decision_threshold"], 0, 1, "decision_threshold")
    if t == 0:
        raise ValueError("decision_threshold must be above 0")
    return KeywordRules(signals, float(t))


def extraction_rules(path: str | Path) -> tuple[Rule, ...]:
    """Ordered extraction rules; patterns compile, name a value group, and rule ids are unique."""
    root = _toml(path, {"extractor", "rules"})
    for k in _keys(root["extractor"], {"model_name", "model_version", "model_source"}, "extractor").items():
        _text(k[1], k[0])
    if not isinstance(root["rules"], list) or not root["rules"]:
        raise ValueError("rules must be a list of tables")
    rules = tuple(Rule(*(_text(_keys(r, {"rule_id", "entity_type", "pattern"}, "rule")[k], k) for k in ("rule_id", "entity_type", "pattern"))) for r in root["rules"])
    if len({r.rule_id for r in rules}) != len(rules):
        raise ValueError("rule ids must be unique")
    if bad := {r.entity_type for r in rules} - set(ENTITY_TYPES):
        raise ValueError(f"unknown entity types {sorted(bad)}")
    return rules


def layout_settings(path: str | Path) -> dict[str, Any]:
    """Settings of the layout dataset; only the contract's values are accepted."""
    root = _toml(path, {"max_length", "bounding_box_scale", "ignore_label_id", "subword_label_policy", "truncation_side"})
    for k, v in {"bounding_box_scale": 1000, "ignore_label_id": -100, "subword_label_policy": "propagate_bio", "truncation_side": "right"}.items():
        if root[k] != v or isinstance(root[k], bool):
            raise ValueError(f"{k} must be {v!r}")
    _number(root["max_length"], 1, 1 << 20, "max_length", whole=True)
    return root


def temperature_settings(path: str | Path) -> dict[str, Any]:
    """Bounds on either side of 1, at least 10 iterations, 2 to 100 bins."""
    root = _toml(path, {"method", "minimum_temperature", "maximum_temperature", "optimization_iterations", "reliability_bin_count"})
    if root["method"] != "temperature_scaling":
        raise ValueError("method must be temperature_scaling")
    low, high = _number(root["minimum_temperature"], 0, 1e9, "minimum_temperature"), _number(root["maximum_temperature"], 0, 1e9, "maximum_temperature")
    if not 0 < low < 1 < high:
        raise ValueError("the bounds must lie on either side of 1")
    _number(root["optimization_iterations"], 10, 1_000_000, "optimization_iterations", whole=True)
    _number(root["reliability_bin_count"], 2, 100, "reliability_bin_count", whole=True)
    return root


# Fields of the OCR pipeline's settings.
_OCR_TEXT = ("paddleocr_version", "paddlepaddle_version", "ocr_version", "detection_model_name", "recognition_model_name", "model_source", "language", "device", "engine")
_OCR_FLAGS = ("use_doc_orientation_classify", "use_doc_unwarping", "use_textline_orientation")


def ocr_settings(path: str | Path) -> dict[str, Any]:
    """OCR pipeline settings with the derived ``model_name`` and ``model_version``."""
    c = dict(_keys(_toml(path, {"pipeline"})["pipeline"], {*_OCR_TEXT, *_OCR_FLAGS, "text_rec_score_threshold"}, "pipeline"))
    for k in _OCR_TEXT:
        _text(c[k], k)
    for k in _OCR_FLAGS:
        if not isinstance(c[k], bool):
            raise TypeError(f"{k} must be true or false")
    c["text_rec_score_threshold"] = float(_number(c["text_rec_score_threshold"], 0, 1, "text_rec_score_threshold"))
    c["model_name"] = f"{c['detection_model_name']}+{c['recognition_model_name']}"
    c["model_version"] = f"paddleocr-{c['paddleocr_version']}/paddlepaddle-{c['paddlepaddle_version']}/{c['ocr_version']}"
    return c


# Options of the OCR engine and the settings they come from.
_ENGINE_OPTIONS = {
    "text_detection_model_name": "detection_model_name", "text_recognition_model_name": "recognition_model_name", **{k: k for k in _OCR_FLAGS},
    "text_rec_score_thresh": "text_rec_score_threshold", "lang": "language", "ocr_version": "ocr_version", "device": "device", "engine": "engine",
}


def engine_options(settings: dict[str, Any]) -> dict[str, Any]:
    """Constructor options of the OCR engine from :func:`ocr_settings`."""
    return {option: settings[key] for option, key in _ENGINE_OPTIONS.items()}


def checked_engine(make: Any, settings: dict[str, Any], installed: dict[str, str]) -> Any:
    """The engine that ``make`` builds of the options, unless the ``installed`` versions (by package) aren't the pinned ones: results would be another model's."""
    for package in ("paddleocr", "paddlepaddle"):
        if installed.get(package) != settings[f"{package}_version"]:
            raise RuntimeError(f"{package} {settings[f'{package}_version']} is configured, {installed.get(package)} is installed")
    return make(**engine_options(settings))


def label_vocabulary(spark: SparkSession, path: str | Path) -> DataFrame:
    """``id, name, prefix, entity_type`` of a vocabulary file that meets its contract."""
    with open(path, encoding="utf-8") as f:
        root = _keys(json.load(f), {"schema_version", "labels"}, "the file")
    rows = [tuple(_keys(x, {"id", "name", "prefix", "entity_type"}, "label")[k] for k in ("id", "name", "prefix", "entity_type")) for x in root["labels"]]
    labels = spark.createDataFrame(rows, "id int, name string, prefix string, entity_type string")
    if bad := vocabulary_issues(labels).collect():
        raise ValueError(f"the vocabulary breaks its contract: {bad}")
    return labels

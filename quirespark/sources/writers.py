"""Sinks: JSON with explicit nulls, exclusive files, serving bundles."""

from __future__ import annotations

import hashlib
import json
import os
import re
import shutil
import tempfile
from datetime import UTC, datetime
from pathlib import Path
from typing import Any
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirespark.functions.text import FORMATS


def json_text(*columns: str) -> Column:
    """The columns as one JSON object, nulls included."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a row with explicit nulls; an existing path is an error."""
    df.select(json_text(*df.columns).alias("value")).write.mode("errorifexists").text(path)


def write_exclusive(value: Any, path: str | Path) -> None:
    """One small JSON file, indented, not ASCII-escaped; an existing file is an error."""
    with open(path, "x", encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False, indent=2)
        f.write("\n")


def iso_utc(ts: Column) -> Column:
    """UTC time in ISO 8601 with ``Z``; microseconds only where they aren't 0. The session's time zone must be UTC."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(F.date_format(ts, "SSSSSS") == "000000", F.concat(whole, F.lit("Z"))).otherwise(F.concat(whole, F.lit("."), F.date_format(ts, "SSSSSS"), F.lit("Z")))


def _model(model: dict[str, str]) -> Column:
    return F.struct(*[F.lit(model[k]).alias(k) for k in ("name", "version", "source")])


def _version() -> Column:
    return F.lit("1.0.0").alias("schema_version")


def ocr_json(tokens: DataFrame, model: dict[str, str]) -> DataFrame:
    """``document_id, json``: canonical OCR documents of token rows ``document_id, page_index, token_index, text, bounding_box, confidence``; pages and tokens in order of index."""
    token = F.struct("text", "bounding_box", "confidence", "page_index", "token_index")
    pages = tokens.groupBy("document_id", "page_index").agg(F.array_sort(F.collect_list(token), lambda a, b: a["token_index"] - b["token_index"]).alias("tokens"))
    whole = pages.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("page_index", "tokens")), lambda a, b: a["page_index"] - b["page_index"]).alias("pages"))
    return whole.select("document_id", F.to_json(F.struct(_version(), "document_id", _model(model).alias("model"), "pages"), {"ignoreNullFields": "false"}).alias("json"))


def classification_json(decisions: DataFrame, model: dict[str, str]) -> DataFrame:
    """``document_id, json`` of classifications."""
    body = F.struct(_version(), "document_id", "label", "decision_score", "decision_threshold", "matched_signals", _model(model).alias("model"))
    return decisions.select("document_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))


def extraction_json(documents: DataFrame, model: dict[str, str]) -> DataFrame:
    """``document_id, json`` of documents of ``pipeline.infer``; references name page and token."""
    refs = lambda e: F.transform(e["token_references"], lambda t: F.struct(e["page_index"].alias("page_index"), t.alias("token_index")))
    own = F.transform("entities", lambda e: F.struct(e["entity_type"].alias("entity_type"), e["raw_value"].alias("raw_value"), refs(e).alias("token_references"), e["rule_id"].alias("rule_id")))
    return documents.select("document_id", F.to_json(F.struct(_version(), "document_id", own.alias("entities"), _model(model).alias("model")), {"ignoreNullFields": "false"}).alias("json"))


def bundle_digest(files: DataFrame) -> DataFrame:
    """``role, filename, size_bytes, sha256`` of bundle files ``role, filename, content``."""
    return files.select("role", "filename", F.octet_length("content").cast("long").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))


# Tasks of a release, roles of its files, and the fields of its metadata with their formats.
TASKS = ("ocr", "document_classification", "semantic_extraction")
ROLES = ("model", "tokenizer", "processor", "labels", "calibration", "config")
_FORMATTED = {"model_name": "slug", "model_version": "semver", "config_version": "semver", "output_schema_version": "semver", "source_commit": "commit"}
_NOT_BLANK = ("model_family", "output_schema_name", "evaluation_report_uri")
_OPTIONAL = ("training_run_id", "dataset_name", "dataset_version")


def check_metadata(metadata: dict[str, Any]) -> None:
    """Raises for the first field of a release's metadata that breaks its rule."""
    if extra := metadata.keys() - {*_FORMATTED, *_NOT_BLANK, *_OPTIONAL, "task"}:
        raise ValueError(f"unexpected metadata {sorted(extra)}")
    for field, kind in _FORMATTED.items():
        if not isinstance(metadata.get(field), str) or not re.fullmatch(FORMATS[kind], metadata[field]):
            raise ValueError(f"{field} must be a {kind}")
    for field in _NOT_BLANK:
        if not isinstance(metadata.get(field), str) or not metadata[field].strip():
            raise ValueError(f"{field} must not be blank")
    if metadata.get("task") not in TASKS:
        raise ValueError(f"task must be one of {TASKS}")
    if (metadata.get("dataset_name") is None) != (metadata.get("dataset_version") is None):
        raise ValueError("dataset_name and dataset_version go together")
    if metadata.get("dataset_version") is not None and not re.fullmatch(FORMATS["semver"], str(metadata["dataset_version"])):
        raise ValueError("dataset_version must be a semver")
    for field in ("training_run_id", "dataset_name"):
        if metadata.get(field) is not None and (not isinstance(metadata[field], str) or not metadata[field].strip()):
            raise ValueError(f"{field} must not be blank")


def export_bundle(destination: str | Path, metadata: dict[str, Any], sources: dict[str, str | Path | tuple[str | Path, str]]) -> dict[str, Any]:
    """Copies files (role -> path, or path and media type) into a new directory with a manifest of sizes and checksums, all or nothing: they are staged beside the destination,
    and renamed once whole. A destination that exists is an error, as are two files of one name, a role that isn't known and metadata that break a rule."""
    destination = Path(destination)
    if destination.exists():
        raise FileExistsError(destination)
    check_metadata(metadata)
    if unknown := sources.keys() - set(ROLES):
        raise ValueError(f"unknown roles {sorted(unknown)}")
    given = {role: p if isinstance(p, tuple) else (p, "application/octet-stream") for role, p in sources.items()}
    if any(not isinstance(m, str) or not re.fullmatch(r"[^/\s]+/[^/\s]+", m) for _, m in given.values()):
        raise ValueError("a media type has a type and a subtype")
    paths = {role: Path(p) for role, (p, _) in given.items()}
    if missing := [str(p) for p in paths.values() if not p.is_file()]:
        raise FileNotFoundError(missing)
    if not paths or len({p.name for p in paths.values()}) != len(paths) or "bundle.json" in {p.name for p in paths.values()}:
        raise ValueError("bundle files need names of their own")
    stage = Path(tempfile.mkdtemp(prefix=f".{destination.name}-", dir=destination.parent))
    try:
        files = []
        for role, p in sorted(paths.items()):
            shutil.copyfile(p, stage / p.name)
            content = (stage / p.name).read_bytes()
            files.append({"role": role, "filename": p.name, "media_type": given[role][1], "size_bytes": len(content), "sha256": hashlib.sha256(content).hexdigest()})
        manifest = {"schema_version": "1.0.0", "created_at": datetime.now(UTC).isoformat().replace("+00:00", "Z"), "metadata": metadata, "artifacts": files}
        write_exclusive(manifest, stage / "bundle.json")
        os.rename(stage, destination)
    except BaseException:
        shutil.rmtree(stage, ignore_errors=True)
        raise
    validate_bundle(destination)
    return manifest


def validate_bundle(directory: str | Path) -> dict[str, Any]:
    """The manifest of a bundle whose files are within it and unchanged; the first problem is an error."""
    root = Path(directory).resolve()
    manifest = json.loads((root / "bundle.json").read_text(encoding="utf-8"))
    if manifest.get("schema_version") != "1.0.0":
        raise ValueError("unsupported bundle version")
    for a in manifest["artifacts"]:
        path = (root / unquote(a["filename"])).resolve()
        if path.parent != root:
            raise ValueError(f"{a['filename']} lies outside the bundle")
        content = path.read_bytes()
        if len(content) != a["size_bytes"]:
            raise ValueError(f"{a['filename']} has another size")
        if hashlib.sha256(content).hexdigest() != a["sha256"]:
            raise ValueError(f"{a['filename']} has another checksum")
    return manifest

"""Readers of documents, annotations, manifests and artifacts. Schemas are explicit; nothing is inferred."""

from __future__ import annotations

import re
from typing import Any
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.sources import schemas

BOX = "struct<x_min:double,y_min:double,x_max:double,y_max:double>"
OCR_DOCUMENT = f"schema_version string, document_id string, model struct<name:string,version:string,source:string>, pages array<struct<page_index:int,tokens:array<struct<text:string,bounding_box:{BOX},confidence:double,token_index:int>>>>"
ANNOTATION = f"schema_version string, label_schema_version string, source_ocr_schema_version string, document_id string, pages array<struct<page_index:int,image_width:int,image_height:int,tokens:array<struct<token_index:int,text:string,bounding_box:{BOX},label:string>>>>"
_ARTIFACT = "struct<uri:string,sha256:string,media_type:string,size_bytes:bigint>"
MANIFEST = f"schema_version string, name string, version string, created_at string, description string, tasks array<string>, sources array<struct<name:string,version:string,uri:string,license:string>>, split_strategy struct<method:string,grouping_keys:array<string>,random_seed:bigint,notes:string>, records array<struct<id:string,split:string,cohorts:array<string>,groups:map<string,string>,source:string,document:{_ARTIFACT},annotation:{_ARTIFACT}>>"
# File endings of documents.
SUFFIXES = ("bmp", "jpeg", "jpg", "pdf", "png", "tif", "tiff")


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row per JSON file, with ``path`` and ``corrupt`` (the text of a file that doesn't fit the schema, else null)."""
    rows = spark.read.schema(f"{schema}, corrupt string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "corrupt").json(path)
    return rows.withColumn("path", F.col("_metadata.file_path"))


def annotation_tokens(documents: DataFrame) -> DataFrame:
    """Token rows of annotation documents; pages without tokens have none."""
    pages = documents.select("document_id", F.posexplode("pages").alias("page_place", "p"))
    return pages.select("document_id", "page_place", "p.page_index", "p.image_width", "p.image_height", F.posexplode("p.tokens").alias("token_place", "t")).select("document_id", "page_place", "page_index", "image_width", "image_height", "token_place", "t.*")


def ocr_tokens(documents: DataFrame) -> DataFrame:
    """Token rows of OCR documents."""
    return documents.select("document_id", F.explode("pages").alias("p")).select("document_id", "p.page_index", F.explode("p.tokens").alias("t")).select("document_id", "page_index", "t.*")


def manifest_records(manifests: DataFrame) -> DataFrame:
    """``manifest_name, pos, id, split, cohorts, groups, source, document, annotation`` of manifest documents."""
    return manifests.select(F.col("name").alias("manifest_name"), F.posexplode("records").alias("pos", "r")).select("manifest_name", "pos", "r.*")


def unknown_fields(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """``path, field``: top-level fields of JSON files that the schema doesn't name (the JSON reader drops those silently)."""
    known = spark.createDataFrame([], schema).columns
    text = spark.read.text(path, wholetext=True).withColumn("path", F.col("_metadata.file_path"))
    return text.select("path", F.explode(F.json_object_keys("value")).alias("field")).where(~F.col("field").isin(known))


def _files(spark: SparkSession, path: str, recursive: bool) -> DataFrame:
    """``path, content`` of every file. Spark's readers leave out empty files; the listing, which the driver has anyway, names them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path)
    full = files.select("path", "content")
    listed = [(_plain(unquote(f)),) for f in files.inputFiles()]
    names = spark.createDataFrame(listed, "path string")
    empty = names.join(files.select("path").withColumn("path", F.regexp_replace("path", "^file:/+", "file:/")), "path", "left_anti")
    return full.unionByName(empty.select("path", F.lit(b"").alias("content")))


def _plain(path: str) -> str:
    return re.sub("^file:/+", "file:/", path)


def document_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, modificationTime, length, content`` of image and PDF files, whatever the case of their ending."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*SUFFIXES))


def artifact_contents(spark: SparkSession, root: str) -> DataFrame:
    """``path, content`` of every file below ``root``, paths relative to it."""
    prefix = root.removeprefix("file://").rstrip("/") + "/"
    return _files(spark, root, True).select(F.substring_index("path", prefix, -1).alias("path"), "content")


def _texts(spark: SparkSession, path: str) -> DataFrame:
    return _files(spark, path, False).withColumnRenamed("content", "value")


def manifest_file_issues(spark: SparkSession, path: str, schema: dict[str, Any] | None = None) -> DataFrame:
    """``path, code, location, keyword``: files that aren't a JSON object (``invalid_manifest_file``), and violations of the manifest's schema at any depth
    in those that are, unknown fields included."""
    return schemas.column_violations(_texts(spark, path), "value", schema or schemas.manifest_schema(), "invalid_manifest_file", "path")


def annotation_file_issues(spark: SparkSession, path: str, schema: dict[str, Any] | None = None) -> DataFrame:
    """The same of annotation files (``invalid_annotation_file``)."""
    return schemas.column_violations(_texts(spark, path), "value", schema or schemas.annotation_schema(), "invalid_annotation_file", "path")


def validate_manifests(spark: SparkSession, path: str, root: str | None = None) -> DataFrame:
    """``path, phase, code, location, id`` of all that is wrong with manifest files: their schema, and for files that meet it uniqueness, splits and, with
    the folder ``root``, the artifacts below it."""
    from quirespark.operators import manifest

    broken = manifest_file_issues(spark, path)
    good = json_documents(spark, path, MANIFEST).join(broken.select("path").distinct(), "path", "left_anti").withColumn("name", F.col("path"))
    found = manifest.issues(manifest_records(good), good, artifact_contents(spark, root) if root else None)
    first = broken.select("path", F.lit(0).alias("phase"), "code", "location", F.lit(None).cast("string").alias("id"))
    return first.unionByName(found.select(F.col("manifest_name").alias("path"), "phase", "code", "location", "id"))

"""Domain tables derived from the given parquet tables. Where both engines take the same text, one SQL statement serves the
query and its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.session import table

OCR_PAGES = """
SELECT CAST(o_orderkey AS STRING) AS document_id, 0 AS page_index, CASE CAST(o_orderkey % 5 AS INT)
  WHEN 0 THEN 'Invoice No: INV-' || CAST(o_orderkey AS STRING) || ' Amount Due: $ ' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) || ' USD subtotal'
  WHEN 1 THEN 'Purchase Order: PO-' || CAST(o_orderkey AS STRING) || ' Invoice Date: 2024-01-15 bill to customer'
  WHEN 2 THEN 'Grand Total: ' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) || ' Invoice # INV' || CAST(o_orderkey AS STRING) || ' tax subtotal'
  WHEN 3 THEN 'This order ' || CAST(o_orderkey AS STRING) || ' has already been invoiced'
  ELSE 'Amount Due: 10 Invoice Date: 1/2/24 Order Ref. R-' || CAST(o_orderkey AS STRING) END AS text
FROM orders"""

RECOGNITION = """
SELECT CAST(p_partkey AS STRING) AS sample_id, p_name AS reference,
  CASE CAST(p_partkey % 5 AS INT) WHEN 0 THEN p_name WHEN 1 THEN replace(p_name, 'a', 'e') WHEN 2 THEN substr(p_name, 2) WHEN 3 THEN p_name || 'x' ELSE 'x' || replace(substr(p_name, 3), 'e', 'o') END AS prediction,
  p_brand, p_type, CASE WHEN p_partkey % 3 = 0 THEN 'INVOICE_NUMBER' END AS identifier_type
FROM part"""

CLASSIFIED = """
SELECT CAST(doc_id AS STRING) AS sample_id, CASE WHEN n_chars % 3 = 0 THEN 'INVOICE' ELSE 'NOT_INVOICE' END AS reference,
  CASE WHEN (n_chars + doc_id) % 4 = 0 THEN 'INVOICE' ELSE 'NOT_INVOICE' END AS prediction, lang, source
FROM documents"""

TOKENS = """
SELECT DISTINCT document_id, page_index, token_index, text, bounding_box, label, image_width, image_height FROM annotation_token"""

# one row per box: predictions of a reference are shifted, missing or doubled by modulo
BOXES = """
SELECT CAST(l_orderkey AS STRING) AS sample_id, l_linenumber AS n, count(*) AS c, CAST(l_linenumber * 20 AS DOUBLE) AS x,
  CASE CAST((l_orderkey + l_linenumber) % 5 AS INT) WHEN 0 THEN 0.0 WHEN 1 THEN 2.0 WHEN 2 THEN 8.0 ELSE 1.0 END AS shift,
  CASE CAST((l_orderkey * 3 + l_linenumber) % 7 AS INT) WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 1 END AS copies
FROM lineitem GROUP BY l_orderkey, l_linenumber"""

MONITORING = """
SELECT event_id AS record_id, ts, CASE CAST(event_id % 4 AS INT) WHEN 0 THEN 'ocr' WHEN 1 THEN 'classification' WHEN 2 THEN 'extraction' ELSE 'pipeline' END AS stage,
  CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'SUCCESS' END AS status, value AS duration_seconds, event_type, user_id
FROM events"""

# every issue that a record can have: faults by modulo
MONITORING_FAULTS = """
SELECT event_id AS record_id, CASE CAST(event_id % 6 AS INT) WHEN 0 THEN 'ERROR' WHEN 1 THEN 'ERROR' ELSE 'SUCCESS' END AS status,
  CASE CAST(event_id % 11 AS INT) WHEN 0 THEN -1.0 WHEN 1 THEN CAST(NULL AS DOUBLE) ELSE value END AS duration_seconds, CASE WHEN event_id % 7 = 3 THEN CAST(NULL AS STRING) ELSE 'm' END AS model_name,
  CASE WHEN event_id % 6 = 0 THEN CAST(NULL AS BIGINT) WHEN event_id % 13 = 5 THEN CAST(-1 AS BIGINT) ELSE CAST(event_id % 5 AS BIGINT) END AS output_count,
  CASE WHEN event_id % 6 <= 1 THEN CAST(NULL AS DOUBLE) WHEN event_id % 17 = 2 THEN 1.5 ELSE 0.5 END AS mean_confidence,
  CASE WHEN event_id % 6 = 0 THEN 'RuntimeError' WHEN event_id % 6 = 1 THEN ' ' WHEN event_id % 19 = 4 THEN 'Late' END AS error_type, event_type, CAST(event_id % 23 = 6 AND event_id % 6 > 1 AS BOOLEAN) AS twice
FROM events"""

# pages of some documents begin at 1, or leave one out
PAGE_GAPS = """
SELECT document_id, CASE WHEN substr(document_id, -1) = '7' THEN page_index + 1 WHEN substr(document_id, -1) = '3' THEN page_index * 2 ELSE page_index END AS page_index FROM annotation_token"""

# the given vocabulary with a row for every fault
LABEL_FAULTS = """
SELECT id, name, prefix, entity_type FROM semantic_labels_v1
UNION ALL SELECT 300, 'B-ODD', 'B', 'ODD' UNION ALL SELECT 0, 'O', 'O', 'X' UNION ALL SELECT 301, 'I-WRONG', 'I', 'RIGHT' UNION ALL SELECT 302, 'Q', 'B', CAST(NULL AS STRING)"""

# OCR results as JSON, most of them with a fault
ENGINE_RESULTS = """
SELECT CAST(o_orderkey AS STRING) AS document_id, CAST(o_orderkey % 3 AS INT) AS result_index, CASE CAST(o_orderkey % 12 AS INT)
  WHEN 0 THEN '{"res": {"page_index": 3, "rec_texts": ["a", " ", "b"], "rec_scores": [0.5, 0.25, 1], "rec_boxes": [[1, 2, 3, 4], [0, 0, 0, 0], [5, 6, 7, 8]]}}'
  WHEN 1 THEN '{"rec_texts": ["a"], "rec_scores": [0.5], "rec_polys": [[[1, 2], [3, 2], [3, 4]]]}'
  WHEN 2 THEN '{"rec_texts": ["a"], "rec_scores": [0.5], "rec_boxes": [[[1, 2], [3, 2], [3, 4], [1, 4]]], "page_index": null}'
  WHEN 3 THEN '{"rec_texts": ["a", "b"], "rec_scores": [0.5, 0.5], "rec_polys": [[[1, 2], [3, 2], [3, 4]]]}'
  WHEN 4 THEN '{"rec_texts": ["a"], "rec_scores": [7.0], "rec_boxes": [[1, 2, 3, 4]]}'
  WHEN 5 THEN '{"rec_texts": ["a"], "rec_scores": [0.5], "rec_boxes": [[1, 2, 1, 4]]}'
  WHEN 6 THEN '{"rec_texts": ["a"], "rec_scores": [0.5], "rec_boxes": [], "rec_polys": [[[1, 2], [3, 2], [3, 4]]]}'
  WHEN 7 THEN '{"rec_texts": [null], "rec_scores": [0.5], "rec_boxes": [[1, 2, 3, 4]]}'
  WHEN 8 THEN '{"rec_scores": [0.5], "rec_boxes": [[1, 2, 3, 4]]}'
  WHEN 9 THEN '[]'
  WHEN 10 THEN '{"page_index": -1, "rec_texts": ["a"], "rec_scores": [0.5], "rec_boxes": [[1, 2, 3, 4]]}'
  ELSE '{"res": {"rec_texts": [], "rec_scores": [], "rec_boxes": []}}' END AS payload
FROM orders"""


def view(spark: SparkSession, d: str, sql: str, *tables: str) -> DataFrame:
    """The statement over some tables of a data directory."""
    for name in tables:
        table(spark, d, name).createOrReplaceTempView(name)
    return spark.sql(sql)


def ocr_pages(spark, d):
    return view(spark, d, OCR_PAGES, "orders")


def recognition(spark, d):
    return view(spark, d, RECOGNITION, "part").select("sample_id", "reference", "prediction", "identifier_type", F.array("p_brand", "p_type").alias("cohorts"))


def classified(spark, d):
    return view(spark, d, CLASSIFIED, "documents").select("sample_id", "reference", "prediction", F.array("lang", "source").alias("cohorts"))


def tokens(spark, d):
    """The token table without rows sent again; partitioned by page, so operators by page need no further shuffle."""
    rows = table(spark, d, "annotation_token").select("document_id", "page_index", "token_index", "text", "bounding_box", "label", "image_width", "image_height")
    return rows.repartition("document_id", "page_index").dropDuplicates(["document_id", "page_index", "token_index"])


def detection(spark, d):
    box = lambda x: F.struct(x.alias("x_min"), F.lit(0.0).alias("y_min"), (x + 10).alias("x_max"), F.lit(10.0).alias("y_max"))
    one = view(spark, d, BOXES, "lineitem").groupBy("sample_id").agg(F.sort_array(F.collect_list(F.struct("n", "x", "shift", "copies"))).alias("b"))
    predicted = F.flatten(F.transform("b", lambda b: F.array_repeat(box(b["x"] + b["shift"]), b["copies"])))
    return one.select("sample_id", F.transform("b", lambda b: box(b["x"])).alias("reference_boxes"), predicted.alias("predicted_boxes"), F.array(F.concat(F.lit("boxes-"), F.size("b").cast("string"))).alias("cohorts"))


def calibration(spark, d):
    logits = F.transform("embedding", lambda v: v.cast("double") * 8)
    return table(spark, d, "embeddings").select("vec_id", logits.alias("logits"), F.col("label").alias("target_index"), F.array(F.concat(F.lit("c"), (F.col("vec_id") % 3).cast("string"))).alias("cohorts"))


def spans_of(sides: DataFrame) -> DataFrame:
    """Both sides of an entity evaluation: reconstructed spans, and the same with errors by modulo."""
    f = F.col("first_token")
    one = lambda kind, value, last, side: F.struct(kind.alias("entity_type"), value.alias("raw_value"), F.col("page_index"), f.alias("first_token"), last.alias("last_token"), F.lit(side).alias("side"))
    wrong = one(F.when(f % 7 == 2, "SELLER_NAME").otherwise(F.col("entity_type")), F.when(f % 5 == 0, F.concat("raw_value", F.lit("x"))).otherwise(F.col("raw_value")), F.col("last_token") + F.when(f % 7 == 1, 1).otherwise(0), "predicted")
    both = F.array_compact(F.array(one(F.col("entity_type"), F.col("raw_value"), F.col("last_token"), "reference"), F.when(f % 7 != 0, wrong)))
    return sides.select(F.col("document_id").alias("sample_id"), F.array(F.substring_index("document_id", "-", 1)).alias("cohorts"), F.explode(both).alias("s")).select("sample_id", "cohorts", "s.*")


def artifact_tables(spark, d):
    """Records whose artifacts are the documents' texts, with faults by modulo, and the contents."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    k = F.col("doc_id")
    plain = F.concat(F.lit("texts/"), k.cast("string"), F.lit(".txt"))
    # ways to write a path, and texts that are JSON, hollow JSON or no JSON
    written = F.when(k % 22 == 7, F.concat(F.lit("./"), plain)).when(k % 22 == 8, F.concat(F.lit("a/.././"), plain)).when(k % 22 == 9, F.replace(plain, F.lit("/"), F.lit("//"))).when(k % 22 == 10, F.replace(plain, F.lit("/"), F.lit("%2F"))).otherwise(plain)
    docs = docs.withColumn("text", F.when(k % 14 == 1, F.lit('" "')).when(k % 14 == 3, F.lit('{"a": 1, "a": NaN}')).when(k % 14 == 5, F.lit(" [ ] ")).when(k % 14 == 7, F.lit("null")).when(k % 14 == 9, F.lit("")).when(k % 14 == 11, F.lit("[1,]")).otherwise(F.col("text")))
    uri = F.when(k % 11 == 0, F.lit("texts")).when(k % 11 == 1, F.concat(F.lit("../up/"), k.cast("string"))).when(k % 11 == 2, F.concat(F.lit("https://host/"), k.cast("string"))).when(k % 11 == 3, F.concat(F.lit("absent/"), k.cast("string"))).otherwise(written)
    artifact = F.struct(uri.alias("uri"), F.when(k % 11 == 4, F.sha2(F.lit("other"), 256)).otherwise(F.sha2("text", 256)).alias("sha256"), F.lit("application/json").alias("media_type"), F.when(k % 11 != 6, F.octet_length("text").cast("long") + F.when(k % 11 == 5, 1).otherwise(0)).alias("size_bytes"))
    records = docs.select(F.lit("texts").alias("manifest_name"), k.alias("pos"), k.cast("string").alias("id"), F.when(k % 2 == 0, artifact).alias("document"), F.when(k % 2 == 1, artifact).alias("annotation"))
    return records, docs.select(plain.alias("path"), F.col("text").cast("binary").alias("content"))


def monitoring(spark, d):
    error = F.col("status") == "ERROR"
    rows = view(spark, d, MONITORING, "events")
    return rows.select("record_id", "ts", "stage", "status", "duration_seconds", F.when(~error, F.col("user_id") % 20).cast("long").alias("output_count"), F.when(error, F.array().cast("array<string>")).otherwise(F.array("event_type")).alias("output_categories"), F.when(~error, (F.col("user_id") % 100) / 100.0).alias("mean_confidence"), F.when(error, "RuntimeError").alias("error_type"), *[F.lit("m").alias(c) for c in ("model_name", "model_version", "model_source")])


def engine_pages(spark, d):
    """OCR engine payloads made of the token pages: polygons instead of boxes, blanks kept, scores by index."""
    t = tokens(spark, d).where("bounding_box IS NOT NULL")
    b = F.col("bounding_box")
    corner = lambda x, y: F.array(b[x], b[y])
    poly = F.array(corner("x_min", "y_min"), corner("x_max", "y_min"), corner("x_max", "y_max"), corner("x_min", "y_max"))
    rows = t.groupBy("document_id", "page_index").agg(F.sort_array(F.collect_list(F.struct("token_index", "text", poly.alias("poly"), ((F.col("token_index") % 10) / 10.0).alias("score")))).alias("t"))
    return rows.select("document_id", F.col("page_index").alias("result_index"), F.when(F.col("page_index") % 2 == 0, F.col("page_index")).alias("page_index"), F.col("t.text").alias("rec_texts"), F.col("t.score").alias("rec_scores"), F.lit(None).cast("array<array<double>>").alias("rec_boxes"), F.col("t.poly").alias("rec_polys"))


def entity_samples(spark, d):
    """Every document of the token table as a sample, with the cohort of its spans (see :func:`spans_of`)."""
    one = table(spark, d, "annotation_token").select(F.col("document_id").alias("sample_id")).distinct()
    return one.withColumn("cohorts", F.array(F.substring_index("sample_id", "-", 1)))


def monitoring_faults(spark, d):
    rows = view(spark, d, MONITORING_FAULTS, "events")
    categories = F.when(F.col("twice"), F.array("event_type", "event_type")).when(F.col("status") == "ERROR", F.array().cast("array<string>")).otherwise(F.array("event_type"))
    return rows.withColumn("output_categories", categories).withColumns({c: F.lit("m") for c in ("model_version", "model_source")})


def ocr_rows(spark, d):
    """The token table with confidences by index, some of them above 1."""
    return tokens(spark, d).withColumn("confidence", F.when(F.col("token_index") % 5 != 3, (F.col("token_index") % 13) / 10.0))


def decisions(spark, d):
    """Classifications with faults by modulo."""
    from quirespark.operators import classification

    k = F.col("document_id").cast("long") % 9
    c = classification.classify(ocr_pages(spark, d))
    return c.withColumn("label", F.when(k == 1, F.lit("OTHER")).when(k == 2, F.when(F.col("label") == "INVOICE", "NOT_INVOICE").otherwise("INVOICE")).otherwise(F.col("label"))).withColumn(
        "decision_score", F.when(k == 3, F.lit(1.5)).otherwise(F.col("decision_score"))).withColumn("decision_threshold", F.when(k == 4, F.lit(0.0)).otherwise(F.col("decision_threshold"))).withColumn(
        "matched_signals", F.when(k == 5, F.array(F.lit("tax"), F.lit("tax"))).when(k == 6, F.array(F.lit(""))).otherwise(F.col("matched_signals")))


def entity_rows(spark, d):
    """Extracted entities with faults by modulo."""
    from quirespark.operators import extraction

    k = F.col("document_id").cast("long") % 9
    e = extraction.entities(ocr_pages(spark, d))
    none = F.array().cast("array<int>")
    return e.withColumn("entity_type", F.when(k == 1, "OTHER").otherwise(F.col("entity_type"))).withColumn("rule_id", F.when(k == 2, " ").otherwise(F.col("rule_id"))).withColumn(
        "token_references", F.when(k == 3, none).when(k == 4, F.array(F.lit(1), F.lit(1))).when(k == 5, F.array(F.lit(-1))).otherwise(F.col("token_references")))

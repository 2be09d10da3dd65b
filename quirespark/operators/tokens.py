"""Token tables: engine payloads, page texts, offsets, contiguity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirespark.functions.geometry import CORNERS, polygon_box, valid_box
from quirespark.functions.text import is_blank


ENGINE_PAGE = "page_index int, rec_texts array<string>, rec_scores array<double>, rec_boxes array<array<double>>, rec_polys array<array<array<double>>>"


def engine_pages(results: DataFrame) -> DataFrame:
    """Engine pages of JSON results ``document_id, result_index, payload``: what is inside ``res``, if that is there, else the object itself;
    null columns for fields that are missing, and null everywhere for a payload that isn't an object. A polygon in ``rec_boxes`` is
    moved to ``rec_polys``, as the engine's two forms of geometry are told apart by their depth."""
    inner = F.coalesce(F.get_json_object("payload", "$.res"), F.col("payload"))
    flat = F.from_json(inner, ENGINE_PAGE)
    deep = F.from_json(inner, "rec_boxes array<array<array<double>>>")["rec_boxes"]
    boxes = F.get_json_object(inner, "$.rec_boxes")
    nested = boxes.rlike(r"^\s*\[\s*\[\s*\[")
    return results.select("document_id", "result_index", flat.alias("p"), deep.alias("deep"), F.coalesce(nested, F.lit(False)).alias("nested")).select(
        "document_id", "result_index", "p.page_index", "p.rec_texts", "p.rec_scores", F.when(~F.col("nested"), F.col("p.rec_boxes")).alias("rec_boxes"), F.when(F.col("nested"), F.col("deep")).otherwise(F.col("p.rec_polys")).alias("rec_polys")
    )


def _geometry() -> Column:
    """Boxes of an engine page, one a text: from ``rec_boxes`` if they are given, else from polygons; null for one that is neither four
    numbers nor at least three points."""
    four = lambda b: F.when(F.size(b) == 4, F.struct(*[b[k].alias(c) for k, c in enumerate(CORNERS)]))
    points = lambda p: F.when(~F.exists(p, lambda q: q.isNull() | (F.size(q) != 2)), polygon_box(p))
    return F.coalesce(F.transform("rec_boxes", four), F.transform("rec_polys", points))


def _page_issue() -> Column:
    """The first thing that is wrong with an engine page; null if nothing is. A page is refused whole, whatever it is."""
    n, boxes = F.size("rec_texts"), _geometry()
    kept = F.exists(F.arrays_zip(F.col("rec_texts").alias("t"), F.col("rec_scores").alias("s"), boxes.alias("b")), lambda x: ~is_blank(x["t"]) & ~F.coalesce(valid_box(x["b"]), F.lit(False)))
    score = F.exists(F.arrays_zip(F.col("rec_texts").alias("t"), F.col("rec_scores").alias("s")), lambda x: ~is_blank(x["t"]) & (x["s"].isNull() | F.isnan(x["s"]) | (x["s"] < 0) | (x["s"] > 1)))
    return (
        F.when(F.col("rec_texts").isNull() | F.col("rec_scores").isNull() | boxes.isNull(), "missing_array")
        .when((F.size("rec_scores") != n) | (F.size(boxes) != n), "length_mismatch").when(F.exists("rec_texts", lambda t: t.isNull()), "invalid_text")
        .when(kept, "invalid_geometry").when(score, "invalid_confidence").when(F.coalesce("page_index", "result_index") < 0, "invalid_page_index")
    )


def from_engine(pages: DataFrame) -> DataFrame:
    """Token rows of OCR engine pages ``document_id, result_index, page_index, rec_texts, rec_scores, rec_boxes, rec_polys``.

    ``page_index`` falls back to the result's place. Blank texts are dropped and the rest is indexed anew from 0. Boxes are used where they are
    given, polygons only without them. A page with arrays that are missing or differ in length, or with a null text, a box or a confidence that
    breaks its contract, gives no tokens (see :func:`engine_issues`)."""
    good = pages.where(_page_issue().isNull()).withColumn("boxes", _geometry())
    kept = F.filter(F.arrays_zip(F.col("rec_texts").alias("text"), F.col("boxes").alias("bounding_box"), F.col("rec_scores").alias("confidence")), lambda x: ~is_blank(x["text"]))
    return good.select("document_id", F.coalesce("page_index", "result_index").alias("page_index"), F.posexplode(kept).alias("token_index", "t")).select("document_id", "page_index", "token_index", "t.text", "t.bounding_box", "t.confidence")


def engine_issues(pages: DataFrame) -> DataFrame:
    """``document_id, result_index, issue`` of the pages that :func:`from_engine` refuses."""
    return pages.select("document_id", "result_index", _page_issue().alias("issue")).where("issue IS NOT NULL")


def with_document_ids(documents: DataFrame) -> DataFrame:
    """``documents`` (``path``, perhaps ``document_id``) whose missing or empty ids are the file's name."""
    name = F.regexp_extract("path", r"([^/]*)/*$", 1)
    given = F.nullif(F.col("document_id"), F.lit("")) if "document_id" in documents.columns else F.lit(None).cast("string")
    return documents.withColumn("document_id", F.coalesce(given, name))


def _placed(tokens: DataFrame) -> DataFrame:
    """Tokens with their ``start`` and ``end`` in the page text."""
    order = Window.partitionBy("document_id", "page_index").orderBy("token_index", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.length(F.coalesce("text", F.lit("")))
    return tokens.withColumn("end", (F.sum(size + 1).over(order) - 1).cast("int")).withColumn("start", (F.col("end") - size).cast("int"))


def page_texts(tokens: DataFrame, with_tokens: bool = False) -> DataFrame:
    """``document_id, page_index, text``: token texts joined by one space in order of index; null texts count as empty. ``with_tokens`` adds
    ``tokens``, the ``token_index, start, end`` of each token in the text, so that later steps need no join; its window and the
    aggregation share one shuffle. Ties of an index go by text."""
    text = F.coalesce("text", F.lit("")).alias("text")
    if not with_tokens:
        pages = tokens.groupBy("document_id", "page_index").agg(F.sort_array(F.collect_list(F.struct("token_index", text))).alias("t"))
        return pages.select("document_id", "page_index", F.array_join("t.text", " ").alias("text"))
    rows = _placed(tokens.select("document_id", "page_index", "token_index", "text"))
    pages = rows.groupBy("document_id", "page_index").agg(F.sort_array(F.collect_list(F.struct("token_index", text, "start", "end"))).alias("t"))
    return pages.select("document_id", "page_index", F.array_join("t.text", " ").alias("text"), F.transform("t", lambda x: F.struct(x["token_index"], x["start"], x["end"])).alias("tokens"))


def offsets(tokens: DataFrame) -> DataFrame:
    """``document_id, page_index, token_index, start, end`` of tokens in the page text. Ties of an index go by text."""
    return _placed(tokens).select("document_id", "page_index", "token_index", "start", "end")


def gaps(tokens: DataFrame) -> DataFrame:
    """``document_id, page_index, token_index, expected_index`` of tokens whose index isn't their place on the page."""
    order = Window.partitionBy("document_id", "page_index").orderBy("token_index")
    placed = tokens.select("document_id", "page_index", "token_index", (F.row_number().over(order) - 1).alias("expected_index"))
    return placed.where("token_index != expected_index")

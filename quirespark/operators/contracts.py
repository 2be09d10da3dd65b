"""Contracts of what passes between stages: rows that break one, each with what it breaks. Nothing is changed or left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirespark.functions.geometry import valid_box
from quirespark.functions.text import is_blank
from quirespark.operators.classification import LABELS
from quirespark.operators.extraction import ENTITY_TYPES


def _blank(c: str) -> Column:
    return F.col(c).isNull() | is_blank(F.col(c))


def _outside_unit(c: Column) -> Column:
    return F.isnan(c) | (c < 0) | (c > 1)


def _rows(df: DataFrame, keys: tuple[str, ...], issues: list[tuple[str, Column]]) -> DataFrame:
    named = F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in issues])
    return df.select(*keys, F.explode(F.array_compact(named)).alias("issue"))


def ocr_token_issues(tokens: DataFrame) -> DataFrame:
    """``document_id, page_index, token_index, issue`` of OCR tokens: text that is missing or blank, a box that isn't one, indexes that are missing or negative, a confidence that isn't in [0, 1] (none is
    allowed); of pages: token indexes that don't count on from 0 in reading order (told of the first such token); of documents: a blank id."""
    order = Window.partitionBy("document_id", "page_index").orderBy("token_index")
    placed = tokens.withColumn("_k", F.row_number().over(order) - 1)
    gap = F.col("token_index") != F.col("_k")
    first = F.min(F.when(gap, F.col("_k"))).over(Window.partitionBy("document_id", "page_index"))
    placed = placed.withColumn("_first", first)
    return _rows(placed, ("document_id", "page_index", "token_index"), [
        ("blank_document_id", _blank("document_id") & (F.col("_k") == 0)), ("blank_text", _blank("text")), ("invalid_box", ~valid_box(F.col("bounding_box"))),
        ("invalid_page_index", F.col("page_index").isNull() | (F.col("page_index") < 0)), ("invalid_token_index", F.col("token_index").isNull() | (F.col("token_index") < 0)),
        ("non_contiguous_tokens", gap & (F.col("_k") == F.col("_first"))), ("invalid_confidence", _outside_unit(F.col("confidence"))),
    ])


def page_gaps(pages: DataFrame) -> DataFrame:
    """``document_id, page_index, issue`` of the first page of a document whose index isn't its place; ``pages`` may hold a page more than once."""
    order = Window.partitionBy("document_id").orderBy("page_index")
    placed = pages.select("document_id", "page_index").distinct().withColumn("_k", F.row_number().over(order) - 1)
    first = placed.where(~F.col("page_index").eqNullSafe(F.col("_k"))).groupBy("document_id").agg(F.min("_k").alias("_k"))
    return placed.join(first, ["document_id", "_k"]).select("document_id", "page_index", F.lit("non_contiguous_pages").alias("issue"))


def classification_issues(decisions: DataFrame, labels: tuple[str, str] = LABELS) -> DataFrame:
    """``document_id, issue`` of classifications ``document_id, label, decision_score, decision_threshold, matched_signals``: the label must be that of the score
    and the threshold, the score in [0, 1], the threshold in (0, 1], signals neither empty nor repeated."""
    score, threshold, signals = F.col("decision_score"), F.col("decision_threshold"), F.col("matched_signals")
    return _rows(decisions, ("document_id",), [
        ("blank_document_id", _blank("document_id")), ("unknown_label", F.col("label").isNull() | ~F.col("label").isin(*labels)), ("invalid_score", score.isNull() | _outside_unit(score)),
        ("invalid_threshold", threshold.isNull() | _outside_unit(threshold) | (threshold == 0)), ("label_disagrees", F.col("label").isin(*labels) & (F.col("label") != F.when(score >= threshold, labels[0]).otherwise(labels[1]))),
        ("empty_signal", signals.isNull() | F.exists(signals, lambda s: s.isNull() | (s == ""))), ("repeated_signal", F.size(F.array_distinct(signals)) != F.size(signals)),
    ])


def entity_issues(entities: DataFrame, types: tuple[str, ...] = ENTITY_TYPES) -> DataFrame:
    """``document_id, page_index, entity_type, raw_value, issue`` of extracted entities with ``token_references`` and ``rule_id``: no or repeated references, negative ones, blank values and rules, unknown types."""
    refs = F.col("token_references")
    return _rows(entities, ("document_id", "page_index", "entity_type", "raw_value"), [
        ("unknown_entity_type", F.col("entity_type").isNull() | ~F.col("entity_type").isin(*types)), ("blank_value", _blank("raw_value")), ("blank_rule_id", _blank("rule_id")),
        ("no_references", refs.isNull() | (F.size(refs) == 0)), ("repeated_reference", F.size(F.array_distinct(refs)) != F.size(refs)), ("negative_reference", F.exists(refs, lambda r: r.isNull() | (r < 0)) | (F.col("page_index") < 0)),
    ])


def span_issues(spans: DataFrame, types: tuple[str, ...] | None = None) -> DataFrame:
    """``document_id, page_index, entity_type, first_token, issue`` of reconstructed spans: a blank text, a type outside ``types`` (if given), tokens that are missing or out of order. A span whose ``token_references`` are there must have every
    index from the first to the last once, in order."""
    first, last = F.col("first_token"), F.col("last_token")
    issues = [("blank_value", _blank("raw_value")), ("invalid_tokens", first.isNull() | last.isNull() | (first < 0) | (last < first))]
    issues.append(("unknown_entity_type", F.col("entity_type").isNull() | (~F.col("entity_type").isin(*types) if types else F.lit(False))))
    if "token_references" in spans.columns:
        issues.append(("not_contiguous", (last >= first) & (F.col("token_references") != F.sequence(first, last))))
    return _rows(spans, ("document_id", "page_index", "entity_type", "first_token"), issues)

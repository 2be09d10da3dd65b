"""Document inference: one page table, two consumers, one row per document."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirespark.operators import classification, extraction, tokens
from quirespark.operators.classification import KeywordRules
from quirespark.operators.extraction import RULES, Rule

Stage = Callable[[DataFrame], DataFrame]
_ENTITY = ("page_index", "token_references", "entity_type", "raw_value", "rule_id")


def infer(pages: DataFrame, classify: Stage | None = None, extract: Stage | None = None, keywords: KeywordRules = KeywordRules(), rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``document_id, label, decision_score, matched_signals, entities`` of page rows ``document_id, page_index, text``, and ``tokens`` if there (see ``extraction.entities``). A document
    without entities has an empty list.

    Pages are read once: each is reduced to its flags and entities, and one shuffle brings a document's pages together. ``classify`` and ``extract`` are plug-in points, any functions
    from page rows to rows by document; with one of them both stages run on their own and are joined. A stage that answers for another document than the pages' is an error of
    the stage: such rows are left out (see :func:`foreign_rows`)."""
    if classify is None and extract is None:
        flags = [f.alias(f"f{k}") for k, f in enumerate(classification.page_flags(F.col("_page"), keywords))]
        ids = F.array(*[F.lit(r.rule_id) for r in rules])
        found = extraction.page_entities(F.col("text"), F.col("tokens") if "tokens" in pages.columns else None, rules)
        listed = F.transform(found, lambda e: F.struct(F.col("page_index"), e["token_references"], e["entity_type"], e["raw_value"], F.get(ids, e["rule"]).alias("rule_id")))
        page = pages.withColumn("_page", classification.normal_page(F.col("text"))).select("document_id", *flags, F.coalesce(listed, F.array().cast(_entities_type(pages))).alias("e"))
        names = [f"f{k}" for k in range(len(flags))]
        seen = page.groupBy("document_id").agg(*[F.max(n).alias(n) for n in names], F.flatten(F.collect_list("e")).alias("e"))
        decision = classification.decided([F.col(n) for n in names], keywords)
        return seen.select("document_id", decision[0], decision[1], decision[3], F.sort_array("e").alias("entities"))
    found = (extract or (lambda p: extraction.entities(p, rules)))(pages).groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct(*_ENTITY))).alias("entities"))
    none = F.array().cast(found.schema["entities"].dataType)
    decided = (classify or (lambda p: classification.classify(p, keywords)))(pages)
    known = pages.select("document_id").distinct()
    return decided.join(known, "document_id", "left_semi").join(found, "document_id", "left").select("document_id", "label", "decision_score", "matched_signals", F.coalesce("entities", none).alias("entities"))


def _entities_type(pages: DataFrame) -> str:
    index = pages.schema["page_index"].dataType.simpleString()
    token = pages.schema["tokens"].dataType.elementType["token_index"].dataType.simpleString() if "tokens" in pages.columns else "int"
    return f"array<struct<page_index:{index},token_references:array<{token}>,entity_type:string,raw_value:string,rule_id:string>>"


def foreign_rows(pages: DataFrame, output: DataFrame) -> DataFrame:
    """Rows of a stage's output whose ``document_id`` isn't that of a page."""
    return output.join(pages.select("document_id").distinct(), "document_id", "left_anti")


def infer_tokens(rows: DataFrame, **stages) -> DataFrame:
    """:func:`infer` of a token table; entities refer to the tokens' indexes."""
    return infer(tokens.page_texts(rows, with_tokens=True), **stages)


def telemetry(documents: DataFrame, rows: DataFrame, durations: dict[str, float] | None = None, with_ids: bool = False) -> DataFrame:
    """Four success records per document of :func:`infer` (``ocr``, ``classification``, ``extraction``, ``pipeline``): ``document_id, stage, status, duration_seconds, output_count, output_categories,
    mean_confidence``. Document ids are null unless asked for; the pipeline's record has no outputs; the decision score isn't reported as confidence. ``rows`` is the token table."""
    took = {k: max(0.0, v) for k, v in (durations or {}).items()}
    ocr = rows.groupBy("document_id").agg(F.count("*").alias("n"), F.avg("confidence").alias("c"))
    both = documents.join(ocr, "document_id", "left")
    none, no_text = F.lit(None), F.array().cast("array<string>")
    record = lambda s, n, cats, conf: F.struct(F.lit(s).alias("stage"), F.lit(took.get(s, 0.0)).alias("duration_seconds"), n.cast("long").alias("output_count"), cats.alias("output_categories"), conf.cast("double").alias("mean_confidence"))
    records = F.array(
        record("ocr", F.coalesce("n", F.lit(0)), no_text, F.col("c")),
        record("classification", F.lit(1), F.array("label"), none),
        record("extraction", F.size("entities"), F.array_sort(F.array_distinct(F.col("entities.entity_type"))), none),
        record("pipeline", none, no_text, none),
    )
    return both.select((F.col("document_id") if with_ids else F.lit(None).cast("string")).alias("document_id"), F.explode(records).alias("r")).select("document_id", "r.stage", F.lit("SUCCESS").alias("status"), "r.duration_seconds", "r.output_count", "r.output_categories", "r.mean_confidence")


def failures(errors: DataFrame, with_ids: bool = False) -> DataFrame:
    """Error records of failed documents ``document_id, stage, error_type, duration_seconds``: one of the stage that failed and one of the
    pipeline, in the columns of :func:`telemetry` and ``error_type``. A stage that didn't run leaves no record; error records have no
    outputs. Negative durations count as 0, a missing or blank error type is ``Exception``."""
    kind = F.when(F.trim(F.coalesce("error_type", F.lit(""))) == "", "Exception").otherwise(F.col("error_type"))
    stages = F.array_distinct(F.array(F.col("stage"), F.lit("pipeline")))
    rows = errors.select((F.col("document_id") if with_ids else F.lit(None).cast("string")).alias("document_id"), F.explode(stages).alias("stage"), F.lit("ERROR").alias("status"), F.greatest(F.lit(0.0), F.coalesce("duration_seconds", F.lit(0.0))).alias("duration_seconds"), kind.alias("error_type"))
    return rows.select("document_id", "stage", "status", "duration_seconds", F.lit(None).cast("long").alias("output_count"), F.array().cast("array<string>").alias("output_categories"), F.lit(None).cast("double").alias("mean_confidence"), "error_type")

"""The pN_ queries of the operators in this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.llm import chunking, frequency, leakage, mixing, normalise, overlap, splits, subjects, twins
from quirespark.session import table

#: Setting that names the rank file of the tokenizer, and its default.
RANKS = "spark.quirespark.ranks", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
Query = Callable[[SparkSession, str], DataFrame]


def _p1_found(spark, d):
    return overlap.found(table(spark, d, "manifest"), table(spark, d, "annotation_token"))


def _overlap(spark, d):
    return overlap.Overlap(table(spark, d, "manifest"), table(spark, d, "annotation_token"))


def _p1_overlap_counts(spark, d):
    return overlap.counts_by_source(table(spark, d, "manifest"), table(spark, d, "annotation_token"))


def _p3_found(spark, d):
    return splits.torn_sets(table(spark, d, "manifest"), table(spark, d, "manifest_head"))


def _p3_splits(spark, d):
    return splits.new_splits(table(spark, d, "manifest"), table(spark, d, "manifest_head"))


def _p3_split_report(spark, d):
    heads = table(spark, d, "manifest_head")
    return splits.split_report(splits.new_splits(table(spark, d, "manifest"), heads), heads)


def _p3_split_check(spark, d):
    """By manifest: records, sets, sets that lie in more than one new split, and whether every share is within two points of its target or of the largest set's share."""
    heads = table(spark, d, "manifest_head")
    placed = splits.new_splits(table(spark, d, "manifest"), heads)
    sets = placed.groupBy("manifest_name", "set_id").agg(F.count("*").alias("n"), F.countDistinct("new_split").alias("k")).groupBy("manifest_name").agg(
        F.sum("n").alias("records"), F.count("*").alias("sets"), F.count_if(F.col("k") > 1).alias("torn_sets"), F.max("n").alias("largest"))
    off = splits.split_report(placed, heads).groupBy("manifest_name").agg(F.max(F.abs(F.col("share") - F.col("target_share"))).alias("off"))
    near = F.col("off") <= F.greatest(F.lit(0.02), F.col("largest") / F.col("records"))
    return sets.join(off, "manifest_name").select("manifest_name", "records", "sets", "torn_sets", near.alias("near_targets"))


def _p4_terms(spark, d):
    return frequency.label_terms(table(spark, d, "annotation_token"), table(spark, d, "semantic_labels_v1"))


def _p4_found(spark, d):
    return _p4_terms(spark, d).where("mark IS NOT NULL").select("field", "term", "mark")


def _p5_normalised(spark, d):
    tokens = table(spark, d, "annotation_token").select("document_id", "page_index", "token_index", "text")
    return normalise.normalised(tokens)


def _p5_found(spark, d):
    return normalise.unusual_tokens(table(spark, d, "annotation_token"))


def _p6_found(spark, d):
    return _p6_pieces(spark, d).select("document_id", "page_index").distinct()


def _p6_pieces(spark, d):
    return chunking.chunked_pages(table(spark, d, "annotation_token"))


def _p6_rejoined(spark, d):
    """By long page: the words of its pieces without those that are repeated, put together again, and whether the pieces keep their limit and overlap."""
    own = F.slice(F.split("text", " "), F.col("repeated") + 1, F.size(F.split("text", " ")))
    pieces = _p6_pieces(spark, d).select("document_id", "page_index", "piece_index", "n_words", "repeated", own.alias("w"))
    one = pieces.groupBy("document_id", "page_index").agg(
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("piece_index", "w"))), lambda x: x["w"])).alias("w"), F.max("n_words").alias("longest"),
        F.min(F.when(F.col("piece_index") > 0, F.col("repeated"))).alias("least_repeated"), F.max(F.when(F.col("piece_index") > 0, F.col("repeated"))).alias("most_repeated"))
    return one.select("document_id", "page_index", F.size("w").cast("long").alias("n_words"), F.md5(F.array_join("w", " ").cast("binary")).alias("words_md5"), (F.col("longest") <= chunking.LIMIT).alias("within_limit"), "least_repeated", "most_repeated")


def _p7_found(spark, d):
    return leakage.found(table(spark, d, "documents"), table(spark, d, "eval_item"))


def _p7_leak_spans(spark, d):
    return leakage.leak_spans(table(spark, d, "documents"), table(spark, d, "eval_item"))


def _p7_cleaned(spark, d):
    return leakage.cleaned(table(spark, d, "documents"), table(spark, d, "eval_item"))


def _mixture(spark, d):
    return mixing.Mixture(table(spark, d, "documents"), table(spark, d, "mix_target"), spark.conf.get(*RANKS))


def _p8_mixture(spark, d):
    return _mixture(spark, d).rows


def _p8_shares(spark, d):
    return _mixture(spark, d).report()


def _p8_share_check(spark, d):
    """By listed source: documents with text, whether no row is used too often, and whether the share reached is within two points of its target among the sources that occur."""
    shares = _p8_shares(spark, d)
    texts = table(spark, d, "documents").where("length(text) > 0").groupBy("source").agg(F.count("*").alias("documents"))
    there = shares.where("tokens > 0").agg(F.sum("target_share")).first()[0]
    wanted = F.when(F.col("tokens") > 0, F.col("target_share") / F.lit(there)).otherwise(0.0)
    both = shares.join(texts, "source", "left")
    return both.select("source", "target_share", "max_repeat", F.coalesce("documents", F.lit(0)).alias("documents"), (F.col("most_copies") <= F.col("max_repeat")).alias("within_repeat"), (F.abs(F.col("actual_share") - wanted) <= 0.02).alias("near_target"))


def _p8_temperature(spark, d):
    return mixing.temperature_report(table(spark, d, "documents"), table(spark, d, "mix_target"), spark.conf.get(*RANKS))


def _scored(spark, d):
    return subjects.scored(table(spark, d, "documents"), table(spark, d, "subject_label"), table(spark, d, "subject_area"))


def _p9_found(spark, d):
    return _scored(spark, d).where("subject IS NOT NULL").select("doc_id", "subject")


def _p9_composition(spark, d):
    return subjects.composition(_scored(spark, d))


def queries() -> dict[str, Query]:
    return {
        "p1_found": _p1_found, "p1_overlap_counts": _p1_overlap_counts,
        "p1_classes": lambda s, d: _overlap(s, d).classes(),
        "p1_links": lambda s, d: _overlap(s, d).links.select(F.col("rep_t").alias("train_class"), F.col("rep_h").alias("held_class"), "distance"),
        "p3_found": _p3_found, "p3_splits": _p3_splits, "p3_split_report": _p3_split_report, "p3_split_check": _p3_split_check,
        "p4_found": _p4_found, "p4_terms": _p4_terms,
        "p5_found": _p5_found, "p5_normalised": _p5_normalised,
        "p6_found": _p6_found, "p6_pieces": _p6_pieces, "p6_rejoined": _p6_rejoined,
        "p7_found": _p7_found, "p7_leak_spans": _p7_leak_spans, "p7_cleaned": _p7_cleaned,
        "p8_mixture": _p8_mixture, "p8_shares": _p8_shares, "p8_share_check": _p8_share_check, "p8_temperature": _p8_temperature,
        "p9_found": _p9_found, "p9_composition": _p9_composition,
    }


def oracle_sql() -> dict[str, str]:
    return twins.SQL

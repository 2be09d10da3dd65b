"""Entity evaluation: token, span and field level.

Spans are rows ``sample_id, side ('reference' or 'predicted'), entity_type, raw_value, page_index, first_token, last_token, cohorts``. Every level is one
aggregation over both sides (no join): a key is a hit if both sides hold it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirespark.functions.geometry import f1_score, ratio
from quirespark.operators.extraction import ENTITY_TYPES
from quirespark.operators.slices import with_slices


def _both(rows: DataFrame, *key: str) -> DataFrame:
    return rows.groupBy("cohort", *key).agg(F.bool_or(F.col("side") == "reference").alias("r"), F.bool_or(F.col("side") == "predicted").alias("p"))


def _scores(keys: DataFrame, level: str) -> DataFrame:
    kinds = F.array(F.lit("ALL"), F.col("entity_type"))
    counts = keys.select("cohort", "r", "p", F.explode(kinds).alias("entity_type")).groupBy("cohort", "entity_type").agg(
        F.count_if(F.col("r") & F.col("p")).alias("true_positives"), F.count_if(~F.col("r") & F.col("p")).alias("false_positives"), F.count_if(F.col("r") & ~F.col("p")).alias("false_negatives"))
    tp = F.col("true_positives")
    both = counts.withColumns({"precision": ratio(tp, tp + F.col("false_positives")), "recall": ratio(tp, tp + F.col("false_negatives"))})
    return both.withColumn("f1", f1_score(F.col("precision"), F.col("recall"), 0.0)).withColumn("level", F.lit(level))


def token_metrics(spans: DataFrame) -> DataFrame:
    """Per slice and type (``ALL``: every type): tokens of a type in a sample."""
    rows = with_slices(spans).select("cohort", "side", "sample_id", "entity_type", "page_index", F.explode(F.sequence("first_token", "last_token")).alias("token"))
    return _scores(_both(rows, "sample_id", "entity_type", "page_index", "token"), "token")


def span_metrics(spans: DataFrame) -> DataFrame:
    """The same for whole spans; the text of a span doesn't matter."""
    return _scores(_both(with_slices(spans), "sample_id", "entity_type", "page_index", "first_token", "last_token"), "entity")


def field_metrics(spans: DataFrame) -> DataFrame:
    """``cohort, entity_type, fields, exact, exact_match_rate``: a field (sample and type) is exact if both sides hold the same values
    equally often, wherever they are; fields neither side holds aren't counted."""
    one = with_slices(spans).groupBy("cohort", "sample_id", "entity_type", "raw_value").agg(F.sum(F.when(F.col("side") == "reference", 1).otherwise(-1)).alias("d"))
    fields = one.groupBy("cohort", "sample_id", "entity_type").agg(F.bool_and(F.col("d") == 0).alias("exact"))
    kinds = fields.select("cohort", "exact", F.explode(F.array(F.lit("ALL"), F.col("entity_type"))).alias("entity_type"))
    sums = kinds.groupBy("cohort", "entity_type").agg(F.count("*").alias("fields"), F.count_if("exact").alias("exact"))
    return sums.withColumn("exact_match_rate", ratio(F.col("exact"), F.col("fields")))


def overlapping(spans: DataFrame) -> DataFrame:
    """``sample_id, side, page_index, token, uses`` of tokens that more than one span of a side uses."""
    rows = spans.select("sample_id", "side", "page_index", F.explode(F.sequence("first_token", "last_token")).alias("token"))
    return rows.groupBy("sample_id", "side", "page_index", "token").agg(F.count("*").alias("uses")).where("uses > 1")


_LEVELS = {"token": token_metrics, "entity": span_metrics}
_COUNTS = ("true_positives", "false_positives", "false_negatives")


def evaluation(samples: DataFrame, spans: DataFrame, types: tuple[str, ...] = ENTITY_TYPES) -> DataFrame:
    """``cohort, entity_type, sample_count``, for both levels ``token`` and ``entity`` the counts and ``precision, recall, f1``, and ``field_count, exact_matches, exact_match_rate``: a row for every slice of
    ``samples`` (``sample_id, cohorts``) and every type (``ALL``: the whole), where nothing was found with zeros and null ratios. Samples without spans count as samples. Cohorts are those of
    the samples; spans of samples that aren't there are left out. Types outside ``types`` are part of ``ALL`` and have rows of their own only if they occur."""
    sizes = with_slices(samples).groupBy("cohort").agg(F.countDistinct("sample_id").alias("sample_count"))
    own = spans.drop("cohorts").join(samples.select("sample_id", "cohorts").dropDuplicates(["sample_id"]), "sample_id")
    grid = sizes.select("cohort", "sample_count", F.explode(F.array(F.lit("ALL"), *map(F.lit, types))).alias("entity_type"))
    out = grid
    for level, metrics in _LEVELS.items():
        found = metrics(own).select(F.col("cohort").alias("_c"), F.col("entity_type").alias("_t"), *[F.col(c).alias(f"{level}_{c}") for c in (*_COUNTS, "precision", "recall", "f1")])
        out = out.join(found, F.col("cohort").eqNullSafe(F.col("_c")) & (F.col("entity_type") == F.col("_t")), "left").drop("_c", "_t")
    fields = field_metrics(own).select(F.col("cohort").alias("_c"), F.col("entity_type").alias("_t"), F.col("fields").alias("field_count"), F.col("exact").alias("exact_matches"), "exact_match_rate")
    out = out.join(fields, F.col("cohort").eqNullSafe(F.col("_c")) & (F.col("entity_type") == F.col("_t")), "left").drop("_c", "_t")
    return out.fillna(0, [f"{level}_{c}" for level in _LEVELS for c in _COUNTS] + ["field_count", "exact_matches"])

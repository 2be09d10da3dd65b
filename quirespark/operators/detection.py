"""Region matching and detection metrics."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirespark.functions.geometry import f1_score, overlap, ratio
from quirespark.operators.slices import sliced

#: Least intersection over union, inclusive.
LEAST_IOU = 0.5
MATCHES = T.ArrayType(T.StructType([T.StructField("reference_index", T.IntegerType()), T.StructField("predicted_index", T.IntegerType())]))


def _checked(least: float) -> float:
    if isinstance(least, bool) or not isinstance(least, (int, float)) or not 0 < least <= 1:
        raise ValueError("the IoU threshold must be a number in (0, 1]")
    return float(least)


def candidates(samples: DataFrame, least: float = LEAST_IOU) -> DataFrame:
    """``sample_id, predicted_index, reference_index, iou`` of the pairs of boxes in one sample with enough overlap. Samples are rows
    ``sample_id, reference_boxes, predicted_boxes`` (arrays of boxes); null boxes pair with nothing. No shuffle."""
    pairs = samples.select("sample_id", F.posexplode("predicted_boxes").alias("predicted_index", "p"), "reference_boxes").select("sample_id", "predicted_index", "p", F.posexplode("reference_boxes").alias("reference_index", "r"))
    return pairs.withColumn("iou", overlap(F.col("r"), F.col("p"))).where(F.col("iou") >= _checked(least)).select("sample_id", "predicted_index", "reference_index", "iou")


def assign(options: list[list[int]]) -> list[tuple[int, int]]:
    """Largest one-to-one assignment: predictions in turn take the first reference of their list that is free or can be freed.
    Iterative, so dense pages don't run out of stack. ``(reference, prediction)`` by reference."""
    owner: dict[int, int] = {}
    for start in range(len(options)):
        seen: set[int] = set()
        path: list[tuple[int, int]] = []  # prediction, reference it asks for
        stack = [(start, iter(options[start]))]
        while stack:
            prediction, rest = stack[-1]
            reference = next((r for r in rest if r not in seen), None)
            if reference is None:
                stack.pop()
                if path:
                    path.pop()
                continue
            seen.add(reference)
            path.append((prediction, reference))
            if reference not in owner:
                for p, r in path:
                    owner[r] = p
                break
            stack.append((owner[reference], iter(options[owner[reference]])))
    return sorted(owner.items())


def _append_matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the last column, the candidate lists, by the matches; other columns pass as they are."""
    for batch in batches:
        rows = [[] if o is None else [{"reference_index": r, "predicted_index": p} for r, p in assign([x or [] for x in o])] for o in batch.column(batch.num_columns - 1).to_pylist()]
        matches = pa.array(rows, pa.list_(pa.struct([("reference_index", pa.int32()), ("predicted_index", pa.int32())])))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], matches], [*batch.schema.names[:-1], "matches"])


def matched(samples: DataFrame, least: float = LEAST_IOU) -> DataFrame:
    """``samples`` with ``matches`` (array of reference and predicted index). The candidate lists are made and pruned inside the JVM, best
    overlap first, ties by higher reference index; Python sees only small index lists."""
    least = _checked(least)
    def options(p):
        pairs = F.transform(F.col("reference_boxes"), lambda r, i: F.struct(overlap(r, p).alias("iou"), i.alias("i")))
        good = F.filter(pairs, lambda x: x["iou"] >= least)
        return F.transform(F.sort_array(good, asc=False), lambda x: x["i"])

    samples = samples.drop("matches")
    listed = samples.select("*", F.transform(F.col("predicted_boxes"), options).alias("_options"))
    return listed.mapInArrow(_append_matches, T.StructType([*samples.schema.fields, T.StructField("matches", MATCHES)]))


def metrics(samples: DataFrame, least: float = LEAST_IOU) -> DataFrame:
    """Per slice ``true_positives, false_positives, false_negatives, precision, recall, f1``; null where undefined, f1 also where
    precision and recall are 0."""
    size = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c))
    rows = matched(samples, least).select("cohorts", F.size("matches").alias("m"), size("predicted_boxes").alias("p"), size("reference_boxes").alias("r"))
    sums = sliced(rows, F.count("*").alias("sample_count"), F.sum("m").alias("true_positives"), F.sum(F.col("p") - F.col("m")).alias("false_positives"), F.sum(F.col("r") - F.col("m")).alias("false_negatives"))
    tp = F.col("true_positives")
    sums = sums.withColumns({"precision": ratio(tp, tp + F.col("false_positives")), "recall": ratio(tp, tp + F.col("false_negatives"))})
    return sums.withColumn("f1", f1_score(F.col("precision"), F.col("recall")))


def observations(samples: DataFrame, least: float = LEAST_IOU) -> DataFrame:
    """``sample_id, stage, category, occurrences, cohorts`` of missed and spurious regions."""
    rows = matched(samples, least)
    missed = F.struct(F.lit("missed_region").alias("category"), (F.size("reference_boxes") - F.size("matches")).cast("long").alias("occurrences"))
    spurious = F.struct(F.lit("spurious_region").alias("category"), (F.size("predicted_boxes") - F.size("matches")).cast("long").alias("occurrences"))
    found = rows.select("sample_id", "cohorts", F.explode(F.array(missed, spurious)).alias("o")).where("o.occurrences > 0")
    return found.select("sample_id", F.lit("detection").alias("stage"), "o.category", "o.occurrences", "cohorts")

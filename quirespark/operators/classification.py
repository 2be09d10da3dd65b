"""Keyword classification and classification metrics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirespark.functions.geometry import f1_score, ratio
from quirespark.functions.text import has_phrase, normalised
from quirespark.operators.slices import with_slices

# Labels in declaration order.
LABELS = ("INVOICE", "NOT_INVOICE")


@dataclass(frozen=True)
class KeywordRules:
    """Signals of the classifier and the least share of them."""

    # The baseline's signals, in order, and its threshold.
    signals: tuple[str, ...] = ("invoice", "invoice date", "bill to", "amount due", "subtotal", "tax")
    threshold: float = 0.3
    labels: tuple[str, str] = LABELS


def page_flags(page: Column, rules: KeywordRules) -> list[Column]:
    """For each signal whether a page in its normal form (:func:`normal_page`) holds it as whole words."""
    return [has_phrase(page, normalised(F.lit(s))) for s in rules.signals]


def normal_page(text: Column) -> Column:
    """A page's text for :func:`page_flags`; null and blank pages hold nothing."""
    return normalised(F.coalesce(text, F.lit("")))


def decided(flags: list[Column], rules: KeywordRules) -> list[Column]:
    """``label, decision_score, decision_threshold, matched_signals`` from a document's flags."""
    matched = F.array_compact(F.array(*[F.when(f, F.lit(s)) for f, s in zip(flags, rules.signals)]))
    score = F.size(matched) / F.lit(float(len(rules.signals)))
    label = F.when(score >= rules.threshold, rules.labels[0]).otherwise(rules.labels[1])
    return [label.alias("label"), score.alias("decision_score"), F.lit(rules.threshold).alias("decision_threshold"), matched.alias("matched_signals")]


def classify(pages: DataFrame, rules: KeywordRules = KeywordRules()) -> DataFrame:
    """``document_id, label, decision_score, decision_threshold, matched_signals`` of documents given by page rows ``document_id, text``.

    A signal counts once if some page holds it as whole normalised words; it never spans pages. Null and blank pages match nothing.
    One shuffle by document, after each page is reduced to one flag a signal.
    """
    names = [f"_{k}" for k in range(len(rules.signals))]
    page = pages.select("document_id", normal_page(F.col("text")).alias("_page"))
    flags = [F.max(f).alias(n) for n, f in zip(names, page_flags(F.col("_page"), rules))]
    return page.groupBy("document_id").agg(*flags).select("document_id", *decided([F.col(n) for n in names], rules))


def _grid(slices: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(r).alias("reference"), F.lit(p).alias("prediction")) for r in labels for p in labels])
    return slices.select("cohort", F.explode(pairs).alias("g")).select("cohort", "g.reference", "g.prediction")


def confusion(samples: DataFrame, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """``cohort, reference, prediction, sample_count``: every cell of every slice, zero ones too. Samples whose label isn't one
    of ``labels`` fill no cell."""
    counts = with_slices(samples).groupBy("cohort", "reference", "prediction").agg(F.count("*").alias("n"))
    cells = _grid(counts.select("cohort").distinct(), labels).alias("g")
    c = counts.alias("c")
    on = F.col("g.cohort").eqNullSafe(F.col("c.cohort")) & (F.col("g.reference") == F.col("c.reference")) & (F.col("g.prediction") == F.col("c.prediction"))
    return cells.join(c, on, "left").select("g.cohort", "g.reference", "g.prediction", F.coalesce("n", F.lit(0)).alias("sample_count"))


def _counts(samples: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """One row per slice with the counts of every class, from one aggregation."""
    measures = [F.count("*").alias("n"), F.count_if(F.col("reference") == F.col("prediction")).alias("hits")]
    for k, c in enumerate(labels):
        r, p = F.col("reference") == c, F.col("prediction") == c
        measures += [F.count_if(r & p).alias(f"tp{k}"), F.count_if(~r & p).alias(f"fp{k}"), F.count_if(r & ~p).alias(f"fn{k}")]
    return with_slices(samples).groupBy("cohort").agg(*measures)


def _scores(k: int) -> tuple[Column, Column, Column]:
    p, r = ratio(F.col(f"tp{k}"), F.col(f"tp{k}") + F.col(f"fp{k}")), ratio(F.col(f"tp{k}"), F.col(f"tp{k}") + F.col(f"fn{k}"))
    return p, r, f1_score(p, r)


def class_metrics(samples: DataFrame, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """``cohort, label, support, precision, recall, f1``; undefined ratios are null, f1 too where both are 0."""
    rows = [F.struct(F.lit(c).alias("label"), (F.col(f"tp{k}") + F.col(f"fn{k}")).alias("support"), *[x.alias(n) for x, n in zip(_scores(k), ("precision", "recall", "f1"))]) for k, c in enumerate(labels)]
    return _counts(samples, labels).select("cohort", F.explode(F.array(*rows)).alias("m")).select("cohort", "m.*")


def summary(samples: DataFrame, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """``cohort, sample_count, accuracy, macro_f1``: macro F1 averages the classes where it is defined."""
    f1s = F.filter(F.array(*[_scores(k)[2] for k in range(len(labels))]), lambda x: x.isNotNull())
    macro = F.try_divide(F.aggregate(f1s, F.lit(0.0), lambda a, x: a + x), F.size(f1s).cast("double"))
    return _counts(samples, labels).select("cohort", F.col("n").alias("sample_count"), ratio(F.col("hits"), F.col("n")).alias("accuracy"), macro.alias("macro_f1"))

"""Boxes, ratios and calibration mathematics as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

CORNERS = ("x_min", "y_min", "x_max", "y_max")


def ratio(numerator: Column, denominator: Column) -> Column:
    """Null, not zero, where the denominator is 0."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def f1_score(precision: Column, recall: Column, both_zero: float | None = None) -> Column:
    """Harmonic mean; null if either is null, ``both_zero`` if their sum is 0."""
    score = F.when(precision + recall == 0, F.lit(both_zero).cast("double")).otherwise(F.try_divide(2 * precision * recall, precision + recall))
    return F.when(precision.isNotNull() & recall.isNotNull(), score)


def width(box: Column) -> Column:
    return box["x_max"] - box["x_min"]


def height(box: Column) -> Column:
    return box["y_max"] - box["y_min"]


def area(box: Column) -> Column:
    return width(box) * height(box)


def valid_box(box: Column) -> Column:
    """Finite, not negative, with positive extent; false for a missing box."""
    good = [box[c].isNotNull() & ~F.isnan(box[c]) & (box[c] >= 0) & (box[c] < float("inf")) for c in CORNERS]
    return F.coalesce(good[0] & good[1] & good[2] & good[3] & (box["x_max"] > box["x_min"]) & (box["y_max"] > box["y_min"]), F.lit(False))


def overlap(a: Column, b: Column) -> Column:
    """Intersection over union; null if the union is empty."""
    w = F.greatest(F.lit(0.0), F.least(a["x_max"], b["x_max"]) - F.greatest(a["x_min"], b["x_min"]))
    h = F.greatest(F.lit(0.0), F.least(a["y_max"], b["y_max"]) - F.greatest(a["y_min"], b["y_min"]))
    return F.try_divide(w * h, area(a) + area(b) - w * h)


def polygon_box(points: Column) -> Column:
    """Smallest box around ``array<array<double>>`` points; null for fewer than three."""
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    return F.when(F.size(points) >= 3, F.struct(F.array_min(xs).alias("x_min"), F.array_min(ys).alias("y_min"), F.array_max(xs).alias("x_max"), F.array_max(ys).alias("y_max")))


def grid_box(box: Column, page_width: Column, page_height: Column, scale: int = 1000) -> Column:
    """Box on the grid ``0..scale``: minima rounded down, maxima up. Null, never clipped, for a box that isn't valid or
    isn't within the page."""
    inside = valid_box(box) & (box["x_max"] <= page_width) & (box["y_max"] <= page_height)

    def at(corner: str, size: Column, rounded: Callable[[Column], Column]) -> Column:
        return rounded(F.lit(float(scale)) * box[corner] / F.nullif(size.cast("double"), F.lit(0.0))).cast("int").alias(corner)

    return F.when(inside, F.struct(at("x_min", page_width, F.floor), at("y_min", page_height, F.floor), at("x_max", page_width, F.ceil), at("y_max", page_height, F.ceil)))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body (and the lambdas in it) use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def softmax(logits: Column, temperature: float | Column = 1.0) -> Column:
    """Probabilities of ``logits / temperature``, stable for large values; linear in their number."""
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))

    def shares(powers: Column) -> Column:
        return bound(total(powers), lambda s: F.transform(powers, lambda e: e / s))

    def powers(scaled: Column) -> Column:
        return bound(F.array_max(scaled), lambda top: bound(F.transform(scaled, lambda z: F.exp(z - top)), shares))

    return bound(F.transform(logits, lambda z: z / t), powers)


def log_sum_exp(values: Column) -> Column:
    """Stable logarithm of the sum of exponentials; linear in their number."""
    return bound(values, lambda v: bound(F.array_max(v), lambda top: top + F.ln(total(F.transform(v, lambda x: F.exp(x - top))))))


def first_max(values: Column) -> Column:
    """Zero-based place of the first largest value."""
    return bound(values, lambda v: (F.array_position(v, F.array_max(v)) - 1).cast("int"))

"""Calibration metrics and temperature scaling. Samples are rows ``sample_id, logits (array), target_index, cohorts``."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirespark.functions.geometry import first_max, log_sum_exp, ratio, softmax
from quirespark.functions.text import FORMATS
from quirespark.operators.slices import with_slices
from quirespark.session import written

# Bounds of the temperature, reliability bins.
T_MIN, T_MAX, BINS = 0.05, 10.0, 15


def check_samples(samples: DataFrame) -> None:
    """Raises unless there are samples, all with the same number of logits, at least two, and targets in range."""
    r = samples.agg(F.count("*"), F.min(F.size("logits")), F.max(F.size("logits")), F.count_if(F.exists("logits", lambda z: z.isNull() | F.isnan(z) | (F.abs(z) == math.inf)) | F.col("target_index").isNull() | (F.col("target_index") < 0) | (F.col("target_index") >= F.size("logits")))).first()
    if not r[0] or r[1] != r[2] or r[1] < 2 or r[3]:
        raise ValueError("calibration needs samples with one number of classes, finite logits and targets in range")


def _checked(samples: DataFrame, temperature: float, bins: int) -> None:
    if isinstance(bins, bool) or not isinstance(bins, int) or not 2 <= bins <= 100:
        raise ValueError("there are 2 to 100 bins")
    if isinstance(temperature, bool) or not 0 < temperature < math.inf:
        raise ValueError("the temperature must be finite and positive")
    check_samples(samples)


def _rows(samples: DataFrame, temperature: float) -> DataFrame:
    p = samples.select("cohorts", "target_index", softmax(F.col("logits"), temperature).alias("p"))
    y = F.col("target_index")
    brier = F.aggregate(F.transform("p", lambda v, i: F.pow(v - F.when(i == y, 1.0).otherwise(0.0), 2)), F.lit(0.0), lambda a, x: a + x)
    nll = -F.ln(F.greatest(F.get("p", y), F.lit(1e-300)))
    return p.select("cohorts", F.array_max("p").alias("confidence"), (first_max(F.col("p")) == y).cast("int").alias("hit"), nll.alias("nll"), brier.alias("brier"))


def _bin(bins: int):
    return F.least(F.floor(F.col("confidence") * bins).cast("int"), F.lit(bins - 1))


def metrics(samples: DataFrame, temperature: float = 1.0, bins: int = BINS) -> DataFrame:
    """``cohort, sample_count, nll, ece, brier, mean_confidence, accuracy`` per slice. The error over bins comes from per-bin sums, so all slices take
    two small aggregations. No samples, or samples with different numbers of classes, are an error."""
    _checked(samples, temperature, bins)
    binned = with_slices(_rows(samples, temperature)).withColumn("bin", _bin(bins)).groupBy("cohort", "bin").agg(
        F.count("*").alias("n"), F.sum("confidence").alias("c"), F.sum("hit").alias("h"), F.sum("nll").alias("nll"), F.sum("brier").alias("b"))
    sums = binned.groupBy("cohort").agg(F.sum("n").alias("sample_count"), *[F.sum(c).alias(f"s_{c}") for c in ("c", "h", "nll", "b")], F.sum(F.abs(F.col("h") - F.col("c"))).alias("gap"))
    n = F.col("sample_count")
    return sums.select("cohort", "sample_count", *[ratio(F.col(c), n).alias(a) for c, a in (("s_nll", "nll"), ("gap", "ece"), ("s_b", "brier"), ("s_c", "mean_confidence"), ("s_h", "accuracy"))])


def reliability(samples: DataFrame, temperature: float = 1.0, bins: int = BINS) -> DataFrame:
    """``bin, lower_bound, upper_bound, sample_count, mean_confidence, accuracy``: every bin, empty ones with nulls. The same errors as of :func:`metrics`."""
    _checked(samples, temperature, bins)
    sums = _rows(samples, temperature).groupBy(_bin(bins).alias("bin")).agg(F.count("*").alias("n"), F.sum("confidence").alias("c"), F.sum("hit").alias("h"))
    grid = samples.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return grid.join(sums, "bin", "left").select("bin", (F.col("bin") / F.lit(float(bins))).alias("lower_bound"), ((F.col("bin") + 1) / F.lit(float(bins))).alias("upper_bound"), F.coalesce("n", F.lit(0)).alias("sample_count"), ratio(F.col("c"), F.col("n")).alias("mean_confidence"), ratio(F.col("h"), F.col("n")).alias("accuracy"))


@dataclass(frozen=True)
class Fit:
    temperature: float
    nll_before: float
    nll_after: float


def fit_temperature(samples: DataFrame, low: float = T_MIN, high: float = T_MAX, points: int = 17, rounds: int = 12) -> Fit:
    """The temperature in [low, high] with the least mean negative log likelihood.

    The loss is convex in 1/T, so it has one valley over log T: each job evaluates a whole grid of temperatures in one pass over the samples and the grid closes in on
    its best point and neighbours, instead of one job per step. The final choice is among 1, both bounds and the middle of the last bracket; equal losses go to the smaller temperature."""
    if not 0 < low < 1 < high:
        raise ValueError("the bounds must lie on either side of 1")
    check_samples(samples)
    shifted = written(samples.select(F.transform("logits", lambda z: z - F.get("logits", F.col("target_index"))).alias("d")), "calibration")

    def losses(grid: list[float]) -> list[float]:
        each = shifted.select("d", F.explode(F.array(*[F.lit(t) for t in grid])).alias("t"))
        loss = F.avg(log_sum_exp(F.transform("d", lambda v: v / F.col("t"))))
        by = {r["t"]: r["loss"] for r in each.groupBy("t").agg(loss.alias("loss")).collect()}  # one row a grid point
        return [by[t] for t in grid]

    a, b = math.log(low), math.log(high)
    for _ in range(rounds):
        grid = [a + (b - a) * k / (points - 1) for k in range(points)]
        loss = losses([math.exp(g) for g in grid])
        best = min(range(points), key=lambda k: (loss[k], k))
        a, b = grid[max(0, best - 1)], grid[min(points - 1, best + 1)]
        if b - a < 1e-9:
            break
    choices = [1.0, low, high, math.exp((a + b) / 2)]
    loss = losses(choices)
    nll, t = min(zip(loss, choices))
    return Fit(t, loss[0], nll)


def calibrated(samples: DataFrame, temperature: float) -> DataFrame:
    """``samples`` with ``probabilities`` at the temperature."""
    return samples.withColumn("probabilities", softmax(F.col("logits"), temperature))


@dataclass(frozen=True)
class Artifact:
    """A fitted temperature with where it comes from and the fitting samples' metrics at temperature 1 and at the fitted one."""

    base_model_name: str
    base_model_version: str
    calibration_dataset_name: str
    calibration_dataset_version: str
    source_commit: str
    config_version: str
    temperature: float
    metrics_before: dict[str, Any]
    metrics_after: dict[str, Any]
    method: str = "temperature_scaling"
    schema_version: str = "1.0.0"

    def __post_init__(self) -> None:
        if self.schema_version != "1.0.0" or self.method != "temperature_scaling":
            raise ValueError("unsupported artifact")
        for field in ("base_model_name", "base_model_version"):
            if not isinstance(getattr(self, field), str) or not getattr(self, field).strip():
                raise ValueError(f"{field} must not be blank")
        for field, kind in (("calibration_dataset_name", "slug"), ("calibration_dataset_version", "semver"), ("config_version", "semver"), ("source_commit", "commit")):
            if not isinstance(getattr(self, field), str) or not re.fullmatch(FORMATS[kind], getattr(self, field)):
                raise ValueError(f"{field} must be a {kind}")
        if isinstance(self.temperature, bool) or not 0 < self.temperature < math.inf:
            raise ValueError("the temperature must be finite and positive")
        if self.metrics_before.get("temperature") != 1.0 or self.metrics_after.get("temperature") != self.temperature:
            raise ValueError("metrics must be those of temperature 1 and of the fitted one")
        if self.metrics_before.get("sample_count") != self.metrics_after.get("sample_count"):
            raise ValueError("both metrics must be of the same samples")

    def to_dict(self) -> dict[str, Any]:
        """The artifact for JSON; no sample is in it."""
        return {
            "schema_version": self.schema_version, "method": self.method, "base_model": {"name": self.base_model_name, "version": self.base_model_version},
            "calibration_dataset": {"name": self.calibration_dataset_name, "version": self.calibration_dataset_version}, "source_commit": self.source_commit,
            "config_version": self.config_version, "temperature": self.temperature, "metrics_before": self.metrics_before, "metrics_after": self.metrics_after,
        }


def fitted_artifact(samples: DataFrame, origin: dict[str, str], **bounds: Any) -> Artifact:
    """Fits the temperature to the samples and measures them before and after."""
    fit = fit_temperature(samples, **bounds)

    def measured(t: float) -> dict[str, Any]:
        total = metrics(samples, t).where("cohort IS NULL").first().asDict()
        bins = [r.asDict() for r in reliability(samples, t).orderBy("bin").collect()]  # at most 100 rows
        return {"temperature": t, **{k: v for k, v in total.items() if k != "cohort"}, "reliability_bins": bins}

    return Artifact(**origin, temperature=fit.temperature, metrics_before=measured(1.0), metrics_after=measured(fit.temperature))

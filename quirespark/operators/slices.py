"""Total and cohort slices in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_slices(samples: DataFrame, cohorts: str = "cohorts") -> DataFrame:
    """Every sample once with null ``cohort`` (the total) and once for each distinct cohort it is in; a missing or
    empty list leaves only the total. Cohorts overlap, so slices don't sum to the total."""
    named = F.array_distinct(F.filter(F.coalesce(F.col(cohorts), F.array().cast("array<string>")), lambda c: c.isNotNull()))
    return samples.withColumn("cohort", F.explode(F.concat(F.array(F.lit(None).cast("string")), named)))


def sliced(samples: DataFrame, *measures: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """``cohort`` (null: total), the columns ``by`` and the measures of every slice. Samples are exploded after their
    per-row measures were made, and partially aggregated before the shuffle."""
    return with_slices(samples).groupBy("cohort", *by).agg(*measures)

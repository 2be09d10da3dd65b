"""Text recognition metrics and error taxonomy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirespark.functions.distance import char_edits, edit_counts, word_edits
from quirespark.functions.geometry import ratio
from quirespark.functions.text import words
from quirespark.operators.slices import sliced, with_slices


def metrics(samples: DataFrame) -> DataFrame:
    """Per slice: corpus character and word error rates, exact-match rates. Samples are rows ``sample_id, reference,
    prediction, cohorts, identifier_type``; ones with a null text are left out. Rates with nothing to divide by are null."""
    r, p = F.col("reference"), F.col("prediction")
    identifier = F.col("identifier_type").isNotNull()
    rows = samples.where(r.isNotNull() & p.isNotNull()).select(
        "cohorts", char_edits(r, p).cast("long").alias("ce"), F.length(r).cast("long").alias("cn"), word_edits(r, p).cast("long").alias("we"), F.size(words(r)).cast("long").alias("wn"), (r == p).alias("hit"), identifier.alias("ident")
    )
    sums = sliced(rows, F.count("*").alias("sample_count"), *[F.sum(c).alias(c) for c in ("ce", "cn", "we", "wn")], F.count_if("hit").alias("hits"), F.count_if("ident").alias("idents"), F.count_if(F.col("hit") & F.col("ident")).alias("ident_hits"))
    return sums.select(
        "cohort", "sample_count", F.col("ce").alias("character_edits"), F.col("cn").alias("reference_characters"), ratio(F.col("ce"), F.col("cn")).alias("cer"),
        F.col("we").alias("word_edits"), F.col("wn").alias("reference_words"), ratio(F.col("we"), F.col("wn")).alias("wer"),
        ratio(F.col("hits"), F.col("sample_count")).alias("exact_match_rate"), ratio(F.col("ident_hits"), F.col("idents")).alias("identifier_exact_match_rate"),
    )


def with_edits(samples: DataFrame) -> DataFrame:
    """Samples with ``substitutions, insertions, deletions, category``; the category is null for equal texts. Only
    distinct texts that differ reach Python."""
    same = F.col("reference") == F.col("prediction")
    edits = edit_counts(F.when(~same, F.col("reference")), F.when(~same, F.col("prediction")))
    counted = samples.where("reference IS NOT NULL AND prediction IS NOT NULL").withColumn("_e", edits)
    s, i, d = (F.coalesce(F.col(f"_e.{c}"), F.lit(0)) for c in ("substitutions", "insertions", "deletions"))
    kinds = (s > 0).cast("int") + (i > 0).cast("int") + (d > 0).cast("int")
    category = F.when(kinds == 0, None).when(kinds > 1, "mixed_character_edits").when(s > 0, "character_substitution").when(i > 0, "character_insertion").otherwise("character_deletion")
    return counted.withColumns({"substitutions": s, "insertions": i, "deletions": d, "category": category}).drop("_e")


def observations(samples: DataFrame) -> DataFrame:
    """``sample_id, stage, category, occurrences, cohorts`` of recognition errors; a wrong identifier is one more."""
    edited = with_edits(samples)
    edit = F.struct(F.col("category"), (F.col("substitutions") + F.col("insertions") + F.col("deletions")).cast("long").alias("occurrences"))
    wrong = F.when(F.col("identifier_type").isNotNull() & (F.col("reference") != F.col("prediction")), F.struct(F.lit("identifier_mismatch").alias("category"), F.lit(1).cast("long").alias("occurrences")))
    found = edited.select("sample_id", "cohorts", F.explode(F.array(F.when(F.col("category").isNotNull(), edit), wrong)).alias("o")).where("o IS NOT NULL")
    return found.select("sample_id", F.lit("recognition").alias("stage"), "o.category", "o.occurrences", "cohorts")


def ranking(observed: DataFrame) -> DataFrame:
    """``cohort, stage, category, affected_samples, occurrences, rank`` by slice: most occurrences first, then stage and category."""
    from pyspark.sql import Window

    counts = with_slices(observed).groupBy("cohort", "stage", "category").agg(F.countDistinct("sample_id").alias("affected_samples"), F.sum("occurrences").alias("occurrences"))
    order = Window.partitionBy("cohort").orderBy(F.desc("occurrences"), "stage", "category")  # a dozen rows a slice
    return counts.withColumn("rank", F.row_number().over(order))


def slice_sizes(samples: DataFrame, observed: DataFrame) -> DataFrame:
    """``cohort, samples, affected_samples``; slices without errors stay, with 0."""
    sizes = with_slices(samples).groupBy("cohort").agg(F.count("*").alias("samples"))
    hit = with_slices(observed).groupBy("cohort").agg(F.countDistinct("stage", "sample_id").alias("affected_samples")).withColumnRenamed("cohort", "c")
    return sizes.join(hit, F.col("cohort").eqNullSafe(F.col("c")), "left").select("cohort", "samples", F.coalesce("affected_samples", F.lit(0)).alias("affected_samples"))

"""BIO sequences: vocabulary, validation, span reconstruction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirespark.operators.extraction import ENTITY_TYPES
from quirespark.session import maybe_broadcast

_ORDER = ("document_id", "page_index")


def vocabulary(spark, types: tuple[str, ...] = ENTITY_TYPES) -> DataFrame:
    """``id, name, prefix, entity_type``: O, then B and I of every type."""
    rows = [(0, "O", "O", None)] + [(2 * k + j + 1, f"{p}-{t}", p, t) for k, t in enumerate(types) for j, p in enumerate("BI")]
    return spark.createDataFrame(rows, "id int, name string, prefix string, entity_type string")


def vocabulary_issues(labels: DataFrame) -> DataFrame:
    """``name, issue`` of a vocabulary that breaks its contract: ids contiguous from 0, id 0 is the only O, names are prefix-type, B and I
    of every type, names unique."""
    naming = F.when(F.col("prefix") == "O", (F.col("name") != "O") | F.col("entity_type").isNotNull()).otherwise(F.col("entity_type").isNull() | (F.col("name") != F.concat_ws("-", "prefix", "entity_type")))
    named = labels.select("name", F.when(F.coalesce(naming, F.lit(True)), "invalid_name").alias("issue"))
    outside = labels.select("name", F.when((F.col("id") == 0) != (F.col("prefix") == "O"), "invalid_outside_label").alias("issue"))
    twice = labels.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name", F.lit("duplicate_name").alias("issue"))
    pairs = labels.where("entity_type IS NOT NULL").groupBy("entity_type").agg(F.countDistinct("prefix").alias("n")).where("n < 2").select(F.col("entity_type").alias("name"), F.lit("incomplete_pair").alias("issue"))
    size = labels.agg(F.count("*").alias("n"), F.min("id").alias("a"), F.max("id").alias("b"), F.countDistinct("id").alias("d")).where("a != 0 OR b != n - 1 OR d != n").select(F.lit(None).cast("string").alias("name"), F.lit("non_contiguous_ids").alias("issue"))
    return named.unionByName(outside).where("issue IS NOT NULL").unionByName(twice).unionByName(pairs).unionByName(size)


def labelled(tokens: DataFrame, labels: DataFrame) -> DataFrame:
    """Tokens with the ``prefix`` and ``entity_type`` of their label; ``known`` is null for a label outside the vocabulary."""
    names = labels.select(F.col("name").alias("label"), "prefix", "entity_type", F.lit(True).alias("known"))
    return tokens.join(maybe_broadcast(names), "label", "left")


def with_issue(known: DataFrame) -> DataFrame:
    """Labelled tokens with the ``issue`` of their label, if any."""
    w = Window.partitionBy(*_ORDER).orderBy("token_index", "label")
    before = known.withColumns({"pp": F.lag("prefix").over(w), "pt": F.lag("entity_type").over(w)})
    continues = F.col("pp").isin("B", "I") & (F.col("pt") == F.col("entity_type"))
    issue = F.when(F.col("known").isNull(), "unknown_label").when((F.col("prefix") == "I") & ~F.coalesce(continues, F.lit(False)), "invalid_transition")
    return before.withColumn("issue", issue)


def sequence_issues(tokens: DataFrame, labels: DataFrame) -> DataFrame:
    """``document_id, page_index, token_index, label, issue``: the first bad label of each page. An unknown label anywhere comes before an I that
    continues nothing of its type. A null label is unknown. Equal indexes are ordered by label."""
    bad = with_issue(labelled(tokens.select(*_ORDER, "token_index", "label"), labels)).where("issue IS NOT NULL")
    first = F.min_by(F.struct("token_index", "label", "issue"), F.struct((F.col("issue") != "unknown_label").alias("a"), "token_index", "label"))
    return bad.groupBy(*_ORDER).agg(first.alias("f")).select(*_ORDER, "f.*")


def spans(tokens: DataFrame, labels: DataFrame, valid_only: bool = True) -> DataFrame:
    """``document_id, page_index, entity_type, raw_value, first_token, last_token``: B starts a span, I extends it, O ends it; texts are joined by one space.
    Pages with sequence issues give no spans unless ``valid_only`` is false; then an I without a start belongs to none and unknown labels end spans.
    Windows and the aggregation share one shuffle by page; nothing is scanned twice."""
    known = labelled(tokens.select(*_ORDER, "token_index", "text", "label"), labels)
    if valid_only:
        known = with_issue(known).withColumn("bad", F.max("issue").over(Window.partitionBy(*_ORDER))).where("bad IS NULL")
    w = Window.partitionBy(*_ORDER).orderBy("token_index", "label").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opened = known.withColumn("span", F.sum(F.when(F.col("prefix") == "I", 0).otherwise(1)).over(w))
    islands = opened.where("prefix IN ('B', 'I')").groupBy(*_ORDER, "span").agg(
        F.sort_array(F.collect_list(F.struct("token_index", F.coalesce("text", F.lit("")).alias("text"), "prefix", "entity_type"))).alias("t"))
    own = F.filter("t", lambda x: x["entity_type"] == F.col("t")[0]["entity_type"])
    return islands.where("t[0].prefix = 'B'").select(*_ORDER, F.col("t")[0]["entity_type"].alias("entity_type"), F.array_join(F.transform(own, lambda x: x["text"]), " ").alias("raw_value"), F.col("t")[0]["token_index"].alias("first_token"), F.element_at(own, -1)["token_index"].alias("last_token"))

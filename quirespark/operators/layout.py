"""Layout model features: page contracts, grid boxes, subword alignment."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirespark.functions.geometry import CORNERS, grid_box, valid_box
from quirespark.functions.text import is_blank
from quirespark.operators.bio import labelled, with_issue
from quirespark.operators.tokens import gaps
from quirespark.session import maybe_broadcast
from quirespark.sources import schemas

# Fixed values of the layout dataset: length, grid, ignored label, box of special tokens.
MAX_LENGTH, SCALE, IGNORE = 512, 1000, -100


def annotation_issues(tokens: DataFrame, labels: DataFrame) -> DataFrame:
    """``document_id, page_index, token_index, code`` of token rows that break the annotation contract: ``non_contiguous_token_index,
    blank_token_text, invalid_bounding_box, box_outside_page, invalid_bio_sequence, non_contiguous_page_index``. A token with a bad box still takes part in
    its page's sequence. A page's sequence issue is that of its first bad label. Tokens take one shuffle by page."""
    page = Window.partitionBy("document_id", "page_index")
    known = with_issue(labelled(tokens, labels)).withColumn("expected", F.row_number().over(page.orderBy("token_index")) - 1)
    rank = F.when(F.col("issue").isNotNull(), F.struct((F.col("issue") != "unknown_label").alias("a"), "token_index", "label"))
    known = known.withColumn("rank", rank).withColumn("first", F.min("rank").over(page))
    box = F.col("bounding_box")
    ok = valid_box(box)
    codes = F.array(
        F.when(F.col("token_index") != F.col("expected"), "non_contiguous_token_index"),
        F.when(F.col("text").isNull() | is_blank(F.col("text")), "blank_token_text"),
        F.when(~ok, "invalid_bounding_box"),
        F.when(ok & ((box["x_max"] > F.col("image_width")) | (box["y_max"] > F.col("image_height"))), "box_outside_page"),
        F.when(F.col("rank").isNotNull() & F.col("rank").eqNullSafe(F.col("first")), "invalid_bio_sequence"),
    )
    found = known.select("document_id", "page_index", "token_index", F.explode(F.array_compact(codes)).alias("code"))
    none = F.lit(None).cast("int")
    # one row a page from the shuffle that is there already
    pages = known.where("expected = 0").select("document_id", F.col("page_index").alias("token_index")).withColumn("page_index", F.lit(0))
    page_gaps = gaps(pages).select("document_id", F.col("token_index").alias("page_index"), none.alias("token_index"), F.lit("non_contiguous_page_index").alias("code"))
    return found.unionByName(page_gaps)


def grid_boxes(tokens: DataFrame, scale: int = SCALE) -> DataFrame:
    """``document_id, page_index, token_index, x_min, y_min, x_max, y_max`` on the grid; nulls for a box that isn't within its page."""
    g = grid_box(F.col("bounding_box"), F.col("image_width"), F.col("image_height"), scale)
    return tokens.select("document_id", "page_index", "token_index", g.alias("g")).select("document_id", "page_index", "token_index", "g.x_min", "g.y_min", "g.x_max", "g.y_max")


#: A tokenizer: from a page's words and the most pieces to a struct ``word_ids array<int>, truncated boolean`` with one word id (or null) a piece.
Tokenizer = Callable[[Column, int], Column]


def fixed_width_word_ids(words: Column, width: int = 4) -> Column:
    """Word ids of a deterministic tokenizer: one null at either end, pieces of ``width`` code points between."""
    pieces = F.flatten(F.transform(words, lambda w, i: F.array_repeat(i, F.greatest(F.lit(1), F.ceil(F.length(w) / F.lit(float(width)))).cast("int"))))
    none = F.array(F.lit(None).cast("int"))
    return F.concat(none, pieces, none)


def fixed_width_tokenizer(width: int = 4) -> Tokenizer:
    """:func:`fixed_width_word_ids`, cut on the right to the most pieces, of which the last is null."""

    def encode(words: Column, most: int) -> Column:
        def cut(ids: Column) -> Column:
            long = F.size(ids) > most
            return F.struct(F.when(long, F.concat(F.slice(ids, 1, most - 1), F.array(F.lit(None).cast("int")))).otherwise(ids).alias("word_ids"), long.alias("truncated"))

        return F.get(F.transform(F.array(fixed_width_word_ids(words, width)), cut), 0)

    return encode


def encoding_issue(word_ids: Column, words: Column, truncated: Column) -> Column:
    """Why an encoding can't be aligned; null if it can."""
    seen = F.filter(word_ids, lambda w: w.isNotNull())
    distinct = F.array_distinct(seen)
    n = F.size(words)
    return (
        F.when(n == 0, "no_words").when(F.size(seen) == 0, "no_source_words")
        .when((F.array_min(seen) < 0) | (F.array_max(seen) >= n), "outside_page").when(F.sort_array(seen) != seen, "decreasing")
        .when(distinct != F.sequence(F.lit(0), F.array_max(seen)), "skipped_word")
        .when(~truncated & (F.size(distinct) != n), "missing_words").when(truncated & (F.size(distinct) == n), "nothing_truncated")
    )


def aligned(word_ids: Column, boxes: Column, label_ids: Column, inside_ids: Column) -> Column:
    """Array of ``(box, label_id)`` of an encoding's pieces: the word's box and label; the box of zeros and the ignored label for pieces of no
    word; later pieces of a word that begins an entity get the label inside it. ``inside_ids`` is each word's label for later pieces."""
    zero = F.struct(*[F.lit(0).alias(c) for c in ("x_min", "y_min", "x_max", "y_max")])

    def piece(w, i):
        first = F.array_position(word_ids, w) == i + 1
        return F.struct(F.when(w.isNull(), zero).otherwise(F.get(boxes, w)).alias("box"), F.when(w.isNull(), F.lit(IGNORE)).when(first, F.get(label_ids, w)).otherwise(F.get(inside_ids, w)).alias("label_id"))

    return F.transform(word_ids, piece)


def _encoded(tokens: DataFrame, labels: DataFrame, max_length: int, scale: int, tokenizer: Tokenizer) -> DataFrame:
    """Pages with their tokens ``t``, encoding ``e`` and the ``issue`` that keeps them from having features."""
    g = grid_box(F.col("bounding_box"), F.col("image_width"), F.col("image_height"), scale)
    inside = labels.select(F.col("name").alias("label"), F.col("id").alias("label_id"), F.when(F.col("prefix") == "B", F.concat(F.lit("I-"), "entity_type")).otherwise(F.col("name")).alias("inner"))
    known = inside.join(labels.select(F.col("name").alias("inner"), F.col("id").alias("inside_id")), "inner").select("label", "label_id", "inside_id")
    rows = tokens.join(maybe_broadcast(known), "label", "left").select("document_id", "page_index", F.struct("token_index", "text", g.alias("box"), "label_id", "inside_id").alias("t"))
    pages = rows.groupBy("document_id", "page_index").agg(F.sort_array(F.collect_list("t")).alias("t"), F.count_if(F.col("t.box").isNull()).alias("boxes"), F.count_if(F.col("t.label_id").isNull() | F.col("t.inside_id").isNull()).alias("labels"))
    words = F.col("t.text")
    whole = pages.withColumn("e", tokenizer(words, max_length).cast("struct<word_ids:array<int>,truncated:boolean>"))
    issue = (
        F.when(F.col("boxes") > 0, "invalid_bounding_box").when(F.col("labels") > 0, "unknown_label").when(F.coalesce(F.size("e.word_ids"), F.lit(0)) == 0, "empty_output")
        .when(F.size("e.word_ids") > max_length, "exceeds_max_length").otherwise(encoding_issue(F.col("e.word_ids"), words, F.col("e.truncated")))
    )
    return whole.select("document_id", "page_index", "t", "e", issue.alias("issue"))


def page_features(tokens: DataFrame, labels: DataFrame, max_length: int = MAX_LENGTH, scale: int = SCALE, tokenizer: Tokenizer | None = None) -> DataFrame:
    """Features of every page: ``document_id, page_index, n_pieces, truncated, pieces`` (``box, label_id``, at most ``max_length``). Pages that can't have any are
    left out and told by :func:`feature_issues`. One shuffle by page; the tokenizer is a plug-in, by default the deterministic fixed-width one."""
    good = _encoded(tokens, labels, max_length, scale, tokenizer or fixed_width_tokenizer()).where("issue IS NULL")
    ids = F.col("e.word_ids")
    return good.select("document_id", "page_index", F.size(ids).alias("n_pieces"), "e.truncated", aligned(ids, F.col("t.box"), F.col("t.label_id"), F.col("t.inside_id")).alias("pieces"))


def feature_issues(tokens: DataFrame, labels: DataFrame, max_length: int = MAX_LENGTH, scale: int = SCALE, tokenizer: Tokenizer | None = None) -> DataFrame:
    """``document_id, page_index, issue`` of the pages without features: a box that isn't within its page, an unknown label, an encoding that is empty,
    longer than ``max_length`` or can't be aligned (see :func:`encoding_issue`)."""
    return _encoded(tokens, labels, max_length, scale, tokenizer or fixed_width_tokenizer()).where("issue IS NOT NULL").select("document_id", "page_index", "issue")


def schema_issues(tokens: DataFrame, labels: DataFrame) -> DataFrame:
    """``document_id, page_index, token_index, code, location, keyword`` of everything in typed token rows that breaks the annotation's schema; ``code`` is ``schema_violation``, locations count pages and
    tokens by their places. A null is a field that isn't given: it breaks ``required`` of its parent. Document and page fields are told once, at the first token. One shuffle by document."""
    names = labels.select(F.col("name").alias("label"), F.lit(True).alias("known")).distinct()
    rows = tokens.join(maybe_broadcast(names), "label", "left")
    document, page = Window.partitionBy("document_id"), Window.partitionBy("document_id", "page_index")
    placed = rows.withColumn("p", F.dense_rank().over(document.orderBy("page_index")) - 1).withColumn("k", F.row_number().over(page.orderBy("token_index", "text")) - 1)
    top, at_page = F.lit("$"), F.concat(F.lit("$.pages["), F.col("p").cast("string"), F.lit("]"))
    at_token = F.concat(at_page, F.lit(".tokens["), F.col("k").cast("string"), F.lit("]"))
    at = lambda where, field: F.concat(where, F.lit(f".{field}"))
    broken = lambda when, where, keyword: F.when(F.coalesce(when, F.lit(False)), F.struct(where.alias("location"), F.lit(keyword).alias("keyword")))
    first, first_page = F.col("k") == 0, (F.col("k") == 0) & (F.col("p") == 0)
    found = [broken(first_page & F.col("document_id").isNull(), top, "required"), broken(first_page & (F.length("document_id") == 0), at(top, "document_id"), "minLength"), broken(first_page & (F.length("document_id") > schemas.LONGEST_ID), at(top, "document_id"), "maxLength")]
    for field, least in (("page_index", 0), ("image_width", 1), ("image_height", 1)):
        found += [broken(first & F.col(field).isNull(), at_page, "required"), broken(first & (F.col(field) < least), at(at_page, field), "minimum")]
    found += [broken(F.col(field).isNull(), at_token, "required") for field in ("token_index", "text", "bounding_box", "label")]
    found += [broken(F.col("token_index") < 0, at(at_token, "token_index"), "minimum"), broken(F.col("text") == "", at(at_token, "text"), "minLength"), broken(F.col("label").isNotNull() & F.col("known").isNull(), at(at_token, "label"), "enum")]
    box, there = F.col("bounding_box"), F.col("bounding_box").isNotNull()
    for c in CORNERS:
        low = c.endswith("min")
        found += [broken(there & box[c].isNull(), at(at_token, "bounding_box"), "required"), broken(box[c] < 0 if low else box[c] <= 0, at(at_token, f"bounding_box.{c}"), "minimum" if low else "exclusiveMinimum")]
    return placed.select("document_id", "page_index", "token_index", F.explode(F.array_compact(F.array(*found))).alias("v")).select("document_id", "page_index", "token_index", F.lit("schema_violation").alias("code"), "v.location", "v.keyword")


def version_issues(tokens: DataFrame, batches: DataFrame, version: str = schemas.VERSION) -> DataFrame:
    """``document_id, code, location, label_schema_version`` of documents with rows from a batch of another label schema's version (or of none); each version once. Batches that aren't listed have
    no version."""
    of = tokens.select("document_id", "batch_id").distinct().join(maybe_broadcast(batches.select("batch_id", "label_schema_version")), "batch_id", "left")
    wrong = of.where(~F.col("label_schema_version").eqNullSafe(F.lit(version))).select("document_id", "label_schema_version").distinct()
    return wrong.select("document_id", F.lit("label_schema_mismatch").alias("code"), F.lit("$.label_schema_version").alias("location"), "label_schema_version")

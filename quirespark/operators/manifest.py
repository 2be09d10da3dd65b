"""Dataset manifest checks. Records are rows ``manifest_name, pos, id, split, groups, document, annotation``; heads are rows
``name, split_strategy``. Every check is per manifest, in order of ``pos``."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirespark.functions.text import FORMATS
from quirespark.operators.keys import with_last_before, with_least
from quirespark.session import maybe_broadcast, written
from quirespark.sources import schemas

ROLES = ("document", "annotation")
#: Bytes of the longest path and of its longest part that a file system takes.
LONGEST_PATH, LONGEST_PART = 4096, 255
# How JSON begins, in one of Unicode's forms.
_JSON_START = r"^(?:efbbbf)?(?:20|09|0a|0d)*(?:7b|5b|22|2d|3[0-9]|74|66|6e|4e|49|$)|^(?:00|fffe|feff|(?:[0-7][0-9a-f])00)"


def duplicate_ids(records: DataFrame) -> DataFrame:
    """``manifest_name, pos, id, code``: every record after the first with its id."""
    rows = records.where("id IS NOT NULL AND manifest_name IS NOT NULL").select("manifest_name", "pos", "id")
    return with_least(rows, ["manifest_name", "id"], "pos", "_first", records.count()).where("pos > _first").select("manifest_name", "pos", "id", F.lit("duplicate_record_id").alias("code"))


def artifacts(records: DataFrame) -> DataFrame:
    """``manifest_name, pos, id, role, uri, sha256, media_type, size_bytes``: one row per artifact that is there."""
    roles = F.array(*[F.struct(F.lit(r).alias("role"), F.col(r).alias("a")) for r in ROLES])
    return records.select("manifest_name", "pos", "id", F.explode(roles).alias("x")).where("x.a IS NOT NULL AND x.a.uri IS NOT NULL").select("manifest_name", "pos", "id", "x.role", "x.a.uri", "x.a.sha256", "x.a.media_type", "x.a.size_bytes")


def duplicate_artifacts(records: DataFrame) -> DataFrame:
    """``manifest_name, pos, id, role, uri, first_id``: artifacts whose role and URI an earlier record uses."""
    rows = artifacts(records).where("manifest_name IS NOT NULL").select("manifest_name", "pos", "id", "role", "uri", F.struct("pos", "id").alias("_p"))
    seen = with_least(rows, ["manifest_name", "role", "uri"], "_p", "_first", 2 * records.count())
    return seen.where("pos > _first.pos").select("manifest_name", "pos", "id", "role", "uri", F.col("_first.id").alias("first_id"))


def _keyed(records: DataFrame, heads: DataFrame) -> DataFrame:
    keys = heads.where("split_strategy.method = 'grouped'").select(F.col("name").alias("manifest_name"), F.explode(F.array_distinct("split_strategy.grouping_keys")).alias("key"))
    return records.select("manifest_name", "pos", "id", "split", "groups").join(keys, "manifest_name").withColumn("value", F.try_element_at("groups", F.col("key")))


def missing_groups(records: DataFrame, heads: DataFrame) -> DataFrame:
    """``manifest_name, pos, id, key``: records of grouped manifests without a value of a grouping key."""
    return _keyed(records, heads).where("value IS NULL").select("manifest_name", "pos", "id", "key")


def split_leaks(records: DataFrame, heads: DataFrame) -> DataFrame:
    """``manifest_name, pos, id, key, value, split, first_split, first_id``: records whose split isn't the first one seen for their group value. ``first_id`` is the last
    earlier record of the group that had the first split. Values count as written; a null split is a split of its own. A group may hold most of the records."""
    key = ["manifest_name", "key", "value"]
    rows = _keyed(records, heads).where("value IS NOT NULL").withColumn("_p", F.struct("pos", "split"))
    rows = with_least(rows, key, "_p", "_first", 4 * records.count()).withColumn("first_split", F.col("_first.split")).drop("_p", "_first")
    kept = F.when(F.col("split").eqNullSafe(F.col("first_split")), F.col("id"))
    seen = with_last_before(rows, key, "pos", kept, "first_id")
    return seen.where(~F.col("split").eqNullSafe(F.col("first_split"))).select("manifest_name", "pos", "id", "key", "value", "split", "first_split", "first_id")


def _uri_path(uri: Column) -> tuple[Column, Column]:
    """Percent-decoded path of a URI, and whether the URI has nothing but a path."""
    # blanks and control characters in front, and tabs and line breaks anywhere, are no part of a URI
    uri = F.regexp_replace(F.regexp_replace(uri, r"[\t\r\n]", ""), r"^[\x00-\x20]+", "")
    path = F.regexp_extract(uri, r"(?s)^([^?#]*)", 1)
    bare = ~uri.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:|^//[^/?#]|\?[^#]|#(?s:.)")
    whole = F.regexp_replace(F.regexp_replace(path, "%(?![0-9A-Fa-f]{2})", "%25"), r"\+", "%2B")
    return F.coalesce(F.try_url_decode(whole), path), bare


def resolved_path(uri: Column) -> Column:
    """The path below its root that a URI means: decoded, without empty parts and ``.``, with ``..`` taken back; empty for the root itself. Null for a
    URI that may not be read: with a scheme, host, query or fragment, with a backslash, absolute, or leaving the root."""
    path, bare = _uri_path(uri)
    allowed = bare & ~path.contains("\\") & ~path.startswith("/") & (F.octet_length(path) <= LONGEST_PATH)
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))

    def step(a: Column, p: Column) -> Column:
        up = p == ".."
        return F.struct((a["out"] | (up & (F.size(a["at"]) == 0))).alias("out"), F.when(up, F.slice(a["at"], 1, F.greatest(F.size(a["at"]) - 1, F.lit(0)))).otherwise(F.concat(a["at"], F.array(p))).alias("at"))

    start = F.struct(F.lit(False).alias("out"), F.array().cast("array<string>").alias("at"))
    joined = F.aggregate(F.when(allowed, parts), start, step, lambda a: F.when(~a["out"], F.array_join(a["at"], "/")))
    # a longer path can't be walked here and no file system opens it
    return F.when(bare & ~path.contains("\\") & ~path.startswith("/") & (F.octet_length(path) > LONGEST_PATH), path).otherwise(joined)


@F.pandas_udf(T.StringType())
def _json_state(contents: pd.Series) -> pd.Series:
    """``corrupt`` or ``hollow`` for bytes that aren't JSON or hold nothing; null for others."""

    def state(content: bytes | None) -> str | None:
        if content is None:
            return None
        try:
            value = json.loads(bytes(content))
        except (ValueError, RecursionError):
            return "corrupt"
        return "hollow" if value is None or (isinstance(value, (str, list, dict)) and not value) else None

    return contents.map(state)


def artifact_issues(records: DataFrame, contents: DataFrame) -> DataFrame:
    """``manifest_name, pos, id, role, uri, code`` of artifacts against ``contents`` (``path, content``; see ``sources.artifact_contents``).

    An unsafe URI, a missing file or one that can't be read (the root, a folder, a name that is too long) is the only issue of its artifact; empty contents, a wrong size, a wrong checksum, and annotation JSON that is corrupt or empty are
    independent. Null sizes aren't compared. JSON is parsed as Python does (NaN is a number, the last of equal keys counts); bytes that can't begin JSON don't reach Python. Contents are reduced to their measures before the join, so no bytes are shuffled."""
    likely = F.hex(F.substring("content", 1, 64)).rlike(f"(?i){_JSON_START}")
    state = F.when(likely, _json_state(F.when(likely, F.col("content")))).otherwise("corrupt")
    files = contents.select(F.col("path"), F.octet_length("content").cast("long").alias("n"), F.sha2("content", 256).alias("sum"), state.alias("json"), F.lit(False).alias("folder"))
    steps = F.split("path", "/")
    folders = contents.select(F.explode(F.transform(F.sequence(F.lit(0), F.size(steps) - 1), lambda k: F.array_join(F.slice(steps, 1, k), "/"))).alias("path")).distinct()
    none = F.lit(None)
    measures = files.unionByName(folders.select("path", none.cast("long").alias("n"), none.cast("string").alias("sum"), none.cast("string").alias("json"), F.lit(True).alias("folder")))
    rows = artifacts(records).withColumn("path", resolved_path(F.col("uri")))
    rows = rows.withColumn("long", F.coalesce((F.octet_length("path") > LONGEST_PATH) | F.exists(F.split("path", "/"), lambda p: F.octet_length(p) > LONGEST_PART), F.lit(False)))
    both = rows.join(measures, "path", "left")
    safe = F.col("path").isNotNull()
    closed = safe & (F.col("long") | (F.col("path") == "") | F.coalesce("folder", F.lit(False)))
    there = safe & ~closed & F.col("n").isNotNull()
    note = there & (F.col("role") == "annotation") & (F.col("media_type") == "application/json") & (F.col("n") > 0)
    codes = F.array(
        F.when(~safe, "unsupported_artifact_uri"), F.when(closed, "unreadable_artifact"), F.when(safe & ~closed & F.col("n").isNull(), "missing_artifact"),
        F.when(there & (F.col("n") == 0), "empty_artifact"), F.when(there & (F.col("size_bytes") != F.col("n")), "artifact_size_mismatch"),
        F.when(there & (F.coalesce("sha256", F.lit("")) != F.col("sum")), "checksum_mismatch"),
        F.when(note & (F.col("json") == "corrupt"), "corrupt_annotation"), F.when(note & (F.col("json") == "hollow"), "empty_annotation"),
    )
    return both.select("manifest_name", "pos", "id", "role", "uri", F.explode(F.array_compact(codes)).alias("code"))


def jvm_pattern(pattern: str) -> str:
    """A schema's pattern for the JVM: the dollar sign stands before a final line feed, as in Python, and before no other line end."""
    return re.sub(r"\$$", r"\\n?\\z", pattern)


def _broken(where: Column, keyword: str, when: Column) -> Column:
    return F.when(F.coalesce(when, F.lit(False)), F.struct(where.alias("location"), F.lit(keyword).alias("keyword")))


def _text_rules(value: Column, at: Column, pattern: str | None = None, longest: int | None = None, least: int | None = None) -> list[Column]:
    out = []
    if pattern:
        out.append(_broken(at, "pattern", ~value.rlike(jvm_pattern(pattern))))
    if least:
        out.append(_broken(at, "minLength", F.length(value) < least))
    if longest:
        out.append(_broken(at, "maxLength", F.length(value) > longest))
    return out


def _each(values: Column, at: Column, rules) -> Column:
    """Violations of the members of an array; ``rules`` gives those of one member at its place."""
    return F.flatten(F.transform(F.coalesce(values, F.expr("array()").cast("array<string>")), lambda v, i: F.array(*rules(v, F.concat(at, F.lit("["), i.cast("string"), F.lit("]"))))))


def _repeated(values: Column) -> Column:
    return F.size(F.array_distinct(values)) != F.size(values)


def schema_issues(records: DataFrame, heads: DataFrame) -> DataFrame:
    """``manifest_name, pos, id, code, location, keyword`` of everything in typed manifest tables that breaks the manifest's schema; ``code`` is ``schema_violation``. A null is a field that
    isn't given: it breaks ``required`` of its parent, or nothing. A null member of a list or map has the wrong ``type``. Rows of a head have a null ``pos`` and ``id``. Columns the schema
    doesn't know are extra columns of the table and no violation."""
    dollar = F.concat(F.lit("$.records["), F.col("pos").cast("string"), F.lit("]"))
    at = lambda field: F.concat(dollar, F.lit(f".{field}"))
    required = lambda field, parent: _broken(parent, "required", F.col(field).isNull())
    one = [required("id", dollar), *_text_rules(F.col("id"), at("id"), f"^{FORMATS['identifier']}$", schemas.LONGEST_ID), required("split", dollar), _broken(at("split"), "enum", ~F.col("split").isin(*schemas.SPLITS)), required("document", dollar)]
    one += [_broken(at("cohorts"), "uniqueItems", _repeated(F.col("cohorts"))), _broken(at("groups"), "minProperties", F.size("groups") == 0)]
    for role in ROLES:
        there, a = F.col(role).isNotNull(), F.col(role)
        for field, rules in (("uri", {"least": 1}), ("sha256", {"pattern": f"^{FORMATS['sha256']}$"}), ("media_type", {"pattern": schemas.MEDIA_PATTERN})):
            one += [_broken(at(role), "required", there & a[field].isNull()), *_text_rules(a[field], at(f"{role}.{field}"), **rules)]
        one.append(_broken(at(f"{role}.size_bytes"), "minimum", a["size_bytes"] < 0))
    cohorts = _each(F.col("cohorts"), at("cohorts"), lambda v, w: [_broken(w, "type", v.isNull()), *_text_rules(v, w, schemas.KEY_PATTERN)])
    entries = F.coalesce(F.map_entries("groups"), F.array().cast("array<struct<key:string,value:string>>"))
    names = F.transform(entries, lambda e: _broken(at("groups"), "pattern", ~e["key"].rlike(jvm_pattern(schemas.KEY_PATTERN))))
    value_at = lambda e: F.concat(at("groups"), F.lit("."), e["key"])
    values = F.flatten(F.transform(entries, lambda e: F.array(_broken(value_at(e), "type", e["value"].isNull()), *_text_rules(e["value"], value_at(e), least=1, longest=schemas.LONGEST_ID))))
    found = F.array_compact(F.concat(F.array(*one), cohorts, names, values))
    of_records = records.select("manifest_name", "pos", "id", F.explode(found).alias("v")).withColumn("pos", F.col("pos").cast("long"))

    top = F.lit("$")
    here = lambda field: F.lit(f"$.{field}")
    strategy = F.col("split_strategy")
    head = [_broken(top, "required", F.col(c).isNull()) for c in ("schema_version", "version", "created_at", "tasks", "sources", "split_strategy")]
    head += [_broken(here("schema_version"), "const", F.col("schema_version") != schemas.VERSION), *_text_rules(F.col("name"), here("name"), f"^{FORMATS['slug']}$", schemas.LONGEST_NAME), *_text_rules(F.col("version"), here("version"), f"^{FORMATS['semver']}$")]
    head += [_broken(here("tasks"), "minItems", F.size("tasks") == 0), _broken(here("tasks"), "uniqueItems", _repeated(F.col("tasks"))), _broken(here("sources"), "minItems", F.size("sources") == 0)]
    keys = strategy["grouping_keys"]
    head += [_broken(here("split_strategy"), "required", strategy.isNotNull() & strategy["method"].isNull()), _broken(here("split_strategy.method"), "enum", ~strategy["method"].isin(*schemas.SPLIT_METHODS))]
    head += [_broken(here("split_strategy"), "required", (strategy["method"] == "grouped") & keys.isNull()), _broken(here("split_strategy.grouping_keys"), "minItems", (strategy["method"] == "grouped") & (F.size(keys) == 0)), _broken(here("split_strategy.grouping_keys"), "uniqueItems", _repeated(keys))]
    head.append(_broken(here("split_strategy.random_seed"), "minimum", strategy["random_seed"] < 0))
    tasks = _each(F.col("tasks"), here("tasks"), lambda v, w: [_broken(w, "enum", v.isNull() | ~v.isin(*schemas.TASKS))])
    own_keys = _each(keys, here("split_strategy.grouping_keys"), lambda v, w: [_broken(w, "type", v.isNull()), *_text_rules(v, w, schemas.KEY_PATTERN)])

    def of_source(x: Column, i: Column) -> Column:
        w = F.concat(F.lit("$.sources["), i.cast("string"), F.lit("]"))
        own = [_broken(w, "type", x.isNull())]
        for field in ("name", "version", "license"):
            if field != "license":
                own.append(_broken(w, "required", x.isNotNull() & x[field].isNull()))
            own += _text_rules(x[field], F.concat(w, F.lit(f".{field}")), least=1, longest=schemas.LONGEST_NAME)
        return F.array(*own)

    sources = F.flatten(F.transform(F.coalesce("sources", F.array().cast(heads.schema["sources"].dataType)), of_source))
    none = F.lit(None)
    of_heads = heads.select(F.col("name").alias("manifest_name"), F.explode(F.array_compact(F.concat(F.array(*head), tasks, own_keys, sources))).alias("v")).select("manifest_name", none.cast("long").alias("pos"), none.cast("string").alias("id"), "v")
    filled = records.select(F.col("manifest_name").alias("name")).distinct()
    empty = heads.join(filled, "name", "left_anti").select(F.col("name").alias("manifest_name"), none.cast("long").alias("pos"), none.cast("string").alias("id"), F.struct(F.lit("$.records").alias("location"), F.lit("minItems").alias("keyword")).alias("v"))
    every = of_records.unionByName(of_heads).unionByName(empty)
    return every.select("manifest_name", "pos", "id", F.lit("schema_violation").alias("code"), "v.location", "v.keyword")


def path_parts(location: Column) -> Column:
    """Parts of a location as texts, the order in which schema violations are told."""
    return F.filter(F.split(F.substring(location, 2, 1 << 30), r"[.\[\]]"), lambda p: p != "")


def issues(records: DataFrame, heads: DataFrame, contents: DataFrame | None = None, schema: bool = False) -> DataFrame:
    """``manifest_name, phase, pos, code, location, id``: all issues in one table; phases are (0) schema, uniqueness, splits, artifacts. ``location`` names the record by its place in its manifest.
    With ``schema`` a manifest that breaks its schema has only those issues."""
    if schema:
        broken = written(schema_issues(records, heads), "schema-issues")
        bad = maybe_broadcast(broken.select("manifest_name").distinct())
        rest = issues(records.join(bad, "manifest_name", "left_anti"), heads, contents)
        return broken.select("manifest_name", F.lit(0).alias("phase"), "pos", "code", "location", "id").unionByName(rest)
    at = F.concat(F.lit("$.records["), F.col("pos").cast("string"), F.lit("]"))
    out = duplicate_ids(records).select("manifest_name", F.lit(1).alias("phase"), "pos", "code", F.concat(at, F.lit(".id")).alias("location"), "id")
    out = out.unionByName(duplicate_artifacts(records).select("manifest_name", F.lit(1).alias("phase"), "pos", F.lit("duplicate_artifact").alias("code"), F.concat(at, F.lit("."), "role", F.lit(".uri")).alias("location"), "id"))
    out = out.unionByName(missing_groups(records, heads).select("manifest_name", F.lit(2).alias("phase"), "pos", F.lit("missing_group_value").alias("code"), F.concat(at, F.lit(".groups")).alias("location"), "id"))
    out = out.unionByName(split_leaks(records, heads).select("manifest_name", F.lit(2).alias("phase"), "pos", F.lit("split_leakage").alias("code"), F.concat(at, F.lit(".groups."), "key").alias("location"), "id"))
    if contents is not None:
        out = out.unionByName(artifact_issues(records, contents).select("manifest_name", F.lit(3).alias("phase"), "pos", "code", F.concat(at, F.lit("."), "role").alias("location"), "id"))
    return out


class DatasetValidationError(ValueError):
    """A dataset that breaks its contract."""


def assert_valid(found: DataFrame, shown: int = 20) -> None:
    """Raises if there is an issue; the message names the first few and how many there are."""
    n = found.count()
    if n:
        first = found.orderBy("manifest_name", "phase", "pos", "code").limit(shown).collect()
        raise DatasetValidationError(f"{n} issues: " + "; ".join(f"[{r['code']}] {r['location']} record={r['id']!r}" for r in first))

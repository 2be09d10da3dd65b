"""Deeply nested records as related flat tables (Merkle subtree identities).

A payload is canonicalised (nesting, boxes, indexes and collections are written differently by
different producers) and its objects are hashed bottom-up: a box by its corners, a token by its
text, label, other fields and its box's hash, a page by its size and the ordered hashes of
its tokens, a document by its fields and the ordered hashes of its pages. Equal objects have
equal hashes and are stored once, each with its own fields and the ordered list of its children; the lists are
the bridges: every occurrence is a row from parent to child with the child's ordinal and its index. The raw row is
the parent of a document.

Payload forms: JSON text, JSON inside a JSON string, wrapped in ``res`` (repeatedly); pages as a
list, one object, or an object keyed by index; tokens in ``tokens`` (list, or object keyed by
index) or in ``lines`` (and blocks of lines); boxes as an object of corners, a list of four
numbers, a polygon, or text; numbers as text. A payload that isn't JSON or isn't an object is
unreadable and has no rows here (see :func:`unreadable`).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from hashlib import blake2b
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirespark.session import written

#: Stored objects of all kinds; ``root`` rows tie raw rows to documents.
OBJECT = (
    "kind string, raw_id long, hash binary, children array<struct<ordinal:int,index:int,hash:binary,labelled:boolean>>, box binary, text string, label string, "
    "x_min double, y_min double, x_max double, y_max double, image_width double, image_height double, document_id string, schema_version string, label_schema_version string, extra string"
)
#: Kinds of objects, each with its own fields.
KINDS = {
    "document": ["document_id", "schema_version", "label_schema_version", "extra"], "page": ["image_width", "image_height", "extra"],
    "token": ["text", "label", "box", "extra"], "box": ["x_min", "y_min", "x_max", "y_max"],
}
# Fields that hold a page's tokens, or parts of a page that do.
PARTS = ("lines", "blocks", "paragraphs", "regions")
_NUMBER = re.compile(r"\s*[+-]?\d+(\.0*)?\s*$")
_NUMBERS = re.compile(r"[+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?")


class Unreadable(ValueError):
    """A payload from which no document can be read."""


def read_payload(payload: str | None) -> dict:
    """The document object of a payload."""
    if payload is None:
        raise Unreadable("missing")
    value: Any = payload
    try:
        while isinstance(value, str):
            value = json.loads(value)
    except (ValueError, RecursionError) as e:
        raise Unreadable("not JSON") from e
    while isinstance(value, dict) and "pages" not in value and isinstance(value.get("res"), (dict, str)):
        value = value["res"]
        try:
            value = json.loads(value) if isinstance(value, str) else value
        except (ValueError, RecursionError) as e:
            raise Unreadable("not JSON") from e
    if not isinstance(value, dict):
        raise Unreadable("not an object")
    return value


def whole_number(value: Any) -> int | None:
    """A 32-bit whole number given as number or text; null for anything else."""
    if isinstance(value, bool):
        return None
    if isinstance(value, str):
        value = int(float(value)) if _NUMBER.match(value) and len(value) < 20 else None
    elif isinstance(value, float):
        value = int(value) if value.is_integer() and abs(value) < 2**31 else None
    return value if isinstance(value, int) and -(2**31) <= value < 2**31 else None


def number(value: Any) -> float | None:
    if isinstance(value, bool) or value is None:
        return None
    try:
        x = float(value)
    except (TypeError, ValueError, OverflowError):
        return None
    return x if x - x == 0 else None


def corners(box: Any) -> tuple | None:
    """``(x_min, y_min, x_max, y_max)`` of a box in any form; null without a box, four nulls if it has a
    form that isn't known."""
    if box is None or (isinstance(box, (dict, list, str)) and not (box.strip() if isinstance(box, str) else box)):
        return None
    unknown = (None,) * 4
    if isinstance(box, str):
        box = _NUMBERS.findall(box)
    if isinstance(box, dict):
        got = tuple(number(box.get(k)) for k in ("x_min", "y_min", "x_max", "y_max"))
        if None in got and None not in (own := [number(box.get(k)) for k in ("x", "y", "width", "height")]):
            got = (own[0], own[1], own[0] + own[2], own[1] + own[3])
        return got
    if not isinstance(box, list):
        return unknown
    if len(box) == 4 and not any(isinstance(p, (list, dict)) for p in box):
        return tuple(map(number, box))
    if len(box) % 2 == 0 and not any(isinstance(p, (list, dict)) for p in box):
        box = [box[i : i + 2] for i in range(0, len(box), 2)]
    points = [(number(p.get("x")), number(p.get("y"))) if isinstance(p, dict) else tuple(map(number, p[:2])) if isinstance(p, list) else (None,) for p in box]
    if any(len(p) != 2 or None in p for p in points):
        return unknown
    xs, ys = zip(*points)
    return min(xs), min(ys), max(xs), max(ys)


def _keyed(value: Any, own: tuple[str, ...]) -> list[tuple[int | None, Any]]:
    """Members of a collection with the index it keys them by: a list, an object keyed by index, or a
    single member (an object that has one of the fields ``own``)."""
    if isinstance(value, list):
        return [(None, v) for v in value]
    if isinstance(value, dict) and value:
        if any(k in value for k in own):
            return [(None, value)]
        keys = [(whole_number(k), v) for k, v in value.items()]
        return sorted(keys, key=lambda x: (x[0] is None, x[0] or 0))
    return []


def page_tokens(page: dict) -> list[tuple[int | None, Any]]:
    """Tokens of a page in reading order, each with the index it is keyed by."""
    out = _keyed(page.get("tokens"), ("text", "token_index", "bounding_box"))
    for part in PARTS:
        for _, piece in _keyed(page.get(part), ("tokens", *PARTS)):
            if isinstance(piece, dict):
                out = out + page_tokens(piece)
    return out


def _first(*values: Any) -> Any:
    return next((v for v in values if v is not None), None)


def _text(value: Any) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False, sort_keys=True)


_TOKEN = frozenset({"token_index", "text", "label", "bounding_box", "box", "bbox"})
_PAGE = frozenset({"page_index", "image_width", "image_height", "tokens", *PARTS})
_DOCUMENT = frozenset({"document_id", "schema_version", "label_schema_version", "pages"})
_CORNERS = {"x_min", "y_min", "x_max", "y_max"}


def _hash(value: tuple, *children: bytes) -> bytes:
    return blake2b(b"".join((repr(value).encode("utf-8", "surrogatepass"), *children)), digest_size=16).digest()


def _rest(value: dict, known: frozenset) -> str | None:
    if value.keys() <= known:
        return None
    return json.dumps({k: v for k, v in value.items() if k not in known}, ensure_ascii=False, sort_keys=True)


def _box(token: dict) -> tuple | None:
    box = token.get("bounding_box")
    if type(box) is dict and box.keys() == _CORNERS:
        got = box["x_min"], box["y_min"], box["x_max"], box["y_max"]
        if all(type(x) is float and x - x == 0 or type(x) is int and -(1 << 53) < x < 1 << 53 for x in got):
            return tuple(map(float, got))
    return corners(_first(box, token.get("box"), token.get("bbox")))


class Shredder:
    """Collects the objects of payloads; one met before in the same task is collected no more. ``kinds`` are those
    that are asked for; hashes are made of all."""

    def __init__(self, kinds: tuple[str, ...] = tuple(KINDS), most: int = 200_000):
        self.seen: set[bytes] = set()
        self.most, self.kinds, self.count = most, frozenset(kinds), 0
        self.clear()

    def clear(self) -> None:
        self.count = 0
        self.roots: tuple[list, list] = ([], [])
        self.of: dict[str, tuple[list, list, list]] = {k: ([], [], []) for k in KINDS}  # hashes, lists of children, own fields

    def _new(self, h: bytes) -> bool:
        if h in self.seen:
            return False
        if len(self.seen) >= self.most:
            self.seen.clear()
        self.seen.add(h)
        return True

    def _store(self, kind: str, h: bytes, children: list, fields: tuple) -> None:
        if kind in self.kinds:
            hashes, lists, values = self.of[kind]
            hashes.append(h)
            lists.append(children)
            values.append(fields)
            self.count += 1 + len(children)

    def _token(self, token: dict) -> tuple[bytes, bool]:
        box, text, label = _box(token), _text(token.get("text")), _text(token.get("label"))
        extra = _rest(token, _TOKEN)
        box_hash = _hash(box) if box is not None else b""
        h = _hash((text, label, extra), box_hash)
        if "token" in self.kinds and self._new(h):
            self._store("token", h, [], (text, label, box_hash or None, extra))
            if box is not None and self._new(box_hash):
                self._store("box", box_hash, [], box)
        return h, box is not None and bool(label)

    def _page(self, page: dict) -> bytes:
        tokens = []
        for place, (key, token) in enumerate(page_tokens(page)):
            if isinstance(token, dict):
                own = token.get("token_index")
                if type(own) is not int or not -(1 << 31) <= own < 1 << 31:
                    own = _first(whole_number(own), key, place)
                tokens.append((place, own, *self._token(token)))
        fields = number(page.get("image_width")), number(page.get("image_height")), _rest(page, _PAGE)
        h = _hash((*fields, [t[:2] for t in tokens]), *(t[2] for t in tokens))
        if self._new(h):
            self._store("page", h, tokens, fields)
        return h

    def add(self, raw_id: int, document: dict) -> None:
        pages = []
        for place, (key, page) in enumerate(_keyed(document.get("pages"), ("page_index", "image_width", "tokens", *PARTS))):
            if isinstance(page, dict):
                pages.append((place, _first(whole_number(page.get("page_index")), key, place), self._page(page), None))
        fields = _text(document.get("document_id")), _text(document.get("schema_version")), _text(document.get("label_schema_version")), _rest(document, _DOCUMENT)
        h = _hash((*fields, [p[:2] for p in pages]), *(p[2] for p in pages))
        self.roots[0].append(raw_id)
        self.roots[1].append(h)
        self.count += 1
        if self._new(h):
            self._store("document", h, pages, fields)

    def batches(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """What was collected, a batch a kind."""
        yield _batch(schema, {"kind": ["root"] * len(self.roots[0]), "raw_id": self.roots[0], "hash": self.roots[1]})
        for kind, (hashes, lists, values) in self.of.items():
            if hashes:
                columns = {"kind": [kind] * len(hashes), "hash": hashes} | dict(zip(KINDS[kind], zip(*values)))
                if kind in ("document", "page"):
                    flat = [c for own in lists for c in own]
                    ends = [0]
                    for own in lists:
                        ends.append(ends[-1] + len(own))
                    parts = list(zip(*flat)) if flat else [(), (), (), ()]
                    item = schema.field("children").type.value_type
                    columns["children"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(p, f.type) for p, f in zip(parts, item)], fields=list(item)), type=schema.field("children").type)
                yield _batch(schema, columns)
        self.clear()


def _batch(schema: pa.Schema, columns: dict[str, Any]) -> pa.RecordBatch:
    n = len(columns["kind"])
    arrays = [pa.nulls(n, f.type) if f.name not in columns else columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(_utf8(columns[f.name], f.type), f.type) for f in schema]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def _utf8(values: Any, kind: pa.DataType) -> Any:
    """Texts with half of a surrogate pair, which JSON can hold and UTF-8 can't, have a question mark there."""
    if pa.types.is_string(kind):
        return [v if v is None or v.isascii() else v.encode("utf-8", "replace").decode() for v in values]
    return values


def _schema() -> pa.Schema:
    child = pa.struct([("ordinal", pa.int32()), ("index", pa.int32()), ("hash", pa.binary()), ("labelled", pa.bool_())])
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
    return pa.schema([(n, pa.list_(child) if n == "children" else kinds[t]) for n, t in (c.split()[:2] for c in OBJECT.split(", "))])


def _shred(kinds: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shredder, schema = Shredder(kinds), _schema()
        for batch in batches:
            for raw_id, payload in zip(batch.column("raw_id").to_pylist(), batch.column("payload").to_pylist()):
                try:
                    shredder.add(raw_id, read_payload(payload))
                except Unreadable:
                    continue
                if shredder.count > 50_000:
                    yield from shredder.batches(schema)
        yield from shredder.batches(schema)

    return run


class NestedTables:
    """The related tables of ``raw`` (``raw_id, payload``). Rows without a raw_id are left out; a row sent twice gives
    the same rows and hashes and counts once. ``kinds`` are the kinds of objects that will be asked for; documents and
    pages, which hold the bridges, always are."""

    def __init__(self, raw: DataFrame, kinds: tuple[str, ...] = tuple(KINDS)):
        self.raw = raw
        rows = raw.where("raw_id IS NOT NULL").select("raw_id", "payload")
        self._objects = written(rows.mapInArrow(_shred(("document", "page", *kinds)), OBJECT), "nested-objects")
        self._once: dict[tuple, DataFrame] = {}

    def _stored(self, kind: str, *columns) -> DataFrame:
        """``hash`` and the columns of each object of a kind once. It is a table of its own, so that adaptive execution can
        split the rows of an object that very many others hold."""
        key = (kind, *map(str, columns))
        if key not in self._once:
            rows = self._objects.where(F.col("kind") == kind).select("hash", *columns)
            self._once[key] = written(rows.groupBy("hash").agg(*[F.first(c).alias(c) for c in rows.columns[1:]]), f"nested-{kind}")
        return self._once[key]

    def objects(self, kind: str) -> DataFrame:
        """Each object of a kind (``document``, ``page``, ``token``, ``box``) once, with its own fields."""
        return self._stored(kind, *KINDS[kind])

    def roots(self) -> DataFrame:
        """``raw_id, hash`` of the document of every readable raw row."""
        return self._objects.where("kind = 'root'").select("raw_id", "hash").distinct()

    def bridge(self, kind: str) -> DataFrame:
        """``parent, ordinal, index, hash``: places of the objects of a kind inside their parents; the parents of documents are raw ids (as text)."""
        if kind == "document":
            return self.roots().select(F.col("raw_id").cast("string").cast("binary").alias("parent"), F.lit(0).alias("ordinal"), F.lit(None).cast("int").alias("index"), "hash")
        if kind == "box":
            return self.objects("token").where("box IS NOT NULL").select(F.col("hash").alias("parent"), F.lit(0).alias("ordinal"), F.lit(None).cast("int").alias("index"), F.col("box").alias("hash"))
        parent = {"page": "document", "token": "page"}[kind]
        return self._stored(parent, "children").select(F.col("hash").alias("parent"), F.explode("children").alias("c")).select("parent", "c.ordinal", "c.index", "c.hash")

    def page_places(self) -> DataFrame:
        """``raw_id, page_ordinal, page_index, page`` of every page of every raw row."""
        held = self.roots().join(self._stored("document", "children"), "hash").select("raw_id", F.explode("children").alias("c"))
        return held.select("raw_id", F.col("c.ordinal").alias("page_ordinal"), F.col("c.index").alias("page_index"), F.col("c.hash").alias("page"))

    def token_places(self) -> DataFrame:
        """``raw_id, page_ordinal, page_index, token_ordinal, token_index, token`` of every token occurrence."""
        held = self.page_places().join(self._stored("page", "children").withColumnRenamed("hash", "page"), "page")
        return held.select("raw_id", "page_ordinal", "page_index", F.explode("children").alias("c")).select("raw_id", "page_ordinal", "page_index", F.col("c.ordinal").alias("token_ordinal"), F.col("c.index").alias("token_index"), F.col("c.hash").alias("token"))

    def documents(self) -> DataFrame:
        """Flat documents: ``raw_id, document, document_id, schema_version, label_schema_version, extra``."""
        return self.roots().withColumnRenamed("hash", "document").join(self.objects("document").withColumnRenamed("hash", "document"), "document")

    def pages(self) -> DataFrame:
        """Flat pages: ``raw_id, page_ordinal, page_index, page, image_width, image_height, extra``."""
        return self.page_places().join(self.objects("page").withColumnRenamed("hash", "page"), "page")

    def tokens(self) -> DataFrame:
        """Flat tokens: ``raw_id, page_ordinal, page_index, token_ordinal, token_index, token, text, label, x_min, y_min,
        x_max, y_max, extra``; the corners are null without a box."""
        boxes = self.objects("box").withColumnRenamed("hash", "box")
        whole = self.objects("token").withColumnRenamed("hash", "token").join(boxes, "box", "left").withColumn("has_box", F.col("box").isNotNull()).drop("box")
        return self.token_places().join(whole, "token")

    def labelled_tokens(self) -> DataFrame:
        """``raw_id, page_index, token_index`` of the tokens with both a box and a label, each once. The lists of a page's children say
        which are, so neither tokens nor boxes are read."""
        good = F.array_distinct(F.transform(F.filter("children", lambda c: c["labelled"]), lambda c: c["index"])).alias("at")
        pages = self._stored("page", good).withColumnRenamed("hash", "page")
        held = self.page_places().select("raw_id", "page_index", "page").distinct().join(pages, "page")
        # two pages of a document can have the same index
        return held.select("raw_id", "page_index", F.explode("at").alias("token_index")).distinct()

    def sharing(self) -> DataFrame:
        """``kind, objects, bridge_rows, occurrences``: how often objects are shared. Occurrences are counted along
        the bridges from the raw rows; boxes occur with their tokens."""
        roots, pages, tokens = self.roots(), self.page_places(), self.token_places()
        count = lambda df, k: df.agg(F.lit(k).alias("kind"), F.count("*").alias("occurrences"))
        boxes = tokens.join(self.objects("token").where("box IS NOT NULL").select(F.col("hash").alias("token")), "token", "left_semi")
        occurrences = count(roots, "document").unionByName(count(pages, "page")).unionByName(count(tokens, "token")).unionByName(count(boxes, "box"))
        stored = self._objects.where("kind != 'root'").groupBy("kind").agg(F.countDistinct("hash").alias("objects"))
        bridges = None
        for k in KINDS:
            one = self.bridge(k).agg(F.lit(k).alias("kind"), F.count("*").alias("bridge_rows"))
            bridges = one if bridges is None else bridges.unionByName(one)
        return stored.join(F.broadcast(bridges), "kind").join(F.broadcast(occurrences), "kind").select("kind", "objects", "bridge_rows", "occurrences")  # four rows each


def unreadable(raw: DataFrame) -> DataFrame:
    """``raw_id, reason`` of the payloads no document can be read from."""

    def reasons(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for raw_id, payload in zip(batch["raw_id"], batch["payload"]):
                try:
                    read_payload(payload)
                except Unreadable as e:
                    out.append((raw_id, str(e)))
            yield pd.DataFrame(out, columns=["raw_id", "reason"])

    return raw.where("raw_id IS NOT NULL").select("raw_id", "payload").mapInPandas(reasons, "raw_id long, reason string").distinct()

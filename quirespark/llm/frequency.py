"""How often every distinct value occurs and in how many records (last-seen counters).

Rows are hash-partitioned by record and sorted by record inside a partition. Each partition
then runs through its rows once; a term stores its occurrences, its records and the last record
it was seen in, so no set of records is kept. Since a record lies in one partition, the
counters of partitions simply add up; a term that holds most rows is spread over all
partitions and reaches the final sum as one row per partition. A partition with very many terms hands
its counters on whenever it holds ``MOST_TERMS`` and begins anew, which adds up as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirespark.session import written

#: Terms of a field that a partition keeps; names of a vocabulary that is kept by every task.
MOST_TERMS, MOST_NAMES = 1_000_000, 100_000
RARE_BELOW = 3
COMMON_SHARE = 0.5


class LastSeen:
    """Counters of one field: term -> [occurrences, records, last record]."""

    def __init__(self) -> None:
        self.code: dict[str, int] = {}
        self.occurrences = np.zeros(64, np.int64)
        self.records = np.zeros(64, np.int64)
        self.last = np.full(64, -1, np.int64)

    def _room(self, n: int) -> None:
        more = max(n, len(self.last)) - len(self.last)
        if n > len(self.last):
            more = max(more, len(self.last))
            self.occurrences, self.records = (np.concatenate((x, np.zeros(more, np.int64))) for x in (self.occurrences, self.records))
            self.last = np.concatenate((self.last, np.full(more, -1, np.int64)))

    def add(self, terms: pa.Array, record: np.ndarray) -> None:
        """Terms of successive rows (null: none) and the ordinals of their records, ascending."""
        coded = terms.dictionary_encode()
        names = coded.dictionary.to_pylist()
        there = coded.indices.is_valid().to_numpy(False)
        if not names or not there.any():
            return
        local = np.array([self.code.setdefault(t, len(self.code)) for t in names], np.int64)
        self._room(len(self.code))
        code, record = local[coded.indices.fill_null(0).to_numpy(False)[there]], record[there]
        n = len(self.code)
        self.occurrences[:n] += np.bincount(code, minlength=n)
        pair = np.unique(code * np.int64(record[-1] - record[0] + 1) + (record - record[0]))
        term, at = np.divmod(pair, np.int64(record[-1] - record[0] + 1))
        at += record[0]
        self.records[:n] += np.bincount(term[at != self.last[term]], minlength=n)
        self.last[term] = np.maximum(self.last[term], at)  # ``pair`` ascends, the last record wins

    def rows(self, field: str) -> pa.RecordBatch:
        n = len(self.code)
        there = self.occurrences[:n] > 0
        terms = pa.array(list(self.code), pa.string()).filter(pa.array(there))
        return pa.RecordBatch.from_pydict({"field": pa.array([field] * len(terms), pa.string()), "term": terms, "occurrences": pa.array(self.occurrences[:n][there]), "records": pa.array(self.records[:n][there])})

    def flushed(self, field: str, record: int) -> pa.RecordBatch:
        """The rows so far; counting begins anew. Terms of ``record``, which may go on, are remembered as seen in it."""
        out = self.rows(field)
        seen = np.flatnonzero(self.last[: len(self.code)] == record)
        terms = list(self.code)
        self.__init__()
        self.code = {terms[k]: i for i, k in enumerate(seen.tolist())}
        self._room(len(self.code))
        self.last[: len(seen)] = record
        return out


def count_terms(rows: DataFrame, record: str, order: list[str], fields: list[str], mapped: dict[str, tuple[str, dict[str, str]]] | None = None, most_terms: int = MOST_TERMS) -> DataFrame:
    """``field, term, occurrences, records`` for every distinct value of ``fields``.

    ``record`` names the record's column; rows that agree in it and in ``order`` are one row sent
    again and count once. ``mapped`` adds fields that look a field's value up in a (small) dict;
    values that aren't in it are no terms. The row with field ``*`` holds the number of records.
    Null values are no terms; rows without a record are left out.
    """
    mapped = mapped or {}
    keys = [record, *order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = {f: LastSeen() for f in [*fields, *mapped]}
        ordinal, last = 0, None
        previous: tuple | None = None
        for batch in batches:
            if not len(batch):
                continue
            changed = np.zeros(len(batch), bool)
            new_record = None
            for k, name in enumerate(keys):
                column = batch.column(name)
                a, b = column.slice(0, len(column) - 1), column.slice(1)
                differs = pc.fill_null(pc.not_equal(a, b), False).to_numpy(False) | (a.is_null().to_numpy(False) != b.is_null().to_numpy(False))
                changed[1:] |= differs
                if k == 0:
                    new_record = np.concatenate(([False], differs))
            first = tuple(batch.column(name)[0].as_py() for name in keys)
            changed[0] = first != previous
            new_record[0] = last is not None and first[0] != last
            at = ordinal + np.cumsum(new_record)
            ordinal, last = int(at[-1]), batch.column(record)[len(batch) - 1].as_py()
            previous = tuple(batch.column(name)[len(batch) - 1].as_py() for name in keys)
            keep = pa.array(changed)
            at = at[changed]
            if not len(at):
                continue
            for f in fields:
                counters[f].add(batch.column(f).filter(keep), at)
            for f, (source, names) in mapped.items():
                coded = batch.column(source).filter(keep).dictionary_encode()
                into = pa.array([names.get(x) for x in coded.dictionary.to_pylist()], pa.string())
                counters[f].add(into.take(coded.indices), at)
            for f, c in counters.items():
                if len(c.code) > most_terms:
                    yield c.flushed(f, ordinal)
        for f, c in counters.items():
            yield c.rows(f)
        if last is not None:
            yield pa.RecordBatch.from_pydict({"field": ["*"], "term": ["*"], "occurrences": [0], "records": [ordinal + 1]}, schema=pa.schema([("field", pa.string()), ("term", pa.string()), ("occurrences", pa.int64()), ("records", pa.int64())]))

    sent = rows.where(F.col(record).isNotNull()).select(*dict.fromkeys([*keys, *fields]))
    parts = sent.repartition(record).sortWithinPartitions(*keys).mapInArrow(run, "field string, term string, occurrences long, records long")
    return parts.groupBy("field", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def entity_types(labels: DataFrame) -> DataFrame:
    """``name, entity_type`` of the label names that stand for one; a name listed twice has the smaller type."""
    return labels.where("name IS NOT NULL AND entity_type IS NOT NULL").groupBy("name").agg(F.min("entity_type").alias("entity_type"))


def label_terms(tokens: DataFrame, labels: DataFrame, most_names: int = MOST_NAMES) -> DataFrame:
    """``field, term, tokens, documents, mark`` of every label and entity type that occurs.

    ``mark`` is ``rare`` below ``RARE_BELOW`` documents, ``common`` above ``COMMON_SHARE`` of all
    documents, else null. A document whose labels are all null still counts among all documents.
    Without rows there are no terms. A vocabulary of at most ``most_names`` names is looked up by every task; a larger one is joined.
    """
    types, key = entity_types(labels), ["page_index", "token_index"]
    names = types.limit(most_names + 1).collect()
    if len(names) <= most_names:
        counts = count_terms(tokens, "document_id", key, ["label"], {"entity_type": ("label", {r["name"]: r["entity_type"] for r in names})})
    else:
        joined = tokens.select("document_id", *key, "label").join(written(types.withColumnRenamed("name", "label"), "types"), "label", "left")
        counts = count_terms(joined, "document_id", key, ["label", "entity_type"])
    counts = written(counts, "terms")
    total = counts.where("field = '*'").agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0]
    mark = F.when(F.col("records") < RARE_BELOW, "rare").when(F.col("records") > COMMON_SHARE * total, "common")
    return counts.where("field != '*'").select("field", "term", F.col("occurrences").alias("tokens"), F.col("records").alias("documents"), mark.alias("mark"))

"""The same or nearly the same records in different splits (weighted cosine join).

A record is the list of its words. Its vector has one component per (word, k-th occurrence),
weighted by how rare the word is, so the dot product of two vectors is the weight of the
words they share. A pair that differs in at most ``rate`` of the longer record's words
shares all but ``k = floor(rate * n / (1 - rate))`` words of a record of n words, so its dot
product is at least the record's whole weight less that of its k heaviest components. This
bound per record replaces one cosine threshold for all: no fixed cosine below 1 - rate
keeps every true pair when weights differ.

1. Weights and the other side's maximum weights come from a table of a fixed number of
   hash buckets (``BUCKETS``), the only thing broadcast; its size doesn't grow with the data.
2. Maximum-weight pruning: a component whose bucket has weight 0 on the other side can't
   contribute; a record with more than k of those has no partner and leaves the join.
3. Residual-norm pruning: components are ordered from heavy to light; only those are put into
   the inverted lists after which the residual weight still reaches the bound.
4. Lists of train and held-out records are joined by component; both sides of a long list are cut into
   parts, and every part meets every part of the other side in a task of its own, however long the list.
   Each row has a signature of its record, one bit of ``SIGNATURE * 64`` for each component. Bits that only one
   record of a pair has stand for as many components that the other lacks, at most one for each edit, so
   most pairs end inside the join and aren't shuffled. Partial dot products plus residuals prune again.
5. Exact dot products of the remaining pairs, then an exact word edit distance.

Signatures of more than ``LONG`` words are too full to tell pairs apart, and words sent along with each pair would fill
the disk. Pairs of two such records are found in blocks (``long_links``): a block of train records meets one of held-out
records of about the same length in one task, each record sent once a task, and no pair leaves it that isn't a link.
The heads indexed there are longer by k components, whose weight every partner must share.

Texts that are equal are one class from the start; only class representatives are joined. Pairs of records, where they
are asked for, come from arrays of at most about ``CHUNK`` members of a class and side.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirespark.llm.normalise import forms_of, keys_of, look_alikes
from quirespark.session import maybe_broadcast, release, written

#: Buckets of the weight table: 8 bytes each on the driver and in each Python worker.
BUCKETS = 1 << 20
#: Rows of either side that meet in one task of a component's list, about.
LIST_SIDE = 1 << 11
#: Words of the longest records whose pairs are told apart by signatures, and a signature's length in 64 bits.
LONG, SIGNATURE = 160, 4
#: Words of one side's block of long records, about; matches and places for pairs that are looked at together there.
BLOCK_WORDS, BLOCK_PAIRS = 1 << 21, 1 << 22
#: Members of a class and side that are kept in one row, about.
CHUNK = 1 << 10
# Ways of writing the split names.
SPLIT_NAMES = {"train": "training", "training": "training", "val": "validation", "dev": "validation", "validation": "validation", "test": "test"}


def split_name(column: str = "split"):
    """The split's full name; null for a missing or unknown one."""
    names = F.create_map(*[F.lit(x) for kv in SPLIT_NAMES.items() for x in kv])
    return F.try_element_at(names, F.lower(F.regexp_replace(F.col(column), r"(?U)^\s+|\s+$", "")))


def record_texts(tokens: DataFrame) -> DataFrame:
    """``document_id, text``: each record's token texts in order of page and token, one a line,
    repeated rows once. Tokens without text are left out."""
    rows = tokens.where(F.col("document_id").isNotNull() & F.col("text").isNotNull())
    one = F.struct("page_index", "token_index", "text")
    return rows.groupBy("document_id").agg(F.sort_array(F.collect_set(one)).alias("t")).select("document_id", F.array_join(F.col("t.text"), "\n").alias("text"))


def _words(look: dict[str, str]):
    """Hashes of the words of each record's text in its one form, and a key of the whole list. The distinct lines that aren't
    ASCII are normalised together."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes: dict[str, int] = {}
        for batch in batches:
            lines = list({t for text in batch["text"] if not text.isascii() for t in text.split("\n") if not t.isascii()})
            key = dict(zip(lines, keys_of(forms_of(lines, look)[0], look)))
            keys, rows = [], []
            for text in batch["text"]:
                if text.isascii():
                    words = text.lower().split()
                else:
                    words = " ".join(key[t] if t in key else t.lower() for t in text.split("\n")).split()
                if len(hashes) > 2_000_000:
                    hashes.clear()
                for w in words:
                    if w not in hashes:
                        hashes[w] = xxhash.xxh64_intdigest(w) - (1 << 63)
                row = np.fromiter(map(hashes.__getitem__, words), np.int64, len(words))
                rows.append(row)
                keys.append(xxhash.xxh3_128_digest(row.tobytes()))
            yield batch.drop(columns="text").assign(key=keys, words=rows)

    return run


def _mix(words: np.ndarray, nth: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = words.view(np.uint64) + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return np.where(nth == 0, words.view(np.uint64), x ^ (x >> np.uint64(29)))


def _components(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Number of the row, and component (word, how often it came before), over all rows."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    words = np.concatenate([np.empty(0, np.int64), *rows])
    order = np.lexsort((words, at))
    at, words = at[order], words[order]
    place = np.arange(len(words))
    start = np.ones(len(words), bool)
    start[1:] = (words[1:] != words[:-1]) | (at[1:] != at[:-1])
    nth = place - np.maximum.accumulate(np.where(start, place, 0))
    return at, _mix(words, nth)


def _bucket(components: np.ndarray, buckets: int) -> np.ndarray:
    return (components >> np.uint64(40)).astype(np.int64) % buckets


def bucket_counts(classes: DataFrame, buckets: int) -> np.ndarray:
    """Records per bucket and side, shape (2, buckets): [0] train, [1] held out."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, buckets), np.int64)
        for batch in batches:
            at, comp = _components(list(batch["words"]))
            b = _bucket(comp, buckets)
            for side, name in enumerate(("in_train", "in_held")):
                total[side] += np.bincount(b[batch[name].to_numpy(bool)[at]], minlength=buckets)
        used = np.flatnonzero(total.any(0))
        yield pd.DataFrame({"bucket": used, "t": total[0, used], "h": total[1, used]})

    sums = classes.mapInPandas(count, "bucket int, t long, h long").groupBy("bucket").agg(F.sum("t").alias("t"), F.sum("h").alias("h"))
    out = np.zeros((2, buckets), np.int64)
    got = sums.select("bucket", F.least("t", F.lit(2**31 - 1)).cast("int").alias("t"), F.least("h", F.lit(2**31 - 1)).cast("int").alias("h")).toArrow()
    out[:, got["bucket"].to_numpy()] = got["t"].to_numpy(), got["h"].to_numpy()
    return out


def _weights(counts: np.ndarray) -> np.ndarray:
    """Weight (squared component) of each bucket: log of the inverse share of records."""
    both = counts.sum(0)
    return np.log1p(max(1, both.max()) / np.maximum(both, 1)).astype(np.float32)


def list_parts(counts: np.ndarray) -> np.ndarray:
    """Parts of the train and of the held-out list of each bucket, shape (2, buckets): 1 unless the product of their lengths
    exceeds that of two sides of ``LIST_SIDE``; then parts of both are about that long, or one side is whole and the other's parts
    are longer."""
    t, h = counts.astype(np.float64)
    long = t * h > LIST_SIDE**2
    of_held = np.where(long, np.maximum(1, np.round(h / LIST_SIDE)), 1)
    of_train = np.where(long, np.maximum(1, np.ceil(t * h / (LIST_SIDE**2 * of_held))), 1)
    return np.array([of_train, of_held]).astype(np.int64)


def signatures(rows: int, at: np.ndarray, components: np.ndarray) -> np.ndarray:
    """A bit set for each component of a record, shape (rows, ``SIGNATURE``)."""
    out = np.zeros((rows, SIGNATURE), np.uint64)
    bit = (components >> np.uint64(8)) % np.uint64(64 * SIGNATURE)
    np.bitwise_or.at(out, (at, (bit >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (bit & np.uint64(63)))
    return out


def _edits(n: np.ndarray, rate: float) -> np.ndarray:
    """Most words of a record of ``n`` words that a partner lacks."""
    return np.floor(rate * n / (1 - rate) + 1e-9).astype(np.int64)


def _heads(n: np.ndarray, a: np.ndarray, c: np.ndarray, x: np.ndarray, b: np.ndarray, rate: float, more: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the components ``c`` that the other side has too (of record ``a``, weight ``x``, bucket ``b``), the heaviest, ``more`` than the edits left to a record; and
    by record the weight of the others and the least that a partner shares. ``n``: words by record."""
    order = np.lexsort((c, -x, a))
    a, c, x, b = a[order], c[order], x[order], b[order]
    m = np.bincount(a, minlength=len(n))
    left = _edits(n, rate) - (n - m)  # edits that may still strike a component of the other side
    first = np.cumsum(m) - m
    place = np.arange(len(a)) - first[a]
    keep = (left[a] >= 0) & (place < left[a] + more[a])
    whole = np.bincount(a, x, minlength=len(n))
    head = np.bincount(a, np.where(place < left[a], x, 0), minlength=len(n))
    indexed = np.bincount(a, np.where(keep, x, 0), minlength=len(n))
    return a[keep], c[keep], x[keep], b[keep], whole - indexed, whole - head


def inverted_lists(classes: DataFrame, counts, buckets: int, rate: float) -> DataFrame:
    """The components that are indexed: ``side, comp, salt, rep, n, w, rest, bound`` and the signature ``s0, s1, ...``. ``counts``
    is the broadcast table of :func:`bucket_counts`."""
    names = [f"s{j}" for j in range(SIGNATURE)]

    def lists(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = counts.value
        weight = _weights(table)
        parts = list_parts(table)
        for batch in batches:
            at, comp = _components(list(batch["words"]))
            b = _bucket(comp, buckets)
            w = weight[b].astype(np.float64)
            reps, n = batch["rep"].to_numpy(object), np.bincount(at, minlength=len(batch))
            hashes = np.array([xxhash.xxh64_intdigest(r) for r in reps], np.uint64)
            sig = signatures(len(batch), at, comp).view(np.int64)
            for side, name in enumerate(("in_train", "in_held")):
                there = batch[name].to_numpy(bool)[at] & (table[1 - side][b] > 0)
                a, c, x, bb, rest, bound = _heads(n, at[there], comp[there], w[there], b[there], rate, np.ones(len(batch), np.int64))
                own, copies = parts[side][bb], parts[1 - side][bb]
                part = ((c ^ hashes[a]) >> np.uint64(11)) % own.astype(np.uint64)
                rows = np.repeat(np.arange(len(a)), copies)
                a2 = a[rows]
                other = np.arange(len(rows)) - np.repeat(np.cumsum(copies) - copies, copies)
                salt = part[rows].astype(np.int64) * copies[rows] + other if side == 0 else other * own[rows] + part[rows].astype(np.int64)
                yield pd.DataFrame({"side": np.int8(side), "comp": c[rows].view(np.int64), "salt": salt, "rep": reps[a2], "n": n[a2].astype(np.int32), "w": x[rows].astype(np.float32), "rest": rest[a2].astype(np.float32), "bound": bound[a2].astype(np.float32)} | {s: sig[a2, j] for j, s in enumerate(names)})

    return classes.mapInPandas(lists, "side byte, comp long, salt long, rep string, n int, w float, rest float, bound float, " + ", ".join(f"{s} long" for s in names))


def word_distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Words changed, dropped or added between two word lists; ``most + 1`` if more than ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    n = min(len(a), len(b))
    same = a[:n] == b[:n]
    start = n if same.all() else int(same.argmin())
    a, b = a[start:], b[start:]
    n = min(len(a), len(b))
    if n:
        same = a[::-1][:n] == b[::-1][:n]
        end = n if same.all() else int(same.argmin())
        a, b = a[: len(a) - end], b[: len(b) - end]
    if not len(a) or not len(b):
        return min(most + 1, max(len(a), len(b)))
    steps = np.arange(len(b) + 1)
    row = steps.copy()
    for i, word in enumerate(a, 1):
        low, high = max(1, i - most), min(len(b), i + most)
        new = np.full(len(b) + 1, most + 1)
        new[low - 1] = i if low == 1 else most + 1
        new[low : high + 1] = np.minimum(row[low - 1 : high] + (b[low - 1 : high] != word), row[low : high + 1] + 1)
        new[low - 1 : high + 1] = np.minimum.accumulate(new[low - 1 : high + 1] - steps[low - 1 : high + 1]) + steps[low - 1 : high + 1]
        if new.min() > most:
            return most + 1
        row = new
    return int(min(row[-1], most + 1))


def _linked(wa: np.ndarray, wb: np.ndarray, bound: float, weight: np.ndarray, buckets: int, rate: float) -> tuple[int, float] | None:
    """Distance and cosine of two records' words, if they are near enough."""
    ca, cb = _components([wa])[1], _components([wb])[1]
    common = np.intersect1d(ca, cb, assume_unique=True)
    dot = float(weight[_bucket(common, buckets)].sum())
    most = int(np.floor(rate * max(len(wa), len(wb)) + 1e-9))
    if dot < bound * (1 - 1e-4) - 1e-3 or max(len(wa), len(wb)) - len(common) > most:
        return None
    d = word_distance(wa, wb, most)
    if d > most:
        return None
    norm = float(weight[_bucket(ca, buckets)].sum() * weight[_bucket(cb, buckets)].sum()) ** 0.5
    return d, dot / norm if norm else 1.0


def _verify(counts, buckets: int, rate: float):
    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weight = None
        for batch in batches:
            if weight is None:
                weight = _weights(counts.value)
            out = []
            for a, b, wa, wb, bound in zip(batch["rep_t"], batch["rep_h"], batch["words_t"], batch["words_h"], batch["bound"]):
                if link := _linked(wa, wb, bound, weight, buckets, rate):
                    out.append((a, b, *link))
            yield pd.DataFrame(out, columns=["rep_t", "rep_h", "distance", "cosine"])

    return verify


def _block_pairs(sides: list[list[np.ndarray]], table: np.ndarray, weight: np.ndarray, buckets: int, rate: float) -> Iterator[tuple[int, int, float]]:
    """Places and bound of the pairs of a train and a held-out block whose heads share enough weight."""
    heads = []
    for side, words in enumerate(sides):
        at, comp = _components(words)
        b = _bucket(comp, buckets)
        n = np.array([len(r) for r in words])
        there = table[1 - side][b] > 0
        heads.append((n, *_heads(n, at[there], comp[there], weight[b[there]].astype(np.float64), b[there], rate, _edits(n, rate) + 1)))
    (n_t, a_t, c_t, x_t, _, rest_t, bound_t), (n_h, a_h, c_h, _, _, rest_h, bound_h) = heads
    order = np.argsort(c_h, kind="stable")
    a_h, c_h = a_h[order], c_h[order]
    low = np.searchsorted(c_h, c_t, "left")
    matches = np.searchsorted(c_h, c_t, "right") - low
    # train records are taken together as far as their matches and pairs have room
    cost = np.bincount(a_t, matches, minlength=len(n_t)) + len(n_h)
    part = np.floor(np.cumsum(cost) / BLOCK_PAIRS)
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), len(n_t)]
    for i, j in zip(cuts[:-1], cuts[1:]):
        at = slice(*np.searchsorted(a_t, (i, j)))
        some = matches[at]
        rows = np.repeat(np.arange(len(some)), some)
        of_held = a_h[low[at][rows] + np.arange(len(rows)) - (np.cumsum(some) - some)[rows]]
        dot = np.bincount((a_t[at][rows] - i) * len(n_h) + of_held, x_t[at][rows], minlength=(j - i) * len(n_h)).reshape(j - i, len(n_h))
        t = slice(i, j)
        longer, bound = np.maximum(n_t[t, None], n_h), np.maximum(bound_t[t, None], bound_h)
        near = (dot > 0) & (np.abs(n_t[t, None] - n_h) <= np.floor(longer * rate + 1e-9))
        near &= dot + np.maximum(rest_t[t, None], rest_h) >= bound * (1 - 1e-4) - 1e-3
        for x, y in zip(*np.nonzero(near)):
            yield i + x, y, bound[x, y]


def long_links(reps: DataFrame, counts, buckets: int, rate: float) -> DataFrame:
    """``rep_t, rep_h, distance, cosine`` of the pairs of records of more than ``LONG`` words. Records are put into classes by
    length, so that partners are in the same class or in two next to each other, and classes into blocks; every two blocks
    that may hold partners are a task."""
    width = max(-math.log1p(-rate), 0.01) * 1.001
    longs = reps.where(F.size("words") > LONG).withColumn("length", F.floor(F.log(F.size("words")) / width))
    sums = longs.groupBy("length").agg(*[F.coalesce(F.sum(F.when(F.col(c), F.size("words"))), F.lit(0)) for c in ("in_train", "in_held")]).collect()
    blocks = [{r[0]: -(-r[side] // BLOCK_WORDS) for r in sums if r[side]} for side in (1, 2)]
    tasks = [(c, i, e, j) for c, of_train in blocks[0].items() for e in (c - 1, c, c + 1) for i in range(of_train) for j in range(blocks[1].get(e, 0))]
    plan = [(k, True, c, blocks[0][c], i) for k, (c, i, _, _) in enumerate(tasks)] + [(k, False, e, blocks[1][e], j) for k, (_, _, e, j) in enumerate(tasks)]
    types = {"task": pa.int32(), "train": pa.bool_(), "length": pa.int64(), "blocks": pa.int64(), "block": pa.int64()}
    plan = reps.sparkSession.createDataFrame(pa.table([pa.array(x, t) for x, t in zip(list(zip(*plan)) or [[]] * 5, types.values())], names=list(types)))
    here = (F.pmod(F.xxhash64("rep"), F.col("blocks")) == F.col("block")) & F.when(F.col("train"), F.col("in_train")).otherwise(F.col("in_held"))
    placed = longs.join(maybe_broadcast(plan), "length").where(here).select("task", "train", "rep", "words")

    def links(block: pd.DataFrame) -> pd.DataFrame:
        table = counts.value
        weight = _weights(table)
        sides = [block[block["train"]], block[~block["train"]]]
        out = []
        if len(sides[0]) and len(sides[1]):
            (reps_t, words_t), (reps_h, words_h) = ((list(x["rep"]), list(x["words"])) for x in sides)
            for i, j, bound in _block_pairs([words_t, words_h], table, weight, buckets, rate):
                if reps_t[i] != reps_h[j] and (link := _linked(words_t[i], words_h[j], bound, weight, buckets, rate)):
                    out.append((reps_t[i], reps_h[j], *link))
        return pd.DataFrame(out, columns=["rep_t", "rep_h", "distance", "cosine"])

    return placed.groupBy("task").applyInPandas(links, "rep_t string, rep_h string, distance int, cosine double")


class Overlap:
    """Cross-split overlaps of ``records`` (``id, split``) with the pages in ``tokens``.

    ``members``: ``document_id, key, rep, in_train, in_held`` of every record with words;
    ``links``: ``rep_t, rep_h, distance, cosine``, pairs of representatives of different texts.
    Records without words, without pages or without a split match nothing. An empty table
    gives empty results. Extra columns are ignored.
    """

    def __init__(self, records: DataFrame, tokens: DataFrame, rate: float = 0.2, buckets: int = BUCKETS):
        spark = records.sparkSession
        split = split_name()
        sides = records.where(F.col("id").isNotNull() & split.isNotNull()).groupBy(F.col("id").alias("document_id")).agg(
            F.bool_or(split == "training").alias("in_train"), F.bool_or(split != "training").alias("in_held")
        )
        # the sides join where the texts lie already, so texts and words are shuffled once only
        texts = record_texts(tokens).join(sides, "document_id").select("document_id", "in_train", "in_held", "text")
        words = texts.mapInPandas(_words(look_alikes(spark)), "document_id string, in_train boolean, in_held boolean, key binary, words array<long>")
        words = written(words.where(F.size("words") > 0), "overlap-words")
        classes = words.groupBy("key").agg(F.min("document_id").alias("rep"), F.bool_or("in_train").alias("class_train"), F.bool_or("in_held").alias("class_held"))
        classes = maybe_broadcast(written(classes, "overlap-classes"))  # written: adaptive execution can split the rows of a hot text
        self.members = written(words.drop("words").join(classes.select("key", "rep", "class_train", "class_held"), "key"), "overlap-members")
        others = maybe_broadcast(self.members.where("document_id != rep").select("document_id"))
        mixed = maybe_broadcast(self.members.where("document_id = rep AND (class_train != in_train OR class_held != in_held)").select("document_id", "class_train", "class_held"))
        reps = words.join(others, "document_id", "left_anti").join(mixed, "document_id", "left").select(
            F.col("document_id").alias("rep"), F.coalesce("class_train", "in_train").alias("in_train"), F.coalesce("class_held", "in_held").alias("in_held"), "words"
        )
        counts = spark.sparkContext.broadcast(bucket_counts(reps, buckets))
        short = reps.where(F.size("words") <= math.ceil(LONG / (1 - rate)) + 1)  # with the partners of those of at most LONG words
        lists = inverted_lists(short, counts, buckets, rate)
        train, held = (lists.where(F.col("side") == s).drop("side").select(*[F.col(c).alias(c if c in ("comp", "salt") else f"{c}_{x}") for c in lists.columns if c != "side"]) for s, x in ((0, "t"), (1, "h")))
        longer, bound = F.greatest("n_t", "n_h"), F.greatest("bound_t", "bound_h")
        lacking = F.greatest(*[sum((F.bit_count(F.col(f"s{j}_{x}").bitwiseAND(F.bitwise_not(F.col(f"s{j}_{y}")))) for j in range(SIGNATURE)), F.lit(0)) for x, y in ("th", "ht")])
        most = F.floor(longer * rate + 1e-9)
        pairs = (
            train.join(held, ["comp", "salt"])
            .where((F.col("rep_t") != F.col("rep_h")) & (F.least("n_t", "n_h") <= LONG) & (F.abs(F.col("n_t") - F.col("n_h")) <= most) & (lacking <= most))
            .groupBy("rep_t", "rep_h").agg(F.sum("w_t").alias("dot"), F.max(bound).alias("bound"), F.max(F.greatest("rest_t", "rest_h")).alias("rest"))
            .where(F.col("dot") + F.col("rest") >= F.col("bound") * (1 - 1e-4) - 1e-3).select("rep_t", "rep_h", "bound")
        )
        pairs = written(pairs, "overlap-pairs")
        # only the records that are in a pair leave the table of words
        ends = written(pairs.select(F.explode(F.array("rep_t", "rep_h")).alias("rep")).distinct(), "overlap-ends")
        vectors = written(reps.select("rep", "words").join(maybe_broadcast(ends), "rep", "left_semi"), "overlap-vectors")
        full = pairs.join(vectors.withColumnsRenamed({"rep": "rep_t", "words": "words_t"}), "rep_t").join(vectors.withColumnsRenamed({"rep": "rep_h", "words": "words_h"}), "rep_h")
        full = full.select("rep_t", "rep_h", "words_t", "words_h", "bound")
        self.candidates = pairs
        links = full.mapInPandas(_verify(counts, buckets, rate), "rep_t string, rep_h string, distance int, cosine double")
        self.links = written(links.unionByName(long_links(reps, counts, buckets, rate)), "overlap-links")
        release(words, ends, vectors)

    def _chunks(self, side: str, rep: str, ids: str) -> DataFrame:
        """Members of a side by class, in arrays of about ``CHUNK``."""
        members = self.members.where(side).select("document_id", F.col("rep").alias(rep))
        large = members.groupBy(rep).agg(F.ceil(F.count("*") / CHUNK).alias("_n")).where("_n > 1")
        placed = members.join(maybe_broadcast(written(large, "overlap-large")), rep, "left").withColumn("_k", F.pmod(F.xxhash64("document_id"), F.coalesce("_n", F.lit(1))))
        return written(placed.groupBy(rep, "_k").agg(F.collect_list("document_id").alias(ids)).drop("_k"), "overlap-chunks")

    def pairs(self) -> DataFrame:
        """``train_id, held_id, distance, cosine``: every pair of a training record and a held-out
        record, equal texts included (distance 0), whatever manifests they are in."""
        own = self.members.where("document_id = rep AND class_train AND class_held")
        links = self.links.unionByName(own.select(F.col("rep").alias("rep_t"), F.col("rep").alias("rep_h"), F.lit(0).alias("distance"), F.lit(1.0).alias("cosine")))
        both = written(links, "overlap-all-links").join(self._chunks("in_train", "rep_t", "ts"), "rep_t").join(self._chunks("in_held", "rep_h", "hs"), "rep_h")
        each = both.select(F.explode("ts").alias("train_id"), "hs", "distance", "cosine").select("train_id", F.explode("hs").alias("held_id"), "distance", "cosine")
        return each.where("train_id != held_id")

    def classes(self) -> DataFrame:
        """``document_id, class_id, in_train, in_held, links``: one row per record with words; its class is that of the records with
        the same words, named after the smallest; links are its partners on the other side."""
        of = self.leaking().groupBy("document_id").agg(F.sum("partners").alias("links"))
        return self.members.select("document_id", F.col("rep").alias("class_id"), "in_train", "in_held").join(of, "document_id", "left").fillna(0, ["links"])

    def leaking(self) -> DataFrame:
        """``document_id, side, rep, partners``: one row per record that has a partner on the other
        side; the partners are counted from class sizes, never listed."""
        members = self.members.select("document_id", "rep", "in_train", "in_held")
        sizes = members.groupBy("rep").agg(F.count_if("in_train").alias("n_t"), F.count_if("in_held").alias("n_h"))
        links = self.links.select("rep_t", "rep_h").unionByName(sizes.select(F.col("rep").alias("rep_t"), F.col("rep").alias("rep_h")))
        of_train = links.join(sizes.select(F.col("rep").alias("rep_h"), "n_h"), "rep_h").groupBy(F.col("rep_t").alias("rep")).agg(F.sum("n_h").alias("partners")).withColumn("side", F.lit("train"))
        of_held = links.join(sizes.select(F.col("rep").alias("rep_t"), "n_t"), "rep_t").groupBy(F.col("rep_h").alias("rep")).agg(F.sum("n_t").alias("partners")).withColumn("side", F.lit("held"))
        found = maybe_broadcast(written(of_train.unionByName(of_held).where("partners > 0"), "overlap-found"))
        own = (F.col("in_train") & F.col("in_held")).cast("int")
        return found.join(members, "rep").where(F.when(F.col("side") == "train", F.col("in_train")).otherwise(F.col("in_held"))).select("document_id", "side", "rep", (F.col("partners") - own).alias("partners")).where("partners > 0")


def found(records: DataFrame, tokens: DataFrame) -> DataFrame:
    """``id_a, id_b`` of each cross-split pair once, the smaller id first."""
    both = Overlap(records, tokens).pairs()
    return both.select(F.least("train_id", "held_id").alias("id_a"), F.greatest("train_id", "held_id").alias("id_b")).distinct()


def counts_by_source(records: DataFrame, tokens: DataFrame) -> DataFrame:
    """``split, source, records, overlapping, partners``: per split and source, the records, those
    with a partner on the other side, and the sum of their partners. A missing source or split is
    a group of its own (null); repeated deliveries count once."""
    leaks = Overlap(records, tokens).leaking().groupBy("document_id", "side").agg(F.sum("partners").alias("partners"))
    one = records.where("id IS NOT NULL").select(F.col("id").alias("document_id"), split_name().alias("split"), "source").distinct()
    keyed = one.withColumn("side", F.when(F.col("split") == "training", "train").otherwise("held"))
    return keyed.join(leaks, ["document_id", "side"], "left").groupBy("split", "source").agg(
        F.countDistinct("document_id").alias("records"), F.count_if(F.col("partners") > 0).alias("overlapping"), F.coalesce(F.sum("partners"), F.lit(0)).alias("partners")
    )

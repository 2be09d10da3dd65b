"""Edit distances of texts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirespark.functions.text import words

EDITS = T.StructType([T.StructField(c, T.IntegerType()) for c in ("substitutions", "insertions", "deletions")])


def char_edits(reference: Column, prediction: Column) -> Column:
    """Levenshtein distance in code points."""
    return F.levenshtein(reference, prediction)


def word_edits(reference: Column, prediction: Column) -> Column:
    """Levenshtein distance in blank-separated words.

    Each distinct word of a pair becomes one code point of the CJK block and up, so the built-in distance does the
    work. Pairs of more than 20,000 distinct words go to :func:`word_edits_long`."""
    a, b = words(reference), words(prediction)
    known = F.array_distinct(F.concat(a, b))

    def coded(side: Column) -> Column:
        return F.array_join(F.transform(side, lambda w: F.decode(F.unhex(F.lpad(F.hex(F.array_position(known, w) + 0x4DFF), 4, "0")), "UTF-16BE")), "")

    short = F.size(known) <= 20_000
    long = word_edits_long(F.when(~short, reference), F.when(~short, prediction))  # Spark calls it for every row; a null costs little
    return F.when(short, F.levenshtein(coded(a), coded(b))).otherwise(long)


@F.pandas_udf(T.IntegerType())
def word_edits_long(reference: pd.Series, prediction: pd.Series) -> pd.Series:
    """The same for any number of words, row by row in linear memory; null for a null text."""
    out = []
    for a, b in zip(reference, prediction):
        if a is None or b is None:
            out.append(None)
            continue
        code: dict[str, int] = {}
        x, y = (np.array([code.setdefault(w, len(code)) for w in t.split()], np.int64) for t in (a, b))
        steps = np.arange(len(y) + 1)
        row = steps.copy()
        for i, w in enumerate(x, 1):
            new = np.concatenate(([i], np.minimum(row[:-1] + (y != w), row[1:] + 1)))
            row = np.minimum.accumulate(new - steps) + steps
        out.append(int(row[-1]))
    return pd.Series(out, dtype="Int32")


def count_edits(references: list[str], predictions: list[str]) -> np.ndarray:
    """Substitutions, insertions and deletions of each pair, shape (pairs, 3); among cheapest edits a match goes before
    a substitution, a deletion and an insertion, seen from the ends. All pairs advance together along
    anti-diagonals, so a step is one vector operation and memory is linear in the longest text."""
    pairs = len(references)
    out = np.zeros((pairs, 3), np.int64)
    order = sorted(range(pairs), key=lambda k: len(references[k]) + len(predictions[k]))
    while order:
        longest = len(references[order[-1]]) + 1
        take = max(1, min(len(order), 400_000 // longest))
        chunk, order = order[-take:], order[:-take]
        _diagonals(chunk, references, predictions, out)
    return out


def _codes(texts: list[str], size: int, fill: int) -> np.ndarray:
    rows = np.full((len(texts), size), fill, np.int64)
    for k, t in enumerate(texts):
        rows[k, : len(t)] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
    return rows


def _diagonals(chunk: list[int], references: list[str], predictions: list[str], out: np.ndarray) -> None:
    ref, pred = [references[k] for k in chunk], [predictions[k] for k in chunk]
    n, m = np.array([len(t) for t in ref]), np.array([len(t) for t in pred])
    a, b = _codes(ref, n.max(), -1), _codes(pred, m.max(), -2)
    # value: cost, substitutions, insertions and deletions packed into one number each
    sub, ins, dele = 1 << 40, 1 << 20, 1
    far = np.int64(1) << 40
    shape = (len(chunk), n.max() + 1)
    cost2, kinds2 = np.full(shape, far), np.zeros(shape, np.int64)
    cost1, kinds1 = np.full(shape, far), np.zeros(shape, np.int64)
    cost1[:, 0] = 0
    for d in range(1, int((n + m).max()) + 1):
        cost, kinds = np.full(shape, far), np.zeros(shape, np.int64)
        low, high = max(0, d - int(m.max())), min(d, int(n.max()))
        i = np.arange(low, high + 1)
        if low == 0:  # nothing of the reference used: insertions only
            cost[:, 0], kinds[:, 0] = cost1[:, 0] + 1, kinds1[:, 0] + ins
            i = i[1:]
        if len(i):
            j = d - i
            inner = j > 0
            x = np.where(inner, np.maximum(j - 1, 0), 0)
            equal = (a[:, i - 1] == b[:, x]) if b.shape[1] else np.zeros((len(chunk), len(i)), bool)
            best = np.where(inner, cost2[:, i - 1] + ~equal, far)
            kind = kinds2[:, i - 1] + np.where(equal, 0, sub)
            c = cost1[:, i - 1] + 1
            better = c < best
            best, kind = np.where(better, c, best), np.where(better, kinds1[:, i - 1] + dele, kind)
            c = np.where(inner, cost1[:, i] + 1, far)
            better = c < best
            cost[:, i], kinds[:, i] = np.where(better, c, best), np.where(better, kinds1[:, i] + ins, kind)
        for k in np.flatnonzero(n + m == d):
            v = int(kinds[k, n[k]])
            out[chunk[k]] = v >> 40, v >> 20 & 0xFFFFF, v & 0xFFFFF
        cost2, kinds2, cost1, kinds1 = cost1, kinds1, cost, kinds


@F.pandas_udf(EDITS)
def edit_counts(reference: pd.Series, prediction: pd.Series) -> pd.DataFrame:
    """Substitutions, insertions and deletions that turn the reference into the prediction; nulls for a null text."""
    there = (reference.notna() & prediction.notna()).to_numpy()
    out = pd.DataFrame({c: pd.array([None] * len(reference), "Int32") for c in ("substitutions", "insertions", "deletions")})
    if there.any():
        counts = count_edits(reference[there].tolist(), prediction[there].tolist())
        for k, c in enumerate(out.columns):
            out.loc[there, c] = counts[:, k]
    return out

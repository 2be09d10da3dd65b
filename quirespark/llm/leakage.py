"""Evaluation passages inside a training corpus (generalised suffix automaton).

The words of all test items form one suffix automaton. Each document's words are streamed through it once; the
state tells the longest piece of any item that ends at the word. A document that holds a passage of at least
``least`` successive item words with at most one edit in ``per`` has an unbroken piece of at least
:func:`shortest_run` words, so pieces of that length are the only seeds needed. A seed's
surroundings are then compared exactly by dynamic programming.

Most documents hold no piece of that length. The pieces of a batch's documents are hashed together as arrays and looked up
among the items' pieces first; only documents with a hit pass through the automaton.

An automaton, the only thing broadcast, holds at most about ``BLOCK_CHARS`` characters of items. More items are searched in
blocks, one pass over the documents each. Documents need no shuffle.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirespark.session import written

#: Fewest successive words of an item, words per allowed edit, characters of items in one automaton.
LEAST, PER, BLOCK_CHARS = 18, 7, 1_000_000
_WORD = re.compile(r"[^\W_]+")
_MARKS = re.compile("[\u0300-\u036f]+")
_MARKED_WORD = re.compile("(?:[^\\W_]|[\u0300-\u036f])+")
SPANS = "array<struct<item_id:bigint,first_char:int,last_char:int,n_words:int,coverage:double>>"


def _pattern(text: str) -> re.Pattern:
    """Pattern of the words; accents that stand as characters of their own belong to theirs."""
    return _WORD if text.isascii() or not _MARKS.search(text) else _MARKED_WORD


def _fold(text: str) -> str:
    return _MARKS.sub("", unicodedata.normalize("NFKD", text.casefold()))


def words_of(text: str) -> list[str]:
    """Words of a text without case, accents and punctuation."""
    if text.isascii():
        return _WORD.findall(text.lower())
    return [w for w in _fold("\n".join(_pattern(text).findall(text))).split("\n") if w]


def words_at(text: str) -> tuple[list[str], list[int], list[int]]:
    """:func:`words_of`; where each starts and ends in the text as it is."""
    words, starts, ends = [], [], []
    for m in _pattern(text).finditer(text):
        w = m.group().lower() if m.group().isascii() else _fold(m.group())
        if w:
            words.append(w)
            starts.append(m.start())
            ends.append(m.end())
    return words, starts, ends


def shortest_run(least: int = LEAST, per: int = PER) -> int:
    """Words of an item that stay together in any passage that counts, at least."""
    return min(-(-(n - n // per) // (n // per + 1)) for n in range(least, 8 * per * per))


def _windows(codes: np.ndarray, run: int) -> np.ndarray:
    """Hashes of every ``run`` successive codes."""
    x = codes.astype(np.uint64)
    n = max(0, len(x) - run + 1)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(run):
            out = (out ^ x[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return out


class Automaton:
    """Generalised suffix automaton over word sequences; knows where the pieces of at least
    ``run`` words end. Ends lie in one list in which those of a state and of the longer ones that link to it are a
    stretch, so its size is that of the items however often they repeat each other."""

    def __init__(self, items: list[list[str]], run: int):
        self.code: dict[str, int] = {}
        self.items = [np.array([self.code.setdefault(w, len(self.code)) for w in item], np.int64) for item in items]
        self.run = run
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        ends: list[list[tuple[int, int]]] = [[]]
        for k, item in enumerate(self.items):
            state = 0
            for place, w in enumerate(item.tolist()):
                state = self._extend(state, w, ends)
                ends[state].append((k, place))
        longer: list[list[int]] = [[] for _ in self.len]
        for s, to in enumerate(self.link):
            if s:
                longer[to].append(s)
        self.ends: list[tuple[int, int]] = []
        self.low, self.high = [0] * len(self.len), [0] * len(self.len)
        stack = [(0, False)]
        while stack:
            s, done = stack.pop()
            if done:
                self.high[s] = len(self.ends)
                continue
            self.low[s] = len(self.ends)
            self.ends += ends[s]
            stack.append((s, True))
            stack += [(x, False) for x in longer[s]]
        pieces = [_windows(item, run) for item in self.items]
        self.pieces = np.unique(np.concatenate([np.empty(0, np.uint64), *pieces]))

    def candidates(self, codes: list[list[int]]) -> np.ndarray:
        """Numbers of the word lists that hold ``run`` successive words of an item, and perhaps a few others."""
        if not len(self.pieces) or not codes:
            return np.empty(0, np.int64)
        sizes = np.array([len(c) + 1 for c in codes])
        flat = np.full(sizes.sum(), -1, np.int64)  # a word of no item behind each list
        ends = np.cumsum(sizes)
        flat[np.delete(np.arange(len(flat)), ends - 1)] = np.fromiter((x for c in codes for x in c), np.int64, len(flat) - len(codes))
        unknown = np.cumsum(np.concatenate(([0], flat < 0)))
        places = np.flatnonzero(unknown[self.run :] == unknown[: len(flat) - self.run + 1]) if len(flat) >= self.run else np.empty(0, np.int64)
        hashes = _windows(flat, self.run)[places]
        at = np.minimum(np.searchsorted(self.pieces, hashes), len(self.pieces) - 1)
        return np.unique(np.searchsorted(ends, places[self.pieces[at] == hashes], side="right"))

    def _new(self, length: int, following: dict[int, int], link: int, ends: list) -> int:
        self.len.append(length)
        self.next.append(following)
        self.link.append(link)
        ends.append([])
        return len(self.len) - 1

    def _split(self, p: int, w: int, q: int, ends: list) -> int:
        clone = self._new(self.len[p] + 1, dict(self.next[q]), self.link[q], ends)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: int, ends: list) -> int:
        q = self.next[last].get(w)
        if q is not None:
            return q if self.len[q] == self.len[last] + 1 else self._split(last, w, q, ends)
        new = self._new(self.len[last] + 1, {}, 0, ends)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.len[q] == self.len[p] + 1 else self._split(p, w, q, ends)
        return new

    def seeds(self, codes: list[int]) -> dict[int, list[tuple[int, int, int]]]:
        """By item: ``(last word in the document, last word in the item, words)`` of every piece of at least ``run``
        words that can't be made longer."""
        found: dict[int, dict[int, list[tuple[int, int, int]]]] = defaultdict(dict)
        state = length = 0
        nxt, link, size, run = self.next, self.link, self.len, self.run
        for i, w in enumerate(codes):
            if w < 0:
                state = length = 0
                continue
            while state and w not in nxt[state]:
                state = link[state]
                length = size[state]
            if w in nxt[state]:
                state = nxt[state][w]
                length += 1
            s, n = state, length
            while n >= run:  # the longest piece that ends here, then the shorter ones of other places
                for k, e in self.ends[self.low[s] : self.high[s]]:
                    pieces = found[k].setdefault(i - e, [])
                    if not pieces or pieces[-1][0] < i - 1:
                        pieces.append((i, e, n))
                    elif pieces[-1][0] == i - 1:
                        pieces[-1] = (i, e, n)
                s = link[s]
                n = size[s] if s > 0 else 0
        return {k: [p for pieces in d.values() for p in pieces] for k, d in found.items()}


def holds(item: np.ndarray, text: np.ndarray, least: int = LEAST, per: int = PER) -> bool:
    """Whether ``text`` holds at least ``least`` successive words of ``item`` with at most one edit in ``per``."""
    n, m = len(item), len(text)
    if n < least or not m:
        return False
    starts = np.arange(n - least + 1)
    steps = np.arange(m + 1)
    cost = np.full((len(starts), m + 1), np.iinfo(np.int32).max // 2, np.int32)
    for i in range(n):
        cost[i : i + 1] = 0  # a passage that starts at this word may start anywhere in the text
        live = cost[: i + 1]
        new = live + 1
        new[:, 1:] = np.minimum(new[:, 1:], live[:, :-1] + (text != item[i]))
        new = np.minimum.accumulate(new - steps, axis=1) + steps
        cost[: i + 1] = new
        done = i + 2 - least
        if done > 0 and (new[:done].min(axis=1) * per <= i + 1 - starts[:done]).any():
            return True
    return False


def _padded(rows: list[np.ndarray], pad: int, fill: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows one after the other with ``pad`` fillers before, between and behind them; where each starts."""
    sizes = np.array([len(r) + pad for r in rows], np.int64)
    starts = pad + np.cumsum(sizes) - sizes
    flat = np.full(pad + sizes.sum(), fill, np.int64)
    if rows:
        flat[np.repeat(starts, sizes - pad) + np.arange((sizes - pad).sum()) - np.repeat(np.cumsum(sizes - pad) - (sizes - pad), sizes - pad)] = np.concatenate(rows)
    return flat, starts


def near(automaton: Automaton, texts: list[np.ndarray], seeds: np.ndarray, least: int, per: int) -> np.ndarray:
    """For rows ``(text, item, d, e)`` whether a passage may lie around a piece that ends at ``text[d]`` and ``item[e]``.

    A passage of at least 2 * least words has a half that counts too, so shorter ones are enough:
    they have at most ``(2 * least - 1) // per`` edits, and lie that close to the piece's diagonal. Some
    ``least`` words in a row then have all but that share of them on a near diagonal. All pieces are tested together."""
    reach = 2 * least - 1
    slack = reach // per
    width = 2 * reach + 1
    own_items, item = np.unique(seeds[:, 1], return_inverse=True)
    items, item_at = _padded([automaton.items[k] for k in own_items], width, -3)
    flat, text_at = _padded(texts, width + 2 * slack, -2)
    out = np.zeros(len(seeds), bool)
    for low in range(0, len(seeds), 4096):
        part = slice(low, low + 4096)
        a = items[(item_at[item[part]] + seeds[part, 3] - reach)[:, None] + np.arange(width)]
        b = flat[(text_at[seeds[part, 0]] + seeds[part, 2] - reach - slack)[:, None] + np.arange(width + 2 * slack)]
        same = np.zeros(a.shape, bool)
        for k in range(2 * slack + 1):
            same |= a == b[:, k : k + width]
        sums = np.cumsum(np.concatenate((np.zeros((len(a), 1), np.int16), same), axis=1), axis=1, dtype=np.int16)
        out[part] = (sums[:, least:] - sums[:, :-least]).max(axis=1) >= least - -(-least * slack // reach) - 1
    return out


def _arm(item: np.ndarray, text: np.ndarray, most: int) -> np.ndarray:
    """Rows ``(item words, edits, text words)`` of the ways on from a piece, with at most ``most`` edits, that end in an
    unchanged word: for each such item word the cheapest, in order; the first is to stay."""
    out = [(0, 0, 0)]
    steps = np.arange(len(text) + 1)
    row = steps
    for i, w in enumerate(item.tolist(), 1):
        same = text == w
        hits = np.flatnonzero(same)
        if len(hits) and row[t := hits[row[hits].argmin()]] <= most:
            out.append((i, int(row[t]), int(t) + 1))
        new = row + 1
        new[1:] = np.minimum(new[1:], row[:-1] + ~same)
        row = np.minimum.accumulate(new - steps) + steps
        if row.min() > most:
            break
    return np.array(out, np.int64)


def passage(item: np.ndarray, text: np.ndarray, piece: tuple[int, int, int], least: int = LEAST, per: int = PER) -> tuple[int, int, int, int] | None:
    """The longest passage that counts and holds the ``piece`` (see :meth:`Automaton.seeds`): its first and last unchanged
    word in the text, then in the item; None if there is none. Changed words at its ends only count towards ``least``."""
    d, e, n = piece
    most = len(item) // per
    head, start = e - n + 1, d - n + 1
    left = _arm(item[:head][::-1], text[max(0, start - head - most) : start][::-1], most)
    right = _arm(item[e + 1 :], text[d + 1 : d + len(item) - e + most], most)
    best = None
    for words, edits, taken in left.tolist():
        size = n + words + right[:, 0]
        lack = np.maximum(0, least - size)
        fits = np.flatnonzero(per * (edits + right[:, 1] + lack) <= size + lack)
        if len(fits):
            r = right[fits[-1]].tolist()
            found = (n + words + r[0], -edits - r[1]), (start - taken, d + r[2], head - words, e + r[0])
            best = found if best is None or found[0] > best[0] else best
    return best and best[1]


def leaks_of(automaton: Automaton, words: list[str], least: int = LEAST, per: int = PER) -> list[tuple[int, int, int]]:
    """:func:`leaks_in` of one text's words."""
    return leaks_in(automaton, [[automaton.code.get(w, -1) for w in words]], least, per)[0]


def leaks_in(automaton: Automaton, texts: list[list[int]], least: int = LEAST, per: int = PER) -> list[list[tuple[int, int, int]]]:
    """By text, given as codes, ``(item, first word, last word)`` of every passage of an item in it, from its first to its last
    unchanged word; passages of one item that overlap are one."""
    rows = [(t, k, d, e, n) for t, codes in enumerate(texts) for k, seeds in automaton.seeds(codes).items() if len(automaton.items[k]) >= least for d, e, n in sorted(seeds, key=lambda s: -s[2])]
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not rows:
        return out
    arrays = [np.array(codes, np.int64) for codes in texts]
    all_rows = np.array(rows, np.int64)
    rows = all_rows[near(automaton, arrays, all_rows[:, :4], least, per)].tolist()
    reach = 2 * least - 1
    slack = reach // per + 1
    for (t, k), own in groupby(rows, key=lambda r: (r[0], r[1])):
        item, text = automaton.items[k], arrays[t]
        spans: list[tuple[int, int, int, int]] = []
        for _, _, d, e, n in own:
            if any(a <= d - n + 1 and d <= b and x <= e - n + 1 and e <= y for a, b, x, y in spans):
                continue
            low, high = max(0, e - reach), min(len(item), e + reach + 1)
            if holds(item[low:high], text[max(0, d - e + low - slack) : max(0, d - e + high + slack)], least, per) and (span := passage(item, text, (d, e, n), least, per)):
                spans.append(span)
        merged: list[list[int]] = []
        for a, b, *_ in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        out[t] += [(k, a, b) for a, b in merged]
    return out


def item_blocks(items: DataFrame, least: int, per: int, block_chars: int = BLOCK_CHARS) -> Iterator[tuple[list[int], Automaton]]:
    """Ids and automaton of every block of items; items without id or text are left out. Without items there is one empty block."""
    known = items.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text")
    chars = known.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-chars // block_chars))
    for k in range(blocks):
        rows = known.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()  # about block_chars characters
        yield [r["item_id"] for r in rows], Automaton([words_of(r["text"]) for r in rows], shortest_run(least, per))


def _texts_spans(texts: list[str | None], ids: list[int], automaton: Automaton, least: int, per: int) -> list[list[tuple]]:
    """``SPANS`` of each text."""
    code = automaton.code.get
    codes = [[code(w, -1) for w in words_of(t)] if t else [] for t in texts]
    out: list[list[tuple]] = [[] for _ in texts]
    likely = automaton.candidates(codes).tolist()
    for at, leaks in zip(likely, leaks_in(automaton, [codes[k] for k in likely], least, per)):
        if leaks:
            _, starts, ends = words_at(texts[at])
            out[at] = [(ids[k], starts[a], ends[b], b - a + 1, (b - a + 1) / len(starts)) for k, a, b in leaks]
    return out


def _search(documents: DataFrame, items: DataFrame, least: int, per: int, block_chars: int, columns: str, last) -> DataFrame:
    """``last(doc_id, text, spans)`` gives the rows of a document, its spans being those of all blocks of items. All blocks
    but the last one leave their spans in a table, so each pass holds one automaton only."""
    spark = documents.sparkSession
    rows = documents.select("doc_id", "text", F.array().cast(SPANS).alias("spans"))
    names = [c.split()[0] for c in columns.split(", ")]

    def passed(ids_automaton, final: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, automaton = ids_automaton.value
            for batch in batches:
                found = _texts_spans(batch["text"].tolist(), ids, automaton, least, per)
                both = [[*(tuple(s.values()) for s in old), *new] for old, new in zip(batch["spans"], found)]
                if final:
                    yield pd.DataFrame([r for doc, text, own in zip(batch["doc_id"], batch["text"], both) for r in last(doc, text, own)], columns=names)
                else:
                    yield batch.assign(spans=[[dict(zip(("item_id", "first_char", "last_char", "n_words", "coverage"), s)) for s in own] for own in both])

        return run

    block = None
    for following in item_blocks(items, least, per, block_chars):
        if block is not None:
            rows = written(rows.mapInPandas(passed(spark.sparkContext.broadcast(block), False), rows.schema), "leaks")
        block = following
    return rows.mapInPandas(passed(spark.sparkContext.broadcast(block), True), columns)


def leak_spans(documents: DataFrame, items: DataFrame, least: int = LEAST, per: int = PER, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id, item_id, first_char, last_char, n_words, coverage``: one row per passage, from its first to its last
    unchanged word; places are those of the text as it is, coverage is the share of the document's words. Null, empty and short texts
    hold nothing; a document or item that comes twice is reported as often. Texts of any length are streamed whole."""
    rows = documents.where("doc_id IS NOT NULL AND text IS NOT NULL")
    return _search(rows, items, least, per, block_chars, "doc_id long, item_id long, first_char int, last_char int, n_words int, coverage double", lambda doc, _, spans: [(doc, *s) for s in spans])


def found(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, item_id`` of each leak once."""
    return leak_spans(documents, items).select("doc_id", "item_id").distinct()


def cleaned(documents: DataFrame, items: DataFrame, most_coverage: float = 0.8, least: int = LEAST, per: int = PER, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id, text, n_leaks, removed_chars, dropped`` of every document: leaked spans are cut out of the text; where
    they cover more than ``most_coverage`` of it the document is marked as dropped and its text is null."""

    def cut(doc, text, spans):
        if not spans:
            return [(doc, text, 0, 0, False)]
        kept, end, gone = [], 0, 0
        for a, b in sorted((s[1], s[2]) for s in spans):
            if b > end:
                kept.append(text[end : max(a, end)])
                gone += b - max(a, end)
                end = b
        dropped = gone > most_coverage * len(text)
        return [(doc, None if dropped else re.sub(r"\s{2,}", " ", "".join([*kept, text[end:]])).strip(), len({s[0] for s in spans}), gone, dropped)]

    return _search(documents, items, least, per, block_chars, "doc_id long, text string, n_leaks int, removed_chars int, dropped boolean", cut)

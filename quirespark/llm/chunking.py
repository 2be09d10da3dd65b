"""Pages longer than a model's window, cut at natural boundaries with a fixed overlap.

For a page of n words the cuts minimise, by dynamic programming over the boundary behind
every word, the sum of the cut penalties and of the squared deviation of each piece's length from
the mean, subject to at most ``limit`` words a piece, of which the first ``overlap`` (in all but the
first piece) repeat the end of the piece before.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirespark.session import maybe_broadcast, written

LIMIT, OVERLAP = 512, 32
#: Penalty of a cut at the end of a sentence, of a line, of a token, and inside a token.
SENTENCE, LINE, TOKEN, INSIDE = 0.0, 0.05, 1.0, 2.0
BALANCE = 0.5
_END = re.compile(r"[.!?。！？…][\"')\]»”’]*$")
# Blanks in the sense of this operator.
BLANKS = r"(?U)[\s\x1c-\x1f ]+"
PIECE = "piece_index int, first_word int, last_word int, first_token int, last_token int, n_words int, repeated int, ends_at string, text string"


def cuts(penalty: np.ndarray, limit: int, overlap: int) -> list[int]:
    """Ends (exclusive word positions) of the pieces of ``len(penalty)`` words; ``penalty[i]`` is
    the price of a cut behind word i. The last end is the number of words."""
    n = len(penalty)
    if n <= limit:
        return [n] if n else []
    step = limit - overlap
    pieces = 1 + -(-(n - limit) // step)
    target = (n + (pieces - 1) * overlap) / pieces
    cost = np.full(n + 1, np.inf)
    back = np.zeros(n + 1, np.int64)
    cost[0] = 0.0
    penalty = np.append(penalty[:-1], 0.0)
    # of pieces that begin behind the first ``overlap`` words, from the longest to the shortest; earlier ones hold all words so far
    uneven = BALANCE * ((np.arange(step, 0, -1) + overlap - target) / limit) ** 2
    for end in range(1, n + 1):
        low = max(0, end - step)
        total = cost[low:end] + uneven[step - (end - low) :]
        if low < overlap:
            m = min(overlap, end) - low
            total[:m] = cost[low : low + m] + BALANCE * ((end - target) / limit) ** 2
        best = int(total.argmin())
        value, start = total[best], low + best
        if end <= limit and (first := BALANCE * ((end - target) / limit) ** 2) <= value:
            value, start = first, 0
        cost[end], back[end] = value + penalty[end - 1], start
    ends = []
    while n:
        ends.append(n)
        n = int(back[n])
    return ends[::-1]


def pieces_of(tokens: list[tuple[int, str, float | None]], limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple]:
    """Pieces of one page given its tokens ``(token_index, text, y_min)`` in order; see ``PIECE``."""
    words, index, kind = [], [], []
    for k, (number, text, y) in enumerate(tokens):
        own = text.split() if text else []
        if not own:
            continue
        words += own
        index += [number] * len(own)
        nxt = next((t for t in tokens[k + 1 : k + 2]), None)
        line = len(own) > 2 or nxt is None or (y is not None and nxt[2] is not None and abs(nxt[2] - y) > 2)
        kind += ["sentence" if _END.search(w) and len(w) > 1 and not w[:-1].replace(".", "").isdigit() else "inside" for w in own[:-1]]
        kind.append("sentence" if _END.search(own[-1]) and any(c.isalpha() for c in own[-1]) else "line" if line else "token")
    price = {"sentence": SENTENCE, "line": LINE, "token": TOKEN, "inside": INSIDE}
    out, start = [], 0
    for k, end in enumerate(cuts(np.array([price[x] for x in kind], float), limit, overlap)):
        first = max(0, start - overlap) if k else 0
        out.append((k, first, end - 1, index[first], index[end - 1], end - first, start - first, "page" if end == len(words) else kind[end - 1], " ".join(words[first:end])))
        start = end
    return out


def word_count(text):
    """Blank-separated words of a text; 0 for null."""
    return F.when(text.isNull(), 0).otherwise(F.size(F.filter(F.split(text, BLANKS), lambda w: w != "")))


def likely_rows(tokens: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``document_id, page_index, token_index, text, y`` of the pages of more than ``limit`` words, repeated rows counted each time: no page has fewer
    words with its repeated rows, so only few pages' rows are told apart later. Rows without a document are left out."""
    rows = tokens.where(F.col("document_id").isNotNull())
    sums = rows.groupBy("document_id", "page_index").agg(F.sum(word_count(F.col("text"))).alias("n")).where(F.col("n") > limit)
    likely = maybe_broadcast(written(sums.select(F.col("document_id").alias("d"), F.col("page_index").alias("p")), "likely-pages"))
    rows = rows.select("document_id", "page_index", "token_index", "text", F.col("bounding_box.y_min").alias("y"))
    return written(rows.join(likely, rows["document_id"].eqNullSafe(F.col("d")) & rows["page_index"].eqNullSafe(F.col("p")), "left_semi"), "likely-rows")


def long_pages(rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``document_id, page_index, n_words`` of the pages of more than ``limit`` words among token rows. Repeated rows
    count once, a token sent with different texts with its most words; a missing
    page index is a page of its own. Tokens without an index are told apart by their text."""
    once = rows.groupBy("document_id", "page_index", "token_index", F.when(F.col("token_index").isNull(), F.col("text"))).agg(F.max(word_count(F.col("text"))).alias("n"))
    return once.groupBy("document_id", "page_index").agg(F.sum("n").alias("n_words")).where(F.col("n_words") > limit)


def chunked_pages(tokens: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """One row per piece of every page of more than ``limit`` words: ``document_id, page_index`` and
    the fields of ``PIECE``. Shorter pages have no row. Null and blank texts add no words; a word
    longer than anything is still one word. Rows sent again are taken once, as in :func:`long_pages`. Tokens
    without an index come first, in order of their texts."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below the limit")
    rows = likely_rows(tokens, limit)
    pages = maybe_broadcast(written(long_pages(rows, limit).select(F.col("document_id").alias("d"), F.col("page_index").alias("p")), "pages"))
    rows = rows.join(pages, rows["document_id"].eqNullSafe(F.col("d")) & rows["page_index"].eqNullSafe(F.col("p")), "left_semi")
    one = rows.groupBy("document_id", "page_index").agg(F.sort_array(F.collect_set(F.struct("token_index", "text", "y"))).alias("t"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["document_id", "page_index", *[f.split()[0] for f in PIECE.split(", ")]]
        for batch in batches:
            for document, page, t in zip(batch["document_id"], batch["page_index"], batch["t"]):
                seen: dict = {}
                for x in t:
                    key = (x["token_index"], x["text"] if x["token_index"] is None else None)
                    if key not in seen or len((x["text"] or "").split()) >= len((seen[key][1] or "").split()):
                        seen[key] = (x["token_index"], x["text"], x["y"])
                yield pd.DataFrame([(document, page, *p) for p in pieces_of(list(seen.values()), limit, overlap)], columns=names).astype({"page_index": "Int32", "first_token": "Int32", "last_token": "Int32"})

    return one.mapInPandas(cut, f"document_id string, page_index int, {PIECE}")

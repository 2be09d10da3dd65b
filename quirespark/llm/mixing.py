"""Mixing sources to target weights.

Every source has a target share t and a limit c, its tokens times its repetition limit. For a wanted
total T a source gives ``c * min(1, t * T / c) ** x``: at x = 1 what its share asks for or, if that is more
than its limit, the limit; at smaller x sources with room to spare give more. The exponent x is bisected so that
the sources together give T: it is 1 as long as every limit holds, and below 1 where scarce sources
end at their limit and the others, nearly in their old ratio, fill the gap.

Unless a total is given it is chosen too: never more than the tokens the listed sources have, and so that
``log(T) - gap / GAP_WORTH`` is largest, where the gap is the sum of the shares that can't be reached. A scarce source
with a small share thus doesn't shrink the mixture, one with a large share does. The rule has no
scale: ten times the tokens give ten times the total.

Without target shares, natural shares are raised to an exponent bisected to a target entropy. A
source's budget is then realised as whole passes over the source and a last pass of whole blocks in permuted
order; of the block in which the budget ends, rows in permuted order. Blocks hold about
``BLOCK_ROWS`` rows; they are summed in two levels, so neither a source's rows nor its blocks meet in one task.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirespark.session import written

# Fixed value: the public pattern that splits text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Most sources and bits of a block's place that name its group are bounds of broadcasts and windows, not of rows.
BLOCK_ROWS, MOST_SOURCES, GROUP_BITS, SEED = 4096, 10_000, 11, 29
#: Sum of unreachable shares for which e times the tokens are worth it.
GAP_WORTH = 0.02


def token_counts(documents: DataFrame, ranks: str, text: str = "text") -> DataFrame:
    """``documents`` with ``n_tokens`` of ``text`` in a public tokenizer; 0 for null and empty texts. The rank
    file (under 1 MB) is read by the driver and broadcast; executors need no copy of it. Very long texts are
    encoded in parts cut in front of a blank, where the pattern splits anyway."""
    with open(ranks, "rb") as file:
        sent = documents.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, sent.value.splitlines())}
        encoding = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        for batch in batches:
            yield batch.drop(columns=text).assign(n_tokens=[sum(len(encoding.encode_ordinary(p)) for p in _parts(t)) if t else 0 for t in batch[text]])

    kept = [c for c in documents.columns if c not in (text, "n_tokens")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.select(*kept).schema.fields)
    return documents.select(*kept, text).mapInPandas(run, f"{schema}, n_tokens long")


def _parts(text: str, most: int = 100_000) -> Iterator[str]:
    while len(text) > most:
        cut = text.rfind(" ", most // 2, most)
        while cut > 0 and text[cut - 1].isspace():
            cut -= 1
        if cut <= 0:
            break
        yield text[:cut]
        text = text[cut:]
    yield text


def entropy(weights: list[float]) -> float:
    total = sum(weights)
    return -sum(w / total * math.log(w / total) for w in weights if w > 0) if total else 0.0


def bisect(good, low: float, high: float, steps: int = 80) -> float:
    """The largest x in [low, high] for which ``good`` holds, given that it holds up to some point;
    ``low`` if it never holds."""
    if good(high):
        return high
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (mid, high) if good(mid) else (low, mid)
    return low


def temperature_weights(tokens: list[float], target_entropy: float) -> tuple[float, list[float]]:
    """Exponent in [0, 8] and weights ``tokens ** x`` whose entropy is ``target_entropy``, or as near as the
    exponent allows (the entropy falls as it grows)."""
    logs = [math.log(t) for t in tokens]

    def weights(x: float) -> list[float]:
        w = [math.exp(x * (v - max(logs))) for v in logs]
        return [v / sum(w) for v in w]

    x = bisect(lambda x: entropy(weights(x)) >= target_entropy, 0.0, 8.0)
    return x, weights(x)


def shares_at(total: float, shares: list[float], most: list[float]) -> tuple[float, list[float]]:
    """Exponent and tokens of each source for a total of at most ``sum(most)``."""
    ratio = [min(1.0, s * total / m) for s, m in zip(shares, most)]

    def tokens(x: float) -> list[float]:
        return [m * r**x for m, r in zip(most, ratio)]

    x = bisect(lambda x: sum(tokens(x)) >= total * (1 - 1e-12), 0.0, 1.0)
    given = tokens(x)
    return x, [g * total / sum(given) for g in given] if x == 1.0 else given


def best_total(shares: list[float], most: list[float], limit: float) -> float:
    """The total of at most ``limit`` with the best of size against unreachable shares; see the module. Between two totals at which
    a source reaches its limit the measure has no peak, so only those and ``limit`` are tried."""
    ends = sorted(((m / s, s, m) for s, m in zip(shares, most)))
    best, at, full_share, full_tokens = None, limit, 0.0, 0.0
    for total, s, m in [*((t, s, m) for t, s, m in ends if t < limit), (limit, 0.0, 0.0)]:
        worth = math.log(total) - (full_share - full_tokens / total) / GAP_WORTH
        if best is None or worth > best + 1e-12:
            best, at = worth, total
        full_share, full_tokens = full_share + s, full_tokens + m
    return at


def mixture_weights(target: list[float], most: list[float], total: float | None = None, natural: float | None = None) -> tuple[float, float, list[float]]:
    """Exponent, total and weights for target shares and most tokens per source (all positive); ``natural`` is the sum of the sources' tokens."""
    shares = [t / sum(target) for t in target]
    total = best_total(shares, most, min(natural or sum(most), sum(most))) if total is None else min(total, sum(most))
    x, tokens = shares_at(total, shares, most)
    return x, total, [t / total for t in tokens]


class Mixture:
    """Rows chosen from ``documents`` (``doc_id, source, text``) by ``targets`` (``source, target_share,
    max_repeat``); ``total`` tokens are wanted, or as many as :func:`best_total` finds.

    ``rows``: ``doc_id, source, n_tokens, copies`` of every row used at least once. ``report``: one row per
    listed source. Sources that aren't listed (a null source never is) take no part; a listed source
    without tokens, with no positive share or limit, gets 0 and the other shares are scaled up. A source listed
    twice counts with the larger share. Rows without tokens are never used. Empty tables give an empty mixture.
    A budget is met to within half of a row.
    """

    def __init__(self, documents: DataFrame, targets: DataFrame, ranks: str, total: float | None = None, seed: int = SEED, block_rows: int = BLOCK_ROWS):
        spark = documents.sparkSession
        listed = targets.where("source IS NOT NULL").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeat").alias("max_repeat")).limit(MOST_SOURCES + 1).collect()
        if len(listed) > MOST_SOURCES:
            raise ValueError(f"more than {MOST_SOURCES} sources")
        names = F.broadcast(spark.createDataFrame([(r["source"],) for r in listed], "source string"))  # at most MOST_SOURCES rows
        counted = written(token_counts(documents.select("doc_id", "source", "text").join(names, "source", "left_semi"), ranks), "token-counts")
        sums = {r["source"]: (r["n"], r["t"]) for r in counted.groupBy("source").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t")).collect()}
        used = sorted((r["source"], r["target_share"], r["max_repeat"]) for r in listed if sums.get(r["source"], (0, 0))[1] and (r["target_share"] or 0) > 0 and (r["max_repeat"] or 0) > 0)
        most = [float(sums[u[0]][1] * u[2]) for u in used]
        self.exponent, self.total, weights = mixture_weights([u[1] for u in used], most, total, float(sum(sums[u[0]][1] for u in used))) if used else (1.0, 0.0, [])
        self.budgets = {u[0]: w * self.total for u, w in zip(used, weights)}
        plan = []
        for s, b in self.budgets.items():
            passes = int(b / sums[s][1] + 1e-9)
            plan.append((s, passes, max(0.0, b - passes * sums[s][1]), max(1, -(-sums[s][0] // block_rows))))
        plan_rows = F.broadcast(spark.createDataFrame(plan, "source string, passes int, rest double, blocks long"))  # at most MOST_SOURCES rows
        block = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("blocks"))
        # a block's place in the permuted order is a hash; places that agree in their first bits are a group
        blocked = counted.where("n_tokens > 0").join(plan_rows, "source").withColumn("block", block).withColumn("place", F.xxhash64("source", "block", F.lit(seed + 1)))
        before = lambda *by: Window.partitionBy("source", *by).rowsBetween(Window.unboundedPreceding, -1)
        sizes = blocked.groupBy("source", "place", "block").agg(F.sum("n_tokens").alias("size"), F.first("rest").alias("rest")).withColumn("group", F.shiftright("place", 64 - GROUP_BITS))
        groups = sizes.groupBy("source", "group").agg(F.sum("size").alias("group_size"), F.first("rest").alias("rest"))
        groups = groups.withColumn("start", F.coalesce(F.sum("group_size").over(before().orderBy("group")), F.lit(0)))  # 2 ** GROUP_BITS rows a source
        groups = groups.where((F.col("start") <= F.col("rest")) & (F.col("rest") < F.col("start") + F.col("group_size"))).select("source", "group", "start")
        inner = sizes.join(F.broadcast(groups), ["source", "group"])  # one row a source
        inner = inner.withColumn("start", F.col("start") + F.coalesce(F.sum("size").over(before("group").orderBy("place", "block")), F.lit(0)))
        last = inner.where((F.col("start") <= F.col("rest")) & (F.col("rest") < F.col("start") + F.col("size"))).select("source", F.col("place").alias("last_place"), F.col("block").alias("last_block"), (F.col("rest") - F.col("start")).alias("room"))
        last = written(last, "last-blocks")
        placed = blocked.join(F.broadcast(last), "source", "left")  # one row a source
        in_last = F.coalesce(F.col("block") == F.col("last_block"), F.lit(False))
        # sources whose budget needs no part of a block have no last one: their last pass is whole or empty
        earlier = F.when(F.col("last_place").isNull(), F.lit(False)).otherwise(F.struct("place", "block") < F.struct("last_place", "last_block"))
        columns = ["doc_id", "source", "n_tokens"]
        whole = placed.where(~in_last).select(*columns, (F.col("passes") + earlier.cast("int")).alias("copies"))
        order = Window.partitionBy("source").orderBy(F.xxhash64("doc_id", F.lit(seed + 2)), "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one block of a source
        inside = placed.where(in_last).withColumn("upto", F.sum("n_tokens").over(order))
        part = inside.select(*columns, (F.col("passes") + (F.col("upto") - F.col("n_tokens") / 2 < F.col("room")).cast("int")).alias("copies"))
        self.rows = whole.unionByName(part).where("copies > 0")
        self._listed, self._sums = listed, sums

    def report(self) -> DataFrame:
        """``source, target_share, max_repeat, tokens, budget, used_tokens, actual_share, used_rows, most_copies, exponent``."""
        spark = self.rows.sparkSession
        used = self.rows.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("used_tokens"), F.count("*").alias("used_rows"), F.max("copies").alias("most_copies"))
        listed = [(r["source"], float(r["target_share"] or 0), int(r["max_repeat"] or 0), int(self._sums.get(r["source"], (0, 0))[1] or 0), float(self.budgets.get(r["source"], 0.0))) for r in self._listed]
        base = F.broadcast(spark.createDataFrame(listed, "source string, target_share double, max_repeat int, tokens long, budget double"))
        both = written(used.join(base, "source", "right"), "mixture")
        total = both.agg(F.coalesce(F.sum("used_tokens"), F.lit(0))).first()[0]
        return both.select("source", "target_share", "max_repeat", "tokens", "budget", F.coalesce("used_tokens", F.lit(0)).alias("used_tokens"), (F.coalesce("used_tokens", F.lit(0)) / F.lit(float(max(1, total)))).alias("actual_share"), F.coalesce("used_rows", F.lit(0)).alias("used_rows"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), F.lit(float(self.exponent)).alias("exponent"))


def temperature_report(documents: DataFrame, targets: DataFrame, ranks: str) -> DataFrame:
    """``source, tokens, natural_share, exponent, weight`` of the listed sources that occur: natural token
    shares raised to the exponent at which their entropy is that of the target shares."""
    spark = documents.sparkSession
    shares = {r["source"]: r["s"] for r in targets.where("source IS NOT NULL AND target_share > 0").groupBy("source").agg(F.max("target_share").alias("s")).limit(MOST_SOURCES + 1).collect()}
    if len(shares) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    names = F.broadcast(spark.createDataFrame([(k,) for k in shares], "source string"))  # at most MOST_SOURCES rows
    rows = token_counts(documents.select("source", "text").join(names, "source", "left_semi"), ranks).groupBy("source").agg(F.sum("n_tokens").alias("t")).where("t > 0").orderBy("source").collect()
    schema = "source string, tokens long, natural_share double, exponent double, weight double"
    if not rows:
        return spark.createDataFrame([], schema)
    tokens = np.array([r["t"] for r in rows], float)
    x, weights = temperature_weights(tokens.tolist(), entropy([shares[r["source"]] for r in rows]))
    return spark.createDataFrame([(r["source"], int(r["t"]), float(r["t"] / tokens.sum()), float(x), float(w)) for r, w in zip(rows, weights)], schema)

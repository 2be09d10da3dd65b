"""Splits that keep related records together.

Records of a manifest that share a value of one of its grouping keys, directly or through other
records, form a set (connected component). Sets are found by alternating large-star and
small-star contraction on (record, smallest record) edges. A node, or a group value, with very many
edges (a hub) is joined with its smallest neighbour by broadcast, so its edges stay where they lie; no
set, hub or edge list is ever gathered in one task. New splits come from largest differencing: in blocks of a bounded number of
sets, the two partial solutions of the largest spread are combined again and again, heavy bins
onto light ones, until a block is ``BINS`` nearly equal bins; blocks are combined the same way,
level by level, and whole bins are then given to the splits by target share.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirespark.llm.overlap import split_name
from quirespark.operators.keys import HUB_ROWS, with_least
from quirespark.session import release, written

#: Equal bins of a manifest, sets in a block, blocks combined at once.
BINS, BLOCK_SETS, FAN_IN = 256, 4000, 64
# Stand-ins for an unknown value, lower case.
STAND_INS = ["", "-", "--", "?", "n/a", "na", "n.a.", "nan", "nil", "none", "null", "unknown", "unk", "undefined", "not available", "missing", "tbd"]


def group_value(value: Column) -> Column:
    """The value that ties records: lower case, outer blanks removed; null for a stand-in."""
    v = F.lower(F.regexp_replace(value, r"(?U)^\s+|\s+$", ""))
    return F.when(~v.isin(STAND_INS), v)


def stars(edges: DataFrame, most: int = 60, hub_rows: int = HUB_ROWS) -> DataFrame:
    """``node, root`` for every node of ``edges`` (``u, v``): root is the smallest node of its
    component. Self loops and repeated edges do no harm; null ends are left out."""
    e = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = written(e, "edges")
    measure = (F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
    before = tuple(e.agg(*measure).first())
    for _ in range(most):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = with_least(both, ["u"], "v", "m", 2 * before[0], hub_rows)
        large = near.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u != v").distinct()
        near = with_least(large, ["u"], "v", "m", 2 * before[0], hub_rows)
        # v = m keeps the edge to the smallest neighbour, every other one moves from the node to that neighbour
        hooked = near.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        following = written(hooked.distinct(), "edges")
        release(e)
        e = following
        now = tuple(e.agg(*measure).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components aren't final after {most} rounds")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def record_sets(records: DataFrame, heads: DataFrame) -> DataFrame:
    """``manifest_name, id, set_id`` of every record, deliveries of one record once. Records without
    an id or a manifest are left out; one without usable groups is a set of its own, as is every
    record of a manifest whose head is missing or names no grouping keys."""
    keys = heads.groupBy(F.col("name").alias("manifest_name")).agg(F.flatten(F.collect_set("split_strategy.grouping_keys")).alias("keys"))
    rows = records.where("id IS NOT NULL AND manifest_name IS NOT NULL").select("manifest_name", "id", "groups")
    entries = rows.select("manifest_name", "id", F.explode("groups").alias("key", "value")).join(keys, "manifest_name").where(F.array_contains("keys", F.col("key")))
    node = F.concat_ws("\x01", "manifest_name", "id")
    ties = entries.select(node.alias("node"), "manifest_name", "key", group_value(F.col("value")).alias("value")).where("value IS NOT NULL").distinct()
    ties = written(ties, "ties")
    edges = with_least(ties, ["manifest_name", "key", "value"], "node", "v", ties.count()).select(F.col("node").alias("u"), "v")
    root = stars(edges)
    every = rows.select("manifest_name", "id", node.alias("node")).distinct()
    return every.join(root, "node", "left").select("manifest_name", "id", F.coalesce(F.split_part("root", F.lit("\x01"), F.lit(2)), "id").alias("set_id"))


def torn_sets(records: DataFrame, heads: DataFrame) -> DataFrame:
    """``id, set_id``: all records of each set whose records lie in more than one split now, of the sets that :func:`new_splits` has
    placed. Records without a split are listed but add none."""
    placed = written(new_splits(records, heads), "placed-sets")
    splits = records.select("manifest_name", "id", split_name().alias("split")).where("split IS NOT NULL").distinct()
    now = placed.join(splits, ["manifest_name", "id"]).groupBy("manifest_name", "set_id").agg(F.min("split").alias("a"), F.max("split").alias("b")).where("a != b")
    # written, so that adaptive execution can split the rows of a giant set
    torn = written(now.select("manifest_name", "set_id"), "torn-sets")
    return placed.join(torn, ["manifest_name", "set_id"], "left_semi").select("id", "set_id").distinct()


def difference(items: list[np.ndarray], bins: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Largest differencing over partial solutions, each the weights of its bins in descending order: weights of the final
    bins, and for each item the final bin of each of its bins. Steps keep only how bins were reordered; the places
    are worked out from the last step back."""
    heap = [(-(w[0] - w[-1]), k, w) for k, w in enumerate(items)]
    heapq.heapify(heap)
    steps: list[tuple[int, int, np.ndarray]] = []
    while len(heap) > 1:
        _, a, wa = heapq.heappop(heap)
        _, b, wb = heapq.heappop(heap)
        w = wa + wb[::-1]
        order = np.argsort(-w, kind="stable")
        w = w[order]
        heapq.heappush(heap, (-(w[0] - w[-1]), len(items) + len(steps), w))
        steps.append((a, b, order.astype(np.int16)))
    place: list[np.ndarray] = [np.arange(bins)] * (len(items) + len(steps))
    for k in range(len(steps) - 1, -1, -1):
        a, b, order = steps[k]
        own = np.empty(bins, np.int64)
        own[order] = place[len(items) + k]
        place[a], place[b] = own, own[::-1]
    return heap[0][2], place[: len(items)]


def _block_bins(bins: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        """Rows ``unit, slot, weight``; rows of one unit are the bins of a partial solution."""
        frame = frame.sort_values(["unit", "weight", "slot"], ascending=[True, False, True], ignore_index=True)
        units, weight = frame["unit"].to_numpy(), frame["weight"].to_numpy(np.float64)
        starts = np.flatnonzero(np.concatenate(([True], units[1:] != units[:-1])))
        ends = np.append(starts[1:], len(frame))
        items = []
        for a, b in zip(starts, ends):
            w = np.zeros(bins)
            w[: b - a] = weight[a:b]
            items.append(w)
        _, place = difference(items, bins)
        to = np.concatenate([p[: b - a] for p, a, b in zip(place, starts, ends)])
        return pd.DataFrame({"manifest_name": frame["manifest_name"], "block": frame["block"], "unit": frame["unit"], "slot": frame["slot"], "bin": to})

    return run


def _to_splits(frame: pd.DataFrame) -> pd.DataFrame:
    """Whole bins of one manifest to its splits, each to the one that lacks most."""
    shares = {k: max(0.0, float(v or 0)) for k, v in zip(frame["names"].iloc[0], frame["shares"].iloc[0])}
    sum_shares = sum(shares.values()) or 1.0
    frame = frame.sort_values(["weight", "bin"], ascending=[False, True], ignore_index=True)
    need = {k: v / sum_shares * frame["weight"].sum() for k, v in shares.items() if v > 0} or {"training": 1.0}
    out = []
    for w in frame["weight"]:
        best = max(need, key=need.__getitem__)
        need[best] -= w
        out.append(best)
    return pd.DataFrame({"manifest_name": frame["manifest_name"], "bin": frame["bin"], "new_split": out})


def balanced_splits(sets: DataFrame, heads: DataFrame, bins: int = BINS, block_sets: int = BLOCK_SETS) -> DataFrame:
    """``manifest_name, id, set_id, new_split`` for a written ``record_sets`` table. A manifest without a head or
    without positive shares goes to training whole. One set never leaves its split, so a set larger
    than a split's share makes the shares uneven by necessity."""
    weights = sets.groupBy("manifest_name", "set_id").agg(F.count("*").alias("weight"))
    n = weights.groupBy("manifest_name").agg(F.count("*").alias("n_sets")).select("manifest_name", F.ceil(F.col("n_sets") / block_sets).alias("blocks"))
    units = weights.join(n, "manifest_name").select("manifest_name", F.pmod(F.xxhash64("set_id"), F.col("blocks")).alias("block"), F.col("set_id").alias("unit"), F.lit(0).alias("slot"), "weight", "blocks")
    result = "manifest_name string, block long, unit string, slot int, bin int"
    at = None
    while True:
        units = written(units, "units")
        most = units.agg(F.max("blocks")).first()[0] or 0
        # a number of partitions that is named isn't lowered: the rows are few but a block is a second of work
        spread = units.select("manifest_name", "block", "unit", "slot", "weight").repartition(int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), "manifest_name", "block")
        placed = written(spread.groupBy("manifest_name", "block").applyInPandas(_block_bins(bins), result), "placed")
        if at is None:
            at = placed.select("manifest_name", F.col("unit").alias("set_id"), F.col("block").alias("b"), "bin")
        else:
            step = placed.select("manifest_name", F.col("unit").cast("long").alias("b"), F.col("slot").alias("bin"), F.col("block").alias("nb"), F.col("bin").alias("nbin"))
            at = at.join(step, ["manifest_name", "b", "bin"]).select("manifest_name", "set_id", F.col("nb").alias("b"), F.col("nbin").alias("bin"))
        totals = placed.join(units, ["manifest_name", "block", "unit", "slot"]).groupBy("manifest_name", "block", "bin").agg(F.sum("weight").alias("weight"), F.max("blocks").alias("blocks"))
        if most <= 1:
            break
        fewer = F.ceil(F.col("blocks") / FAN_IN)
        units = totals.select("manifest_name", F.pmod("block", fewer).alias("block"), F.col("block").cast("string").alias("unit"), F.col("bin").alias("slot"), "weight", fewer.alias("blocks"))
    share = heads.select(F.col("name").alias("manifest_name"), F.map_from_arrays(F.array(*[F.lit(c) for c in _share_names(heads)]), F.array(*[F.col(f"target_share.{c}") for c in _share_names(heads)])).alias("s"))
    share = share.groupBy("manifest_name").agg(F.max_by("s", F.size("s")).alias("s")).select("manifest_name", F.map_keys("s").alias("names"), F.map_values("s").alias("shares"))
    all_bins = totals.join(share, "manifest_name", "left").select("manifest_name", "bin", "weight", F.coalesce("names", F.array(F.lit("training"))).alias("names"), F.coalesce("shares", F.array(F.lit(1.0))).alias("shares"))
    split = all_bins.groupBy("manifest_name").applyInPandas(_to_splits, "manifest_name string, bin int, new_split string")
    of_set = written(at.join(split, ["manifest_name", "bin"]).select("manifest_name", "set_id", "new_split"), "set-splits")  # as in torn_sets
    return sets.join(of_set, ["manifest_name", "set_id"])


def _share_names(heads: DataFrame) -> list[str]:
    return [f.name for f in heads.schema["target_share"].dataType.fields]


def new_splits(records: DataFrame, heads: DataFrame, **sizes: int) -> DataFrame:
    """``manifest_name, id, set_id, new_split`` of every record."""
    return balanced_splits(written(record_sets(records, heads), "sets"), heads, **sizes)


def split_report(assigned: DataFrame, heads: DataFrame) -> DataFrame:
    """``manifest_name, new_split, records, sets, share, target_share`` of a :func:`new_splits` table."""
    target = heads.select(F.col("name").alias("manifest_name"), F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in _share_names(heads)]), F.array(*[F.col(f"target_share.{c}") for c in _share_names(heads)]))).alias("new_split", "target_share"))
    counts = assigned.groupBy("manifest_name", "new_split").agg(F.count("*").alias("records"), F.countDistinct("set_id").alias("sets"))
    total = counts.groupBy("manifest_name").agg(F.sum("records").alias("total"))
    return target.join(counts, ["manifest_name", "new_split"], "left").join(total, "manifest_name", "left").select(
        "manifest_name", "new_split", F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("sets", F.lit(0)).alias("sets"), F.try_divide(F.coalesce("records", F.lit(0)), "total").alias("share"), "target_share"
    )

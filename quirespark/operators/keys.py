"""Keys that may hold very many rows: values of a key's rows beside each of them, without all of them in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows from which on a key is a hub; most hubs that are broadcast (in a larger table a hub needs more rows).
HUB_ROWS, MOST_HUBS = 100_000, 10_000
#: Places in an order that are looked at together.
BLOCK = 4096


def with_least(rows: DataFrame, key: list[str], value: str, name: str, n: int, hub_rows: int = HUB_ROWS) -> DataFrame:
    """``rows`` with the smallest ``value`` of their key as ``name``; ``n`` is (about) the number of rows. Rows with a null in the key are left out. The smallest values
    come from partial aggregates; rows of hubs get theirs by broadcast, so that no task holds all rows of a key."""
    hub = max(hub_rows, n // MOST_HUBS)
    sums = rows.groupBy(*key).agg(F.min(value).alias(name), F.count("*").alias("_n"))
    hubs = sums.where(F.col("_n") > hub).drop("_n")  # at most MOST_HUBS rows
    light = sums.where(F.col("_n") <= hub).drop("_n")
    of_hubs = rows.join(F.broadcast(hubs), key)
    return of_hubs.unionByName(rows.join(F.broadcast(hubs.select(*key)), key, "left_anti").join(light, key))


def with_last_before(rows: DataFrame, key: list[str], order: str, value: Column, name: str, block: int = BLOCK) -> DataFrame:
    """``rows`` with the last ``value`` that isn't null of the rows of their key before them in ``order`` (whole numbers, unique in a key) as ``name``. The order is cut into blocks
    of ``block`` numbers: a window never holds more rows of a key than a block has, or than the key has blocks."""
    rows = rows.withColumns({"_b": F.floor(F.col(order) / block), "_v": value})
    inside = Window.partitionBy(*key, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy(*key, "_b").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col(order))).alias("_l"))
    earlier = Window.partitionBy(*key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.withColumn("_before", F.last("_l", ignorenulls=True).over(earlier)).drop("_l")
    own = rows.withColumn("_own", F.last("_v", ignorenulls=True).over(inside))
    return own.join(before, [*key, "_b"]).withColumn(name, F.coalesce("_own", "_before")).drop("_b", "_v", "_own", "_before")

"""Positions in an order, and joins with hot keys, without one task for a large group."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.session import broadcast_if_small, materialize

PART_BITS = 33  # monotonically_increasing_id: the partition above, the row in it below
HEAVY = 4096  # keys with more than a 4096th of all rows are at most so many


def in_order(df: DataFrame, groups: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """``df`` with ``position``: 0, 1, 2, ... in each group, nulls first; groups may not be null.

    The rows are dealt into ranges of the whole order and written sorted, each range with its rows
    numbered; only the first number and the count of a group in each range are exchanged. Equal rows
    are parted by their place in a written table, so neither a group nor a run of repeated rows lands
    in one task. ``order`` should be short: its values are sampled to find the ranges.
    """
    tied = materialize(df.withColumn("_tie", F.monotonically_increasing_id()), f"{name}-rows")
    keys = [*groups, *order, "_tie"]
    ranged = materialize(
        tied.repartitionByRange(*keys).sortWithinPartitions(*keys)
        .withColumn("_row", F.monotonically_increasing_id()),
        f"{name}-sorted",
    ).withColumn("_part", F.shiftright("_row", PART_BITS))
    found = ranged.groupBy(*groups, "_part").agg(
        F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = found.select(
        *groups, "_part",
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
    )
    return (
        ranged.join(broadcast_if_small(starts), [*groups, "_part"])
        .withColumn("position", F.col("_row") + F.col("_shift"))
        .drop("_tie", "_row", "_part", "_shift")
    )


def split_join(rows: DataFrame, sized: DataFrame, keys: Sequence[str], size: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with one row for the values of ``keys``; ``size`` is their rows in ``rows``.

    Those with more than ``total / HEAVY`` rows, at most ``HEAVY`` of them, are broadcast, so the rows
    of such a value stay where they are; the others are shuffled.
    """
    hot = F.col(size) > total / HEAVY
    heavy, light = sized.where(hot), sized.where(~hot)
    keys = list(keys)
    return rows.join(F.broadcast(heavy), keys).unionByName(
        rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(light, keys)
    )

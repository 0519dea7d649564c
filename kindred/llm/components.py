"""Connected components of an edge table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.session import materialize


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _mark(edges: DataFrame) -> tuple[int, int]:
    """Count and an order-free checksum, to see whether a round changed anything."""
    word = F.xxhash64("u", "v")
    row = edges.agg(F.count("*"), F.bit_xor(word)).first()
    return row[0], row[1] or 0


def connected(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """``v, root``: the least vertex of the component of every vertex that isn't least itself.

    Alternates two steps on edges ``u, v``: every vertex hands the least of its neighbours to the
    larger ones, then to the smaller ones and itself. Paths shorten like powers of two; each round
    is written to the shared folder. Edges of a vertex with itself are passed over.
    """
    now = materialize(edges.filter("u <> v").select("u", "v").distinct(), "edges")
    mark = _mark(now)
    for _ in range(rounds):
        if not mark[0]:
            break
        near = _both_ways(now)
        least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = near.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.filter("u <> v").distinct(), "large-star")
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        lowest = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(lowest.select("u", F.col("m").alias("v")))
        now = materialize(small.filter("u <> v").distinct(), "small-star")
        before, mark = mark, _mark(now)
        if before == mark:
            break
    else:
        raise RuntimeError(f"components are not found after {rounds} rounds")
    return now.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("root"))

"""Row numbers and running totals that never sort a whole group in one task.

Groups are cut into buckets of bounded size. Rows are numbered inside a bucket, and the number of
rows in earlier buckets of the group is added; only the small table of bucket totals is scanned
group by group.
"""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.session import broadcast_if_small, never_broadcast

BUCKET_ROWS = 500_000
QUANTILES = 200


def _exclusive(total: Column, window) -> Column:
    """Sum over the rows before this one."""
    before = window.rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(total).over(before), F.lit(0))


def group_join(
    df: DataFrame, other: DataFrame, groups: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Join on group columns, where NULL is a group like any other, as in a window."""
    own = {g: f"_other_{g}" for g in groups}
    same = F.lit(True)
    for g, name in own.items():
        same = same & df[g].eqNullSafe(F.col(name))
    return df.join(other.withColumnsRenamed(own), same, how).drop(*own.values())


def _with_size(df: DataFrame, groups: Sequence[str], name: str) -> DataFrame:
    size = F.count(F.lit(1)).alias(name)
    if groups:
        return group_join(df, broadcast_if_small(df.groupBy(*groups).agg(size)), groups)
    return df.withColumn(name, df.agg(size).scalar())


def shuffled_index(
    df: DataFrame,
    unit: str,
    row_id: str,
    groups: Sequence[str] = (),
    size: str | None = None,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Number the rows of each group 0, 1, 2, ... in the order of ``unit``, then ``row_id``.

    ``unit`` is a uniform hash in [0, 1), so equal slices of it are buckets of equal size. Adds
    ``idx`` and, unless the column ``size`` already holds it, ``group_rows``.
    """
    sized = df if size else _with_size(df, groups, "group_rows")
    buckets = F.ceil(F.col(size or "group_rows") / F.lit(bucket_rows))
    cut = sized.withColumn("_bucket", F.floor(F.col(unit) * buckets))
    totals = cut.groupBy(*groups, "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    in_order = Window.partitionBy(*groups).orderBy("_bucket")
    offsets = totals.select(
        *groups, "_bucket", _exclusive(F.col("_rows"), in_order).alias("_offset")
    )
    in_bucket = Window.partitionBy(*groups, "_bucket").orderBy(unit, row_id)
    return (
        group_join(never_broadcast(cut), offsets, [*groups, "_bucket"])
        .withColumn("idx", F.col("_offset") + F.row_number().over(in_bucket) - 1)
        .drop("_bucket", "_offset")
    )


def blocked_index(
    df: DataFrame,
    groups: Sequence[str],
    block: str,
    unit: str,
    row_id: str,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Number the rows of each group so that rows of one block are neighbours.

    Adds ``idx`` (from 0), ``block_start``, ``block_rows`` and ``group_rows``.
    """
    widths = df.groupBy(*groups, block).agg(F.count(F.lit(1)).alias("block_rows"))
    sizes = widths.groupBy(*groups).agg(F.sum("block_rows").alias("group_rows"))
    buckets = F.ceil(F.col("group_rows") / F.lit(bucket_rows)).cast("bigint")
    blocks = group_join(never_broadcast(widths), sizes, groups).withColumn(
        "_part", F.pmod(F.xxhash64(block), buckets)
    )
    parts = blocks.groupBy(*groups, "_part").agg(F.sum("block_rows").alias("_rows"))
    part_order = Window.partitionBy(*groups).orderBy("_part")
    parts = parts.select(*groups, "_part", _exclusive(F.col("_rows"), part_order).alias("_before"))
    block_order = Window.partitionBy(*groups, "_part").orderBy(block)
    inside = blocks.withColumn("_inside", _exclusive(F.col("block_rows"), block_order))
    starts = (
        group_join(never_broadcast(inside), parts, [*groups, "_part"])
        .withColumn("block_start", F.col("_before") + F.col("_inside"))
        .drop("_part", "_inside", "_before")
    )
    placed = group_join(never_broadcast(df), starts, [*groups, block])
    indexed = shuffled_index(
        placed, unit, row_id, [*groups, block], size="block_rows", bucket_rows=bucket_rows
    )
    return indexed.withColumn("idx", F.col("block_start") + F.col("idx"))


def running_sums(
    df: DataFrame,
    groups: Sequence[str],
    order: str,
    values: Mapping[str, Column],
    ties: Sequence[str] = (),
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Sums from the start of the group up to each row, in the order of a numeric column.

    Groups above ``bucket_rows`` rows are cut at quantiles of ``order``, so that outliers don't crowd
    the others together. There are at most ``rows / bucket_rows`` such groups, so the table that
    describes them stays small. Rows of one value of ``order`` stay in one bucket. Where no group is above,
    rows are shuffled by their group and once only.
    """
    place = F.col(order).cast("double")
    steps = F.array(*[F.lit((i + 1) / QUANTILES) for i in range(QUANTILES - 1)])
    step = F.greatest(F.lit(1), F.floor(F.lit(QUANTILES * bucket_rows) / F.col("_rows")))
    counts = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("_rows"))
    counts = counts.where(F.col("_rows") > bucket_rows)
    if counts.isEmpty():  # every group is one bucket
        window = Window.partitionBy(*groups).orderBy(order, *ties)
        window = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sums = [F.coalesce(F.sum(v).over(window), F.lit(0)).alias(n) for n, v in values.items()]
        return df.select(*df.columns, *sums)
    large = (
        group_join(df, broadcast_if_small(counts), groups)
        .groupBy(*groups, "_rows")
        .agg(F.percentile_approx(place, steps, 10_000).alias("_cuts"))
        .withColumn("_cuts", F.filter("_cuts", lambda c, i: (i + 1) % step == 0))
    )
    bucket = F.coalesce(F.size(F.filter("_cuts", lambda c: c < place)), F.lit(0))
    marked = group_join(df, broadcast_if_small(large), groups, "left")
    # without cuts size() is NULL or -1: one bucket
    cut = marked.withColumn("_bucket", F.greatest(bucket, F.lit(0))).drop("_rows", "_cuts")
    totals = cut.groupBy(*groups, "_bucket").agg(
        *[F.sum(v).alias("_total_" + n) for n, v in values.items()]
    )
    bucket_order = Window.partitionBy(*groups).orderBy("_bucket")
    offsets = totals.select(
        *groups,
        "_bucket",
        *[_exclusive(F.col("_total_" + n), bucket_order).alias("_before_" + n) for n in values],
    )
    in_bucket = (
        Window.partitionBy(*groups, "_bucket")
        .orderBy(order, *ties)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    joined = group_join(cut, offsets, [*groups, "_bucket"])
    sums = [
        (F.col("_before_" + n) + F.coalesce(F.sum(v).over(in_bucket), F.lit(0))).alias(n)
        for n, v in values.items()
    ]
    return joined.select(*df.columns, *sums)

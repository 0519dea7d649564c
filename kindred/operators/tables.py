"""Product and media tables: snapshots, filters, dimensions, media order, quarantine."""

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions.keys import canonical_id, has_text, is_positive_id, shift_date
from kindred.functions.text import gen_title
from kindred.operators.ranking import BUCKET_ROWS, running_sums


def scan_day(df: DataFrame, day: str, column: str = "dt") -> DataFrame:
    """One day's snapshot; on a table partitioned by day only that partition is read."""
    return df.where(F.col(column) == F.lit(day))


def scan_recent_days(
    df: DataFrame, day: str, days: int = 7, column: str = "dt", end_day: str | None = None
) -> DataFrame:
    """Days from ``day - days`` on; later days stay in unless ``end_day`` closes the range."""
    recent = df.where(F.col(column) >= shift_date(day, -days))
    return recent if end_day is None else recent.where(F.col(column) <= F.lit(end_day))


def valid_sku(df: DataFrame, column: str = "sku") -> DataFrame:
    return df.where(has_text(F.col(column)))


def with_canonical_ids(df: DataFrame, columns: Sequence[str], positive: str) -> DataFrame:
    """Keep rows whose ``positive`` id is above zero, then rewrite ids as integer text."""
    kept = df.where(is_positive_id(F.col(positive)))
    return kept.withColumns({c: canonical_id(F.col(c)) for c in columns})


def with_title(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "title",
        gen_title(
            F.col("first_level_category_name"),
            F.col("second_level_category_name"),
            F.col("product_name"),
            F.col("product_title"),
        ),
    )


def product_dim(df: DataFrame, key: str, attributes: Mapping[str, str]) -> DataFrame:
    """One row per item with the greatest value of each attribute, each on its own.

    ``attributes`` maps source columns to output names.
    """
    greatest = [F.max(c).alias(n) for c, n in attributes.items()]
    return df.groupBy(F.col(key).cast("string").alias(key)).agg(*greatest)


def active_items(df: DataFrame, status: Column, columns: Sequence[str]) -> DataFrame:
    return df.where(status).select(*columns).distinct()


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def latest_media(df: DataFrame, item: str, order: str, url: str, condition: Column) -> DataFrame:
    """Address of the newest medium of each item."""
    return df.where(condition).groupBy(item).agg(F.max_by(url, order).alias(url))


def rank_images(
    products: DataFrame,
    media: DataFrame,
    *,
    item: str,
    media_item: str,
    media_id: str,
    url: str,
    kinds: Sequence[str],
    kind: str,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Products with their media, numbered from 0 per item in id order; items without media stay."""
    chosen = media.where(F.col(kind).isin(*kinds) & F.col(media_item).isNotNull())
    numbered = running_sums(
        chosen.select(media_item, media_id, url),
        [media_item],
        media_id,
        {"_place": F.lit(1)},
        ties=[url],
        bucket_rows=bucket_rows,
    ).select(
        F.col(media_item).alias(item),
        F.col(url),
        (F.col("_place") - 1).cast("string").alias("img_id"),
    )
    return products.join(numbered, item, "left")


def quarantine(df: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Split rows by rules that must hold: the good ones, and the bad ones with an ``error`` column.

    ``error`` lists the names of all broken rules. A rule that yields NULL counts as broken.
    """
    broken = [
        F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()
    ]
    error = F.concat_ws(",", *broken)
    marked = df.withColumn("error", error)
    return marked.where("error = ''").drop("error"), marked.where("error <> ''")


def job_counts(frames: Mapping[str, DataFrame]) -> DataFrame:
    """Row count of each named frame."""
    counted = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows")
        for name, df in frames.items()
    ]
    return reduce(DataFrame.unionByName, counted)


def training_view(df: DataFrame, drop: Sequence[str], label: str, as_name: str = "labels") -> DataFrame:
    return df.drop(*drop).withColumnRenamed(label, as_name)

"""Expiring key-value rows and the plug for a store."""

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions.codec import join_list

BATCH = 1000
WEEK_SECONDS = 7 * 24 * 3600
DAY_AND_A_HALF = 36 * 3600


def kv_rows(
    lists: DataFrame, key: Column, now: Column, ttl_seconds: int, keep: Sequence[str] = ()
) -> DataFrame:
    """``key, value, expire_at`` from neighbour lists; empty lists are not published."""
    return lists.where(F.size("neighbours") > 0).select(
        *keep,
        key.alias("key"),
        join_list(F.col("neighbours")).alias("value"),
        expiry(now, ttl_seconds).alias("expire_at"),
    )


def expiry(now: Column, ttl_seconds: int) -> Column:
    return F.timestamp_seconds(F.unix_timestamp(now) + ttl_seconds)


def one_value_per_key(rows: DataFrame, order: str) -> DataFrame:
    """Of several rows with one key, the one with the greatest ``order`` wins."""
    others = [c for c in rows.columns if c != "key"]
    picked = F.max_by(F.struct(*others), order).alias("_row")
    return rows.groupBy("key").agg(picked).select("key", "_row.*")


def kv_copy(rows: DataFrame, now: Column, ttl_seconds: int = WEEK_SECONDS) -> DataFrame:
    """A key-value namespace with a new expiry; missing keys and values are skipped."""
    return rows.where(F.col("key").isNotNull() & F.col("value").isNotNull()).select(
        "key", "value", expiry(now, ttl_seconds).alias("expire_at")
    )


Batch = list[tuple[str, str, object]]


def write_kv(
    rows: DataFrame,
    connect: Callable[[], Callable[[Batch], None]],
    batch: int = BATCH,
    order: str = "value",
) -> None:
    """Send one ``(key, value, expire_at)`` per key to a store in batches.

    Of rows with one key the one with the greatest ``order`` is sent, so that every run publishes
    the same. ``connect`` runs once per task and returns the function that stores a batch. Setting a key is
    idempotent, so a retried task does no harm.
    """

    def send(partition: Iterator) -> None:
        store = None
        pending: Batch = []
        for row in partition:
            pending.append((row["key"], row["value"], row["expire_at"]))
            if len(pending) >= batch:
                store = store or connect()
                store(pending)
                pending = []
        if pending:
            (store or connect())(pending)

    columns = list(dict.fromkeys(["key", "value", "expire_at", order]))
    single = one_value_per_key(rows.select(*columns), order)
    single.select("key", "value", "expire_at").foreachPartition(send)

"""Merging neighbour lists and embedding tables."""

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_neighbours(
    first: DataFrame, second: DataFrame | tuple[DataFrame, DataFrame], keys: Sequence[str]
) -> DataFrame:
    """Lists of ``first``, then what ``second`` adds; a key of either side is kept, NULL is a key.

    ``second`` may be the pair of rows and lists of a search that is ``apart``. Then keys meet while rows
    are narrow, and the long lists, of which many rows may share one, are neither shuffled nor sorted by
    key. A key without neighbours on either side is no row then.
    """
    none = F.array().cast("array<string>")
    late = None
    if isinstance(second, tuple):
        second, late = second
    given = [c for c in second.columns if c not in keys]
    a = first.select(*[F.col(k).alias(f"_a_{k}") for k in keys], F.col("neighbours").alias("_a"))
    b = second.select(*[F.col(k).alias(f"_b_{k}") for k in keys], *(given if late else [F.col("neighbours").alias("_b")]))
    same = reduce(and_, [F.col(f"_a_{k}").eqNullSafe(F.col(f"_b_{k}")) for k in keys])
    met = a.join(b, same, "full_outer")
    if late:
        on = reduce(and_, [F.col(c) == F.col(c.replace("_on_", "_of_", 1)) for c in given if c != "_item"])
        others = F.slice(F.filter("_ids", lambda e: e["item"] != F.col("_item")), 1, F.coalesce("_cap", F.lit(1)))
        met = met.join(late, on, "left").withColumn("_b", F.transform(others, lambda e: e["id"]))
    added = F.coalesce("_b", none)
    both = F.when(F.size("_a") > 0, F.array_distinct(F.concat("_a", added))).otherwise(F.array_distinct(added))
    merged = met.select(
        *[F.coalesce(f"_a_{k}", f"_b_{k}").alias(k) for k in keys], both.alias("neighbours")
    )
    return merged.where(F.size("neighbours") > 0) if late else merged


def one_row_per_key(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The latest row of each key."""
    others = [c for c in df.columns if c != key]
    picked = F.max_by(F.struct(*others), F.struct(*order)).alias("_row")
    return df.groupBy(key).agg(picked).select(key, "_row.*")


def _distinct_columns(tables: Sequence[DataFrame], key: str) -> list[list[str]]:
    columns = [[c for c in t.columns if c != key] for t in tables]
    named = [c for own in columns for c in own]
    if len(set(named)) < len(named):
        raise ValueError(f"tables to be merged share columns: {named}")
    return columns


def _stamped(wide: DataFrame, stamp: str | None) -> DataFrame:
    wide = wide.fillna("")
    return wide if stamp is None else wide.withColumn("modifydate", F.lit(stamp))


def merge_modalities(tables: Sequence[DataFrame], key: str, stamp: str | None = None) -> DataFrame:
    """Full outer merge of embedding tables; gaps become ''.

    One aggregation by key, so every table is shuffled once, however many there are. Of a table's
    rows with one key the greatest counts; rows without key make one row without key.
    """
    columns = _distinct_columns(tables, key)
    parts = []
    for n, table in enumerate(tables):
        rows = [
            F.struct(*own).alias(f"_t{m}") if m == n else F.lit(None).alias(f"_t{m}")
            for m, own in enumerate(columns)
        ]
        parts.append(table.select(key, *rows))
    stacked = reduce(DataFrame.unionByName, parts)
    greatest = [F.max(f"_t{n}").alias(f"_t{n}") for n in range(len(tables))]
    merged = stacked.groupBy(key).agg(*greatest)
    flat = [F.col(f"_t{n}.`{c}`") for n, own in enumerate(columns) for c in own]
    return _stamped(merged.select(key, *flat), stamp)


def merge_bucketed(tables: Sequence[DataFrame], key: str, stamp: str | None = None) -> DataFrame:
    """As :func:`merge_modalities`, of tables bucketed by ``key`` that hold one row per key.

    An outer join forgets how its rows lie, so a chain of them would shuffle. Here the keys that a
    table is the first to hold come from anti joins, and the tables after it are added by left joins,
    both of which read bucket by bucket: nothing is shuffled.
    """
    _distinct_columns(tables, key)
    parts = []
    for n, table in enumerate(tables):
        rows = table
        for earlier in tables[:n]:
            rows = rows.join(earlier.select(key), key, "left_anti")
        for later in tables[n + 1 :]:
            rows = rows.join(later, key, "left")
        parts.append(rows)
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return _stamped(union, stamp)


def new_items(items: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Items without a row in ``known``."""
    return items.join(known.select(key), key, "left_anti")


def append_embeddings(
    old: DataFrame, new: DataFrame, day: str, stamp: str = "all"
) -> DataFrame:
    """Old rows and new rows; ``stamp`` puts the day on ``all`` rows or only on ``new`` ones."""
    if stamp not in ("all", "new"):
        raise ValueError(f"stamp must be 'all' or 'new', not {stamp!r}")
    fresh = new.withColumn("modifydate", F.lit(day))
    merged = old.unionByName(fresh, allowMissingColumns=True)
    if stamp == "all":
        merged = merged.withColumn("modifydate", F.lit(day))
    return merged.fillna("")

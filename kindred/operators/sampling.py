"""Training sets: class weights, weighted draws, positive and negative pairs, shuffles, batches."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions.hashing import hash_int, hash_unit
from kindred.operators.ranking import BUCKET_ROWS, blocked_index, shuffled_index
from kindred.session import broadcast_if_small, materialize, never_broadcast

NEGATIVE_DRAWS = 3


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Each row with its class frequency and the inverse of it as sample weight."""
    counts = broadcast_if_small(df.groupBy(label).agg(F.count(F.lit(1)).alias("class_count")))
    return df.join(counts, df[label].eqNullSafe(counts[label])).drop(counts[label]).withColumn(
        "weight", F.lit(1.0) / F.col("class_count")
    )


def weighted_sample(
    df: DataFrame, row_id: str, label: str, seed: str, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """As many draws with replacement as there are rows, each row weighing 1 / its class count.

    Every class then has the same mass: a draw picks a class, then a row of that class. Rows without
    label are a class.
    Returns ``draw_id`` and the drawn row's id and label.
    """
    rows = df.select(row_id, label).withColumn("_unit", hash_unit(seed + ":order", F.col(row_id)))
    rows = shuffled_index(rows, "_unit", row_id, [label], bucket_rows=bucket_rows)
    classes = df.groupBy(label).agg(F.count(F.lit(1)).alias("class_rows"))
    numbered = shuffled_index(
        classes.withColumn("_unit", hash_unit(seed + ":class", F.col(label))), "_unit", label
    )
    class_count = classes.agg(F.count(F.lit(1))).scalar()
    draws = df.select(
        F.col(row_id).alias("draw_id"),
        F.pmod(hash_int(seed + ":pick", F.col(row_id)), class_count).alias("class_idx"),
    )
    chosen = draws.join(
        numbered.select(
            F.col("idx").alias("class_idx"), F.col(label).alias("_class"), "class_rows"
        ),
        "class_idx",
    ).withColumn("_idx", F.pmod(hash_int(seed + ":row", F.col("draw_id")), F.col("class_rows")))
    drawn = F.col("_class").eqNullSafe(F.col(label)) & (F.col("_idx") == F.col("idx"))
    return chosen.join(rows.select(label, "idx", row_id), drawn).select("draw_id", row_id, label)


def _rules(lv1: str, lv2: str, tag: str, name: str) -> dict[str, tuple]:
    """Kinds of pairs: (group to draw from, block left out, candidates that must exist)."""
    return {
        "same lv1": (F.col(lv1), F.col(name), 1),
        "same lv2": (F.col(lv2), F.col(name), 1),
        "same tag": (F.col(tag), F.col(name), 3),
        "other tag": (F.col(lv2), F.col(tag), 1),
        "other lv2": (F.col(lv1), F.col(lv2), 1),
        "other lv1": (F.lit(""), F.col(lv1), 1),
    }


def _pair_kind(unit: Column, choice: Column, tag: Column) -> Column:
    """Which kind of pair a row asks for; NULL means it is paired with itself."""
    positive = (
        F.when(choice < 0.1, "same lv1")
        .when((choice < 0.2) | (tag == -1), "same lv2")
        .when(choice < 0.7, "same tag")
    )
    negative = (
        F.when((choice < 0.1) & (tag != -1), "other tag")
        .when(choice < 0.2, "other lv2")
        .when(choice < 0.7, "other lv1")
    )
    return F.when(unit > 0.5, positive).otherwise(negative)


def _any_other_title(index: DataFrame, left: DataFrame) -> DataFrame:
    """A candidate of another block and another title for rows whose draws all met their title.

    If such a candidate exists, the least or the greatest title outside the row's block is one.
    Outside one block, these are found in the two blocks that are first by that measure.
    """
    entry = F.struct("title", "block", "cand_id")
    per_block = index.groupBy("kind", "grp", "block").agg(
        F.min(entry).alias("least"), F.max(entry).alias("greatest")
    )
    group = Window.partitionBy("kind", "grp")
    ends = [
        per_block.withColumn("_n", F.row_number().over(group.orderBy(order))).select(
            "kind", "grp", F.lit(side).alias("side"), "_n", F.col(name).alias("cand")
        ).where("_n <= 2")
        for side, name, order in ((0, "least", F.asc("least")), (1, "greatest", F.desc("greatest")))
    ]
    return (
        never_broadcast(left).join(reduce(DataFrame.union, ends), ["kind", "grp"])
        .where((F.col("cand.block") != F.col("block")) & (F.col("cand.title") != F.col("title")))
        .groupBy("id")
        .agg(F.min_by("cand", F.struct("side", "_n")).alias("cand"))
        .select("id", F.col("cand.cand_id").alias("cand_id"), F.col("cand.title").alias("cand_title"))
    )


def mine_pairs(
    df: DataFrame,
    *,
    row_id: str,
    name: str,
    title: str,
    lv1: str,
    lv2: str,
    tag: str,
    seed: str,
    allow_self: bool = True,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """One pair per row: ``id, query, title, label, kind, cand_id``.

    About half the rows ask for a positive partner (same category or tag, another name), the rest
    for a negative one (another tag, lv2 or lv1, another title). Partners are drawn uniformly from
    the allowed rows. A row without a partner is paired with itself, label 1.
    """
    rules = _rules(lv1, lv2, tag, name)
    asked = df.select(
        F.col(row_id).alias("id"),
        F.col(title).alias("query"),
        _pair_kind(
            hash_unit(seed + ":side", F.col(row_id)),
            hash_unit(seed + ":rule", F.col(row_id)),
            F.col(tag),
        ).alias("kind"),
    )
    memberships = F.array(
        *[
            F.struct(
                F.lit(kind).alias("kind"),
                F.coalesce(group.cast("string"), F.lit("")).alias("grp"),
                F.coalesce(block.cast("string"), F.lit("")).alias("block"),
                F.lit(least).alias("least"),
            )
            for kind, (group, block, least) in rules.items()
        ]
    )
    members = df.select(
        F.col(row_id).alias("cand_id"),
        F.col(title).alias("title"),
        hash_unit(seed + ":order", F.col(row_id)).alias("_unit"),
        F.explode(memberships).alias("_m"),
    ).select("cand_id", "title", "_unit", "_m.*")
    index = materialize(
        blocked_index(members, ["kind", "grp"], "block", "_unit", "cand_id", bucket_rows).drop("_unit"),
        "pair-index",
    )

    # The row's own place in the group it draws from.
    own = index.withColumnRenamed("cand_id", "id").join(
        never_broadcast(asked.select("id", "kind")), ["id", "kind"], "left_semi"
    )
    allowed = F.col("group_rows") - F.col("block_rows")
    own = own.where(allowed >= F.col("least")).select(
        "id", "kind", "grp", "block", "title", "block_start", "block_rows", allowed.alias("allowed")
    )
    is_negative = F.col("kind").startswith("other")
    positions = F.array(
        *[
            F.pmod(hash_int(f"{seed}:draw{n}", F.col("id")), F.greatest("allowed", F.lit(1)))
            for n in range(NEGATIVE_DRAWS)
        ]
    )
    draws = own.withColumn(
        "_draws", F.when(is_negative, positions).otherwise(F.slice(positions, 1, 1))
    ).select("*", F.posexplode("_draws").alias("attempt", "_j"))
    # Step over the row's own block.
    target = F.col("_j") + F.when(F.col("_j") >= F.col("block_start"), F.col("block_rows")).otherwise(0)
    drawn = never_broadcast(draws.withColumn("idx", target)).join(
        index.select("kind", "grp", "idx", "cand_id", F.col("title").alias("cand_title")),
        ["kind", "grp", "idx"],
    )
    picked = (
        drawn.where(~is_negative | (F.col("cand_title") != F.col("title")))
        .groupBy("id")
        .agg(F.min_by(F.struct("cand_id", "cand_title"), "attempt").alias("_c"))
        .select("id", "_c.*")
    )
    picked = materialize(picked, "drawn-pairs")
    unlucky = own.where(is_negative).join(never_broadcast(picked.select("id")), "id", "left_anti")
    negatives = index.where(is_negative)
    picked = picked.unionByName(_any_other_title(negatives, unlucky))

    paired = asked.join(never_broadcast(picked), "id", "left" if allow_self else "inner")
    found = F.col("cand_id").isNotNull()
    return paired.select(
        "id",
        "query",
        F.coalesce("cand_title", "query").alias("title"),
        F.when(found & is_negative, 0).otherwise(1).alias("label"),
        F.when(found, F.col("kind")).otherwise("self").alias("kind"),
        "cand_id",
    )


def shuffle_rows(df: DataFrame, row_id: str, seed: str) -> DataFrame:
    """All rows in a seeded random order (a distributed sort)."""
    unit = hash_unit(seed, F.col(row_id))
    return df.withColumn("_unit", unit).orderBy("_unit", row_id).drop("_unit")


def shuffled_positions(
    df: DataFrame, row_id: str, seed: str, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """The place of each row in :func:`shuffle_rows`' order, as ``position`` from 0."""
    marked = df.withColumn("_unit", hash_unit(seed, F.col(row_id)))
    indexed = shuffled_index(marked, "_unit", row_id, bucket_rows=bucket_rows)
    return indexed.withColumnRenamed("idx", "position").drop("_unit")


def batch_rows(
    df: DataFrame,
    row_id: str,
    seed: str,
    batch_size: int,
    drop_last: bool = True,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Shuffled rows in batches: ``batch_id`` and ``slot``; an incomplete last batch is dropped."""
    placed = shuffled_positions(df, row_id, seed, bucket_rows)
    batch = F.floor(F.col("position") / F.lit(batch_size))
    numbered = placed.withColumn("batch_id", batch).withColumn(
        "slot", F.pmod(F.col("position"), F.lit(batch_size))
    )
    if drop_last:
        numbered = numbered.where(
            F.col("batch_id") < F.floor(F.col("group_rows") / F.lit(batch_size))
        )
    return numbered.drop("position", "group_rows")

"""Fixed-length token records from a word vocabulary."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions.text import words
from kindred.session import broadcast_if_small, materialize

PAD_ID = 0
UNKNOWN_ID = 1
FIRST_WORD_ID = 2
IN_PARTITION = (1 << 33) - 1  # bits of a row's place within its partition


def build_vocabulary(df: DataFrame, texts: list[Column], size: int | None = None) -> DataFrame:
    """All words, or the ``size`` most frequent, with their ids; ties go to the lesser word.

    Words are sorted by ranges and numbered in each; only the row counts of ranges are added up.
    """
    tokens = df.select(F.explode(F.concat(*[words(t) for t in texts])).alias("word"))
    counts = tokens.groupBy("word").agg(F.count(F.lit(1)).alias("uses"))
    ordered = counts.orderBy(F.desc("uses"), "word")
    if size is not None:
        ordered = ordered.limit(size)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit(IN_PARTITION))
    placed = materialize(
        ordered.withColumns({"_part": F.spark_partition_id(), "_place": place}), "vocabulary"
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    starts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    starts = starts.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    token_id = F.col("_start") + F.col("_place") + FIRST_WORD_ID
    return placed.join(broadcast_if_small(starts), "_part").select(
        "word", "uses", token_id.cast("int").alias("token_id")
    )


def tokenize_pad(
    df: DataFrame, row_id: str, texts: dict[str, Column], vocabulary: DataFrame, length: int
) -> DataFrame:
    """Per row and text column a struct of ``input_ids``, ``token_type_ids``, ``attention_mask``.

    ``texts`` maps output names to text expressions. Each array has exactly ``length`` entries.
    A small vocabulary is broadcast, a larger one joined by word.
    """
    sides = F.array(
        *[
            F.struct(
                F.lit(name).alias("side"),
                F.slice(words(F.coalesce(text, F.lit(""))), 1, length).alias("words"),
            )
            for name, text in texts.items()
        ]
    )
    tokens = (
        df.select(F.col(row_id), F.explode(sides).alias("_s"))
        .select(row_id, "_s.side", F.posexplode_outer("_s.words").alias("pos", "word"))
        .join(broadcast_if_small(vocabulary.select("word", "token_id")), "word", "left")
    )
    token = F.struct("pos", F.coalesce("token_id", F.lit(UNKNOWN_ID)).alias("token_id"))
    found = F.when(F.col("word").isNotNull(), token)

    def padded(name: str) -> Column:
        listed = F.transform(F.array_sort(F.col("_" + name)), lambda t: t["token_id"])
        used = F.size(listed)
        ids = F.slice(F.concat(listed, F.array_repeat(F.lit(PAD_ID), length)), 1, length)
        mask = F.concat(
            F.array_repeat(F.lit(1), used), F.array_repeat(F.lit(0), F.lit(length) - used)
        )
        return F.struct(
            ids.alias("input_ids"),
            F.array_repeat(F.lit(0), length).alias("token_type_ids"),
            mask.alias("attention_mask"),
        ).alias(name)

    lists = [
        F.collect_list(F.when(F.col("side") == name, found)).alias("_" + name) for name in texts
    ]
    grouped = tokens.groupBy(row_id).agg(*lists)
    return grouped.select(row_id, *[padded(name) for name in texts])

"""Line dedup against levelled sorted runs of line hashes, in SQL functions only.

Documents are taken in batches, those of greater ids first. A run holds line hashes, each once, with
the document that keeps the line, in order of the hash. A batch's hashes are merged with the runs:
those that no run holds become a run of the batch, those that some run holds are only counted. When a
level has ``FAN_OUT`` runs they are merged into one run of the next level. A line that enough
documents hold is dropped where its document is not the keeper.
"""

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.columns import text_hash
from kindred.llm.ordering import split_join
from kindred.session import materialize, scratch_path

BATCHES = 4
FAN_OUT = 2
LEAST_CHARS = 40
LEAST_DOCS = 5
BLANKS = " \t\n\x0b\x0c\r"  # fixed set: what is stripped from a line's ends
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HASH = ["h1", "h2"]  # 128 bits
SECOND_SEED = 13  # any constant that makes the second half differ


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def lines_of(text: Column) -> Column:
    """The lines of a text; a null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def long_lines(text: Column, least_chars: int) -> Column:
    """``h1, h2, place`` of every line whose key has enough characters."""
    lines = F.transform(
        lines_of(text), lambda line, i: F.struct(line_key(line).alias("key"), i.alias("place"))
    )
    return F.transform(
        F.filter(lines, lambda e: F.char_length(e["key"]) >= least_chars),
        lambda e: F.struct(
            F.xxhash64(e["key"]).alias("h1"),
            F.xxhash64(F.lit(SECOND_SEED), e["key"]).alias("h2"),
            e["place"].alias("place"),
        ),
    )


class LineRuns:
    """Sorted runs in levels, and the counts of hashes that a run already held when they came.

    Runs are tables bucketed and sorted by hash, so a batch is dealt out once and merged with each of
    them where it lies. Every batch must hold lesser documents than those before it.
    """

    def __init__(self, spark: SparkSession, fan_out: int = FAN_OUT):
        self.spark = spark
        self.fan_out = fan_out
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.repeats: list[DataFrame] = []
        self.written: list[str] = []

    def add(self, lines: DataFrame) -> None:
        """Take in a batch of lines ``h1, h2, doc``."""
        batch = (
            lines.groupBy(*HASH, "doc").agg(F.count(F.lit(1)).alias("rows"))
            .groupBy(*HASH)
            .agg(F.count(F.lit(1)).alias("n"), F.sum("rows").alias("rows"), F.max("doc").alias("keeper"))
        )
        known = [name for level in self.levels for name in level]
        if known:
            held = F.lit(False)
            for i, name in enumerate(known):
                run = self.spark.table(name).select(*HASH, F.lit(True).alias(f"in_{i}"))
                batch = batch.join(run.hint("merge"), HASH, "left")
                held = held | F.col(f"in_{i}").isNotNull()
            batch = materialize(batch.select(*HASH, "n", "rows", "keeper", held.alias("held")), "line-batch")
            self.repeats.append(batch.where("held").select(*HASH, "n", "rows"))
            batch = batch.where("not held").drop("held")
        self._put(0, batch)

    def _put(self, level: int, rows: DataFrame) -> None:
        """Write a run of a level; a full level is merged into one run of the next."""
        if len(self.levels) == level:
            self.levels.append([])
        self.levels[level].append(self._write(rows))
        if len(self.levels[level]) == self.fan_out:
            full, self.levels[level] = self.levels[level], []
            self._put(level + 1, _union([self.spark.table(name) for name in full]))
            self._drop(full)

    def _write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        dealt = rows.repartition(self.buckets, *HASH).write.bucketBy(self.buckets, *HASH).sortBy(*HASH)
        dealt.option("path", scratch_path(self.spark, "line-run")).saveAsTable(name)
        self.written.append(name)
        return name

    def _drop(self, names: Sequence[str]) -> None:
        for name in names:
            self.spark.sql(f"drop table {name}")
            self.written.remove(name)

    def close(self) -> None:
        self._drop(list(self.written))

    def frequent(self, least: int) -> DataFrame:
        """``h1, h2, keeper, n, rows`` of the hashes that at least ``least`` documents hold."""
        found = []
        more = None
        if self.repeats:
            more = _union(self.repeats).groupBy(*HASH).agg(
                F.sum("n").alias("more"), F.sum("rows").alias("more_rows")
            )
        for name in [name for level in self.levels for name in level]:
            run = self.spark.table(name)
            if more is not None:
                run = run.join(more, HASH, "left").select(
                    *HASH,
                    "keeper",
                    (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"),
                    (F.col("rows") + F.coalesce("more_rows", F.lit(0))).alias("rows"),
                )
            found.append(run.where(F.col("n") >= least))
        return _union(found)


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    whole = frames[0]
    for f in frames[1:]:
        whole = whole.unionByName(f)
    return whole


def batch_number(docs: DataFrame, key: str, batches: int) -> Column:
    """0 for the greatest keys, up to ``batches - 1`` for the least and for null."""
    shares = [1 - (i + 1) / batches for i in range(batches - 1)]
    cuts = docs.agg(F.percentile_approx(F.col(f"`{key}`"), shares, 10_000)).first()[0] if shares else None
    number = F.lit(batches - 1)
    for i, cut in reversed(list(enumerate(cuts or []))):
        number = F.when(F.col(f"`{key}`") >= F.lit(cut), F.lit(i)).otherwise(number)
    return number


def drop_lines(
    docs: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    least_chars: int = LEAST_CHARS,
    least_docs: int = LEAST_DOCS,
    batches: int = BATCHES,
    fan_out: int = FAN_OUT,
) -> DataFrame:
    """One row per row of ``docs``: ``key, n_lines, n_dropped, kept``, the text that is left.

    A line's key is the line without blanks at its ends, A-Z in lower case. Keys of at least
    ``least_chars`` code points that at least ``least_docs`` documents hold lose all their lines but
    those of the document with the greatest ``key``, which is a number. Rows of one ``key`` are one
    document, null being the least. A null or empty text is one empty line, repeated rows return
    each, texts of any length are read whole, an empty table gives no rows and other columns are left
    out.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "long-lines")
    docs.select(
        batch_number(docs, key, batches).alias("batch"),
        F.col(f"`{key}`").alias("doc"),
        text_hash(text).alias("text_hash"),
        F.inline(long_lines(F.col(f"`{text}`"), least_chars)),
    ).write.partitionBy("batch").parquet(path)
    kind = docs.select(F.col(f"`{key}`").alias("doc")).schema["doc"].dataType.simpleString()
    lines = spark.read.schema(
        f"doc {kind}, text_hash bigint, h1 bigint, h2 bigint, place int, batch int"
    ).parquet(path)
    runs = LineRuns(spark, fan_out)
    for batch in range(batches):
        runs.add(lines.where(F.col("batch") == batch).select(*HASH, "doc"))
    frequent = materialize(runs.frequent(least_docs), "frequent-lines")
    runs.close()
    held = split_join(lines, frequent, HASH, "rows", lines.count())
    dropped = (
        held.where(~F.col("doc").eqNullSafe(F.col("keeper")))
        .groupBy(F.col("doc").alias("of"), F.col("text_hash").alias("of_hash"))
        .agg(F.collect_set("place").alias("places"))
    )
    rows = docs.select(
        F.col(f"`{key}`").alias("doc"), F.col(f"`{text}`").alias("text"), text_hash(text).alias("text_hash")
    )
    own = F.col("doc").eqNullSafe(F.col("of")) & (F.col("text_hash") == F.col("of_hash"))
    split = lines_of(F.col("text"))
    # the lines enter a lambda as a variable, else the text would be split again for every line
    rest = F.element_at(
        F.transform(
            F.array(F.transform(split, lambda line: line)),
            lambda all_lines: F.array_join(
                F.transform(
                    F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), F.col("places")),
                    lambda i: F.get(all_lines, i),
                ),
                "\n",
            ),
        ),
        1,
    )
    return rows.join(dropped, own, "left").select(
        F.col("doc").alias(key),
        F.size(split).cast("long").alias("n_lines"),
        F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("places").isNull(), F.coalesce("text", F.lit(""))).otherwise(rest).alias("kept"),
    )

"""Typed table writes and stage-then-publish."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from kindred.operators.merge import one_row_per_key
from kindred.session import remove_scratch, scratch_path

FILE_ROWS = 1_000_000


def embedding_schema(key: str, *vectors: str, stamp: bool = True) -> StructType:
    """A non-null text key, text vectors and, unless told otherwise, the day stamp."""
    names = (*vectors, "modifydate") if stamp else vectors
    optional = [StructField(c, StringType(), True) for c in names]
    return StructType([StructField(key, StringType(), False), *optional])


def as_typed(df: DataFrame, schema: StructType) -> DataFrame:
    """Columns of the schema, cast; a row without a required value stops the job.

    Part such rows off first with :func:`without_required` where they are to be expected.
    """

    def typed(f: StructField):
        value = F.col(f.name).cast(f.dataType)
        if not f.nullable:
            value = F.coalesce(value, F.raise_error(F.lit(f"a row has no {f.name}")).cast(f.dataType))
        return value.alias(f.name)

    return df.select(*[typed(f) for f in schema.fields])


def without_required(df: DataFrame, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """The rows that have all required values, and those that don't."""
    odd = F.lit(False)
    for f in schema.fields:
        if not f.nullable:
            odd = odd | F.col(f.name).cast(f.dataType).isNull()
    return df.where(~odd), df.where(odd)


def write_table(
    df: DataFrame,
    name: str,
    schema: StructType,
    path: str | None = None,
    partitions: int | None = None,
) -> None:
    """Overwrite a managed table (or one at ``path``).

    Without ``partitions`` adaptive execution picks the number of files; ``FILE_ROWS`` bounds each.
    """
    typed = as_typed(df, schema)
    typed = typed.repartition(partitions) if partitions else typed
    writer = typed.write.mode("overwrite").option("maxRecordsPerFile", FILE_ROWS)
    (writer.option("path", path) if path else writer).saveAsTable(name)


def stage_and_publish(
    df: DataFrame, name: str, schema: StructType, partitions: int | None = None
) -> None:
    """Write the rows to a staging folder, then overwrite table ``name`` from there.

    The job may read ``name`` itself: its old files are not touched until the new rows are whole.
    The staging folder is removed once they are published.
    """
    spark: SparkSession = df.sparkSession
    staging = scratch_path(spark, "staging")
    typed = as_typed(df, schema)
    typed = typed.repartition(partitions) if partitions else typed
    typed.write.option("maxRecordsPerFile", FILE_ROWS).parquet(staging)
    staged = spark.read.schema(schema).parquet(staging)
    staged.select(*spark.table(name).columns).write.insertInto(name, overwrite=True)
    remove_scratch(spark, staging)


def write_bucketed(
    df: DataFrame, name: str, schema: StructType, key: str, buckets: int, path: str | None = None
) -> None:
    """Overwrite a table that is bucketed and sorted by ``key``, one row per key.

    Of rows with one key the greatest stays. One shuffle serves this and the buckets, so each bucket
    is one file and tables with equal ``buckets`` join without a shuffle.
    """
    others = [f.name for f in schema.fields if f.name != key]
    single = one_row_per_key(as_typed(df, schema).repartition(buckets, key), key, others)
    writer = single.select(*schema.fieldNames()).write.mode("overwrite")
    writer = writer.bucketBy(buckets, key).sortBy(key)
    (writer.option("path", path) if path else writer).saveAsTable(name)

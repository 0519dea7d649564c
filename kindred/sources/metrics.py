"""Append-only training log."""

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "run string, name string, step bigint, value double"


def append_metrics(rows: DataFrame, path: str) -> None:
    rows.select("run", "name", "step", "value").write.mode("append").parquet(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)

"""Classifier metrics and training logs."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.operators.ranking import BUCKET_ROWS, running_sums


def accuracy(df: DataFrame, predicted: Column, label: Column, by: Sequence[str] = ()) -> DataFrame:
    hit = (predicted == label).cast("double")
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.avg(hit).alias("accuracy"))


def micro_f1(df: DataFrame, predicted: Column, label: Column, by: Sequence[str] = ()) -> DataFrame:
    """Counts over all classes: a wrong row is one false positive and one false negative."""
    hit = F.coalesce(predicted == label, F.lit(False))
    tp = F.sum(F.when(hit, 1).otherwise(0))
    fp = F.sum(F.when(~hit & predicted.isNotNull(), 1).otherwise(0))
    fn = F.sum(F.when(~hit & label.isNotNull(), 1).otherwise(0))
    counted = df.groupBy(*by).agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    f1 = F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return counted.withColumn("micro_f1", f1)


def precision_recall_at_1(df: DataFrame, top1: Column, labels: Column) -> DataFrame:
    """Rows, hits over rows and hits over all true labels; ``labels`` is an array."""
    hits = F.sum(F.when(F.array_contains(labels, top1), 1).otherwise(0))
    rows = F.count(F.lit(1))
    return df.agg(
        rows.alias("rows"),
        F.try_divide(hits.cast("double"), rows).alias("precision_at_1"),
        F.try_divide(hits.cast("double"), F.sum(F.size(labels))).alias("recall_at_1"),
    )


def mean_loss(df: DataFrame, by: Sequence[str], loss: Column) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(loss).alias("mean_loss"), F.count(F.lit(1)).alias("rows"))


def running_mean(
    df: DataFrame,
    groups: Sequence[str],
    step: str,
    value: Column,
    name: str,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Mean from the group's first step up to each row."""
    sums = running_sums(
        df,
        groups,
        step,
        {"_sum": value.cast("double"), "_n": F.when(value.isNotNull(), 1).otherwise(0)},
        bucket_rows=bucket_rows,
    )
    return sums.withColumn(name, F.try_divide("_sum", "_n")).drop("_sum", "_n")


def metric_rows(df: DataFrame, run: Column, step: Column, metrics: dict[str, Column]) -> DataFrame:
    """``run, name, step, value``: one row per metric and step."""
    entries = F.array(
        *[F.struct(F.lit(n).alias("name"), v.cast("double").alias("value")) for n, v in metrics.items()]
    )
    return df.select(run.alias("run"), step.alias("step"), F.explode(entries).alias("_m")).select(
        "run", "_m.name", "step", "_m.value"
    )

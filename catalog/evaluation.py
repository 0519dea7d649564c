"""Training logs on the events: a run per event type, a step per event."""

from pyspark.sql import functions as F

from catalog.base import query, r5, r5_sql, table
from kindred.operators import evaluate as E
from kindred.session import scratch_path
from kindred.sources.metrics import append_metrics, read_metrics

CORRECT = "case when value > 100 then 1.0::DOUBLE else 0.0::DOUBLE end"


def correct():
    return (F.col("value") > 100).cast("double")


@query(
    "metric_log",
    f"""select event_type as run, 'loss' as name, event_id as step, {r5_sql('value')} as value
    from events union all
    select event_type, 'correct', event_id, {CORRECT} from events""",
)
def metric_log(spark, folder):
    events = table(spark, folder, "events")
    path = scratch_path(spark, "metrics")
    for metrics in ({"loss": F.col("value")}, {"correct": correct()}):
        append_metrics(E.metric_rows(events, F.col("event_type"), F.col("event_id"), metrics), path)
    return read_metrics(spark, path).withColumn("value", r5("value"))


@query(
    "running_accuracy",
    f"""select event_type as run, event_id as step, {r5_sql(f'''avg({CORRECT}) over (
      partition by event_type order by event_id
      rows between unbounded preceding and current row)''')} as accuracy from events""",
)
def running_accuracy(spark, folder):
    steps = table(spark, folder, "events").select(
        F.col("event_type").alias("run"), F.col("event_id").alias("step"), "value"
    )
    running = E.running_mean(steps, ["run"], "step", correct(), "accuracy")
    return running.select("run", "step", r5("accuracy").alias("accuracy"))


EPOCH = "cast(substr(cast(ts as varchar), 9, 2) as integer)"


@query(
    "running_loss",
    f"""select event_type as run, {EPOCH} as epoch, event_id as step, {r5_sql(f'''avg(value) over (
      partition by event_type, {EPOCH} order by event_id
      rows between unbounded preceding and current row)''')} as loss from events""",
)
def running_loss(spark, folder):
    steps = table(spark, folder, "events").select(
        F.col("event_type").alias("run"),
        F.dayofmonth("ts").alias("epoch"),
        F.col("event_id").alias("step"),
        "value",
    )
    running = E.running_mean(steps, ["run", "epoch"], "step", F.col("value"), "loss")
    return running.select("run", "epoch", "step", r5("loss").alias("loss"))


@query(
    "epoch_loss",
    f"""select event_type as run, {EPOCH} as epoch, {r5_sql('avg(value)')} as mean_loss,
      count(*) as "rows" from events group by event_type, {EPOCH}""",
)
def epoch_loss(spark, folder):
    steps = table(spark, folder, "events").select(
        F.col("event_type").alias("run"), F.dayofmonth("ts").alias("epoch"), "value"
    )
    losses = E.mean_loss(steps, ["run", "epoch"], F.col("value"))
    return losses.withColumn("mean_loss", r5("mean_loss"))

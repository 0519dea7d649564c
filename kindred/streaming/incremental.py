"""The incremental embedding job over files as they arrive."""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def publish_arrivals(
    arrivals: DataFrame, publish: Callable[[DataFrame], None], checkpoint: str
) -> StreamingQuery:
    """Hand all arrived items, batch by batch, to ``publish`` and stop.

    ``publish`` is the batch job. It embeds only items the table lacks, so a batch that runs twice
    after a failure adds nothing.
    """
    return (
        arrivals.writeStream.foreachBatch(lambda batch, _: publish(batch))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )

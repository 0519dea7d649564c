"""Session helpers."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: the cluster's ``spark.checkpoint.dir``.

    Only a local session without the setting gets a temporary folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_folders:
        _local_folders[app] = tempfile.mkdtemp(prefix="kindred-")
    return _local_folders[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def remove_scratch(spark: SparkSession, path: str) -> None:
    """Remove a path that :func:`scratch_path` gave and nothing reads any more."""
    if not path.startswith(shared_folder(spark) + "/"):
        raise ValueError(f"{path} is no scratch path")
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write rows that several later steps read to the shared folder, and read them from there.

    The steps then scan columns of a table instead of repeating the joins behind it, and a lost
    executor costs nothing that was already written.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


BROADCAST_ROWS = 200_000


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a narrow, aggregated table for broadcast once its size is checked.

    A larger one is left to a shuffled join. The check runs the table, so it must be cheap to make.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def never_broadcast(df: DataFrame) -> DataFrame:
    """Mark rows that grow with the input, so that a join with them is a shuffled one.

    Spark guesses the size of a table by its files and takes no account of exploded rows: a few MB of
    well compressed files may be millions of rows, which the driver would have to hold.
    """
    return df.hint("merge")

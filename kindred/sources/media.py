"""Planning and running media downloads."""

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions.keys import media_path

THREADS = 20


def fetch_manifest(wanted: DataFrame, existing: DataFrame, root: str) -> DataFrame:
    """Media still to fetch: ``item, n, url, path``, without paths already in ``existing``."""
    path = media_path(root, F.col("item"), F.col("n"))
    planned = wanted.where(F.col("url").isNotNull()).select("item", "n", "url", path.alias("path"))
    return planned.join(existing.select("path").distinct(), "path", "left_anti")


def fetch(
    manifest: DataFrame,
    connect: Callable[[], Callable[[str], tuple[int, bytes]]],
    partitions: int | None = None,
    threads: int = THREADS,
) -> DataFrame:
    """Fetch each address: ``path, status, content, error``.

    ``connect`` runs once per task and returns a function from address to status and body. Only a
    2xx body is content; a failure becomes a row with its error, and the job goes on.
    """

    def attempt(get, url: str):
        try:
            status, body = get(url)
        except Exception as e:  # noqa: BLE001 - a fetcher may raise anything
            return None, None, f"{type(e).__name__}: {e}"
        ok = 200 <= status < 300
        return status, body if ok else None, None if ok else f"status {status}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = connect()
        with ThreadPoolExecutor(threads) as pool:
            for batch in batches:
                done = list(pool.map(lambda u: attempt(get, u), batch["url"]))
                yield pd.DataFrame(
                    {
                        "path": batch["path"],
                        "status": pd.array([d[0] for d in done], dtype="Int64"),
                        "content": [d[1] for d in done],
                        "error": [d[2] for d in done],
                    }
                )

    spread = manifest.repartition(partitions, "path") if partitions else manifest
    return spread.select("path", "url").mapInPandas(
        run, "path string, status bigint, content binary, error string"
    )

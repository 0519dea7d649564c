"""Helpers shared by the operators: Arrow batches, spans and digests."""

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BATCH_BYTES = 8 << 20  # text handled at once inside a task


def per_text(
    df: DataFrame, text: str, keys: list[str], schema: StructType | str, fn: Callable[[bytes], tuple]
) -> DataFrame:
    """The ``keys`` of every row, and behind them what ``fn`` makes of its text (UTF-8; null: empty).

    ``schema`` is that of the keys and results together. Runs on Arrow batches of a few MB.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, len(keys)):
                texts = piece.column(len(keys)).cast(pa.binary()).to_pylist()
                rows = [fn(t or b"") for t in texts]
                columns = [piece.column(i) for i in range(len(keys))]
                columns += [
                    pa.array([r[i] for r in rows], type=target.field(len(keys) + i).type)
                    for i in range(len(target) - len(keys))
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=target)

    target = arrow_schema(df, schema)
    picked = df.select(*[f"`{k}`" for k in keys], f"`{text}`")
    return picked.mapInArrow(run, schema)


def fresh(name: str, df: DataFrame) -> str:
    """``name``, lengthened until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_hash(text: str) -> Column:
    """A hash that tells apart rows of one key; null is an empty text."""
    return F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit("")))


def rows_of(docs: DataFrame, kept: DataFrame, text: str, key: str) -> DataFrame:
    """The rows of ``docs`` whose key (null too) and text are those of ``key, text_hash`` in ``kept``."""
    own, digest = fresh("_kept_key", docs), fresh("_kept_hash", docs)
    wanted = kept.select(F.col(f"`{key}`").alias(own), F.col("text_hash").alias(digest))
    same = F.col(f"`{key}`").eqNullSafe(F.col(own)) & (text_hash(text) == F.col(digest))
    return docs.join(wanted, same, "left_semi")


def arrow_schema(df: DataFrame, schema: StructType | str) -> pa.Schema:
    """The Arrow form of a Spark schema, with the session's time zone left out of it."""
    from pyspark.sql.pandas.types import to_arrow_schema

    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    return to_arrow_schema(schema)


def slices(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part's texts stay within ``BATCH_BYTES``, or it is one row."""
    lengths = pa.compute.binary_length(batch.column(text)).to_pylist()
    start = held = 0
    for i, n in enumerate(lengths):
        if held and held + (n or 0) > BATCH_BYTES:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n or 0
    if start < len(lengths):
        yield batch.slice(start)


def span_text(spans: Iterable[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()

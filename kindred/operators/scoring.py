"""Scores of items against a class table (linear layer or class centres)."""

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ITEM_ROWS = 8192
CLASS_ROWS = 16384
CLASS_BYTES = 64 << 20  # a class table up to this size travels to every task
CELLS = 4_000_000  # scores held at a time


def _matrix(column: pa.ChunkedArray, rows: np.ndarray) -> np.ndarray:
    part = column.take(pa.array(rows)).combine_chunks()
    if len(np.unique(part.value_lengths())) > 1:
        raise ValueError("vectors of different lengths are scored together")
    flat = part.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(rows), -1)


def _unit_rows(matrix: np.ndarray) -> np.ndarray:
    length = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
    return matrix / np.where(length > 0, length, 1.0)[:, None]


def _check_dense(ids: np.ndarray) -> None:
    """Class ids stand for places in the array of scores, so none may be missing or repeated."""
    if len(ids) and not np.array_equal(ids, np.arange(ids[0], ids[0] + len(ids))):
        raise ValueError("class ids must count up without gaps; number them with dense_classes()")


def dense_classes(classes: DataFrame, class_id: str, name: str = "class_place") -> DataFrame:
    """``classes`` with a place from 0 without gaps, in order of ``class_id`` (text ids too).

    A class table is small beside the items; its ids are numbered by one sort.
    """
    return classes.withColumn(name, F.row_number().over(Window.orderBy(class_id)) - 1)


def _score_task(cosine: bool, names: Sequence[str]):
    """The function that scores one block of items against one chunk of classes."""

    def score(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        is_class = table.column("_is_class").to_numpy()
        class_ids = table.column("_class").to_numpy()
        class_rows = np.flatnonzero(is_class)
        class_rows = class_rows[np.argsort(class_ids[class_rows], kind="stable")]
        _check_dense(class_ids[class_rows])
        item_rows = np.flatnonzero(~is_class)
        taken = pa.array(item_rows)
        columns = {n: table.column(n).take(taken) for n in (*names, "_chunk", "_row")}
        if not len(item_rows) or not len(class_rows):
            empty = pa.array([[]] * len(item_rows), pa.list_(pa.float64()))
            return pa.table({**columns, "scores": empty})
        items = _matrix(table.column("_vec"), item_rows)
        classes = _matrix(table.column("_vec"), class_rows)
        if cosine:
            items, classes = _unit_rows(items), _unit_rows(classes)
        scores = items @ classes.T
        if not cosine:
            scores += table.column("_bias").to_numpy()[class_rows][None, :]
        width = len(class_rows)
        ends = pa.array(np.arange(0, (len(item_rows) + 1) * width, width, dtype=np.int32))
        lists = pa.ListArray.from_arrays(ends, pa.array(scores.ravel()))
        return pa.table({**columns, "scores": lists})

    return score


def _held_classes(
    classes: DataFrame,
    class_id: str,
    weights: str,
    bias: str | None,
    cosine: bool,
    class_bytes: int = CLASS_BYTES,
) -> tuple[np.ndarray, np.ndarray] | None:
    """Class matrix and biases in class order if they are within ``class_bytes``, else None."""
    table = classes.select(
        F.col(class_id).cast("bigint").alias("id"),
        F.col(weights).cast("array<double>").alias("vec"),
        (F.col(bias).cast("double") if bias else F.lit(0.0)).alias("bias"),
    )
    cells = table.agg(F.coalesce(F.sum(F.size("vec") + 2), F.lit(0))).first()[0]
    if 8 * cells > class_bytes:
        return None
    held = table.toArrow()
    ids = held["id"].to_numpy()
    order = np.argsort(ids, kind="stable")
    if len(order) and ids[order[0]] != 0:
        raise ValueError("class ids count from 0; number them with dense_classes()")
    _check_dense(ids[order])
    matrix = _matrix(held["vec"], order) if len(order) else np.zeros((0, 0))
    return (_unit_rows(matrix) if cosine else matrix), held["bias"].to_numpy()[order]


def _map_scores(items: DataFrame, names, vec: str, held, cosine: bool, fields, reduce) -> DataFrame:
    """Scores of each item made and, by ``reduce``, summed up where the item is read."""
    matrix, biases = held
    schema = T.StructType([T.StructField(n, items.schema[n].dataType) for n in names])
    for field in fields:
        schema.add(field)
    step = max(1, CELLS // max(1, len(matrix)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            rows = np.flatnonzero(np.asarray(table["_vec"].combine_chunks().is_valid()))
            for start in range(0, len(rows), step):
                some = rows[start : start + step]
                taken = pa.array(some)
                if len(matrix):
                    values = _matrix(table["_vec"], some)
                    scores = (_unit_rows(values) if cosine else values) @ matrix.T
                    if not cosine:
                        scores += biases[None, :]
                else:
                    scores = np.zeros((len(some), 0))
                own = [table[n].take(taken).combine_chunks() for n in names]
                columns = [c if isinstance(c, pa.Array) else c.chunk(0) for c in own]
                yield pa.RecordBatch.from_arrays(
                    [*columns, *reduce(scores)], names=[f.name for f in schema.fields]
                )

    picked = items.select(*names, F.col(vec).cast("array<double>").alias("_vec"))
    return picked.mapInArrow(run, schema)


def _all_scores(scores: np.ndarray) -> list[pa.Array]:
    width = scores.shape[1]
    ends = np.arange(0, (len(scores) + 1) * width, width) if width else np.zeros(len(scores) + 1)
    return [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(scores.ravel()))]


def _first_best(scores: np.ndarray) -> list[pa.Array]:
    best = scores.argmax(axis=1) if scores.shape[1] else np.zeros(0, np.int64)
    return [pa.array(best.astype(np.int32)), pa.array(scores[np.arange(len(best)), best])]


def best_class(
    items: DataFrame,
    classes: DataFrame,
    *,
    row_id: str,
    vec: str,
    class_id: str,
    weights: str,
    bias: str | None = None,
    carry: Sequence[str] = (),
    cosine: bool = False,
) -> DataFrame:
    """``class_id`` and ``score`` of each item's first best class; scores stay in the task.

    A class table beyond ``CLASS_BYTES`` is scored in chunks by :func:`class_scores`.
    """
    names = [row_id, *[c for c in carry if c != row_id]]
    held = _held_classes(classes, class_id, weights, bias, cosine)
    if held is None:
        scored = class_scores(
            items, classes, row_id=row_id, vec=vec, class_id=class_id, weights=weights, bias=bias,
            carry=carry, cosine=cosine,
        )
        best = (F.array_position("scores", F.array_max("scores")) - 1).cast("int")
        return scored.select(*names, best.alias("class_id"), F.array_max("scores").alias("score"))
    if not len(held[0]):
        items = items.limit(0)
    fields = [T.StructField("class_id", T.IntegerType()), T.StructField("score", T.DoubleType())]
    return _map_scores(items, names, vec, held, cosine, fields, _first_best)


def class_scores(
    items: DataFrame,
    classes: DataFrame,
    *,
    row_id: str,
    vec: str,
    class_id: str,
    weights: str,
    bias: str | None = None,
    carry: Sequence[str] = (),
    cosine: bool = False,
    item_rows: int = ITEM_ROWS,
    class_rows: int = CLASS_ROWS,
    class_bytes: int = CLASS_BYTES,
) -> DataFrame:
    """One row per item row with ``scores``, an array in class order; items without vector have none.

    ``class_id`` counts from 0 without gaps (see :func:`dense_classes`). A class table of at most
    ``class_bytes`` bytes goes to every task and the items are scored where they are read. Beyond
    that items are hashed into blocks and classes cut into chunks; a task multiplies one block by
    one chunk.
    """
    names = [row_id, *[c for c in carry if c != row_id]]
    if class_bytes:
        held = _held_classes(classes, class_id, weights, bias, cosine)
        if held is not None:
            fields = [T.StructField("scores", T.ArrayType(T.DoubleType()))]
            return _map_scores(items, names, vec, held, cosine, fields, _all_scores)
    blocks = items.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / F.lit(item_rows)))).scalar()
    chunk_of = F.floor(F.col(class_id) / F.lit(class_rows)).cast("int")
    chunks = classes.agg(F.max(chunk_of)).scalar()
    # rows are told apart by their place, as ids may repeat
    left = items.where(F.col(vec).isNotNull()).withColumn("_row", F.monotonically_increasing_id())
    left = left.select(
        *names,
        "_row",
        F.lit(False).alias("_is_class"),
        F.lit(-1).cast("bigint").alias("_class"),
        F.col(vec).cast("array<double>").alias("_vec"),
        F.lit(0.0).alias("_bias"),
        F.pmod(F.xxhash64("_row"), blocks.cast("bigint")).cast("int").alias("_block"),
        F.explode(F.sequence(F.lit(0), chunks)).alias("_chunk"),
    )
    kinds = {f.name: f.dataType for f in items.schema.fields}
    right = classes.select(
        *[F.lit(None).cast(kinds[n]).alias(n) for n in names],
        F.lit(None).cast("bigint").alias("_row"),
        F.lit(True).alias("_is_class"),
        F.col(class_id).cast("bigint").alias("_class"),
        F.col(weights).cast("array<double>").alias("_vec"),
        (F.col(bias).cast("double") if bias else F.lit(0.0)).alias("_bias"),
        F.explode(F.sequence(F.lit(0), blocks.cast("int") - 1)).alias("_block"),
        chunk_of.alias("_chunk"),
    )
    schema = T.StructType([T.StructField(n, kinds[n]) for n in names])
    schema.add("_chunk", T.IntegerType()).add("_row", T.LongType())
    schema.add("scores", T.ArrayType(T.DoubleType()))
    scored = (
        left.unionByName(right)
        .groupBy("_block", "_chunk")
        .applyInArrow(_score_task(cosine, names), schema)
    )
    pieces = F.array_sort(F.collect_list(F.struct("_chunk", "scores")))
    return (
        scored.groupBy(*names, "_row")
        .agg(pieces.alias("_pieces"))
        .select(*names, F.flatten(F.transform("_pieces", lambda p: p["scores"])).alias("scores"))
    )

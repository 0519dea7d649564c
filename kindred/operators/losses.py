"""Softmax losses of items against class tables of any size, several heads in one pass.

A task keeps of an item's scores only what a loss needs: the logarithm of their summed exponentials
and the score of the item's own class. Both merge over chunks of classes, so no array of scores leaves
a task.
"""

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.operators.scoring import (
    CELLS,
    CLASS_BYTES,
    CLASS_ROWS,
    ITEM_ROWS,
    _check_dense,
    _held_classes,
    _matrix,
    _unit_rows,
)
from kindred.session import materialize


@dataclass(frozen=True)
class Head:
    """A class table (ids from 0 without gaps) and the items' column with the true class.

    With ``margin`` the true class's score is a cosine to which the angular margin is added.
    """

    classes: DataFrame
    label: str
    class_id: str = "class_id"
    weights: str = "weights"
    bias: str | None = None
    cosine: bool = True
    scale: float = 64.0
    margin: float | None = 0.40
    easy_margin: bool = False


Rule = tuple[bool, float, float | None, bool]  # cosine, scale, margin, easy margin


def _rule(head: Head) -> Rule:
    return head.cosine, head.scale, head.margin, head.easy_margin


def _with_margin(c: np.ndarray, margin: float, easy: bool) -> np.ndarray:
    widened = c * math.cos(margin) - np.sqrt(np.maximum(0.0, 1.0 - c * c)) * math.sin(margin)
    if easy:
        return np.where(c > 0, widened, c)
    return np.where(c > math.cos(math.pi - margin), widened, c - math.sin(math.pi - margin) * margin)


def _states(
    items: np.ndarray, labels: np.ndarray, classes: np.ndarray, biases: np.ndarray, start: int, rule: Rule
) -> tuple[np.ndarray, np.ndarray]:
    """Each item's log of summed exponentials over the classes from ``start``, and its own score.

    The own score is NaN if the label is not among these classes.
    """
    cosine, scale, margin, easy = rule
    summed, own = np.full(len(items), -np.inf), np.full(len(items), np.nan)
    if not len(classes):
        return summed, own
    step = max(1, CELLS // len(classes))
    for first in range(0, len(items), step):
        some = slice(first, first + step)
        values = _unit_rows(items[some]) if cosine else items[some]
        scores = values @ classes.T
        if not cosine:
            scores += biases[None, :]
        place = labels[some] - start
        rows = np.flatnonzero((place >= 0) & (place < len(classes)))
        at = place[rows].astype(np.int64)
        if margin is not None:
            scores[rows, at] = _with_margin(scores[rows, at], margin, easy)
        scores *= scale
        own[first + rows] = scores[rows, at]
        top = scores.max(axis=1)
        summed[some] = top + np.log(np.exp(scores - top[:, None]).sum(axis=1))
    return summed, own


def _labels(column: pa.ChunkedArray) -> np.ndarray:
    """Class numbers; -1 for null."""
    return column.cast(pa.int64()).fill_null(-1).to_numpy()


def _or_null(values: np.ndarray) -> pa.Array:
    return pa.array(values, mask=~np.isfinite(values))


def _held_losses(items: DataFrame, names: list[str], held: dict[str, tuple]) -> DataFrame:
    """Losses of the heads whose classes travel to the tasks, in one scan of the items."""
    schema = T.StructType([items.schema[n] for n in names])
    for name in held:
        schema.add(name, T.DoubleType())
    order = list(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            rows = np.arange(table.num_rows)
            if not len(rows):
                continue
            values = _matrix(table["_vec"], rows)
            losses = []
            for name in order:
                matrix, biases, label, rule = held[name]
                summed, own = _states(values, _labels(table[label]), matrix, biases, 0, rule)
                losses.append(_or_null(summed - own))
            own_columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*own_columns, *losses], names=[*names, *order])

    return items.mapInArrow(run, schema)


def _chunked_losses(
    items: DataFrame, label: str, head: Head, name: str, class_rows: int, item_rows: int
) -> DataFrame:
    """``_row`` and loss: blocks of items meet chunks of classes, and states merge by row."""
    rule = _rule(head)
    blocks = max(1, -(-items.count() // item_rows))
    chunk_of = F.floor(F.col(head.class_id) / class_rows).cast("int")
    chunks = head.classes.agg(F.max(chunk_of)).first()[0]
    left = items.select(
        "_row",
        "_vec",
        F.col(label).cast("bigint").alias("_label"),
        F.pmod(F.xxhash64("_row"), F.lit(blocks)).cast("int").alias("_block"),
        F.explode(F.sequence(F.lit(0), F.lit(chunks))).alias("_chunk"),
    )
    right = head.classes.select(
        F.col(head.class_id).cast("bigint").alias("_class"),
        F.col(head.weights).cast("array<double>").alias("_weights"),
        (F.col(head.bias).cast("double") if head.bias else F.lit(0.0)).alias("_bias"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block"),
        chunk_of.alias("_chunk"),
    )

    def score(have: pa.Table, classes: pa.Table) -> pa.Table:
        classes = classes.combine_chunks()
        ids = classes["_class"].to_numpy()
        order = np.argsort(ids, kind="stable")
        _check_dense(ids[order])
        if not have.num_rows or not len(ids):
            states = np.zeros(0), np.zeros(0)
            have = have.slice(0, 0)
        else:
            matrix = _matrix(classes["_weights"], order)
            states = _states(
                _matrix(have["_vec"], np.arange(have.num_rows)),
                _labels(have["_label"]),
                _unit_rows(matrix) if rule[0] else matrix,
                classes["_bias"].to_numpy()[order],
                int(ids[order[0]]),
                rule,
            )
        return pa.table({"_row": have["_row"], "summed": pa.array(states[0]), "own": _or_null(states[1])})

    states = (
        left.groupBy("_block", "_chunk")
        .cogroup(right.groupBy("_block", "_chunk"))
        .applyInArrow(score, "_row long, summed double, own double")
    )
    merged = states.groupBy("_row").agg(
        F.collect_list("summed").alias("_all"),  # one of each chunk
        F.max("summed").alias("_top"),
        F.max("own").alias("_own"),
    )
    total = F.aggregate("_all", F.lit(0.0), lambda acc, s: acc + F.exp(s - F.col("_top")))
    return merged.select("_row", (F.log(total) + F.col("_top") - F.col("_own")).alias(name))


def class_losses(
    items: DataFrame,
    heads: Mapping[str, Head],
    *,
    row_id: str,
    vec: str,
    carry: Sequence[str] = (),
    class_bytes: int = CLASS_BYTES,
    class_rows: int = CLASS_ROWS,
    item_rows: int = ITEM_ROWS,
) -> DataFrame:
    """One row per item row with ``row_id``, ``carry`` and each head's softmax cross-entropy.

    Heads whose class tables together stay within ``class_bytes`` are computed where an item is read,
    all in one scan; beyond that classes are cut into chunks. Items without vector have no row; the
    loss is NULL if the label is NULL or no class. Ids may repeat.
    """
    names = list(dict.fromkeys([row_id, *carry]))
    held, large, left = {}, {}, class_bytes
    places = {name: f"_label{n}" for n, name in enumerate(heads)}
    for name, head in heads.items():
        found = _held_classes(head.classes, head.class_id, head.weights, head.bias, head.cosine, left)
        if found is None:
            large[name] = head
        else:
            held[name] = (*found, places[name], _rule(head))
            left -= found[0].nbytes + found[1].nbytes
    picked = items.where(F.col(vec).isNotNull()).select(
        *names,
        F.col(vec).cast("array<double>").alias("_vec"),
        *[F.col(head.label).alias(places[name]) for name, head in heads.items()],
    )
    if not large:
        return _held_losses(picked, names, held).select(*names, *heads)
    # rows are told apart by a number that is written down, as ids may repeat
    picked = materialize(picked.withColumn("_row", F.monotonically_increasing_id()), "loss-items")
    found = _held_losses(picked, [*names, "_row"], held)
    for name, head in large.items():
        found = found.join(
            _chunked_losses(picked, places[name], head, name, class_rows, item_rows), "_row", "left"
        )
    return found.select(*names, *heads)

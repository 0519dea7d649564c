"""Whole jobs, put together from the operators."""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions.codec import encode_vector
from kindred.functions.vectors import l2_normalize
from kindred.operators.embed import (
    ModelFactory,
    embed_batch,
    mean_pool_images,
    sentence_vectors,
)
from kindred.operators.merge import append_embeddings, merge_bucketed, merge_neighbours, new_items
from kindred.operators.similar import (
    BLOCK_ROWS,
    neighbour_lists,
    similar_after_rules,
    similar_before_rules,
    similar_recent,
)
from kindred.operators.tables import product_dim, scan_recent_days, valid_sku, with_title
from kindred.session import materialize
from kindred.sources.files import read_vector_files
from kindred.sources.tables import embedding_schema, stage_and_publish, write_bucketed, write_table

KEYS = {"q_area_id": "area_id", "q_spu_sn": "spu_sn"}
TEXT_CATEGORY = "first_level_category_id"
IMAGE_CATEGORY = "second_level_category_id"
TEXT_CAP = 101


def _names(category: str, vec: str, block_rows: int) -> dict:
    return {
        "area": "area_id",
        "item": "spu_sn",
        "category": category,
        "row_id": "row_id",
        "vec": vec,
        "block_rows": block_rows,
    }


def similar_items(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Merged neighbour lists per area and item: image neighbours first, then text neighbours.

    ``rows``: ``row_id, spu_sn, area_id, dt``, both category ids, ``text_vec``, ``image_vec``.
    A row without one of the vectors takes part in the other search only.
    """
    text = similar_after_rules(
        rows, cap=TEXT_CAP, apart=True, **_names(TEXT_CATEGORY, "text_vec", block_rows)
    )
    image = similar_before_rules(rows, **_names(IMAGE_CATEGORY, "image_vec", block_rows))
    return merge_neighbours(
        neighbour_lists(image, KEYS, "c_spu_sn"),
        neighbour_lists(text, KEYS, "c_spu_sn", cap=TEXT_CAP),
        list(KEYS.values()),
    )


def similar_items_recent(
    rows: DataFrame,
    target_day: str,
    share: int = 7,
    block_rows: int = BLOCK_ROWS,
    state: str | None = None,
) -> DataFrame:
    """As :func:`similar_items` over several days; only items of ``target_day`` are returned.

    ``state`` names a folder that keeps, day by day, what was counted for the vectors seen so far.
    """
    text = similar_recent(
        rows,
        target_day=target_day,
        share=share,
        min_score=-0.6,
        cap=TEXT_CAP,
        state=state and f"{state}/text",
        listed=True,
        **_names(TEXT_CATEGORY, "text_vec", block_rows),
    )
    image = similar_recent(
        rows,
        target_day=target_day,
        share=share,
        min_score=0.15,
        cap=27,
        state=state and f"{state}/image",
        listed=True,
        **_names(IMAGE_CATEGORY, "image_vec", block_rows),
    )
    return merge_neighbours(
        neighbour_lists(image, KEYS, "c_spu_sn"),
        neighbour_lists(text, KEYS, "c_spu_sn"),
        list(KEYS.values()),
    )


def search_rows(
    products: DataFrame,
    images: DataFrame,
    word_vectors: DataFrame,
    *,
    row_id: str = "row_id",
    item: str = "spu_sn",
    dims: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """What the searches read, made from products, image vectors and word vectors; and the errors.

    ``products``: one row per area and item with its categories, names and ``sku``; rows without
    sku are left out. ``images``: ``spu_sn, n, image_id, vec``, numbered from 0. Titles become mean
    word vectors, images mean vectors. The error rows (``row_id, spu_sn, error``) lack a title vector,
    an image vector, the area or a category, and take no part in the searches that need it.
    """
    titled = with_title(valid_sku(products))
    text = sentence_vectors(titled, row_id, F.col("title"), word_vectors, dims)
    image = mean_pool_images(images, item, "n", "image_id", "vec")
    rows = materialize(
        titled.join(text.select(row_id, F.col("vec").alias("text_vec")), row_id, "left").join(
            image.select(item, F.col("vec").alias("image_vec")), item, "left"
        ),
        "search-rows",
    )
    missing = F.array_compact(
        F.array(
            F.when(F.col("text_vec").isNull(), "no known word in the title"),
            F.when(F.col("image_vec").isNull(), "no image"),
            *[F.when(F.col(c).isNull(), f"no {c}") for c in ("area_id", TEXT_CATEGORY, IMAGE_CATEGORY)],
        )
    )
    told = rows.select(row_id, item, F.array_join(missing, ", ").alias("error"))
    return rows, told.where("error <> ''")


def similar_items_of_days(
    products: DataFrame,
    images: DataFrame,
    word_vectors: DataFrame,
    target_day: str,
    *,
    days: int = 7,
    share: int = 7,
    dims: int | None = None,
    state: str | None = None,
    block_rows: int = BLOCK_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """From a product table by days to the lists of ``target_day``, and the error rows.

    ``products`` has one row per area, item and day ``dt``, by which it should be partitioned: only the
    folders from ``days`` days before ``target_day`` on are read. With ``state``, a folder, the run of a
    new day counts its rows for all vectors, and the rows of earlier days for new vectors only.
    """
    recent = scan_recent_days(products, target_day, days)
    rows, errors = search_rows(recent, images, word_vectors, dims=dims)
    return similar_items_recent(rows, target_day, share, block_rows, state), errors


def encoded_rows(vectors: DataFrame, key: str, vec: Column, name: str) -> DataFrame:
    """Unit vectors as bracketed text."""
    unit = l2_normalize(vec, zero="nan")
    return vectors.select(
        F.col(key).cast("string").alias(key), encode_vector(unit.cast("array<float>")).alias(name)
    )


def incremental_embeddings(
    items: DataFrame,
    old: DataFrame,
    *,
    key: str,
    inputs: Sequence[str],
    load_model: ModelFactory,
    name: str,
    day: str,
    stamp: str = "all",
    tried: DataFrame | None = None,
) -> DataFrame:
    """Embed the items missing from ``old`` and append them; failed rows wait for the next run.

    :func:`embedding_attempts` tells which rows fail and why. Its result, written once, may be handed
    in as ``tried``, so that table and errors come from one run of the model.
    """
    if tried is None:
        tried = embedding_attempts(items, old, key=key, inputs=inputs, load_model=load_model)
    embedded = tried.where(F.col("vec").isNotNull())
    return append_embeddings(old, encoded_rows(embedded, key, F.col("vec"), name), day, stamp)


def embedding_attempts(
    items: DataFrame, old: DataFrame, *, key: str, inputs: Sequence[str], load_model: ModelFactory
) -> DataFrame:
    """``key, vec, error`` of every item missing from ``old``; of rows with one key the greatest counts."""
    others = [c for c in dict.fromkeys(inputs) if c != key]
    if others:
        greatest = F.max(F.struct(*others)).alias("_row")
        single = items.groupBy(key).agg(greatest).select(key, "_row.*")
    else:
        single = items.select(key).distinct()
    return embed_batch(new_items(single, old, key), key, inputs, load_model)


def vectors_of_items(items: DataFrame, cache: DataFrame, *, key: str, vec: str) -> DataFrame:
    """One row per item, ``key, vec, error``; repeated items and repeated vectors make no more rows.

    Of an item's vectors the greatest counts. ``error`` tells of items without key, without vector, and
    of those whose vectors can't be read (NULL, or with a NULL element).
    """
    sound = F.when(~F.exists(F.col(vec), lambda x: x.isNull()), F.col(vec))
    held = cache.groupBy(key).agg(F.max(sound).alias("vec"))
    joined = items.select(key).distinct().join(held.withColumn("_held", F.lit(True)), key, "left")
    error = (
        F.when(F.col(key).isNull(), "no key")
        .when(F.col("_held").isNull(), "no vector")
        .when(F.col("vec").isNull(), "vector can't be read")
    )
    return joined.select(key, "vec", error.alias("error"))


def refresh_embeddings(
    items: DataFrame, cache: DataFrame, *, key: str, vec: str, name: str, day: str
) -> DataFrame:
    """Embeddings of all items with a cached vector; earlier rows are not kept."""
    cached = vectors_of_items(items, cache, key=key, vec=vec).where("error is null")
    return encoded_rows(cached, key, F.col("vec"), name).withColumn("modifydate", F.lit(day))


def refresh_from_files(
    items: DataFrame,
    folder: str,
    table: str,
    *,
    key: str,
    key_pattern: str,
    name: str,
    day: str,
    partitions: int | None = None,
) -> DataFrame:
    """Publish table ``table`` anew from the vector files of the items, and return the error rows.

    ``folder`` holds a file per item (see :func:`read_vector_files`). Vectors become unit vectors in
    brackets; rows of earlier runs go. The files are read once, and the table is overwritten only
    after all its rows are written. The error rows are ``key, error``.
    """
    files = read_vector_files(items.sparkSession, folder, key_pattern, key)
    found = materialize(vectors_of_items(items, files, key=key, vec="vec"), "vectors-of-items")
    rows = encoded_rows(found.where("error is null"), key, F.col("vec"), name)
    schema = embedding_schema(key, name)
    stage_and_publish(rows.withColumn("modifydate", F.lit(day)), table, schema, partitions)
    return found.where("error is not null").select(key, "error")


ATTRIBUTES = {
    c: c
    for c in (
        "product_name",
        "product_title",
        "first_level_category_name",
        "second_level_category_name",
    )
}


def multimodal_table(
    products: DataFrame,
    word_vectors: DataFrame,
    load_model: ModelFactory,
    folder: str,
    table: str,
    *,
    key: str,
    key_pattern: str,
    day: str,
    buckets: int,
    dims: int | None = None,
) -> DataFrame:
    """Publish the wide table of word, model and image vectors, and return the error rows.

    ``products`` are product rows, several to an item; an attribute's greatest value counts. Titles
    give the mean of their words' vectors (``fasttext_emb``) and what the model makes of them
    (``bert_emb``); ``folder`` holds image vector files (``cv_emb``). An item that only one of them
    knows has a row too, with '' in the other columns.

    Every modality is first settled to one row per item in a table ``{table}_{modality}``, bucketed by
    item, and the wide table is put together from them without another shuffle. So the model runs once, and a modality that another job keeps can be merged in the same way. The
    error rows (``key, modality, error``) tell of titles without known word, of items that the model
    fails on, and of files that can't be read.
    """
    spark = products.sparkSession
    titled = materialize(
        with_title(product_dim(products.where(F.col(key).isNotNull()), key, ATTRIBUTES)).select(
            key, "title"
        ),
        "titles",
    )
    words = sentence_vectors(titled, key, F.col("title"), word_vectors, dims)
    tried = materialize(embed_batch(titled, key, ["title"], load_model), "model-vectors")
    files = read_vector_files(spark, folder, key_pattern, key)
    files = materialize(files.groupBy(key).agg(F.max("vec").alias("vec")), "file-vectors")
    modalities = {"fasttext_emb": words, "bert_emb": tried, "cv_emb": files}
    for name, vectors in modalities.items():
        number = F.col("vec").cast("array<float>")
        rows = vectors.select(key, encode_vector(number, brackets=False).alias(name))
        schema = embedding_schema(key, name, stamp=False)
        write_bucketed(rows.where(F.col(name).isNotNull()), f"{table}_{name}", schema, key, buckets)
    settled = {name: spark.table(f"{table}_{name}") for name in modalities}
    wide = merge_bucketed(list(settled.values()), key, day)
    write_table(wide, table, embedding_schema(key, *modalities))
    unknown = titled.join(settled["fasttext_emb"].select(key), key, "left_anti")
    odd = {
        "fasttext_emb": unknown.select(key, F.lit("no known word in the title").alias("error")),
        "bert_emb": tried.where("vec is null").select(key, "error"),
        "cv_emb": files.where("vec is null").select(key, F.lit("vector can't be read").alias("error")),
    }
    told = [df.select(key, F.lit(name).alias("modality"), "error") for name, df in odd.items()]
    return reduce(DataFrame.unionByName, told)

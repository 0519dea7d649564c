"""Embeddings: pooling, word vectors, batch models, text classifier."""

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, SQLTransformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.functions.text import words
from kindred.functions.vectors import mean_of
from kindred.session import materialize, never_broadcast

MAX_IMAGES = 8  # how many images of an item are pooled unless another number is asked for
MAX_COLUMNS = 128


def _of_length(vec: Column, dims: int, kind: T.DataType | str) -> Column:
    """The vector; one of another length stops the job."""
    wrong = F.raise_error(F.lit(f"a vector has not {dims} elements")).cast(kind)
    return F.when(F.size(vec) == dims, vec).otherwise(wrong)


def mean_vector(
    df: DataFrame,
    keys: Sequence[str],
    vec: Column,
    weight: Column | None = None,
    dims: int | None = None,
) -> DataFrame:
    """Element-wise mean per key as ``vec``, partly summed before the shuffle.

    Rows of weight 0 and NULL vectors do not count; a key with no weight at all has no row. Vectors
    of another length than ``dims``, or than each other, stop the job. With known ``dims`` (at most
    128) the sums are plain columns of a hash aggregate; otherwise a vector summarizer adds them up.
    """
    used = F.lit(1.0) if weight is None else weight.cast("double")
    rows = df.select(*keys, vec.alias("_v"), used.alias("_w")).where("_w > 0 and _v is not null")
    if dims is not None:
        rows = rows.withColumn("_v", _of_length(F.col("_v"), dims, rows.schema["_v"].dataType))
    if dims is None or dims > MAX_COLUMNS:
        mean = Summarizer.mean(array_to_vector("_v"), F.col("_w")).alias("_mean")
        return rows.groupBy(*keys).agg(mean).select(*keys, vector_to_array("_mean").alias("vec"))
    sums = [F.sum(F.col("_v")[i].cast("double") * F.col("_w")).alias(f"_s{i}") for i in range(dims)]
    summed = rows.groupBy(*keys).agg(F.sum("_w").alias("_n"), *sums)
    means = [F.col(f"_s{i}") / F.col("_n") for i in range(dims)]
    return summed.select(*keys, F.array(*means).alias("vec"))


def mean_pool_images(
    df: DataFrame, item: str, number: str, row_id: str, vec: str, most: int = MAX_IMAGES
) -> DataFrame:
    """Mean vector of an item's images 0, 1, 2, ... up to the first missing number, at most ``most``.

    Of several rows with one number the least ``row_id`` counts. ``images`` tells how many entered;
    :func:`images_left_out` lists the rows that did not for their number.
    """
    wanted = df.where(F.col(number).between(0, most - 1) & F.col(vec).isNotNull())
    single = wanted.groupBy(item, number).agg(F.min_by(vec, row_id).alias("_v"))
    entry = F.struct(F.col(number).alias("n"), F.col("_v").alias("v"))
    listed = single.groupBy(item).agg(F.array_sort(F.collect_list(entry)).alias("_all"))
    unbroken = F.transform(
        F.filter("_all", lambda e, i: e["n"].cast("int") == i), lambda e: e["v"]
    )
    return (
        listed.select(item, unbroken.alias("_images"))
        .where(F.size("_images") > 0)
        .select(item, F.size("_images").alias("images"), mean_of(F.col("_images")).alias("vec"))
    )


def images_left_out(df: DataFrame, number: str, most: int = MAX_IMAGES) -> DataFrame:
    """The rows whose image number is past those that :func:`mean_pool_images` looks at."""
    return df.where((F.col(number) >= most) | (F.col(number) < 0) | F.col(number).isNull())


def masked_mean_pool(
    tokens: DataFrame, row_id: str, vec: str, mask: str, dims: int | None = None
) -> DataFrame:
    """Mean of a row's token vectors where the mask is 1; NULL when no token is.

    Masked tokens enter the sum as zeros, so one aggregation serves both kinds of rows. With known
    ``dims`` (at most 128) the sums are plain columns of a hash aggregate, so that tokens of a row are
    added up where they are read; a summarizer sorts all tokens once it meets more than a few rows.
    """
    kept = F.col(mask) == 1
    if dims is not None and dims <= MAX_COLUMNS:
        given = _of_length(F.col(vec).cast("array<double>"), dims, "array<double>")
        rows = tokens.select(row_id, given.alias("_v"), kept.alias("_k"))
        sums = [F.sum(F.when(F.col("_k"), F.col("_v")[i]).otherwise(0.0)).alias(f"_s{i}") for i in range(dims)]
        summed = rows.groupBy(row_id).agg(F.sum(F.col("_k").cast("int")).alias("_n"), *sums)
        mean = F.array(*[F.col(f"_s{i}") / F.col("_n") for i in range(dims)])
        return summed.select(row_id, F.when(F.col("_n") > 0, mean).alias("vec"))
    zeros = F.transform(vec, lambda x: F.lit(0.0))
    shown = F.when(kept, F.col(vec).cast("array<double>")).otherwise(zeros)
    rows = tokens.select(row_id, array_to_vector(shown).alias("_v"), kept.cast("int").alias("_k"))
    summed = rows.groupBy(row_id).agg(
        Summarizer.sum(F.col("_v")).alias("_sum"), F.sum("_k").alias("_n")
    )
    mean = F.transform(vector_to_array("_sum"), lambda x: x / F.col("_n"))
    return summed.select(row_id, F.when(F.col("_n") > 0, mean).alias("vec"))


FREQUENT_WORDS = 5000  # words whose vectors travel to every task


def sentence_vectors(
    df: DataFrame,
    row_id: str,
    text: Column,
    word_vectors: DataFrame,
    dims: int | None = None,
    frequent: int = FREQUENT_WORDS,
) -> DataFrame:
    """Mean of the vectors of a text's known words; ``word_vectors`` holds ``word, vec``.

    The ``frequent`` most frequent words, which make up most of any text, are broadcast; their
    vectors are added up where the text is read. Only the rarer words are shuffled, so no word that
    stands in every text is a join key. Of a word's vectors, if it has several, the greatest counts.
    Texts are split once and vectors settled once, not again for the counts and each of both joins.
    """
    settled = word_vectors.groupBy("word").agg(F.max("vec").alias("vec"))
    word_vectors = materialize(settled, "word-vectors")
    tokens = materialize(df.select(row_id, F.explode(words(text)).alias("word")), "tokens")
    counts = tokens.groupBy("word").agg(F.count(F.lit(1)).alias("_uses"))
    top = counts.orderBy(F.desc("_uses"), "word").limit(frequent).select("word")
    held = materialize(top.join(word_vectors.select("word", "vec"), "word", "left"), "frequent-words")
    held = held.withColumn("_frequent", F.lit(True))
    marked = tokens.join(F.broadcast(held), "word", "left")  # ``frequent`` rows
    rare = never_broadcast(marked.where("_frequent is null").select(row_id, "word"))
    joined = marked.where("_frequent").select(row_id, "vec").unionByName(
        rare.join(word_vectors.select("word", "vec"), "word").select(row_id, "vec")
    )
    return mean_vector(joined, [row_id], F.col("vec"), dims=dims)


ModelFactory = Callable[[], Callable[[pd.DataFrame], Sequence]]


def embed_batch(
    df: DataFrame, key: str, inputs: Sequence[str], load_model: ModelFactory
) -> DataFrame:
    """Vectors from a model, in Arrow batches: ``key, vec, error``.

    ``load_model`` runs once per task and returns a function from a frame of the input columns to
    one vector per row. When a batch fails its rows are tried one by one, so a bad row yields an
    ``error`` and NULL instead of stopping the job.
    """
    names = list(dict.fromkeys([key, *inputs]))

    def one_by_one(model, batch: pd.DataFrame):
        vectors, errors = [], []
        for n in range(len(batch)):
            try:
                vectors.append(list(model(batch.iloc[n : n + 1]))[0])
                errors.append(None)
            except Exception as e:  # noqa: BLE001 - a model may raise anything
                vectors.append(None)
                errors.append(f"{type(e).__name__}: {e}")
        return vectors, errors

    def embed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load_model()
        for batch in batches:
            asked = batch[list(inputs)]
            try:
                vectors, errors = list(model(asked)), [None] * len(batch)
            except Exception:  # noqa: BLE001
                vectors, errors = one_by_one(model, asked)
            yield pd.DataFrame({key: batch[key], "vec": vectors, "error": errors})

    schema = T.StructType(
        [
            T.StructField(key, df.schema[key].dataType),
            T.StructField("vec", T.ArrayType(T.FloatType())),
            T.StructField("error", T.StringType()),
        ]
    )
    return df.select(*names).mapInPandas(embed, schema)


def text_classifier(
    df: DataFrame, text: str, label: str, features: int = 1 << 16, epochs: int = 5
) -> PipelineModel:
    """Softmax classifier on hashed words and word pairs; ``label`` is a class number from 0."""
    tokens = SQLTransformer(
        statement=f"SELECT *, filter(split(lower({text}), '\\\\s+'), w -> w <> '') AS _words FROM __THIS__"
    )
    grams = SQLTransformer(
        statement=(
            "SELECT *, concat(_words, transform(slice(_words, 2, greatest(size(_words) - 1, 0)),"
            " (w, i) -> concat(_words[i], ' ', w))) AS _grams FROM __THIS__"
        )
    )
    hashed = HashingTF(inputCol="_grams", outputCol="_features", numFeatures=features)
    softmax = LogisticRegression(
        featuresCol="_features", labelCol=label, family="multinomial", maxIter=epochs, regParam=1e-3
    )
    return Pipeline(stages=[tokens, grams, hashed, softmax]).fit(df)

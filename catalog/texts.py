"""Text functions and text models on the documents."""

from pyspark.sql import functions as F

from catalog.base import (
    HASH_DIMS,
    hash_vector,
    hash_vector_sql,
    load_hash_model,
    query,
    r5,
    r5_sql,
    table,
    unnested,
    unnested_sql,
)
from kindred.functions.text import clean_title, collapse_whitespace, words
from kindred.operators import embed as M
from kindred.operators.tokens import build_vocabulary, tokenize_pad
from kindred.session import materialize, scratch_path
from kindred.sources.files import read_labelled_lines, write_labelled_lines

PHRASES = ("ation", "the", "er", "at", "[")


SPACES = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def collapse_sql(c: str) -> str:
    return f"trim(regexp_replace({c}, '{SPACES}', ' ', 'g'))"


def words_sql(c: str) -> str:
    return f"list_filter(string_split({collapse_sql(c)}, ' '), lambda w: w <> '')"


def phrases_sql(c: str) -> str:
    for phrase in PHRASES[:-1]:
        c = f"replace({c}, '{phrase}', '')"
    return c


@query(
    "clean_title",
    f"""select doc_id, regexp_replace({phrases_sql('text')}, '\\[[^()]*\\]', '', 'g') as text
    from documents""",
)
def cleaned(spark, folder):
    text = clean_title(F.col("text"), PHRASES[:-1])
    return table(spark, folder, "documents").select("doc_id", text.alias("text"))


WORDS = f"""tokens as (
  select doc_id, unnest(w) as word, unnest(range(0, len(w))) as pos
  from (select doc_id, {words_sql('text')} as w from documents))"""
LENGTH = 128


@query(
    "tokenize_pad",
    f"""with {WORDS}, vocabulary as (
      select word, row_number() over (order by uses desc, word) + 1 as token_id
      from (select word, count(*) as uses from tokens group by word)),
    ids as (select doc_id, list(coalesce(token_id, 1) order by pos) as ids
      from tokens left join vocabulary using (word) where pos < {LENGTH} group by doc_id),
    whole as (select d.doc_id, coalesce(i.ids, []) as ids from documents d left join ids i
      on d.doc_id = i.doc_id)
    select doc_id, array_to_string(list_concat(ids,
        list_transform(range(0, {LENGTH} - len(ids)), lambda e: 0)), ' ') as input_ids,
      len(ids) as used, {LENGTH} as length from whole""",
)
def tokenized(spark, folder):
    documents = table(spark, folder, "documents")
    vocabulary = build_vocabulary(documents, [F.col("text")])
    records = tokenize_pad(documents, "doc_id", {"tokens": F.col("text")}, vocabulary, LENGTH)
    used = F.aggregate("tokens.attention_mask", F.lit(0), lambda acc, x: acc + x)
    return records.select(
        "doc_id",
        F.array_join("tokens.input_ids", " ").alias("input_ids"),
        used.alias("used"),
        F.size("tokens.attention_mask").alias("length"),
    )


def averages_sql(weight: str) -> str:
    return ", ".join(
        f"{r5_sql(f'avg(v[{i + 1}]) filter (where {weight})')} as v{i}" for i in range(HASH_DIMS)
    )


def as_columns(df, key, vec):
    return df.select(key, *[r5(F.get(vec, F.lit(i))).alias(f"v{i}") for i in range(HASH_DIMS)])


@query(
    "sentence_vectors",
    f"""with {WORDS}, vectors as (select word, {hash_vector_sql('word')} as v
      from (select distinct word from tokens))
    select doc_id, {averages_sql('true')} from tokens join vectors using (word) group by doc_id""",
)
def sentence_vectors(spark, folder):
    documents = table(spark, folder, "documents")
    vocabulary = documents.select(F.explode(words(F.col("text"))).alias("word")).distinct()
    # written, as Spark else leaves the distinct out and makes a vector for every token
    vocabulary = materialize(vocabulary, "vocabulary")
    vectors = vocabulary.select("word", hash_vector(F.col("word")).alias("vec"))
    found = M.sentence_vectors(documents, "doc_id", F.col("text"), vectors, HASH_DIMS)
    return as_columns(found, "doc_id", F.col("vec"))


@query(
    "masked_mean_pool",
    f"""with {WORDS}, vectors as (select doc_id, word, {hash_vector_sql('word')} as v from tokens)
    select doc_id, {averages_sql('length(word) >= 4')} from vectors group by doc_id""",
)
def masked_mean_pool(spark, folder):
    documents = table(spark, folder, "documents")
    tokens = documents.select("doc_id", F.explode(words(F.col("text"))).alias("word"))
    marked = tokens.select(
        "doc_id",
        hash_vector(F.col("word")).alias("vec"),
        (F.length("word") >= 4).cast("int").alias("mask"),
    )
    pooled = M.masked_mean_pool(marked, "doc_id", "vec", "mask", HASH_DIMS)
    return as_columns(pooled, "doc_id", F.col("vec"))


@query(
    "embed_batch",
    f"with h as (select doc_id, list_transform({hash_vector_sql('text')}, lambda e: "
    "e::FLOAT::DOUBLE) as vec from documents) " + unnested_sql("h", "doc_id", "vec"),
)
def embed_batch(spark, folder):
    documents = table(spark, folder, "documents")
    embedded = M.embed_batch(documents, "doc_id", ["text"], load_hash_model)
    return unnested(embedded, ["doc_id"], F.col("vec").cast("array<double>"))


@query(
    "scan_labelled_lines",
    f"""select cast(quality as varchar) as label, {collapse_sql('text')} as text
    from documents join labels using (doc_id)""",
)
def scan_labelled_lines(spark, folder):
    documents = table(spark, folder, "documents").join(
        table(spark, folder, "labels"), "doc_id", "left"
    )
    path = scratch_path(spark, "labelled")
    write_labelled_lines(documents, F.col("quality"), collapse_whitespace(F.col("text")), path)
    return read_labelled_lines(spark, path).select("label", "text")


@query("text_classifier")
def text_classifier(spark, folder):
    labelled = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id")
    labelled = labelled.select("doc_id", "text", F.col("quality").cast("double").alias("quality"))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    marked = labelled.withColumn("held_out", held_out)
    model = M.text_classifier(marked.where("not held_out"), "text", "quality")
    return model.transform(marked).select("doc_id", "held_out", "quality", "prediction")

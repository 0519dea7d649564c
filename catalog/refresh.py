"""Embedding tables made from product rows and vector files, to the published table and the errors."""

import uuid

from pyspark.sql import functions as F

from catalog.base import (
    HASH_DIMS,
    ITEM_VECTORS,
    PRODUCT_DAILY,
    hash_vector,
    hash_vector_sql,
    item_vectors,
    load_hash_model,
    product_daily,
    query,
    r5,
    r5_sql,
)
from catalog.products import TITLE
from catalog.texts import words_sql
from kindred.functions.codec import decode_vector
from kindred.functions.text import words
from kindred.operators import merge as M
from kindred.operators import tables as T
from kindred.plans import jobs
from kindred.session import scratch_path
from kindred.sources import files as R
from kindred.sources import tables as W

STAMP = "2024-01-10"
FILES = 4  # output partitions asked for
BUCKETS = 4

# Product rows of several items share a goods_sku; every seventh item's file can't be read, and the
# items of one label have none.
GOODS = f"""{PRODUCT_DAILY}, {ITEM_VECTORS}, goods as (
  select concat('V', cast(cast(sku as bigint) % 444 as varchar)) as goods_sku, max(product_name) as product_name,
    max(product_title) as product_title,
    max(first_level_category_name) as first_level_category_name,
    max(second_level_category_name) as second_level_category_name
  from product_daily group by 1),
files as (
  select spu_sn as goods_sku, embedding::DOUBLE[] as vec,
    cast(substr(spu_sn, 2) as bigint) % 7 = 3 as broken
  from (select *, row_number() over (partition by spu_sn order by dt desc, row_id desc) as n
    from item_vectors where lv2 <> 0) where n = 1)"""


def goods(spark, folder):
    item = F.concat(F.lit("V"), F.col("sku").cast("bigint") % 444)
    return product_daily(spark, folder).withColumn("goods_sku", item)


def write_files(spark, folder) -> str:
    path = scratch_path(spark, "vector-files")
    rows = item_vectors(spark, folder).where("lv2 <> 0").select("spu_sn", "dt", "row_id", "embedding")
    latest = M.one_row_per_key(rows, "spu_sn", ["dt", "row_id"])
    broken = F.substr("spu_sn", F.lit(2)).cast("bigint") % 7 == 3
    R.write_vector_files(latest.where(~broken), "spu_sn", "embedding", path)
    lines = latest.where(broken).select(F.col("spu_sn").alias("item"), F.lit("no numbers").alias("value"))
    lines.write.partitionBy("item").mode("append").text(path)
    return path


def head_and_sum(name):
    vec = decode_vector(F.col(name)).cast("array<double>")
    total = F.aggregate(vec, F.lit(0.0), lambda acc, x: acc + x)
    return [
        F.size(vec).alias(f"{name}_n"),
        r5(F.get(vec, F.lit(0))).alias(f"{name}_first"),
        r5(total).alias(f"{name}_sum"),
    ]


def head_and_sum_sql(vec, name):
    return (
        f"len({vec}) as {name}_n, {r5_sql(vec + '[1]')} as {name}_first, "
        f"{r5_sql('list_sum(' + vec + ')')} as {name}_sum"
    )


@query(
    "refresh_from_files",
    f"""with {GOODS}, sound as (
      select goods_sku, list_transform(vec, lambda e: (e / sqrt(list_sum(list_transform(vec,
        lambda x: x * x))))::FLOAT::DOUBLE) as u from files where not broken)
    select g.goods_sku, {head_and_sum_sql('u', 'cv_emb')},
      case when s.goods_sku is not null then '{STAMP}' end as modifydate,
      case when f.goods_sku is null then 'no vector' when broken then 'vector can''t be read' end as error
    from goods g left join files f on g.goods_sku = f.goods_sku
    left join sound s on s.goods_sku = g.goods_sku""",
)
def refresh_from_files(spark, folder):
    name = f"refreshed_{uuid.uuid4().hex}"
    schema = W.embedding_schema("goods_sku", "cv_emb")
    earlier = item_vectors(spark, folder).select(
        F.concat(F.lit("gone"), "row_id").alias("goods_sku"), F.lit("[1.0]").alias("cv_emb"), F.lit("").alias("modifydate")
    )
    W.write_table(earlier, name, schema, scratch_path(spark, name))
    errors = jobs.refresh_from_files(
        goods(spark, folder),
        write_files(spark, folder),
        name,
        key="goods_sku",
        key_pattern=r"item=([^/]+)/",
        name="cv_emb",
        day=STAMP,
        partitions=FILES,
    )
    return (
        spark.table(name)
        .select("goods_sku", *head_and_sum("cv_emb"), "modifydate")
        .join(errors, "goods_sku", "full_outer")
    )


MEANS = ", ".join(f"avg(v[{i + 1}])::FLOAT::DOUBLE" for i in range(HASH_DIMS))


@query(
    "multimodal_table",
    f"""with {GOODS}, titled as (select goods_sku, {TITLE} as title from goods),
    title_words as (select goods_sku, unnest({words_sql('title')}) as word from titled),
    text_means as (select goods_sku, [{MEANS}] as a
      from (select goods_sku, {hash_vector_sql('word')} as v from title_words where length(word) > 6)
      group by goods_sku),
    models as (select goods_sku, list_transform({hash_vector_sql('title')},
      lambda e: e::FLOAT::DOUBLE) as b from titled),
    keys as (select goods_sku from titled union select goods_sku from files)
    select k.goods_sku, {head_and_sum_sql('a', 'fasttext_emb')}, {head_and_sum_sql('b', 'bert_emb')},
      {head_and_sum_sql('c', 'cv_emb')},
      case when coalesce(len(a), len(b), len(c)) is not null then '{STAMP}' end as modifydate,
      nullif(concat_ws(', ',
        case when f.broken then 'cv_emb: vector can''t be read' end,
        case when t.goods_sku is not null and a is null then 'fasttext_emb: no known word in the title' end),
        '') as error
    from keys k left join titled t using (goods_sku) left join text_means using (goods_sku)
    left join models using (goods_sku) left join files f using (goods_sku)
    left join (select goods_sku, vec as c from files where not broken) using (goods_sku)""",
)
def multimodal_table(spark, folder):
    name = f"multimodal_{uuid.uuid4().hex}"
    products = goods(spark, folder)
    titles = T.with_title(products).select(F.explode(words(F.col("title"))).alias("word"))
    known = titles.where(F.length("word") > 6).distinct()  # shorter ones are unknown
    errors = jobs.multimodal_table(
        products,
        known.select("word", hash_vector(F.col("word")).alias("vec")),
        load_hash_model,
        write_files(spark, folder),
        name,
        key="goods_sku",
        key_pattern=r"item=([^/]+)/",
        day=STAMP,
        buckets=BUCKETS,
        dims=HASH_DIMS,
    )
    told = errors.groupBy("goods_sku").agg(
        F.array_join(
            F.array_sort(F.collect_list(F.concat_ws(": ", "modality", "error"))), ", "
        ).alias("error")
    )
    shown = [c for m in ("fasttext_emb", "bert_emb", "cv_emb") for c in head_and_sum(m)]
    return spark.table(name).select("goods_sku", *shown, "modifydate").join(told, "goods_sku", "full_outer")

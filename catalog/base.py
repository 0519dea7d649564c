"""Registry, table access and the stand-ins for the product tables, in Spark and in SQL."""

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions.hashing import HEX_DIGITS, hash_int
from kindred.session import broadcast_if_small, never_broadcast

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def r5(c: Column | str) -> Column:
    """Five places; a nudge keeps exact halves from falling either way by the order of a sum."""
    value = F.col(c) if isinstance(c, str) else c
    return F.round(value + F.lit(1e-9), 5) + F.lit(0.0)


def r5_sql(expression: str) -> str:
    return f"(round(({expression}) + 1e-9::DOUBLE, 5) + 0.0::DOUBLE)"


def hash_sql(seed: str, *columns: str) -> str:
    """The library's hash_int in SQL."""
    parts = ", ".join(f"cast({c} as varchar)" for c in columns)
    return f"('0x' || substr(md5(concat_ws('|', '{seed}', {parts})), 1, 13))::BIGINT"


def unit_sql(seed: str, *columns: str) -> str:
    return f"({hash_sql(seed, *columns)} / 4503599627370496.0::DOUBLE)"


# --- product_daily ---------------------------------------------------------------------------

PRODUCT_DAILY = """product_daily as (
  select distinct concat('P', cast(l_partkey as varchar)) as spu_sn,
    cast(l_partkey as varchar) as sku, n.n_regionkey as area_id, p.p_name as product_name,
    case when p.p_size % 7 = 0 then null
         else concat(p.p_name, ' ', cast(p.p_size as varchar)) end as product_title,
    concat(p.p_type, ' ', cast(p.p_size as varchar)) as first_level_category_name,
    p.p_brand as second_level_category_name, p.p_type as first_level_category_id,
    concat(p.p_type, '|', p.p_brand) as second_level_category_id,
    substr(cast(l_shipdate as varchar), 1, 10) as dt
  from lineitem join part p on l_partkey = p.p_partkey join supplier on l_suppkey = s_suppkey
  join nation n on s_nationkey = n.n_nationkey)"""


def product_daily(
    spark: SparkSession,
    folder: str,
    pick: Callable[[DataFrame], DataFrame] = DataFrame.distinct,
    pick_part: Callable[[DataFrame], DataFrame] = DataFrame.distinct,
    by_day: bool = False,
) -> DataFrame:
    """The product rows. ``pick`` chooses from the keys and days they are made of, which are narrow:
    ``l_partkey, n_regionkey, l_shipdate``, with repeats; what it returns must be distinct. ``pick_part``
    does so from the parts, ``p_partkey`` and what products take from them. With ``by_day`` rows of a day
    are brought together, while they are narrow."""
    line = table(spark, folder, "lineitem").select(
        "l_partkey", "l_suppkey", F.col("l_shipdate").cast("date").alias("l_shipdate")
    )
    part = pick_part(table(spark, folder, "part").select("p_partkey", "p_name", "p_size", "p_type", "p_brand"))
    supplier = table(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, folder, "nation").select("n_nationkey", "n_regionkey")
    regions = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_regionkey")
    size = F.col("p_size").cast("string")
    # equal rows go while they are three numbers wide; of distinct parts and distinct keys no row is twice
    sold = pick(
        line.join(broadcast_if_small(regions), F.col("l_suppkey") == F.col("s_suppkey"))
        .select("l_partkey", "n_regionkey", "l_shipdate")
    )
    joined = never_broadcast(sold).join(part, F.col("l_partkey") == F.col("p_partkey"))
    if by_day:
        joined = joined.drop("p_partkey").repartition("l_shipdate")
    return (
        joined.select(
            F.concat(F.lit("P"), F.col("l_partkey")).alias("spu_sn"),
            F.col("l_partkey").cast("string").alias("sku"),
            F.col("n_regionkey").alias("area_id"),
            F.col("p_name").alias("product_name"),
            F.when(F.col("p_size") % 7 != 0, F.concat_ws(" ", "p_name", size)).alias(
                "product_title"
            ),
            F.concat_ws(" ", "p_type", size).alias("first_level_category_name"),
            F.col("p_brand").alias("second_level_category_name"),
            F.col("p_type").alias("first_level_category_id"),
            F.concat_ws("|", "p_type", "p_brand").alias("second_level_category_id"),
            F.date_format("l_shipdate", "yyyy-MM-dd").alias("dt"),
        )
    )


# --- media -----------------------------------------------------------------------------------

MEDIA = """media as (
  select concat('P', cast(l_partkey as varchar)) as spusn, l_orderkey * 10 + l_linenumber as id,
    concat('http://img/', cast(l_orderkey as varchar), '/', cast(l_linenumber as varchar))
      as originalimgurl,
    case when l_returnflag = 'R' then 'DETAIL' else 'PRIMARY' end as imgtype
  from lineitem)"""


def media(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        F.concat(F.lit("P"), F.col("l_partkey")).alias("spusn"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.concat(
            F.lit("http://img/"), F.col("l_orderkey"), F.lit("/"), F.col("l_linenumber")
        ).alias("originalimgurl"),
        F.when(F.col("l_returnflag") == "R", "DETAIL").otherwise("PRIMARY").alias("imgtype"),
    )


# --- item_vectors ----------------------------------------------------------------------------

ITEM_VECTORS = """item_vectors as (
  select vec_id as row_id, concat('V', cast(vec_id % 444 as varchar)) as spu_sn,
    vec_id % 4 as area_id, label % 5 as lv1, label as lv2,
    concat('2024-01-0', cast(1 + vec_id % 7 as varchar)) as dt, embedding
  from embeddings)"""

HALF = 32  # elements 1-32 are the text vector, 33-64 the image vector


def item_vectors(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("vec_id")
    return table(spark, folder, "embeddings").select(
        n.alias("row_id"),
        F.concat(F.lit("V"), n % 444).alias("spu_sn"),
        (n % 4).alias("area_id"),
        (F.col("label") % 5).alias("lv1"),
        F.col("label").alias("lv2"),
        F.concat(F.lit("2024-01-0"), 1 + n % 7).alias("dt"),
        F.col("embedding"),
        F.slice("embedding", 1, HALF).alias("text_vec"),
        F.slice("embedding", HALF + 1, HALF).alias("image_vec"),
    )


# --- pair_items ------------------------------------------------------------------------------

PAIR_ITEMS = """pair_items as (
  select p_partkey as item_id, p_name as sku_sn_name,
    concat(p_type, ' ', p_brand, ' ', p_name) as title, p_type as lv1_category_id,
    concat(p_type, '|', p_brand) as lv2_category_id,
    case when p_partkey % 11 = 0 then -1 else p_size end as tag_id
  from part)"""


def pair_items(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("item_id"),
        F.col("p_name").alias("sku_sn_name"),
        F.concat_ws(" ", "p_type", "p_brand", "p_name").alias("title"),
        F.col("p_type").alias("lv1_category_id"),
        F.concat_ws("|", "p_type", "p_brand").alias("lv2_category_id"),
        F.when(F.col("p_partkey") % 11 == 0, -1).otherwise(F.col("p_size")).alias("tag_id"),
    )


# --- vectors from text -------------------------------------------------------------------------

HASH_DIMS = 8  # six bits of a hash each


def hash_vector(text: Column) -> Column:
    """A deterministic vector for a word or a text; stands in for a trained model."""
    code = hash_int("vector", text)
    return F.array(
        *[
            F.shiftright(code, 6 * i).bitwiseAND(F.lit(63)).cast("double") / 31.5 - 1.0
            for i in range(HASH_DIMS)
        ]
    )


def hash_vector_sql(text: str) -> str:
    parts = [
        f"(({hash_sql('vector', text)} >> {6 * i}) & 63) / 31.5::DOUBLE - 1.0::DOUBLE"
        for i in range(HASH_DIMS)
    ]
    return f"[{', '.join(parts)}]"


def load_hash_model():
    """The same vectors from a Python function, in place of a model."""

    def vector(text: str) -> list[float]:
        digest = hashlib.md5(f"vector|{text}".encode()).hexdigest()
        code = int(digest[:HEX_DIGITS], 16)
        return [((code >> (6 * i)) & 63) / 31.5 - 1.0 for i in range(HASH_DIMS)]

    return lambda batch: [vector(t) for t in batch[batch.columns[0]]]


def unnested(df: DataFrame, keys: list[str], vec: Column | str) -> DataFrame:
    """A vector as rows ``pos, value``."""
    return df.select(*keys, F.posexplode(vec).alias("pos", "_x")).select(
        *keys, "pos", r5("_x").alias("value")
    )


def unnested_sql(source: str, keys: str, vec: str) -> str:
    return (
        f"select {keys}, cast(i - 1 as integer) as pos, {r5_sql('v[i]')} as value from "
        f"(select {keys}, {vec} as v, unnest(range(1, len({vec}) + 1)) as i from {source})"
    )

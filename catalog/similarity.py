"""Nearest-neighbour searches, merged lists and publishing."""

from pyspark.sql import functions as F

from catalog.base import HALF, ITEM_VECTORS, item_vectors, query, r5, r5_sql
from kindred.functions.keys import dated_key, prefixed_key
from kindred.functions.vectors import concat_modalities
from kindred.operators import similar as S
from kindred.operators.merge import merge_neighbours
from kindred.plans import jobs
from kindred.sources import kv

TARGET_DAY = "2024-01-03"
NOW = "2024-01-10 00:00:00"
TEXT, IMAGE = f"embedding[1:{HALF}]", f"embedding[{HALF + 1}:{2 * HALF}]"


def unit_rows_sql(name: str, vec: str) -> str:
    """Rows with their unit vector ``u``; ``asks`` marks the one row per item that asks."""
    return f"""{name} as (
      select *, list_transform(x, lambda e: e / len2) as u, row_number() over (
        partition by area_id, spu_sn order by dt desc, row_id desc) = 1 as asks,
        count(x) over (partition by area_id) as area_rows
      from (select *, sqrt(list_dot_product(x, x)) as len2
            from (select *, {vec}::DOUBLE[] as x from item_vectors)))"""


def pairs_sql(name: str, rows: str, extra: str = "true") -> str:
    return f"""{name} as (
      select q.row_id as q_row, c.row_id as c_row, q.area_id, q.spu_sn, c.spu_sn as neighbour,
        q.lv1 as q_lv1, c.lv1 as c_lv1, q.lv2 as q_lv2, c.lv2 as c_lv2, c.dt as c_dt,
        q.area_rows, round(list_dot_product(q.u, c.u), 9) as s
      from {rows} q join {rows} c on q.area_id = c.area_id and q.row_id <> c.row_id
      where q.asks and {extra})"""


def ranked_sql(name: str, source: str, rules: str, cap: int) -> str:
    """Rules, one row per candidate item, then the cap."""
    return f"""{name} as (
      select * from (
        select area_id, spu_sn, neighbour, s, row_number() over (
          partition by q_row order by s desc, c_row) as rnk
        from (select *, row_number() over (
                partition by q_row, neighbour order by s desc, c_row) as n
              from {source} where {rules} and spu_sn <> neighbour)
        where n = 1) where rnk <= {cap})"""


def limited_sql(name: str, source: str, limit: str) -> str:
    return f"""{name} as (
      select * from (select *, row_number() over (
        partition by q_row order by s desc, c_row) as place from {source})
      where place <= {limit})"""


def lists_sql(name: str, ranked: str) -> str:
    return f"""{name} as (
      select area_id, spu_sn, list(neighbour order by rnk) as neighbours
      from {ranked} group by area_id, spu_sn)"""


def merged_sql(name: str, first: str, second: str) -> str:
    return f"""{name} as (
      select coalesce(a.area_id, b.area_id) as area_id, coalesce(a.spu_sn, b.spu_sn) as spu_sn,
        list_concat(coalesce(a.neighbours, []),
          list_filter(coalesce(b.neighbours, []),
            lambda e: not list_contains(coalesce(a.neighbours, []), e))) as neighbours
      from {first} a full outer join {second} b on a.area_id = b.area_id and a.spu_sn = b.spu_sn)"""


RECENT = "(greatest(1, area_rows // 7) - 1)"
TEXT_RANKED = ",\n".join(
    [
        unit_rows_sql("text_rows", TEXT),
        pairs_sql("text_pairs", "text_rows"),
        ranked_sql("text_ranked", "text_pairs", "q_lv1 = c_lv1 and s > -0.6", 101),
    ]
)
IMAGE_RANKED = ",\n".join(
    [
        unit_rows_sql("image_rows", IMAGE),
        pairs_sql("image_pairs", "image_rows"),
        limited_sql("image_top", "image_pairs", "25"),
        ranked_sql("image_ranked", "image_top", "q_lv2 = c_lv2 and s > 0.15", 25),
    ]
)
TEXT_RECENT = ",\n".join(
    [
        unit_rows_sql("text_rows", TEXT),
        pairs_sql("text_pairs", "text_rows"),
        limited_sql("text_top", "text_pairs", RECENT),
        ranked_sql(
            "text_ranked",
            "text_top",
            f"q_lv1 = c_lv1 and s > -0.6 and c_dt = '{TARGET_DAY}'",
            101,
        ),
    ]
)
IMAGE_RECENT = ",\n".join(
    [
        unit_rows_sql("image_rows", IMAGE),
        pairs_sql("image_pairs", "image_rows"),
        limited_sql("image_top", "image_pairs", RECENT),
        ranked_sql(
            "image_ranked",
            "image_top",
            f"q_lv2 = c_lv2 and s > 0.15 and c_dt = '{TARGET_DAY}'",
            27,
        ),
    ]
)
MERGED = ",\n".join(
    [
        lists_sql("text_lists", "text_ranked"),
        lists_sql("image_lists", "image_ranked"),
        merged_sql("merged", "image_lists", "text_lists"),
    ]
)
SHOW = f"select area_id, spu_sn, rnk as rank, neighbour, {r5_sql('s')} as score from "


def shown(found):
    return found.select(
        F.col("q_area_id").alias("area_id"),
        F.col("q_spu_sn").alias("spu_sn"),
        "rank",
        F.col("c_spu_sn").alias("neighbour"),
        r5("score").alias("score"),
    )


TEXT_ARGS = dict(area="area_id", item="spu_sn", category="lv1", row_id="row_id", vec="text_vec")
IMAGE_ARGS = dict(area="area_id", item="spu_sn", category="lv2", row_id="row_id", vec="image_vec")


@query("similar_text", f"with {ITEM_VECTORS}, {TEXT_RANKED} {SHOW} text_ranked")
def similar_text(spark, folder):
    return shown(S.similar_after_rules(item_vectors(spark, folder), **TEXT_ARGS))


@query("similar_image", f"with {ITEM_VECTORS}, {IMAGE_RANKED} {SHOW} image_ranked")
def similar_image(spark, folder):
    return shown(S.similar_before_rules(item_vectors(spark, folder), **IMAGE_ARGS))


@query("similar_text_recent", f"with {ITEM_VECTORS}, {TEXT_RECENT} {SHOW} text_ranked")
def similar_text_recent(spark, folder):
    rows = item_vectors(spark, folder)
    return shown(
        S.similar_recent(rows, target_day=TARGET_DAY, min_score=-0.6, cap=101, **TEXT_ARGS)
    )


@query("similar_image_recent", f"with {ITEM_VECTORS}, {IMAGE_RECENT} {SHOW} image_ranked")
def similar_image_recent(spark, folder):
    rows = item_vectors(spark, folder)
    return shown(
        S.similar_recent(rows, target_day=TARGET_DAY, min_score=0.15, cap=27, **IMAGE_ARGS)
    )


CLOSE = 0.4  # the given vectors are spread wider than titles are; a threshold of 0.9 finds none


def unit_list(vec: str) -> str:
    return f"list_transform({vec}, lambda e: e / sqrt(list_dot_product({vec}, {vec})))"


@query(
    "similar_multimodal",
    f"""with {ITEM_VECTORS}, rows_ as (
      select row_id, spu_sn, list_concat({unit_list(TEXT + '::DOUBLE[]')},
        {unit_list(IMAGE + '::DOUBLE[]')}) as u from item_vectors),
    scored as (select q.row_id, q.spu_sn, c.row_id as c_row, c.spu_sn as neighbour,
        round(list_distance(q.u, c.u) * list_distance(q.u, c.u), 9) as d
      from rows_ q join rows_ c on q.row_id <> c.row_id),
    placed as (select *, row_number() over (partition by row_id order by d, c_row) as rank
      from scored)
    select row_id, spu_sn, cast(rank as integer) as rank, neighbour, {r5_sql('d')} as distance
    from placed where rank <= 12""",
)
def similar_multimodal(spark, folder):
    both = concat_modalities(F.col("text_vec"), F.col("image_vec"))
    rows = item_vectors(spark, folder).withColumn("both", both)
    found = S.nearest(rows, item="spu_sn", row_id="row_id", vec="both", k=13, metric="l2")
    return found.select(
        F.col("q_row").alias("row_id"),
        F.col("q_spu_sn").alias("spu_sn"),
        "rank",
        F.col("c_spu_sn").alias("neighbour"),
        r5(-F.col("score")).alias("distance"),
    )


@query(
    "similar_cosine_threshold",
    f"""with {ITEM_VECTORS}, rows_ as (
      select row_id, spu_sn, {unit_list(TEXT + '::DOUBLE[]')} as u from item_vectors),
    scored as (select q.row_id, q.spu_sn, c.row_id as c_row, c.spu_sn as neighbour,
        round(list_dot_product(q.u, c.u), 9) as s
      from rows_ q join rows_ c on q.row_id <> c.row_id),
    placed as (select *, row_number() over (partition by row_id order by s desc, c_row) as rank
      from scored)
    select row_id, spu_sn, rank, neighbour, {r5_sql('s')} as score
    from placed where rank <= 12 and s > {CLOSE}""",
)
def similar_cosine_threshold(spark, folder):
    found = S.nearest(
        item_vectors(spark, folder),
        item="spu_sn",
        row_id="row_id",
        vec="text_vec",
        k=13,
        min_score=CLOSE,
    )
    return found.select(
        F.col("q_row").alias("row_id"),
        F.col("q_spu_sn").alias("spu_sn"),
        "rank",
        F.col("c_spu_sn").alias("neighbour"),
        r5("score").alias("score"),
    )


@query(
    "merge_neighbours",
    f"""with {ITEM_VECTORS}, {TEXT_RANKED}, {IMAGE_RANKED}, {MERGED}
    select area_id, spu_sn, len(neighbours) as n, array_to_string(neighbours, ',') as neighbours
    from merged""",
)
def merged_lists(spark, folder):
    rows = item_vectors(spark, folder)
    text = S.neighbour_lists(S.similar_after_rules(rows, **TEXT_ARGS), jobs.KEYS, "c_spu_sn")
    image = S.neighbour_lists(S.similar_before_rules(rows, **IMAGE_ARGS), jobs.KEYS, "c_spu_sn")
    merged = merge_neighbours(image, text, ["area_id", "spu_sn"])
    return merged.select(
        "area_id",
        "spu_sn",
        F.size("neighbours").alias("n"),
        F.array_join("neighbours", ",").alias("neighbours"),
    )


def job_rows(spark, folder):
    return (
        item_vectors(spark, folder)
        .withColumnRenamed("lv1", jobs.TEXT_CATEGORY)
        .withColumnRenamed("lv2", jobs.IMAGE_CATEGORY)
    )


def published(lists, ttl_seconds, day=TARGET_DAY):
    key = dated_key(day, F.col("spu_sn"))
    now = F.lit(NOW).cast("timestamp")
    rows = kv.kv_rows(lists, key, now, ttl_seconds, keep=["area_id"])
    return rows.withColumn("expire_at", F.date_format("expire_at", "yyyy-MM-dd HH:mm:ss"))


PUBLISHED = """published as (
  select area_id, concat('20240103:', spu_sn) as key, array_to_string(neighbours, ',') as value,
    '{expires}' as expire_at from merged where len(neighbours) > 0)"""
IN_A_WEEK, IN_36_HOURS = "2024-01-17 00:00:00", "2024-01-11 12:00:00"


@query(
    "similar_items",
    f"""with {ITEM_VECTORS}, {TEXT_RANKED}, {IMAGE_RANKED}, {MERGED},
    {PUBLISHED.format(expires=IN_A_WEEK)} select * from published""",
)
def similar_items(spark, folder):
    return published(jobs.similar_items(job_rows(spark, folder)), kv.WEEK_SECONDS)


@query(
    "similar_items_recent",
    f"""with {ITEM_VECTORS}, {TEXT_RECENT}, {IMAGE_RECENT}, {MERGED},
    {PUBLISHED.format(expires=IN_36_HOURS)} select * from published""",
)
def similar_items_recent(spark, folder):
    lists = jobs.similar_items_recent(job_rows(spark, folder), TARGET_DAY)
    return published(lists, kv.DAY_AND_A_HALF)


@query(
    "kv_publish",
    f"""with {ITEM_VECTORS}, {IMAGE_RANKED}, {lists_sql('image_lists', 'image_ranked')},
    numbered as (select concat('similar:', spu_sn) as key, area_id,
        array_to_string(neighbours, ',') as value,
        row_number() over (partition by spu_sn order by area_id desc) as n from image_lists)
    select key, area_id, value, '{IN_A_WEEK}' as expire_at from numbered where n = 1""",
)
def kv_publish(spark, folder):
    found = S.similar_before_rules(item_vectors(spark, folder), **IMAGE_ARGS)
    lists = S.neighbour_lists(found, jobs.KEYS, "c_spu_sn")
    key = prefixed_key("similar:", F.col("spu_sn"))
    now = F.lit(NOW).cast("timestamp")
    rows = kv.kv_rows(lists, key, now, kv.WEEK_SECONDS, keep=["area_id"])
    winners = kv.one_value_per_key(rows, "area_id")
    return winners.withColumn("expire_at", F.date_format("expire_at", "yyyy-MM-dd HH:mm:ss"))


@query(
    "kv_copy",
    f"""with {ITEM_VECTORS} select concat('similar:', cast(row_id as varchar)) as key,
      case when lv2 = 0 then null else spu_sn end as value, '{IN_A_WEEK}' as expire_at
    from item_vectors where lv2 <> 0""",
)
def kv_copy(spark, folder):
    key = F.concat(F.lit("similar:"), F.col("row_id"))
    source = item_vectors(spark, folder).select(
        key.alias("key"), F.when(F.col("lv2") != 0, F.col("spu_sn")).alias("value")
    )
    copied = kv.kv_copy(source, F.lit(NOW).cast("timestamp"))
    return copied.withColumn("expire_at", F.date_format("expire_at", "yyyy-MM-dd HH:mm:ss"))

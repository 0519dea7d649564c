"""Product and media tables."""

from pyspark.sql import functions as F

from catalog.base import MEDIA, PRODUCT_DAILY, media, product_daily, query, table
from kindred.functions.keys import has_text
from kindred.operators import tables as T
from kindred.operators.ranking import running_sums
from kindred.operators.similar import latest_rows
from kindred.sources.media import fetch_manifest

DAY = "1998-06-15"
RECENT_DAY = "2001-06-01"
COLUMNS = "spu_sn, sku, area_id, product_name, product_title, dt"


@query("scan_day", f"with {PRODUCT_DAILY} select {COLUMNS} from product_daily where dt = '{DAY}'")
def scan_day(spark, folder):
    return T.scan_day(product_daily(spark, folder), DAY).select(*COLUMNS.split(", "))


@query(
    "scan_recent_days",
    f"with {PRODUCT_DAILY} select {COLUMNS} from product_daily where dt >= '2001-05-25'",
)
def scan_recent_days(spark, folder):
    recent = T.scan_recent_days(product_daily(spark, folder), RECENT_DAY, 7)
    return recent.select(*COLUMNS.split(", "))


GAPS = "case when product_title is null then null when area_id = 4 then '' else sku end"


@query(
    "filter_valid_sku",
    f"""with {PRODUCT_DAILY}, gaps as (select spu_sn, area_id, dt, {GAPS} as sku from product_daily)
    select * from gaps where sku is not null and sku <> ''""",
)
def filter_valid_sku(spark, folder):
    gaps = product_daily(spark, folder).select("spu_sn", "area_id", "dt", F.expr(GAPS).alias("sku"))
    return T.valid_sku(gaps)


@query(
    "canonical_id",
    """with ids as (select l_orderkey, l_partkey, l_linenumber * 1.0::DOUBLE as img_id,
      case when l_returnflag = 'R' then 'nan'::DOUBLE else l_quantity - 10.5 end as sku
      from lineitem)
    select l_orderkey, l_partkey, cast(cast(img_id as bigint) as varchar) as img_id,
      cast(cast(trunc(sku) as bigint) as varchar) as sku
    from ids where not isnan(sku) and sku > 0""",
)
def canonical_id(spark, folder):
    line = table(spark, folder, "lineitem")
    missing = F.when(F.col("l_returnflag") == "R", F.lit(float("nan")))
    ids = line.select(
        "l_orderkey",
        "l_partkey",
        F.col("l_linenumber").cast("double").alias("img_id"),
        missing.otherwise(F.col("l_quantity") - 10.5).alias("sku"),
    )
    return T.with_canonical_ids(ids, ["sku", "img_id"], positive="sku")


@query(
    "quarantine_rows",
    f"""with {PRODUCT_DAILY}, marked as (select spu_sn, area_id, dt,
      case when product_title is null then 'title' else '' end as a,
      case when area_id = 4 then 'area' else '' end as b from product_daily)
    select spu_sn, area_id, dt,
      case when a <> '' and b <> '' then concat(a, ',', b) else concat(a, b) end as error
    from marked""",
)
def quarantine_rows(spark, folder):
    rows = product_daily(spark, folder).select("spu_sn", "area_id", "dt", "product_title")
    good, bad = T.quarantine(
        rows, {"title": has_text(F.col("product_title")), "area": F.col("area_id") != 4}
    )
    return good.withColumn("error", F.lit("")).unionByName(bad).drop("product_title")


@query("area_list", f"with {PRODUCT_DAILY} select distinct area_id from product_daily")
def area_list(spark, folder):
    return T.distinct_values(product_daily(spark, folder), "area_id")


@query(
    "job_counts",
    f"""with {PRODUCT_DAILY}, {MEDIA}
    select 'products' as name, count(*) as "rows" from product_daily
    union all select 'areas', count(distinct area_id) from product_daily
    union all select 'media', count(*) from media""",
)
def job_counts(spark, folder):
    products = product_daily(spark, folder)
    return T.job_counts(
        {
            "products": products,
            "areas": T.distinct_values(products, "area_id"),
            "media": media(spark, folder),
        }
    )


DIGITS = "'0123456789'"
TITLE = f"""trim(regexp_replace(concat(
  translate(first_level_category_name, {DIGITS}, ''), ' ',
  translate(second_level_category_name, {DIGITS}, ''), ' ',
  coalesce(product_name, ''), ' ', translate(coalesce(product_title, ''), {DIGITS}, '')),
  '\\s+', ' ', 'g'))"""


@query(
    "gen_title",
    f"with {PRODUCT_DAILY} select spu_sn, area_id, dt, {TITLE} as title from product_daily",
)
def gen_title(spark, folder):
    return T.with_title(product_daily(spark, folder)).select("spu_sn", "area_id", "dt", "title")


@query(
    "product_dim",
    f"""with {PRODUCT_DAILY} select sku, max(product_name) as product_name,
      max(product_title) as product_title,
      max(first_level_category_name) as first_level_category_name,
      max(second_level_category_name) as second_level_category_name
    from product_daily group by sku""",
)
def product_dim(spark, folder):
    names = (
        "product_name",
        "product_title",
        "first_level_category_name",
        "second_level_category_name",
    )
    return T.product_dim(product_daily(spark, folder), "sku", {n: n for n in names})


@query(
    "latest_item_row",
    f"""with {PRODUCT_DAILY}, numbered as (select *, row_number() over (
      partition by area_id, spu_sn order by dt desc, sku desc) as n from product_daily)
    select spu_sn, area_id, dt, sku, product_title from numbered where n = 1""",
)
def latest_item_row(spark, folder):
    rows = product_daily(spark, folder).select("spu_sn", "area_id", "dt", "sku", "product_title")
    return latest_rows(rows, ["area_id", "spu_sn"], ["dt", "sku"])


@query(
    "training_view",
    f"""with {PRODUCT_DAILY} select spu_sn, product_name, dt, second_level_category_id as labels
    from product_daily""",
)
def training_view(spark, folder):
    rows = product_daily(spark, folder).select(
        "spu_sn", "product_name", "dt", "sku", "area_id", "second_level_category_id"
    )
    return T.training_view(rows, ["sku", "area_id"], "second_level_category_id")


NUMBERED = """numbered as (
  select spusn, id, originalimgurl, row_number() over (
    partition by spusn order by id, originalimgurl) - 1 as n
  from media where imgtype in ('PRIMARY'))"""


@query(
    "rank_images",
    f"""with {PRODUCT_DAILY}, {MEDIA}, {NUMBERED}
    select p.spu_sn, p.sku, p.area_id, m.originalimgurl, cast(m.n as varchar) as img_id
    from product_daily p left join numbered m on p.spu_sn = m.spusn
    where p.dt = '{DAY}' and p.sku is not null""",
)
def rank_images(spark, folder):
    products = T.scan_day(product_daily(spark, folder), DAY).where("sku is not null")
    return T.rank_images(
        products.select("spu_sn", "sku", "area_id"),
        media(spark, folder),
        item="spu_sn",
        media_item="spusn",
        media_id="id",
        url="originalimgurl",
        kinds=["PRIMARY"],
        kind="imgtype",
    )


@query(
    "latest_media",
    f"""with {MEDIA}
    select spusn, arg_max(originalimgurl, id) as originalimgurl from media
    where imgtype = 'DETAIL' group by spusn""",
)
def latest_media(spark, folder):
    newest = F.col("imgtype") == "DETAIL"
    return T.latest_media(media(spark, folder), "spusn", "id", "originalimgurl", newest)


@query(
    "active_items",
    "select distinct o_custkey, o_orderpriority from orders where o_orderstatus = 'O'",
)
def active_items(spark, folder):
    orders = table(spark, folder, "orders")
    return T.active_items(orders, F.col("o_orderstatus") == "O", ["o_custkey", "o_orderpriority"])


@query(
    "fetch_manifest",
    f"""with {MEDIA}, {NUMBERED}, planned as (select spusn as item, cast(n as bigint) as n,
      originalimgurl as url, concat('/images/', spusn, '/', cast(n as varchar), '.jpg') as path, id
      from numbered)
    select item, n, url, path from planned
    where path not in (select path from planned where id % 2 = 0)""",
)
def manifest(spark, folder):
    numbered = running_sums(
        media(spark, folder).where("imgtype in ('PRIMARY')"),
        ["spusn"],
        "id",
        {"_place": F.lit(1)},
        ties=["originalimgurl"],
    )
    n = (F.col("_place") - 1).alias("n")
    wanted = numbered.select(
        F.col("spusn").alias("item"), n, F.col("originalimgurl").alias("url"), "id"
    )
    path = F.concat(F.lit("/images/"), "item", F.lit("/"), F.col("n"), F.lit(".jpg"))
    existing = wanted.where("id % 2 = 0").select(path.alias("path"))
    return fetch_manifest(wanted, existing, "/images")

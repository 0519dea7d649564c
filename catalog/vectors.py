"""Vector functions, class scores and embedding tables."""

import uuid

from pyspark.sql import functions as F

from catalog.base import (
    ITEM_VECTORS,
    hash_vector_sql,
    item_vectors,
    load_hash_model,
    query,
    r5,
    r5_sql,
    unnested,
    unnested_sql,
)
from catalog.similarity import IMAGE, TEXT, unit_list
from kindred.functions import vectors as V
from kindred.functions.codec import decode_vector, encode_vector
from kindred.operators import evaluate as E
from kindred.operators import merge as M
from kindred.operators.embed import mean_pool_images, mean_vector
from kindred.operators.losses import Head, class_losses
from kindred.operators.scoring import best_class, class_scores
from kindred.plans import jobs
from kindred.session import scratch_path
from kindred.sources import tables as W
from kindred.sources.images import RGB_MEAN, RGB_STD

STAMP = "2024-01-10"
WHOLE = "embedding::DOUBLE[]"


@query(
    "l2_normalize",
    f"with {ITEM_VECTORS}, u as (select row_id, {unit_list(WHOLE)} as vec from item_vectors) "
    + unnested_sql("u", "row_id", "vec"),
)
def l2_normalize(spark, folder):
    return unnested(item_vectors(spark, folder), ["row_id"], V.l2_normalize(F.col("embedding")))


@query(
    "concat_modalities",
    f"""with {ITEM_VECTORS}, u as (select row_id, list_concat(
      {unit_list(TEXT + '::DOUBLE[]')}, {unit_list(IMAGE + '::DOUBLE[]')}) as vec
      from item_vectors) """
    + unnested_sql("u", "row_id", "vec"),
)
def concat_modalities(spark, folder):
    both = V.concat_modalities(F.col("text_vec"), F.col("image_vec"))
    return unnested(item_vectors(spark, folder), ["row_id"], both)


@query(
    "pair_features",
    f"""with {ITEM_VECTORS}, p as (select a.row_id, list_concat(list_concat(
      a.{WHOLE}, b.{WHOLE}), list_transform(list_zip(a.{WHOLE}, b.{WHOLE}),
      lambda e: abs(e[1] - e[2]))) as vec
      from item_vectors a join item_vectors b on b.row_id = a.row_id + 1) """
    + unnested_sql("p", "row_id", "vec"),
)
def pair_features(spark, folder):
    rows = item_vectors(spark, folder).select("row_id", "embedding")
    after = rows.select((F.col("row_id") - 1).alias("row_id"), F.col("embedding").alias("other"))
    features = V.pair_features(F.col("embedding"), F.col("other"))
    return unnested(rows.join(after, "row_id"), ["row_id"], features)


@query(
    "mean_pool",
    f"""with {ITEM_VECTORS}, images as (
      select row_id // 9 as item, row_id % 9 + case when lv2 = 3 then 1 else 0 end as n,
        row_id, {WHOLE} as v from item_vectors),
    single as (select * from (select *, row_number() over (
      partition by item, n order by row_id) as k from images where n between 0 and 7) where k = 1),
    prefix as (select * from (select *, row_number() over (
      partition by item order by n) - 1 as place from single) where place = n),
    parts as (select item, unnest(v) as x, unnest(range(0, 64)) as pos from prefix)
    select item, cast(pos as integer) as pos, {r5_sql('avg(x)')} as value, count(*) as images
    from parts group by item, pos""",
)
def mean_pool(spark, folder):
    n = F.col("row_id") % 9 + F.when(F.col("lv2") == 3, 1).otherwise(0)
    images = item_vectors(spark, folder).select(
        F.floor(F.col("row_id") / 9).alias("item"), n.alias("n"), "row_id", "embedding"
    )
    pooled = mean_pool_images(images, "item", "n", "row_id", "embedding")
    return unnested(pooled, ["item", "images"], "vec")


@query(
    "encode_vector",
    f"""with {ITEM_VECTORS} select row_id, '[' as head, ']' as tail, len(embedding) - 1 as commas
    from item_vectors""",
)
def encoded(spark, folder):
    text = encode_vector(F.col("embedding"))
    return item_vectors(spark, folder).select(
        "row_id",
        F.substring(text, 1, 1).alias("head"),
        F.substring(text, -1, 1).alias("tail"),
        F.regexp_count(text, F.lit(",")).alias("commas"),
    )


@query(
    "decode_vector", f"with {ITEM_VECTORS} " + unnested_sql("item_vectors", "row_id", WHOLE)
)
def decoded(spark, folder):
    text = encode_vector(F.col("embedding"))
    rows = item_vectors(spark, folder).select("row_id", decode_vector(text).alias("v"))
    return unnested(rows, ["row_id"], F.col("v").cast("array<double>"))


@query(
    "pixel_normalize",
    f"""with {ITEM_VECTORS}, p as (select row_id, list_transform({WHOLE},
      lambda e, i: (floor((e + 1.0) * 127.5) / 255.0::DOUBLE
        - list_extract(cast([0.485, 0.456, 0.406] as DOUBLE[]), (i - 1) % 3 + 1))
        / list_extract(cast([0.229, 0.224, 0.225] as DOUBLE[]), (i - 1) % 3 + 1)) as vec
      from item_vectors) """
    + unnested_sql("p", "row_id", "vec"),
)
def pixel_normalize(spark, folder):
    bytes_ = F.transform(V.as_double(F.col("embedding")), lambda e: F.floor((e + 1.0) * 127.5))
    normal = V.pixel_normalize(bytes_, RGB_MEAN, RGB_STD)
    return unnested(item_vectors(spark, folder), ["row_id"], normal)


# --- scores against classes --------------------------------------------------------------------


def centres_sql(name: str, label: str) -> str:
    """Mean vector per label."""
    return f"""{name} as (
      select class_id, list(m order by i) as w from (
        select class_id, i, avg(x) as m from (
          select {label} as class_id, unnest({WHOLE}) as x, unnest(range(0, 64)) as i
          from item_vectors) group by class_id, i) group by class_id)"""


def scores_sql(name: str, centres: str, label: str) -> str:
    """Cosine scores, and scores with the angular margin at the true class."""
    threshold, fallback = "cos(pi() - 0.4)", "sin(pi() - 0.4) * 0.4"
    return f"""{name} as (
      select row_id, area_id, label, class_id, c, 64.0::DOUBLE * case when class_id <> label then c
          when c > {threshold} then c * cos(0.4) - sqrt(greatest(0.0, 1.0 - c * c)) * sin(0.4)
          else c - {fallback} end as s
      from (select row_id, area_id, {label} as label, class_id,
          list_dot_product({WHOLE}, w) / sqrt(list_dot_product({WHOLE}, {WHOLE}))
            / sqrt(list_dot_product(w, w)) as c
        from item_vectors, {centres}))"""


def losses_sql(name: str, scores: str) -> str:
    return f"""{name} as (
      select row_id, ln(sum(exp(s - top))) + max(top) - max(case when class_id = label then s end)
        as loss
      from (select *, max(s) over (partition by row_id) as top from {scores}) group by row_id)"""


LV1 = centres_sql("lv1_centres", "lv1") + ", " + scores_sql("lv1_scores", "lv1_centres", "lv1")
LV2 = centres_sql("lv2_centres", "lv2") + ", " + scores_sql("lv2_scores", "lv2_centres", "lv2")
TAG = (
    centres_sql("tag_centres", "row_id % 20")
    + ", "
    + scores_sql("tag_scores", "tag_centres", "row_id % 20")
)
TOP1 = """top1 as (
  select row_id, area_id, label, class_id as top1 from (select *, row_number() over (
    partition by row_id order by c desc, class_id) as n from lv2_scores) where n = 1)"""


def cosine_scores(spark, folder, label):
    """Scores of every row against the mean vector of each label."""
    rows = item_vectors(spark, folder).withColumn("label", label.cast("bigint"))
    centres = mean_vector(rows, ["label"], F.col("embedding"))
    return class_scores(
        rows,
        centres.withColumnsRenamed({"vec": "weights", "label": "class_id"}),
        row_id="row_id",
        vec="embedding",
        class_id="class_id",
        weights="weights",
        carry=["area_id", "label"],
        cosine=True,
    )


def exploded(df, keys, scores):
    return df.select(*keys, F.posexplode(scores).alias("class_id", "_s")).select(
        *keys, "class_id", r5("_s").alias("score")
    )


@query(
    "cosine_class_scores",
    f"""with {ITEM_VECTORS}, {LV2}
    select row_id, class_id, {r5_sql('c')} as score from lv2_scores""",
)
def cosine_class_scores(spark, folder):
    return exploded(cosine_scores(spark, folder, F.col("lv2")), ["row_id"], "scores")


@query(
    "margin_scores",
    f"""with {ITEM_VECTORS}, {LV2}
    select row_id, class_id, {r5_sql('s')} as score from lv2_scores""",
)
def margin_scores(spark, folder):
    scored = cosine_scores(spark, folder, F.col("lv2"))
    return exploded(scored, ["row_id"], V.margin_scores(F.col("scores"), F.col("label")))


@query(
    "linear_score",
    f"""with {ITEM_VECTORS}, {centres_sql('weights', 'case when lv2 < 5 then 0 else 1 end')}
    select row_id, class_id, {r5_sql(f'list_dot_product({WHOLE}, w) + w[1]')} as score
    from item_vectors, weights""",
)
def linear_score(spark, folder):
    rows = item_vectors(spark, folder)
    half = F.when(F.col("lv2") < 5, 0).otherwise(1).alias("class_id")
    weights = mean_vector(rows.select(half, "embedding"), ["class_id"], F.col("embedding"))
    scored = class_scores(
        rows,
        weights.withColumn("bias", F.col("vec")[0]),
        row_id="row_id",
        vec="embedding",
        class_id="class_id",
        weights="vec",
        bias="bias",
    )
    return exploded(scored, ["row_id"], "scores")


@query(
    "cross_entropy",
    f"""with {ITEM_VECTORS}, {LV2}, {losses_sql('losses', 'lv2_scores')}
    select row_id, {r5_sql('loss')} as loss from losses""",
)
def cross_entropy(spark, folder):
    rows = item_vectors(spark, folder)
    losses = class_losses(
        rows, {"loss": centre_head(rows, "lv2")}, row_id="row_id", vec="embedding"
    )
    return losses.select("row_id", r5("loss").alias("loss"))


def centre_head(rows, label):
    """The mean vectors of a label as classes."""
    centres = mean_vector(rows, [label], F.col("embedding"))
    return Head(centres.withColumnsRenamed({"vec": "weights", label: "class_id"}), label)


@query(
    "multitask_loss",
    f"""with {ITEM_VECTORS}, {LV1}, {LV2}, {TAG}, {losses_sql('l1', 'lv1_scores')},
    {losses_sql('l2', 'lv2_scores')}, {losses_sql('l3', 'tag_scores')}
    select row_id, {r5_sql('10.0 * l1.loss + 5.0 * l2.loss + l3.loss')} as loss
    from l1 join l2 using (row_id) join l3 using (row_id)""",
)
def multitask_loss(spark, folder):
    rows = item_vectors(spark, folder).withColumn("tag", F.col("row_id") % 20)
    heads = {"l1": centre_head(rows, "lv1"), "l2": centre_head(rows, "lv2"), "l3": centre_head(rows, "tag")}
    losses = class_losses(rows, heads, row_id="row_id", vec="embedding")
    total = V.multitask_loss(F.col("l1"), F.col("l2"), F.col("l3"))
    return losses.select("row_id", r5(total).alias("loss"))


def predictions(spark, folder):
    rows = item_vectors(spark, folder).withColumn("label", F.col("lv2").cast("bigint"))
    centres = mean_vector(rows, ["label"], F.col("embedding"))
    best = best_class(
        rows,
        centres.withColumnsRenamed({"vec": "weights", "label": "class_id"}),
        row_id="row_id",
        vec="embedding",
        class_id="class_id",
        weights="weights",
        carry=["area_id", "label"],
        cosine=True,
    )
    return best.select("row_id", "area_id", "label", F.col("class_id").alias("top1"))


@query(
    "top1_label",
    f"with {ITEM_VECTORS}, {LV2}, {TOP1} select row_id, label, top1 from top1",
)
def top1_label(spark, folder):
    return predictions(spark, folder).drop("area_id")


@query(
    "accuracy",
    f"""with {ITEM_VECTORS}, {LV2}, {TOP1} select area_id, count(*) as "rows",
      {r5_sql('avg(case when top1 = label then 1.0::DOUBLE else 0.0::DOUBLE end)')} as accuracy
    from top1 group by area_id""",
)
def accuracy(spark, folder):
    scored = E.accuracy(predictions(spark, folder), F.col("top1"), F.col("label"), ["area_id"])
    return scored.withColumn("accuracy", r5("accuracy"))


@query(
    "micro_f1",
    f"""with {ITEM_VECTORS}, {LV2}, {TOP1}, counted as (
      select count(*) filter (where top1 = label) as tp,
        count(*) filter (where top1 <> label) as fp, count(*) filter (where top1 <> label) as fn
      from top1)
    select tp, fp, fn, {r5_sql('2.0::DOUBLE * tp / (2 * tp + fp + fn)')} as micro_f1
    from counted""",
)
def micro_f1(spark, folder):
    scored = E.micro_f1(predictions(spark, folder), F.col("top1"), F.col("label"))
    return scored.withColumn("micro_f1", r5("micro_f1"))


@query(
    "precision_recall_at_1",
    f"""with {ITEM_VECTORS}, {LV2}, {TOP1}, h as (select count(*) as n, 2 * count(*) as labels,
      count(*) filter (where top1 in (label, row_id % 10)) as hits from top1)
    select n as "rows", {r5_sql('hits * 1.0::DOUBLE / n')} as precision_at_1,
      {r5_sql('hits * 1.0::DOUBLE / labels')} as recall_at_1 from h""",
)
def precision_recall_at_1(spark, folder):
    labels = F.array(F.col("label"), F.col("row_id") % 10)
    report = E.precision_recall_at_1(
        predictions(spark, folder), F.col("top1").cast("bigint"), labels
    )
    return report.withColumns({c: r5(c) for c in ("precision_at_1", "recall_at_1")})


# --- embedding tables --------------------------------------------------------------------------


def one_per_item(rows, vec, name):
    """Encoded vectors, one row per item: the latest."""
    latest = M.one_row_per_key(rows.select("spu_sn", "dt", "row_id", vec), "spu_sn", ["dt", "row_id"])
    return jobs.encoded_rows(
        latest.withColumnRenamed("spu_sn", "goods_sku"), "goods_sku", F.col(vec), name
    )


def old_items(rows):
    return rows.where("row_id < 250")


def unit_float(vec: str) -> str:
    """A unit vector as it is stored: rounded to float."""
    return f"list_transform({unit_list(vec)}, lambda e: e::FLOAT::DOUBLE)"


def latest_sql(name: str, vec: str, condition: str) -> str:
    return f"""{name} as (
      select spu_sn as goods_sku, {unit_float(vec + '::DOUBLE[]')} as vec from (
        select *, row_number() over (partition by spu_sn order by dt desc, row_id desc) as n
        from item_vectors where {condition}) where n = 1)"""


HASHED_ITEM = hash_vector_sql("spu_sn")
OLD = latest_sql("old", TEXT, "row_id < 250")
GROWN = f"""{OLD},
    fresh_ as (select distinct spu_sn, list_transform({HASHED_ITEM}, lambda e: e::FLOAT::DOUBLE) as h
      from item_vectors where spu_sn not in (select goods_sku from old)),
    grown as (select goods_sku, vec from old
      union all select spu_sn, {unit_float('h')} from fresh_)"""
GROWN_ROWS = (
    f"with {ITEM_VECTORS}, {GROWN}, stamped as (select *, '{STAMP}' as modifydate from grown) "
    + unnested_sql("stamped", "goods_sku, modifydate", "vec")
)


@query(
    "new_items",
    f"""with {ITEM_VECTORS} select distinct spu_sn from item_vectors
    where spu_sn not in (select spu_sn from item_vectors where row_id < 250)""",
)
def new_items(spark, folder):
    rows = item_vectors(spark, folder)
    return M.new_items(rows.select("spu_sn").distinct(), old_items(rows), "spu_sn")


def grown_table(rows, old):
    items = rows.select(F.col("spu_sn").alias("goods_sku")).distinct()
    return jobs.incremental_embeddings(
        items,
        old,
        key="goods_sku",
        inputs=["goods_sku"],
        load_model=load_hash_model,
        name="bert_emb",
        day=STAMP,
    )


def read_back(df, name):
    vec = decode_vector(F.col(name)).cast("array<double>")
    return unnested(df.select("goods_sku", "modifydate", vec.alias("v")), ["goods_sku", "modifydate"], "v")


@query("incremental_embeddings", GROWN_ROWS)
def incremental_embeddings(spark, folder):
    rows = item_vectors(spark, folder)
    old = one_per_item(old_items(rows), "text_vec", "bert_emb")
    old = old.withColumn("modifydate", F.lit("2024-01-09"))
    return read_back(grown_table(rows, old), "bert_emb")


@query("publish_embedding", GROWN_ROWS)
def publish_embedding(spark, folder):
    rows = item_vectors(spark, folder)
    old = one_per_item(old_items(rows), "text_vec", "bert_emb")
    schema = W.embedding_schema("goods_sku", "bert_emb")
    name = f"embedding_{uuid.uuid4().hex}"
    W.write_table(
        old.withColumn("modifydate", F.lit("2024-01-09")), name, schema, scratch_path(spark, name)
    )
    W.stage_and_publish(grown_table(rows, spark.table(name)), name, schema)
    return read_back(spark.table(name), "bert_emb")


@query(
    "write_embedding_table",
    f"with {ITEM_VECTORS}, {latest_sql('t', TEXT, 'true')}, "
    f"stamped as (select *, '{STAMP}' as modifydate from t) "
    + unnested_sql("stamped", "goods_sku, modifydate", "vec"),
)
def write_embedding_table(spark, folder):
    rows = one_per_item(item_vectors(spark, folder), "text_vec", "fasttext_emb")
    name = f"embedding_{uuid.uuid4().hex}"
    W.write_table(
        rows.withColumn("modifydate", F.lit(STAMP)),
        name,
        W.embedding_schema("goods_sku", "fasttext_emb"),
        scratch_path(spark, name),
    )
    return read_back(spark.table(name), "fasttext_emb")


@query(
    "refresh_embeddings",
    f"""with {ITEM_VECTORS}, {latest_sql('cache', IMAGE, 'lv2 <> 0')},
    kept as (select c.*, '{STAMP}' as modifydate from cache c
      where goods_sku in (select spu_sn from item_vectors)) """
    + unnested_sql("kept", "goods_sku, modifydate", "vec"),
)
def refresh_embeddings(spark, folder):
    rows = item_vectors(spark, folder)
    items = rows.select(F.col("spu_sn").alias("goods_sku")).distinct()
    cached = rows.where("lv2 <> 0").select("spu_sn", "dt", "row_id", "image_vec")
    cache = M.one_row_per_key(cached, "spu_sn", ["dt", "row_id"])
    table = jobs.refresh_embeddings(
        items,
        cache.withColumnRenamed("spu_sn", "goods_sku"),
        key="goods_sku",
        vec="image_vec",
        name="cv_emb",
        day=STAMP,
    )
    return read_back(table, "cv_emb")


def size_and_head_sql(alias: str, name: str) -> str:
    return (
        f"coalesce(len({alias}.vec), 0) as {name}_n, "
        f"case when {alias}.vec is not null then {r5_sql(alias + '.vec[1]')} end as {name}_first"
    )


@query(
    "merge_modalities",
    f"""with {ITEM_VECTORS}, {latest_sql('a', TEXT, 'area_id <> 3')},
    {latest_sql('b', 'embedding', 'area_id <> 2')}, {latest_sql('c', IMAGE, 'lv2 <> 0')}
    select coalesce(a.goods_sku, b.goods_sku, c.goods_sku) as goods_sku,
      {size_and_head_sql('a', 'fasttext')}, {size_and_head_sql('b', 'bert')},
      {size_and_head_sql('c', 'cv')}, '{STAMP}' as modifydate
    from a full outer join b on a.goods_sku = b.goods_sku
    full outer join c on c.goods_sku = coalesce(a.goods_sku, b.goods_sku)""",
)
def merge_modalities(spark, folder):
    rows = item_vectors(spark, folder)
    wide = M.merge_modalities(
        [
            one_per_item(rows.where("area_id <> 3"), "text_vec", "fasttext_emb"),
            one_per_item(rows.where("area_id <> 2"), "embedding", "bert_emb"),
            one_per_item(rows.where("lv2 <> 0"), "image_vec", "cv_emb"),
        ],
        "goods_sku",
        STAMP,
    )
    columns = []
    for name in ("fasttext", "bert", "cv"):
        vec = decode_vector(F.col(name + "_emb")).cast("array<double>")
        columns.append(F.coalesce(F.size(vec), F.lit(0)).alias(name + "_n"))
        columns.append(r5(F.get(vec, F.lit(0))).alias(name + "_first"))
    return wide.select("goods_sku", *columns, "modifydate")

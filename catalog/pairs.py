"""Training sets."""

from pyspark.sql import functions as F

from catalog.base import PAIR_ITEMS, hash_sql, pair_items, query, r5, r5_sql, unit_sql
from catalog.texts import words_sql
from kindred.operators import sampling as S
from kindred.operators.tokens import build_vocabulary, tokenize_pad
from kindred.session import materialize, never_broadcast

SEED = "2024"
BATCH = 32


@query(
    "class_weights",
    f"""with {PAIR_ITEMS} select item_id, tag_id, count(*) over (partition by tag_id)
      as class_count, {r5_sql('1.0::DOUBLE / count(*) over (partition by tag_id)')} as weight
    from pair_items""",
)
def class_weights(spark, folder):
    weighted = S.class_weights(pair_items(spark, folder).select("item_id", "tag_id"), "tag_id")
    return weighted.withColumn("weight", r5("weight"))


@query(
    "weighted_sample",
    f"""with {PAIR_ITEMS}, tagged as (
      select item_id, nullif(tag_id, -1) as tag_id from pair_items), rows_ as (select item_id, tag_id, row_number() over (
        partition by tag_id order by {unit_sql(SEED + ':order', 'item_id')}, item_id) - 1 as idx
      from tagged),
    classes as (select tag_id, n, row_number() over (
        order by {unit_sql(SEED + ':class', 'tag_id')}, tag_id) - 1 as class_idx
      from (select tag_id, count(*) as n from tagged group by tag_id)),
    draws as (select item_id as draw_id, {hash_sql(SEED + ':pick', 'item_id')}
        % (select count(*) from classes) as class_idx from pair_items)
    select d.draw_id, r.item_id, r.tag_id from draws d join classes c using (class_idx)
    join rows_ r on r.tag_id is not distinct from c.tag_id and r.idx = {hash_sql(SEED + ':row', 'd.draw_id')} % c.n""",
)
def weighted_sample(spark, folder):
    tag = F.when(F.col("tag_id") != -1, F.col("tag_id"))  # items without tag are a class
    items = pair_items(spark, folder).withColumn("tag_id", tag)
    return S.weighted_sample(items, "item_id", "tag_id", SEED)


@query(
    "shuffle_rows",
    f"""with {PAIR_ITEMS} select item_id, title, row_number() over (
      order by {unit_sql(SEED, 'item_id')}, item_id) - 1 as position from pair_items""",
)
def shuffle_rows(spark, folder):
    placed = S.shuffled_positions(pair_items(spark, folder), "item_id", SEED)
    return placed.select("item_id", "title", "position")


@query(
    "batch_rows",
    f"""with {PAIR_ITEMS}, placed as (select item_id, row_number() over (
        order by {unit_sql(SEED, 'item_id')}, item_id) - 1 as position, count(*) over () as n
      from pair_items)
    select item_id, position // {BATCH} as batch_id, position % {BATCH} as slot from placed
    where position // {BATCH} < n // {BATCH}""",
)
def batch_rows(spark, folder):
    rows = pair_items(spark, folder).select("item_id")
    return S.batch_rows(rows, "item_id", SEED, BATCH)


KINDS = {
    "same lv1": ("lv1_category_id", "sku_sn_name", 1),
    "same lv2": ("lv2_category_id", "sku_sn_name", 1),
    "same tag": ("cast(tag_id as varchar)", "sku_sn_name", 3),
    "other tag": ("lv2_category_id", "cast(tag_id as varchar)", 1),
    "other lv2": ("lv1_category_id", "lv2_category_id", 1),
    "other lv1": ("''", "lv1_category_id", 1),
}
MEMBERS = " union all ".join(
    f"select '{kind}' as kind, {grp} as grp, {blk} as blk, {least} as least, item_id, title, "
    f"{unit_sql(SEED + ':order', 'item_id')} as u from pair_items"
    for kind, (grp, blk, least) in KINDS.items()
)
SIDE, RULE = unit_sql(SEED + ":side", "item_id"), unit_sql(SEED + ":rule", "item_id")
DRAWS = " union all ".join(
    f"select *, {n} as attempt, {hash_sql(f'{SEED}:draw{n}', 'item_id')} % allowed as j from own "
    + ("" if n == 0 else "where kind like 'other%'")
    for n in range(S.NEGATIVE_DRAWS)
)
ENDS = " union all ".join(
    f"""select * from (
      select kind, grp, {side} as side, title, blk, cand_id, row_number() over (
        partition by kind, grp order by title {way}, blk {way}, cand_id {way}) as n
      from (select *, row_number() over (
          partition by kind, grp, blk order by title {way}, cand_id {way}) as k from members)
      where k = 1) where n <= 2"""
    for side, way in ((0, "asc"), (1, "desc"))
)
PAIRS = f"""members as materialized (select *, item_id as cand_id from ({MEMBERS})),
  placed as materialized (select *,
    row_number() over (partition by kind, grp order by blk, u, item_id) - 1 as idx,
    count(*) over (partition by kind, grp) as group_rows,
    count(*) over (partition by kind, grp, blk) as block_rows from members),
  indexed as materialized (select *, min(idx) over (partition by kind, grp, blk) as block_start
    from placed),
  asked as (select item_id, title, {SIDE} as side, {RULE} as rule, tag_id from pair_items),
  kinds as materialized (select item_id, title, case when side > 0.5 then
      case when rule < 0.1 then 'same lv1' when rule < 0.2 or tag_id = -1 then 'same lv2'
           when rule < 0.7 then 'same tag' end
    else case when rule < 0.1 and tag_id <> -1 then 'other tag' when rule < 0.2 then 'other lv2'
           when rule < 0.7 then 'other lv1' end end as kind from asked),
  own as materialized (select i.item_id, i.kind, i.grp, i.blk, i.title, i.block_start,
      i.block_rows, i.group_rows - i.block_rows as allowed
    from indexed i join kinds k on i.item_id = k.item_id and i.kind = k.kind
    where i.group_rows - i.block_rows >= i.least),
  draws as ({DRAWS}),
  drawn as (select d.item_id, d.kind, d.attempt, d.title, i.cand_id, i.title as cand_title
    from draws d join indexed i on i.kind = d.kind and i.grp = d.grp
      and i.idx = case when d.j >= d.block_start then d.j + d.block_rows else d.j end
    where d.kind like 'same%' or i.title <> d.title),
  picked as materialized (select item_id, arg_min(cand_id, attempt) as cand_id,
      arg_min(cand_title, attempt) as cand_title from drawn group by item_id),
  ends as ({ENDS}),
  rescued as (select o.item_id, arg_min(e.cand_id, e.side * 10 + e.n) as cand_id,
      arg_min(e.title, e.side * 10 + e.n) as cand_title
    from own o join ends e on e.kind = o.kind and e.grp = o.grp
    where o.kind like 'other%' and o.item_id not in (select item_id from picked)
      and e.blk <> o.blk and e.title <> o.title group by o.item_id),
  found as (select * from picked union all select * from rescued),
  pairs as (select k.item_id as id, k.title as query, coalesce(f.cand_title, k.title) as title,
      case when f.cand_id is not null and k.kind like 'other%' then 0 else 1 end as label,
      case when f.cand_id is not null then k.kind else 'self' end as kind, f.cand_id
    from kinds k left join found f on k.item_id = f.item_id)"""


def mined(spark, folder):
    return S.mine_pairs(
        pair_items(spark, folder),
        row_id="item_id",
        name="sku_sn_name",
        title="title",
        lv1="lv1_category_id",
        lv2="lv2_category_id",
        tag="tag_id",
        seed=SEED,
    )


@query("pair_samples", f"with {PAIR_ITEMS}, {PAIRS} select * from pairs")
def pair_samples(spark, folder):
    return mined(spark, folder)


@query(
    "positive_pairs", f"with {PAIR_ITEMS}, {PAIRS} select * from pairs where kind like 'same%'"
)
def positive_pairs(spark, folder):
    return mined(spark, folder).where(F.col("kind").startswith("same"))


@query(
    "negative_pairs", f"with {PAIR_ITEMS}, {PAIRS} select * from pairs where kind like 'other%'"
)
def negative_pairs(spark, folder):
    return mined(spark, folder).where(F.col("kind").startswith("other"))


LENGTH = 80


def ids_sql(name: str, column: str) -> str:
    return f"""{name} as (
      select id, list(coalesce(token_id, 1) order by pos) as ids from (
        select id, unnest(w) as word, unnest(range(0, len(w))) as pos
        from (select id, {words_sql(column)} as w from pairs))
      left join vocabulary using (word) where pos < {LENGTH} group by id)"""


def padded_sql(c: str) -> str:
    return (
        f"array_to_string(list_concat({c}, list_transform(range(0, {LENGTH} - len({c})), "
        "lambda e: 0)), ' ')"
    )


@query(
    "pair_tokens",
    f"""with {PAIR_ITEMS}, {PAIRS}, vocabulary as (
      select word, row_number() over (order by uses desc, word) + 1 as token_id
      from (select word, count(*) as uses from (
        select unnest({words_sql('title')}) as word from pair_items) group by word)),
    {ids_sql('q', 'query')}, {ids_sql('t', 'title')}
    select p.id, p.label, {padded_sql('q.ids')} as query_ids, len(q.ids) as query_used,
      {padded_sql('t.ids')} as title_ids, len(t.ids) as title_used
    from pairs p join q on p.id = q.id join t on p.id = t.id""",
)
def pair_tokens(spark, folder):
    samples = materialize(mined(spark, folder), "pair-samples")
    vocabulary = build_vocabulary(pair_items(spark, folder), [F.col("title")])
    sides = {"query_tokens": F.col("query"), "title_tokens": F.col("title")}
    records = tokenize_pad(samples, "id", sides, vocabulary, LENGTH)
    joined = samples.select("id", "label").join(never_broadcast(records), "id")

    def used(name):
        return F.aggregate(name + ".attention_mask", F.lit(0), lambda acc, x: acc + x)

    return joined.select(
        "id",
        "label",
        F.array_join("query_tokens.input_ids", " ").alias("query_ids"),
        used("query_tokens").alias("query_used"),
        F.array_join("title_tokens.input_ids", " ").alias("title_ids"),
        used("title_tokens").alias("title_used"),
    )

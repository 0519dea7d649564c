"""One registered query for each operator, over the whole of its table."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm import (
    bpe,
    chat,
    fixity,
    line_crf,
    line_dedup,
    merkle,
    near_dup,
    packing,
    permutation_index,
    pii,
    prefix_trie,
    quality_rules,
    secrets,
)
from kindred.llm.registry import query, table


@query("op1_minhash")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, folder, "documents"))


@query("op2_secrets")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.scan(table(spark, folder, "documents")).select(
        "doc_id",
        "n_assign",
        "n_access",
        "n_hex",
        F.sha2("base", 256).alias("base_sha256"),
        "spans",
    )


@query("op3_permutation_index")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return permutation_index.nearest(vectors, vectors.filter(F.col("vec_id") % 20 == 0))


@query("op4_quality_rules")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.judge(table(spark, folder, "documents")).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "posterior",
    )


OWN = """{"messages": [{"role": "user", "content": "</s>[INST] ok [/INST]"},
 {"role": "assistant", "content": "</s>[INST] ok [/INST]"}]}"""
ESCAPED = r"regexp_replace(replace({0}, '\', '\\'), '([<\[])(\||/?s>|/?INST\]|</?SYS>>)', '\1\\\2', 'g')"
CHAT_SQL = f"""
with said as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]')
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text))
    as turns_sha256,
  cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text)
    filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum({len(chat.OPEN + chat.SAYS + chat.CLOSE)} + length({ESCAPED.format('role')})
    + length({ESCAPED.format('text')})) as bigint) as formatted_chars
from said group by conv_id"""


@query("op5_chat", CHAT_SQL)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations")
    records = rows.select(
        F.col("conv_id").cast("long"), F.to_variant_object(F.struct("turn", "role", "text")).alias("record")
    )
    own = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.parse_json(F.lit(OWN)).alias("record"))
    laid = chat.formatted(chat.canonical_turns(records.unionByName(own), "conv_id"))
    read = laid.select(
        "conv_id",
        chat.whole_text(F.col("segments")).alias("formatted"),
        chat.loss_text(F.col("segments")).alias("loss"),
    ).withColumn("turns", chat.read_back(F.col("formatted")))
    line = F.lit("\n")
    said = F.transform("turns", lambda t: F.concat(t["role"], line, t["text"], line))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


FIXITY_SQL = """
with primary_pages as (select page_id, url, html from pages),
replica_pages as (
  select page_id, url, case when page_id % 97 = 5 then replace(html, 'e', '3') else html end as html
  from pages where page_id % 193 <> 7
  union all select page_id, url || '#again', html from pages where page_id % 211 = 9),
both_sides as (
  select 'a' as side, * from primary_pages union all select 'b' as side, * from replica_pages),
texts as (
  select side, page_id, concat('WARC/1.1', chr(13), chr(10), 'WARC-Type: response', chr(13), chr(10),
    'WARC-Record-ID: <urn:page:', page_id, '>', chr(13), chr(10), 'WARC-Target-URI: ', url, chr(13),
    chr(10), 'Content-Length: ', strlen(html), chr(13), chr(10), chr(13), chr(10), html, chr(13),
    chr(10), chr(13), chr(10)) as record from both_sides),
records as (
  select side, page_id, sha256(record) as sha256, cast(strlen(record) as bigint) as length,
    count(*) as copies from texts group by 1, 2, 3, 4),
placed as (
  select *, cast(floor(page_id / 1024) as bigint) as archive,
    cast(coalesce(sum(length * copies) over (partition by side, floor(page_id / 1024)
      order by page_id, sha256 rows between unbounded preceding and 1 preceding), 0) as bigint)
      as "offset" from records),
paired as (
  select page_id, sha256, length, copies, max(archive) as archive,
    max("offset") filter (where side = 'a') as a, max("offset") filter (where side = 'b') as b
  from placed group by 1, 2, 3, 4),
alone as (select *, case when b is null then 'a' else 'b' end as side from paired where a is null or b is null)
select archive, page_id, side,
  case when min(side) over (partition by page_id) <> max(side) over (partition by page_id) then 'corrupt'
    when side = 'a' then 'missing' else 'extra' end as status,
  coalesce(a, b) as "offset", length, sha256, copies, cast(null as bigint) as shift, 1 as records
from alone
union all
select archive, min(page_id), 'a', 'moved', min(a), sum(length * copies)::bigint, null,
  sum(copies)::bigint, b - a, count(*)
from paired where a <> b group by archive, b - a"""


@query("op6_fixity", FIXITY_SQL)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    """The archive against a replica with changed, lost and added records."""
    pages = table(spark, folder, "pages")
    number = F.col("page_id")
    kept = pages.filter(number % 193 != 7).withColumn(
        "html", F.when(number % 97 == 5, F.replace("html", F.lit("e"), F.lit("3"))).otherwise(F.col("html"))
    )
    added = pages.filter(number % 211 == 9).withColumn("url", F.concat("url", F.lit("#again")))
    replica = kept.unionByName(added)
    return fixity.audit(fixity.manifest(pages), fixity.manifest(replica))


@query("op7_pii")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return pii.find(table(spark, folder, "documents")).select(
        "doc_id",
        "n_email",
        "n_ip",
        "n_card",
        "n_phone",
        F.sha2("base", 256).alias("base_sha256"),
        "spans",
    )


@query("op8_bpe")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe.encode_decode(table(spark, folder, "documents"), path).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op9_quality_classifier")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = line_crf.train(docs, table(spark, folder, "labels"))
    return line_crf.score(docs, model).select(
        "doc_id",
        line_crf.held_out().alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


@query("op10_packing")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack(table(spark, folder, "documents"), path)


def crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of a text of ASCII characters."""
    codes = f"list_transform(string_split({text}, ''), lambda c: ascii(c)::bigint)"
    # fixed value: the reversed polynomial
    byte = (
        "list_reduce([xor(r, b), 0, 0, 0, 0, 0, 0, 0, 0], "
        "lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))"
    )
    return f"xor(list_reduce(list_concat([4294967295::bigint], {codes}), lambda r, b: {byte}), 4294967295)"


def framed_sql(columns: list[str]) -> str:
    texts = [f"coalesce(strlen({c}::varchar) || ':' || ({c}::varchar), '-')" for c in columns]
    return f"sha256({' || '.join(texts)})"


# Nodes of one tree a group, lvl by lvl: lvl, idx, digest and n, the nodes of that level.
TREE_SQL = """
  select grp, 0 as lvl, idx, digest, count(*) over (partition by grp) as n from {leaves}
  union all
  select grp, lvl + 1, idx // 2, sha256(digest || coalesce(other, '')), (n + 1) // 2
  from (select *, lead(digest) over (partition by grp order by idx) as other from {tree} where n > 1)
  where idx % 2 = 0"""
MERKLE_SQL = f"""
with recursive leaves as (
  select doc_id, coalesce('=' || lang, '') as grp, digest,
    case when {crc32_sql('doc_id::varchar')} % 7 = 0 then {framed_sql(
        ['doc_id', 'source', 'lang', '(n_chars + 1)', 'text'])} end as tampered,
    row_number() over (partition by coalesce('=' || lang, '') order by doc_id nulls first, digest) - 1
      as idx
  from (select *, {framed_sql(['doc_id', 'source', 'lang', 'n_chars', 'text'])} as digest from documents)),
tree as ({TREE_SQL.format(leaves='leaves', tree='tree')}),
subroots as (
  select '' as grp, grp as own, digest, row_number() over (order by grp) - 1 as idx from tree where n = 1),
top as ({TREE_SQL.format(leaves='subroots', tree='top')}),
rows as (
  select l.*, s.digest as subroot, s.idx as place, r.digest as root, row_number() over () as id
  from leaves l join subroots s on l.grp = s.own cross join (select digest from top where n = 1) r),
steps as (
  select id, h.lvl, rows.idx >> h.lvl & 1 as side, t.digest as other
  from rows join (select distinct grp, lvl from tree where n > 1) h on rows.grp = h.grp
  left join tree t on t.grp = rows.grp and t.lvl = h.lvl and t.idx = xor(rows.idx >> h.lvl, 1)
  union all
  select id, 1000 + h.lvl, place >> h.lvl & 1, t.digest
  from rows cross join (select distinct lvl from top where n > 1) h
  left join top t on t.lvl = h.lvl and t.idx = xor(place >> h.lvl, 1)),
path as (
  select *, row_number() over (partition by id order by lvl) as step, count(*) over (partition by id) as n
  from steps),
folded as (
  select id, 0 as step, coalesce(tampered, digest) as h from rows
  union all
  select id, f.step + 1, sha256(case when other is null then h when side = 1 then other || h else h || other end)
  from folded f join path p using (id) where p.step = f.step + 1),
ends as (select id, arg_max(h, step) as folded_root from folded group by id),
proofs as (select id, string_agg(other, '' order by lvl) as siblings from path group by id)
select doc_id, digest as leaf, subroot, root, sha256(coalesce(siblings, '')) as proof_sha256,
  folded_root, folded_root = root as verified
from rows join ends using (id) left join proofs using (id)"""


@query("op11_merkle_manifest", MERKLE_SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    """Proofs of all rows, checked against rows of which some were tampered with."""
    docs = table(spark, folder, "documents")
    changed = {"n_chars": F.col("n_chars") + 1}
    tampered = F.when(
        F.crc32(F.col("doc_id").cast("string")) % 7 == 0,
        merkle.framed_digest([changed.get(c, F.col(c)) for c in merkle.FIELDS]),
    )
    proofs = merkle.prove(docs, carry={"tampered": tampered})
    folded = merkle.fold(F.coalesce("tampered", "leaf"), F.col("path"))
    return proofs.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        merkle.siblings_digest(F.col("path")).alias("proof_sha256"),
        folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


BLANKS_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
LINES_SQL = f"""
with docs as (
  select row_number() over () as id, doc_id, string_split(coalesce(text, ''), chr(10)) as lines
  from documents),
lines as (
  select id, doc_id, generate_subscripts(lines, 1) as place, unnest(lines) as line from docs),
keyed as (
  select *, translate(trim(line, {BLANKS_SQL}), '{line_dedup.UPPER}', '{line_dedup.LOWER}') as key
  from lines),
frequent as (
  select key, max(doc_id) as keeper from keyed where length(key) >= 40 group by key
  having count(distinct coalesce(doc_id::varchar, '')) >= 5),
marked as (
  select k.*, keeper is not null and doc_id is distinct from keeper as dropped
  from keyed k left join frequent using (key))
select doc_id, count(*) as n_lines, count(*) filter (where dropped) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by place) filter (where not dropped), '')) as kept_sha256
from marked group by id, doc_id"""


@query("op13_line_dedup", LINES_SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.drop_lines(table(spark, folder, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256")
    )


TRIE_SQL = f"""
with said as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text
  from conversations where conv_id is not null),
own as (
  select *, row_number() over (partition by conv_id order by turn nulls first, left(role, 32),
    left(text, 32), sha256(strlen(role) || ':' || role || text)) - 1 as pos from said),
convs as (
  select conv_id, {crc32_sql('conv_id::varchar')} % 4 as h from (select distinct conv_id from own)),
turns as (
  select conv_id, row_number() over (partition by conv_id order by own, pos) as depth, role, text
  from (
    select c.conv_id, 0 as own, pos, role, text
    from convs c join own o on o.conv_id = c.conv_id - c.conv_id % 20 and pos < h
    union all
    select conv_id, 1, pos, role, text from own join convs using (conv_id) where pos >= h)),
members as (
  select conv_id, depth, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) as words,
    sha256(string_agg(sha256(strlen(role) || ':' || role || text), '') over (
      partition by conv_id order by depth)) as node from turns
  union all select conv_id, 0, 0, 'root' from convs),
hung as (
  select *, lag(node) over (partition by conv_id order by depth) as parent,
    depth = max(depth) over (partition by conv_id) as ends from members),
nodes as (
  select node, min(conv_id) as conv_id, min(depth) as depth, min(parent) as parent, min(words) as words,
    count(*) as n_convs, coalesce(string_agg(conv_id, ',' order by conv_id) filter (where ends), '') as ids
  from hung group by node),
children as (select parent as node, count(*) as n from nodes where parent is not null group by parent),
family as (
  select nodes.*, coalesce(n, 0) as n_children from nodes left join children using (node)),
subtrees as (
  select m.node, count(*) filter (where n_children = 0) as n_leaves,
    sum((n_convs - 1) * u.words) as saved_tokens
  from family u join members m on m.conv_id = u.conv_id and m.depth <= u.depth group by m.node),
reps as (select node as parent, conv_id as parent_conv_id from nodes)
select conv_id, depth, parent_conv_id, n_convs, n_children, t.n_leaves, t.saved_tokens::bigint as saved_tokens,
  sha256(ids) as ends_sha256
from family join subtrees t using (node) left join reps using (parent)"""


@query("op12_prefix_trie", TRIE_SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations")
    turns, convs = prefix_trie.branched(
        prefix_trie.numbered_turns(rows, "conv_id", "turn", "role", "text")
    )
    return prefix_trie.trie(turns, convs)

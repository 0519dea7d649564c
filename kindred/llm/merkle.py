"""Merkle manifest of a table: one hash for all rows, and proofs that a row belongs to it.

The nodes of a tree are cut into aligned blocks of ``1 << BITS``. A block keeps each of its levels as
one string of hexadecimal digests; fixed-width substrings of a level hash to the next, and the
substrings beside a node's own are its siblings. What a block comes to is a node of the next round,
until one is left in each group; the groups' roots are hashed likewise.
"""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.ordering import in_order
from kindred.session import broadcast_if_small, materialize

BITS = 12  # 4096 nodes, 256 kB for the lowest level of a block
WIDTH = 64  # of a digest
FEW_PATHS = 20_000  # paths of a block's node travel to tasks up to this number
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

# The parents of a level: every two digests, or the last one alone, are hashed.
PARENTS = f"""cast(array_join(transform(
  sequence(1, cast(ceil(octet_length(element_at(acc, -1)) / {2 * WIDTH}) as int)),
  j -> sha2(substring(element_at(acc, -1), (j - 1) * {2 * WIDTH} + 1, {2 * WIDTH}), 256)), '') as binary)"""
LEVELS = f"""aggregate(
  if(depth = 0, cast(array() as array<int>), sequence(1, depth)),
  array(cast(array_join(transform(rows, r -> r.digest), '') as binary)),
  (acc, k) -> concat(acc, array({PARENTS})))"""
# A node's path: at each level L or R, for the side on which its sibling stands, and the sibling.
SIBLING = f"""substring(get(levels, l), (shiftright(i, l) ^ 1) * {WIDTH} + 1, {WIDTH})"""
SEGMENT = f"""if(depth = 0, cast(array() as array<string>), transform(sequence(0, depth - 1), l ->
  if((shiftright(i, l) ^ 1) * {WIDTH} < octet_length(get(levels, l)),
    concat(if((shiftright(i, l) & 1) = 1, 'L', 'R'), cast({SIBLING} as string)), '')))"""


def framed_digest(columns: Sequence[Column]) -> Column:
    """Digest of values told apart by their lengths: ``-`` for null, else byte count, ``:``, value."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(
        F.concat(*[F.coalesce(F.concat(F.octet_length(t), F.lit(":"), t), F.lit("-")) for t in texts]),
        256,
    )


def _blocks(nodes: DataFrame, name: str) -> DataFrame:
    """One round: ``grp, block, depth, rows, levels`` of nodes ``grp, position, size, digest, own``."""
    top = F.least(
        F.lit(BITS), F.when(F.col("size") > 1, F.length(F.bin(F.col("size") - 1))).otherwise(0)
    )
    listed = nodes.groupBy("grp", F.shiftright("position", BITS).alias("block")).agg(
        F.max("size").alias("size"),
        F.array_sort(F.collect_list(F.struct("position", "digest", "own"))).alias("rows"),
    )
    return materialize(
        listed.withColumn("depth", top.cast("int")).withColumn("levels", F.expr(LEVELS)), name
    )


def _rounds(nodes: DataFrame, name: str) -> list[DataFrame]:
    """The rounds of every group's tree; in the last one each group has one block."""
    rounds = [_blocks(nodes, f"{name}-0")]
    while rounds[-1].agg(F.max("block")).first()[0]:
        up = rounds[-1].select(
            "grp",
            F.col("block").alias("position"),
            F.ceil(F.col("size") / (1 << BITS)).alias("size"),
            F.element_at("levels", -1).cast("string").alias("digest"),
            F.lit(None).cast("int").alias("own"),
        )
        rounds.append(_blocks(up, f"{name}-{len(rounds)}"))
    return rounds


def _paths(rounds: Sequence[DataFrame], above: DataFrame, carried: Sequence[str]) -> DataFrame:
    """``grp, block, digest, own, path`` of all nodes of the first round, and ``carried``.

    ``above`` holds, per group, the path from its root upwards and the carried columns.
    """
    on = ["grp"]
    for blocks in reversed(rounds):
        # bound as objects, once a block: read from the row itself, a level is copied at each use
        seen = f"""element_at(transform(array(transform(levels, x -> x)), levels -> transform(rows, (r, i) ->
            struct(r.position, r.digest, r.own, {SEGMENT} as segment))), 1)"""
        above = (
            blocks.join(broadcast_if_small(above, FEW_PATHS), on)
            .select("grp", "path", *carried, F.explode(F.expr(seen)).alias("r"))
            .select(
                "grp", F.col("r.position").alias("block"), "r.digest", "r.own",
                F.concat("r.segment", "path").alias("path"), *carried,
            )
        )
        on = ["grp", "block"]
        if blocks is not rounds[0]:
            above = above.drop("digest", "own")
    return above


def prove(
    docs: DataFrame,
    key: str = "doc_id",
    group: str = "lang",
    fields: Sequence[str] = FIELDS,
    carry: Mapping[str, Column] | None = None,
) -> DataFrame:
    """One row per row of ``docs``: ``key, leaf, subroot, root, path`` and the columns of ``carry``.

    A leaf is the digest of ``fields``. In each ``group`` (null is one) leaves ascend by ``key``, null
    first, equal keys by leaf; of a level every two nodes, or the last one alone, are hashed together
    while there are several; the roots of the groups, null first, then by their bytes, come to ``root``
    in the same way. ``path`` lists, level by level, the sibling of a node with the side on which it
    stands before it, or an empty text where there is none: see :func:`fold`. Null and empty values
    differ, texts of any length are hashed whole, repeated rows are leaves each, an empty table gives
    no rows and other columns are left out.
    """
    carry = carry or {}
    own = F.struct(F.col(f"`{key}`").alias("key"), *[c.alias(n) for n, c in carry.items()])
    rows = docs.select(
        # null sorts before all others
        F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit("")).alias("grp"),
        F.col(f"`{key}`").alias("key"),
        framed_digest([F.col(f"`{c}`") for c in fields]).alias("digest"),
        own.alias("own"),
    )
    placed = in_order(rows, ["grp"], ["key", "digest"], "leaves")
    sizes = placed.groupBy("grp").agg((F.max("position") + 1).alias("size"))
    rounds = _rounds(placed.drop("key").join(broadcast_if_small(sizes), "grp"), "leaves")
    roots = rounds[-1].select("grp", F.element_at("levels", -1).cast("string").alias("digest"))
    one = roots.select(
        F.lit("").alias("grp"), "digest", F.col("grp").alias("own")
    )  # own: the group that a root stands for
    tops = in_order(one, ["grp"], ["own"], "roots")
    top_rounds = _rounds(tops.withColumn("size", F.lit(roots.count())), "roots")
    none = F.array().cast("array<string>")
    root = top_rounds[-1].select(
        "grp", F.element_at("levels", -1).cast("string").alias("root"), none.alias("path")
    )
    above = _paths(top_rounds, root, ["root"]).select(
        F.col("own").alias("grp"), F.col("digest").alias("subroot"), "root", "path"
    )
    return _paths(rounds, above, ["subroot", "root"]).select(
        F.col("own.key").alias(key),
        F.col("digest").alias("leaf"),
        "subroot",
        "root",
        "path",
        *[F.col(f"own.{n}").alias(n) for n in carry],
    )


def siblings_digest(path: Column) -> Column:
    """Digest of the siblings of a path, one after the other."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.substring(s, 2, WIDTH)), ""), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings come to."""

    def step(digest: Column, s: Column) -> Column:
        other = F.substring(s, 2, WIDTH)
        both = F.when(s.startswith("L"), F.concat(other, digest)).otherwise(F.concat(digest, other))
        return F.sha2(both, 256)

    return F.aggregate(path, leaf, step)

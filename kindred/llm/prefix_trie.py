"""Prefix trie of conversations: which first turns are shared, by how many, and what sharing saves.

Every prefix has a digest, worked out by running sums. A count-min sketch of all digests never counts
too few, so a prefix that it estimates at one is held by one conversation: such tails are given out
where they are read. Only prefixes that may be shared are shuffled and grouped exactly.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from kindred.llm.columns import sha256_hex
from kindred.llm.ordering import in_order, split_join
from kindred.session import broadcast_if_small, materialize

WORD = "[^\\x20\\x09-\\x0D]+"
ROOT = "root"
SHORT = 32  # code points of a role or text by which turns of one number are put in order
SUMS = 5  # 32-bit words of a turn's digest that are added up: 160 bits
CHUNK_BITS = 14  # turns of a conversation that are added up in one task
SKETCH_ROWS = 4
LEAST_BITS, MOST_BITS = 16, 24  # cells of a sketch row; 4 x 16 M cells of 2 bits are 16 MB
PIECE_BITS = 16  # cells of a sketch that travel together
ENDS_BITS = 8  # ids that are listed at once: those with equal higher bits


# --- conversations -----------------------------------------------------------------------------


def numbered_turns(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """``conv_id, position, digest, words`` of every turn, by number and null first.

    Turns of one number are in order of the first characters of role and text, then of their digest.
    """
    said = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    who = F.coalesce(F.col(f"`{role}`"), F.lit(""))
    turns = rows.where(F.col(f"`{conv}`").isNotNull()).select(
        F.col(f"`{conv}`").cast("long").alias("conv_id"),
        F.col(f"`{turn}`").alias("turn"),
        F.substring(who, 1, SHORT).alias("who"),
        F.substring(said, 1, SHORT).alias("said"),
        F.sha2(F.concat(F.octet_length(who), F.lit(":"), who, said), 256).alias("digest"),
        F.regexp_count(said, F.lit(WORD)).cast("long").alias("words"),
    )
    placed = in_order(turns, ["conv_id"], ["turn", "who", "said", "digest"], "turns")
    return materialize(placed.select("conv_id", "position", "digest", "words"), "turns")


def branched(turns: DataFrame, every: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt on the first turns of others, and their ids with the number of turns.

    Conversation c takes the first h turns of c - c % ``every``, h being its CRC-32 modulo ``heads``,
    and its own behind its first h. Returns ``conv_id, turns, depth, digest, words`` with depths from
    1, and ``conv_id, turns`` of all.
    """
    h = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(heads)).cast("int")
    donor = F.col("conv_id") - F.col("conv_id") % every
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("size"))
    first = F.struct("position", "digest", "words")
    given = (
        turns.where((F.col("conv_id") % every == 0) & (F.col("position") < heads - 1))
        .groupBy(F.col("conv_id").alias("donor"))
        .agg(F.array_sort(F.collect_list(first)).alias("given"))
    )
    none = F.array().cast("array<struct<position: bigint, digest: string, words: bigint>>")
    convs = materialize(
        sizes.withColumn("donor", donor)
        .join(given, "donor", "left")
        .select("conv_id", "size", h.alias("h"), F.slice(F.coalesce("given", none), 1, h).alias("taken"))
        .withColumn("shift", F.size("taken") - F.col("h"))
        .withColumn(
            "turns", F.size("taken") + F.greatest(F.col("size") - F.col("h"), F.lit(0))
        ),
        "conversations",
    )
    kept = split_join(turns, convs.drop("taken"), ["conv_id"], "size", turns.count())
    own = kept.where(F.col("position") >= F.col("h")).select(
        "conv_id", "turns", (F.col("position") + F.col("shift") + 1).alias("depth"), "digest", "words"
    )
    lent = convs.select("conv_id", "turns", F.posexplode("taken").alias("i", "t")).select(
        "conv_id", "turns", (F.col("i") + 1).cast("long").alias("depth"), "t.digest", "t.words"
    )
    return materialize(own.unionByName(lent), "rebuilt"), convs.select("conv_id", "turns")


# --- digests of prefixes -----------------------------------------------------------------------


def running(df: DataFrame, key: str, place: str, values: list[str]) -> DataFrame:
    """Sums of ``values`` from a key's first place to each row; places are numbers without gaps.

    A key is cut into chunks of places; what chunks before one add up to is worked out for keys of
    several chunks only, and there is one such row for thousands of others.
    """
    cut = df.withColumn("_chunk", F.shiftright(place, CHUNK_BITS))
    sums = [F.sum(v).alias(f"_of_{v}") for v in values]
    long = cut.where(F.col(place) == 1 << CHUNK_BITS).select(key)
    chunks = cut.join(broadcast_if_small(long), key, "left_semi").groupBy(key, "_chunk").agg(*sums)
    before = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    past = chunks.select(
        key, "_chunk", *[F.sum(f"_of_{v}").over(before).alias(f"_before_{v}") for v in values]
    ).where("_chunk > 0")
    inside = Window.partitionBy(key, "_chunk").orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    summed = cut.withColumns({f"_in_{v}": F.sum(v).over(inside) for v in values})
    joined = summed.join(broadcast_if_small(past), [key, "_chunk"], "left")
    totals = {
        v: F.col(f"_in_{v}") + F.coalesce(F.col(f"_before_{v}"), F.lit(0)) for v in values
    }
    return joined.select(*[c for c in df.columns if c not in values], *[t.alias(v) for v, t in totals.items()])


def prefixes(turns: DataFrame) -> DataFrame:
    """``conv_id, turns, depth, words, node, parent``: the digests of each prefix and of the one before.

    What is added up for a turn is a digest of its place and its own digest, so equal sums are equal
    sequences, and a conversation of any length is added up in parts.
    """
    own = F.sha2(F.concat_ws("|", "depth", "digest"), 256)
    parts = [f"s{i}" for i in range(SUMS)]
    # 32 bits each, so that billions of turns fit into a sum
    words = [F.conv(F.substring("own", 8 * i + 1, 8), 16, 10).cast("long") for i in range(SUMS)]
    named = turns.withColumn("own", own).select(
        "conv_id", "turns", "depth", "words", "own", *[w.alias(p) for w, p in zip(words, parts, strict=True)]
    )
    whole = running(named, "conv_id", "depth", parts)
    less = [F.col(p) - w for w, p in zip(words, parts, strict=True)]
    parent = F.sha2(F.concat_ws("|", F.col("depth") - 1, *less), 256)
    return whole.select(
        "conv_id",
        "turns",
        "depth",
        "words",
        F.sha2(F.concat_ws("|", "depth", *parts), 256).alias("node"),
        F.when(F.col("depth") == 1, ROOT).otherwise(parent).alias("parent"),
    )


# --- the sketch --------------------------------------------------------------------------------


def cells(digests: pa.Array, bits: int) -> np.ndarray:
    """The cell of each hexadecimal digest in each row of the sketch."""
    words = np.array([], ">u4")
    if len(digests):
        words = np.frombuffer(bytes.fromhex("".join(digests.to_pylist())), ">u4")
    words = words.reshape(len(digests), 8)
    return (words[:, :SKETCH_ROWS].T >> (32 - bits)).astype(np.int64)


def sketch(digests: DataFrame, column: str, bits: int) -> np.ndarray:
    """Counts of the digests of a column, cut off at 2: ``SKETCH_ROWS`` rows of ``1 << bits`` cells.

    Each task counts its rows; the pieces of its counts that aren't empty are added up piece by piece.
    The size of what reaches the driver doesn't grow with the input beyond ``MOST_BITS``.
    """
    width = min(bits, PIECE_BITS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((SKETCH_ROWS, 1 << bits), np.uint8)
        for batch in batches:
            for row, found in zip(counts, cells(batch.column(0), bits), strict=True):
                cell, n = np.unique(found, return_counts=True)
                row[cell] = np.minimum(row[cell] + np.minimum(n, 2), 2)
        yield from pieces(enumerate(counts.reshape(-1, 1 << width)))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None
        for batch in batches:
            for piece, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                more = np.frombuffer(zlib.decompress(data), np.uint8)
                if piece == at:
                    held = np.minimum(held + more, 2)
                    continue
                yield from pieces([] if at is None else [(at, held)])
                at, held = piece, more
        yield from pieces([] if at is None else [(at, held)])

    def pieces(numbered) -> Iterator[pa.RecordBatch]:
        for piece, data in numbered:
            if data.any():
                packed = zlib.compress(np.ascontiguousarray(data, np.uint8).tobytes(), 1)
                yield pa.RecordBatch.from_pydict({"piece": pa.array([piece], pa.int64()), "data": [packed]})

    kind = "piece long, data binary"
    counted = digests.select(column).mapInArrow(count, kind)
    merged = counted.repartition("piece").sortWithinPartitions("piece").mapInArrow(merge, kind)
    out = np.zeros((SKETCH_ROWS << bits - width, 1 << width), np.uint8)
    for row in merged.collect():
        out[row["piece"]] = np.frombuffer(zlib.decompress(row["data"]), np.uint8)
    return out.reshape(SKETCH_ROWS, 1 << bits)


def screened(rows: DataFrame, counts: np.ndarray, columns: dict[str, str]) -> DataFrame:
    """``rows`` and, for each digest column, whether the sketch proves that it is held once."""
    spark = rows.sparkSession
    bits = counts.shape[1].bit_length() - 1
    single = np.packbits(counts == 1, axis=1)  # all that is asked of a count
    sent = spark.sparkContext.broadcast(single)
    names = list(columns)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        for batch in batches:
            for name in names:
                digests = batch.column(batch.schema.get_field_index(name))
                known = np.array([d != ROOT for d in digests.to_pylist()], bool)
                proven = np.zeros(len(known), bool)
                for row, cell in zip(held, cells(digests.filter(pa.array(known)), bits), strict=True):
                    proven[known] |= (row[cell >> 3] >> (7 - (cell & 7)) & 1).astype(bool)
                batch = batch.append_column(columns[name], pa.array(proven))
            yield batch

    flags = [StructField(flag, BooleanType()) for flag in columns.values()]
    return rows.mapInArrow(check, StructType([*rows.schema.fields, *flags]))


# --- the trie ----------------------------------------------------------------------------------


def ends_digests(ends: DataFrame) -> DataFrame:
    """``node, ends_sha256`` from ``node, conv_id``: ids of a node in order, joined by commas.

    Ids are listed in short runs first; a hash has to read them one after the other, but nothing
    longer than a run is held.
    """
    runs = ends.groupBy("node", F.shiftright("conv_id", ENDS_BITS).alias("run")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
        .alias("ids")
    )
    schema = "node string, ends_sha256 string"

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        at, state = None, None
        for batch in batches:
            nodes, hashes = [], []
            for node, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if node == at:
                    state.update(b"," + ids.encode())
                    continue
                if at is not None:
                    nodes.append(at)
                    hashes.append(state.hexdigest())
                at, state = node, sha256(ids.encode())
            yield pa.RecordBatch.from_pydict({"node": pa.array(nodes, pa.string()), "ends_sha256": pa.array(hashes, pa.string())})
        if at is not None:
            yield pa.RecordBatch.from_pydict({"node": [at], "ends_sha256": [state.hexdigest()]})

    dealt = runs.repartition("node").sortWithinPartitions("node", "run").select("node", "ids")
    return dealt.mapInArrow(digest, schema)


NOTHING = sha256_hex(b"")


def trie(turns: DataFrame, convs: DataFrame, bits: int | None = None) -> DataFrame:
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256``.

    ``turns``: ``conv_id, turns, depth, digest, words`` with depths 1 to ``turns``; ``convs``:
    ``conv_id, turns`` of every conversation, those without turns too. A node is a distinct sequence of first turns, named
    by its smallest member; the root has depth 0 and no parent. ``bits`` sets the width of the sketch,
    else it follows the number of turns up to ``MOST_BITS``; beyond that fewer prefixes are proven
    single, and the result is the same. No conversations give no rows.
    """
    rows = materialize(prefixes(turns), "prefixes")
    total = rows.count()
    if bits is None:
        bits = min(MOST_BITS, max(LEAST_BITS, (4 * total).bit_length()))
    counts = sketch(rows, "node", bits)
    marked = materialize(
        screened(rows, counts, {"node": "single", "parent": "parent_single"}), "screened"
    ).withColumn("ends", F.col("depth") == F.col("turns"))
    tails = marked.where("single")
    zero = F.lit(0).cast("long")
    roots = convs.select(
        "conv_id", "turns", zero.alias("depth"), zero.alias("words"), F.lit(ROOT).alias("node"),
        F.lit(None).cast("string").alias("parent"), F.lit(False).alias("single"),
        F.lit(False).alias("parent_single"), (F.col("turns") == 0).alias("ends"),
    )
    shared = marked.where("not single").unionByName(roots)
    groups = materialize(
        shared.groupBy("node").agg(
            F.min(F.struct("conv_id", "turns")).alias("least"),
            F.min("depth").alias("depth"),
            F.min("parent").alias("parent"),
            F.min("words").alias("words"),
            F.count(F.lit(1)).alias("n_convs"),
            F.max("parent_single").alias("parent_single"),
        ),
        "nodes",
    ).select("*", "least.*").drop("least")
    # children: nodes that may be shared, and the first nodes of tails
    hung = F.col("parent").isNotNull() & ~F.col("parent_single")
    below = groups.where(hung).select("parent").unionByName(tails.where(hung).select("parent"))
    children = below.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n"))
    nodes = materialize(
        groups.join(children, "node", "left")
        .withColumn("n_children", F.coalesce("n", F.lit(0)).cast("long"))
        .drop("n"),
        "trie-nodes",
    )
    summed = nodes.join(_subtree_sums(nodes, shared, total), "node", "left")
    ends = ends_digests(shared.where("ends").select("node", "conv_id"))
    named = nodes.select(
        F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("n")
    )
    inner = summed.join(ends, "node", "left").select(
        "conv_id", "depth", "parent", "parent_single", "n_convs", "n_children",
        (1 + F.coalesce("branches", F.lit(0))).alias("n_leaves"),
        F.coalesce("saved", F.lit(0)).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"),
    )
    outer = tails.select(
        "conv_id", "depth", "parent", "parent_single", F.lit(1).cast("long").alias("n_convs"),
        F.when(F.col("ends"), 0).otherwise(1).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
        F.when(F.col("ends"), F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(NOTHING)
        .alias("ends_sha256"),
    )
    every = inner.unionByName(outer)
    alone = every.where(~hung).withColumn(
        "parent_conv_id", F.when(F.col("parent").isNotNull(), F.col("conv_id"))
    )
    below = split_join(every.where(hung), named, ["parent"], "n", total).drop("n")
    return alone.unionByName(below).select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        "ends_sha256",
    )


def _subtree_sums(nodes: DataFrame, shared: DataFrame, total: int) -> DataFrame:
    """``node, branches, saved``: over each node's subtree, the children beyond the first of each
    node, and the words that sharing its last turn saves.

    A node stands with its smallest member. From the depth where a conversation first is a smallest
    member it is one down to its end, so a node's sum is that of its own conversation from there on,
    and the whole sums of its other members.
    """
    branches = F.greatest(F.col("n_children") - 1, F.lit(0))
    saved = (F.col("n_convs") - 1) * F.col("words")
    valued = nodes.select(
        "node", "conv_id", "turns", "depth", branches.alias("branches"), saved.alias("saved")
    )
    worth = (F.col("branches") > 0) | (F.col("saved") > 0)
    paths = materialize(
        valued.groupBy("conv_id").agg(
            (F.max("turns") + 1).alias("rows"),
            F.min("depth").alias("first"),
            F.max(F.when(worth, F.col("depth"))).alias("last"),
            F.sum("branches").alias("b"),
            F.sum("saved").alias("s"),
        ).where("last is not null"),
        "trie-paths",
    )
    held = split_join(shared.select("conv_id", "depth", "node"), paths, ["conv_id"], "rows", total)
    above = held.where(F.col("depth") < F.col("first")).select("node", "b", "s")
    # a conversation's own nodes, from the last of value up to the first
    own = split_join(valued.drop("turns"), paths.drop("b", "s"), ["conv_id"], "rows", total)
    own = materialize(
        own.where(F.col("depth") <= F.col("last")).select(
            "conv_id", "node", (F.col("last") - F.col("depth")).alias("place"),
            F.col("branches").alias("b"), F.col("saved").alias("s"),
        ),
        "trie-values",
    )
    inside = running(own, "conv_id", "place", ["b", "s"]).select("node", "b", "s")
    sums = [F.sum("b").alias("branches"), F.sum("s").alias("saved")]
    return above.unionByName(inside).groupBy("node").agg(*sums)

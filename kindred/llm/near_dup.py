"""Near-duplicate documents by bottom-k sketches of one hash function.

The k least shingle hashes of a document are its sketch. Inverted lists of the retained values give
pairs of documents with common values, the k least of both sketches together estimate how alike a
pair is, and what passes is confirmed on the full sets.

Documents with equal sets are one vertex from the start. Lists are told apart by length. In a short
one all pairs are looked at. A value held by many documents - a licence line, a large group of near
copies - says little: documents are led by their rarer values wherever these are a fair part of the
sketch. The others, which consist mostly of frequent values, are each compared with one hub of their
lists; those not alike to the hub are compared with the hub's other documents block by block, and of
what is found in a block only a forest of links is handed on.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.columns import arrow_schema, per_text, rows_of, slices, text_hash
from kindred.llm.components import connected
from kindred.session import materialize

WORDS = 5
PERCENT = 75
SKETCH = 64
POSTED = 16  # rarer values by which a document is listed
POSTED_OFTEN = 10  # frequent values by which a document of mostly frequent ones is listed
SHORT_LIST = 64  # documents; a value in more sketches is frequent
FREQUENT_SHARE = 3 / 8  # of a sketch, from which a document is compared with hubs
BLOCK, ACROSS = 256, 1024  # documents of a block on either side

FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                    0xFF51AFD7ED558CCD], np.uint64)


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted hashes of the distinct runs of five lower-cased words; of all words, if fewer."""
    words = text.lower().split()  # of bytes: A-Z, and ASCII white space only
    if not words:
        return np.zeros(0, np.int64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(WORDS, len(words))
    n = len(words) - width + 1
    total = np.full(n, width, np.uint64)
    for i in range(width):
        total += hashes[i : i + n] * FACTORS[i]
    return np.unique(_spread(total).view(np.int64))


def sketches(docs: DataFrame, text: str, key: str) -> DataFrame:
    """``key, text_hash, n, vertex, sketch`` of each row; the vertex names its set (null: empty)."""

    def one(data: bytes) -> tuple:
        values = shingle_set(data)
        if not len(values):
            return 0, None, None
        return len(values), xxhash.xxh3_128_digest(values.tobytes()), values[:SKETCH].tolist()

    kind = docs.select(f"`{key}`").schema[0].dataType.simpleString()
    marked = docs.select(F.col(f"`{key}`").alias("key"), text_hash(text).alias("text_hash"), F.col(f"`{text}`").alias("t"))
    schema = f"key {kind}, text_hash long, n long, vertex binary, sketch array<long>"
    return per_text(marked, "t", ["key", "text_hash"], schema, one)


def postings(vertices: DataFrame) -> DataFrame:
    """``vertex, n, rare, frequent``: the values of its sketch by which each vertex is listed.

    Values of one vertex only are left out. ``frequent`` is empty unless such values are more than
    ``FREQUENT_SHARE`` of the sketch.
    """
    values = vertices.select("vertex", "n", F.size("sketch").alias("k"), F.posexplode("sketch").alias("at", "value"))
    held = values.groupBy("value").agg(F.count("*").alias("held")).filter("held > 1")
    listed = (
        values.join(held, "value")
        .groupBy("vertex", "n", "k")
        .agg(F.array_sort(F.collect_list(F.struct("at", "value", "held"))).alias("shared"))
    )
    often = F.filter("shared", lambda s: s["held"] > SHORT_LIST)
    rare = F.filter("shared", lambda s: s["held"] <= SHORT_LIST)
    worth = F.size(often) > FREQUENT_SHARE * F.col("k")
    return listed.select(
        "vertex",
        "n",
        F.slice(F.transform(rare, lambda s: s["value"]), 1, POSTED).alias("rare"),
        F.when(worth, F.slice(F.transform(often, lambda s: s["value"]), 1, POSTED_OFTEN))
        .otherwise(F.array().cast("array<bigint>"))
        .alias("frequent"),
        F.size(often).alias("n_often"),
    )


def _sizes_allow(a: str, b: str) -> Column:
    return (100 * F.least(a, b)) >= PERCENT * F.greatest(a, b)


def overlaps(posted: DataFrame) -> DataFrame:
    """Pairs ``a < b`` of vertices that share enough of their rarer values."""
    lists = posted.select("vertex", "n", F.size("rare").alias("c"), F.explode("rare").alias("value"))
    left = lists.select("value", F.col("vertex").alias("a"), F.col("n").alias("na"), F.col("c").alias("ca"))
    right = lists.select("value", F.col("vertex").alias("b"), F.col("n").alias("nb"), F.col("c").alias("cb"))
    met = left.join(right, "value").filter((F.col("a") < F.col("b")) & _sizes_allow("na", "nb"))
    counted = met.groupBy("a", "b").agg(
        F.count("*").alias("met"), F.min(F.least("ca", "cb")).alias("posted")
    )
    # of 12 and more listed values an alike pair shares over half; one alone is a chance passage
    return counted.filter((F.col("met") > 1) | (F.col("posted") < 12)).select("a", "b")


def estimated(pairs: DataFrame, vertices: DataFrame) -> DataFrame:
    """The pairs whose joint sketch doesn't rule out the wanted similarity (six deviations off)."""
    own = vertices.select("vertex", "sketch")
    both = pairs.join(own.select(F.col("vertex").alias("a"), F.col("sketch").alias("sa")), "a").join(
        own.select(F.col("vertex").alias("b"), F.col("sketch").alias("sb")), "b"
    )
    joint = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, SKETCH)
    common = F.size(F.array_intersect(joint, F.array_intersect("sa", "sb")))
    p = PERCENT / 100
    seen = both.withColumn("_k", F.size(joint)).withColumn("_common", common)
    slack = 6 * F.sqrt(F.lit(p * (1 - p)) * F.col("_k"))
    return seen.filter(F.col("_common") >= p * F.col("_k") - slack).select("a", "b")


def full_sets(docs: DataFrame, text: str, key: str, wanted: DataFrame) -> DataFrame:
    """``vertex, n, shingles``: the full sets of the wanted vertices, from one document each."""
    kept = docs.select(F.col(f"`{key}`").alias("_k"), text_hash(text).alias("_h"), F.col(f"`{text}`").alias("t"))
    met = kept.join(wanted, F.col("_k").eqNullSafe(F.col("key")) & (F.col("_h") == F.col("text_hash")))
    schema = "vertex binary, n long, shingles binary"

    def one(data: bytes) -> tuple:
        values = shingle_set(data)
        return len(values), values.tobytes()

    return per_text(met.select("vertex", "t"), "t", ["vertex"], schema, one)


def alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with ``linked``, from the full sets."""
    left = sets.select(F.col("vertex").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("vertex").alias("b"), F.col("shingles").alias("sb"))
    schema = "a binary, b binary, linked boolean"
    target = arrow_schema(pairs, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, 3):
                linked = []
                for x, y in zip(piece.column(2), piece.column(3), strict=True):
                    x, y = (np.frombuffer(s.as_buffer(), np.int64) for s in (x, y))
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    linked.append(100 * common >= PERCENT * (len(x) + len(y) - common))
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), piece.column(1), pa.array(linked, pa.bool_())], schema=target
                )

    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(run, schema)


def hub_pairs(posted: DataFrame) -> DataFrame:
    """``a`` (hub), ``b``, ``fits``: every vertex of mostly frequent values with its lists' hubs.

    A list's hub is the vertex with most frequent values, which near copies have in common.
    """
    lists = posted.select("vertex", "n", "n_often", F.explode("frequent").alias("value"))
    hubs = lists.groupBy("value").agg(
        F.max(F.struct("n_often", "vertex", "n")).alias("hub")
    ).select("value", F.col("hub.vertex").alias("a"), F.col("hub.n").alias("na"))
    return (
        lists.join(hubs, "value")
        .filter("vertex <> a")
        .select("a", F.col("vertex").alias("b"), _sizes_allow("na", "n").alias("fits"))
        .distinct()
    )


def forest(left: pa.Table, right: pa.Table) -> pa.Table:
    """Links between two blocks of documents, as few as keep the same components.

    Rows: vertex, shingles and whether the vertex is linked to the hub, as all such are with each
    other.
    """
    sets = [np.frombuffer(s.as_buffer(), np.int64) for t in (left, right) for s in t["shingles"].combine_chunks()]
    sizes = np.array([len(s) for s in sets])
    names = left["vertex"].to_pylist() + right["vertex"].to_pylist()
    held = left["linked"].to_pylist() + right["linked"].to_pylist()
    cut = left.num_rows
    _, columns = np.unique(np.concatenate(sets), return_inverse=True)
    rows = np.repeat(np.arange(len(sets)), sizes)
    one, other = (np.bincount(columns[side], minlength=columns.max() + 1) for side in (rows < cut, rows >= cut))
    shared = np.flatnonzero((one > 0) & (other > 0))
    place = np.full(columns.max() + 1, -1)
    place[shared] = np.arange(len(shared))
    columns = place[columns]
    common = np.zeros((cut, len(sets) - cut), np.float32)
    for low in range(0, len(shared), 4096):
        at = (columns >= low) & (columns < low + 4096)
        matrix = np.zeros((len(sets), 4096), np.float32)
        matrix[rows[at], columns[at] - low] = 1
        common += matrix[:cut] @ matrix[cut:].T
    union = sizes[:cut, None] + sizes[None, cut:] - common
    parent = list(range(len(sets) + 1))  # the last stands for the hub

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for i, known in enumerate(held):
        if known:
            parent[i] = len(sets)
    found: dict[bytes, int] = {}
    for i, name in enumerate(names):  # a vertex may stand on both sides
        parent[root(i)] = root(found.setdefault(name, i))
    links = []
    for i, j in np.argwhere(100 * common >= PERCENT * union):
        a, b = root(int(i)), root(int(j) + cut)
        if a != b:
            parent[a] = b
            links.append((names[i], names[j + cut]))
    return pa.table(
        [pa.array([x[k] for x in links], pa.binary()) for k in (0, 1)], names=["a", "b"]
    )


def rest_links(star: DataFrame, sets: DataFrame) -> DataFrame:
    """Links of the vertices that aren't alike to their hub with the hub's other vertices."""
    counts = star.groupBy("a").agg(
        F.count("*").alias("_all"), F.count(F.when(~F.col("linked"), 1)).alias("_open")
    ).filter("_open > 0")
    sized = star.join(
        counts.select(
            "a",
            F.ceil(F.col("_open") / BLOCK).alias("_blocks"),
            F.ceil(F.col("_all") / ACROSS).alias("_across"),
        ),
        "a",
    )
    with_sets = sized.join(sets.select(F.col("vertex").alias("b"), "shingles"), "b")
    word = F.xxhash64("b")
    names = {"a": "hub", "b": "vertex", "shingles": "shingles", "linked": "linked"}
    columns = [F.col(c).alias(name) for c, name in names.items()]  # the two sides' own columns
    left = with_sets.filter("not linked").select(
        *columns,
        F.pmod(word, "_blocks").alias("block"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_across") - 1)).alias("across"),
    )
    right = with_sets.select(
        *columns,
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_blocks") - 1)).alias("block"),
        F.pmod(word, "_across").alias("across"),
    )
    cell = ["hub", "block", "across"]

    def links(one: pa.Table, other: pa.Table) -> pa.Table:
        if not one.num_rows or not other.num_rows:
            return pa.table([pa.array([], pa.binary())] * 2, names=["a", "b"])
        return forest(one, other)

    return left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(links, "a binary, b binary")


def links_of(docs: DataFrame, made: DataFrame, text: str, key: str) -> DataFrame:
    """Edges ``u, v`` between vertices; they join what similarity joins, directly or in steps."""
    vertices = materialize(
        made.filter("vertex is not null")
        .groupBy("vertex", "n")
        .agg(F.first("sketch").alias("sketch"), F.min(F.struct("key", "text_hash")).alias("row")),
        "vertices",
    )
    posted = materialize(postings(vertices), "postings")
    pairs = materialize(estimated(overlaps(posted), vertices), "pairs")
    hubs = materialize(hub_pairs(posted), "hub-pairs")
    ends = [p.select(F.col(c).alias("vertex")) for p in (pairs, hubs) for c in ("a", "b")]
    needed = ends[0].unionByName(ends[1]).unionByName(ends[2]).unionByName(ends[3]).distinct()
    wanted = vertices.join(needed, "vertex").select("vertex", "row.key", "row.text_hash")
    sets = materialize(full_sets(docs, text, key, wanted).dropDuplicates(["vertex"]), "sets")
    near = alike(pairs, sets).filter("linked").select("a", "b")
    star = alike(hubs.filter("fits").select("a", "b"), sets)
    known = hubs.select("a", "b").join(star.filter("linked"), ["a", "b"], "left").select(
        "a", "b", F.coalesce("linked", F.lit(False)).alias("linked")
    )
    known = materialize(known, "star")
    links = near.unionByName(known.filter("linked").select("a", "b"))
    return links.unionByName(rest_links(known, sets)).select(F.col("a").alias("u"), F.col("b").alias("v"))


def named_rows(docs: DataFrame, text: str, key: str) -> DataFrame:
    """``key, text_hash, n, root`` of each row; the root names its component (null: no shingles)."""
    made = materialize(sketches(docs, text, key), "sketches")
    roots = connected(links_of(docs, made, text, key))
    named = made.select("key", "text_hash", "n", "vertex").join(
        roots.select(F.col("v").alias("vertex"), "root"), "vertex", "left"
    ).select("key", "text_hash", "n", F.coalesce("root", "vertex").alias("root"))
    return materialize(named, "named")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, n_shingles, component_id, kept``, one row per row of ``docs``.

    Rows are linked when 100 * intersection >= 75 * union of their shingle sets. The component id is
    the least key reachable over links; null keys are passed over in it and are never kept. Texts
    that are null, empty or white space have no shingles, no links, and their own key as component.
    Repeated rows share a component; rows of one key with other texts are rows of their own. An
    empty table gives no rows; other columns are left out.
    """
    named = named_rows(docs, text, key)
    least = named.filter("root is not null").groupBy("root").agg(F.min("key").alias("least"))
    component = F.when(F.col("root").isNull(), F.col("key")).otherwise(F.col("least"))
    return named.join(least, "root", "left").select(
        F.col("key").alias(key),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("key") == component, F.lit(False)).alias("kept"),
    )


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row of each component, all columns: of the least key, then the least text hash.

    Of repeated rows one stays. Null keys come last. Texts without shingles are linked to nothing:
    each different row of them stays.
    """
    alone = F.col("root").isNull()
    rows = named_rows(docs, text, key).groupBy("root", "key", "text_hash").agg(F.count("*").alias("n"))
    order = F.struct(F.col("key").isNull().alias("last"), "key", "text_hash", "n")
    linked = rows.filter(~alone).groupBy("root").agg(F.min(order).alias("row")).select("row.*").drop("last")
    kept = linked.unionByName(rows.filter(alone).drop("root")).withColumnRenamed("key", key)
    kept = materialize(kept, "kept")
    out = rows_of(docs, kept.filter("n = 1"), text, key)
    repeated = kept.filter("n > 1")
    if repeated.isEmpty():
        return out
    more = rows_of(docs, repeated, text, key).withColumn("_text_hash", text_hash(text))
    return out.unionByName(more.dropDuplicates([key, "_text_hash"]).drop("_text_hash"))

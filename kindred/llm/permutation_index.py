"""Approximate nearest neighbours by a permutation index.

Every vector is represented by its nearest pivots in order. A shard of the rows posts each of its
vectors in the inverted files of these pivots; a query reads the files of its own pivots, adds up the
footrule distance of the two orders, and the candidates that, with their lengths, are likeliest to
be near are ranked again by inner product.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.session import materialize

PIVOTS = 256
SAMPLE = 4096  # rows, chosen by a hash of the id, that pivots are taken from
APART = 0.7  # greatest cosine of two pivots
PREFIX = 48  # nearest pivots of a vector that are kept
SHARD_ROWS = 4096
QUERY_ROWS = 512
LEAST = 512  # distinct vectors of a shard that are ranked again, or
SHARE = 4  # one in so many, if that is more, and
CROWD = 0.5  # all that have this share of the credit of an equal order
PAIRS = 64, 256  # queries and vectors on whose pairs cosines are fitted to credit

Pivots = dict[int, np.ndarray]


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """``id, vec`` of the rows that take part; of rows with one id the greatest vector counts."""
    vec = F.col(f"`{vector}`").cast("array<double>")
    odd = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(vec, lambda x: x != 0)
    return (
        vectors.select(F.col(f"`{key}`").cast("long").alias("id"), vec.alias("vec"))
        .filter(F.col("id").isNotNull() & F.col("vec").isNotNull() & ~odd_of(odd) & some)
        .groupBy("id")
        .agg(F.max("vec").alias("vec"))
    )


def odd_of(odd):
    """Unknown counts as odd."""
    return F.coalesce(odd, F.lit(True))


def choose_pivots(rows: DataFrame, pivots: int = PIVOTS, sample: int = SAMPLE) -> Pivots:
    """For each vector length, up to ``pivots`` unit vectors of a sample of rows.

    None is closer than ``APART`` to another, so that a crowd of alike vectors gives one pivot and
    doesn't outweigh the others in every order.
    """
    found = rows.orderBy(F.xxhash64("id"), "id").limit(sample).collect()
    out: dict[int, list[np.ndarray]] = {}
    for r in found:
        v = np.array(r.vec)
        v /= np.linalg.norm(v)
        kept = out.setdefault(len(v), [])
        if not kept or len(kept) < pivots and (np.stack(kept) @ v).max() < APART:
            kept.append(v)
    return {d: np.stack(kept) for d, kept in out.items()}


def orders(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The pivots nearest to each vector, nearest first."""
    nearness = x @ pivots.T
    return np.argsort(-nearness, axis=1, kind="stable")[:, :prefix]


def footrule_credit(
    posted: np.ndarray, asked: np.ndarray, pivots: int
) -> np.ndarray:
    """For each query and vector, what sharing pivots takes off the greatest footrule distance.

    A pivot that is missing from an order counts as being at its end. A pivot at places a and b of
    orders of length n then brings the distance down by twice n - max(a, b).
    """
    n, prefix = posted.shape
    credit = np.zeros((len(asked), n), np.int16 if prefix * prefix < 1 << 15 else np.int32)
    of, place = posted.ravel().argsort(kind="stable"), np.tile(np.arange(prefix), n)
    starts = np.searchsorted(posted.ravel()[of], np.arange(pivots + 1))
    asks, rank = np.nonzero(np.ones_like(asked, bool))
    by = asked.ravel().argsort(kind="stable")
    bounds = np.searchsorted(asked.ravel()[by], np.arange(pivots + 1))
    worth = np.arange(prefix, 0, -1).astype(credit.dtype)  # of each place
    for p in range(pivots):
        members = of[starts[p] : starts[p + 1]]
        readers = by[bounds[p] : bounds[p + 1]]
        if len(members) and len(readers):
            shared = np.minimum.outer(worth[rank[readers]], worth[place[members]])
            credit[np.ix_(asks[readers], members // prefix)] += shared
    return credit


def distinct_vectors(ids: np.ndarray, x: np.ndarray, most: int) -> tuple[np.ndarray, list]:
    """Row of one copy of each vector, and the ids of its first ``most`` copies, ascending."""
    order = np.argsort(ids, kind="stable")
    rows = np.ascontiguousarray(x[order]).view(f"V{x.shape[1] * x.itemsize}").ravel()
    _, first, inverse = np.unique(rows, return_index=True, return_inverse=True)
    copies: list[list[int]] = [[] for _ in first]
    for i, group in zip(ids[order].tolist(), inverse.tolist(), strict=True):
        if len(copies[group]) < most:
            copies[group].append(i)
    return order[first], copies


def guessed_cosines(
    credit: np.ndarray, x: np.ndarray, lengths: np.ndarray, q: np.ndarray, asked: np.ndarray
) -> np.ndarray:
    """Each query's and vector's cosine as a rising line over their credit, fitted on some pairs."""
    i = np.arange(0, len(q), -(-len(q) // PAIRS[0]))
    j = np.arange(0, len(x), -(-len(x) // PAIRS[1]))
    cosines = (q[i] / asked[i, None]) @ (x[j] / lengths[j, None]).T
    some = credit[np.ix_(i, j)].astype(float)
    spread = some - some.mean()
    rise = (spread * cosines).sum() / max((spread * spread).sum(), 1.0)
    rise = max(rise, 1e-9)
    return cosines.mean() + rise * (credit - some.mean())


def candidates(
    credit: np.ndarray, x: np.ndarray, q: np.ndarray, k: int, wanted: int, crowd: float
) -> list[np.ndarray]:
    """For each query the vectors whose inner products are computed.

    Orders know directions only, and a long vector needs less of the query's direction than a short
    one. So the products of half of the ``wanted`` vectors, those of the greatest guesses, give a
    score to be reached; then vectors are taken by how far their guessed cosine is above the one
    that, at their length, reaches it. A crowd with nearly the query's own order is taken as a whole.
    """
    lengths = np.maximum(np.sqrt((x * x).sum(axis=1)), 1e-150)
    asked = np.maximum(np.sqrt((q * q).sum(axis=1)), 1e-150)
    guess = guessed_cosines(credit, x, lengths, q, asked)
    half = min(len(x), max(k + 1, wanted // 2))
    out = []
    for i, v in enumerate(q):
        first = np.argpartition(-guess[i] * lengths, half - 1)[:half]
        scores = x[first] @ v
        reach = np.partition(scores, max(0, half - k - 1))[max(0, half - k - 1)] / asked[i]
        above = guess[i] - reach / lengths
        last = np.partition(above, len(x) - wanted)[len(x) - wanted]
        taken = (above >= last) | (credit[i] >= crowd)
        taken[first] = True
        out.append(np.flatnonzero(taken))
    return out


def search_shard(ids, x, query_ids, q, pivots: np.ndarray, k: int, prefix: int):
    """Each query's ``k`` best of the shard's candidates: query id, id, inner product."""
    keep, copies = distinct_vectors(ids, x, k + 1)
    x = x[keep]
    n = len(x)
    if not n:
        return
    wanted = min(n, max(LEAST, -(-n // SHARE)))
    prefix = min(prefix, len(pivots))
    if wanted < n:
        posted, asked = orders(x, pivots, prefix), orders(q, pivots, prefix)
        credit = footrule_credit(posted, asked, len(pivots))
        chosen = candidates(credit, x, q, k, wanted, CROWD * prefix * (prefix + 1) / 2)
    else:
        chosen = [np.arange(n)] * len(q)
    # copies only add ids to a vector, so the k + 1 best vectors and their ties are enough; the
    # margin covers the order of summing, in which the rough scores differ from the exact ones
    margin = 1e-12 * np.sqrt((q * q).sum(axis=1) * (x * x).sum(axis=1).max())
    for i, own in enumerate(query_ids.tolist()):
        near = x[chosen[i]]
        rough = near @ q[i]
        place = max(0, len(near) - k - 1)
        best = np.flatnonzero(rough >= np.partition(rough, place)[place] - margin[i])
        scores = (near[best] * q[i]).sum(axis=1).tolist()
        rows = chosen[i][best].tolist()
        found = [(-s, c) for s, j in zip(scores, rows, strict=True) for c in copies[j] if c != own]
        for score, c in sorted(found)[:k]:
            yield own, c, -score


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    key: str = "vec_id",
    vector: str = "embedding",
    prefix: int = PREFIX,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows of ``vectors`` found nearest to each query.

    Score is the inner product in double precision; ties go to the smaller id, and a query's own id
    is no candidate. Rows whose id or vector is null, and vectors that are empty, all zero or hold a
    null, NaN or infinite element take no part. Vectors of other lengths than the query's aren't
    compared with it. Of rows with one id the greatest vector counts. With fewer than ``k``
    candidates all are returned; empty tables give no rows; other columns are left out.
    Rows and queries are hashed into a grid of shards and blocks; each cell is one bounded task.
    """
    rows = materialize(usable(vectors, key, vector), "vectors")
    asks = materialize(usable(queries, key, vector), "queries")
    pivots = choose_pivots(rows)
    shards = max(1, -(-rows.count() // SHARD_ROWS))
    blocks = max(1, -(-asks.count() // QUERY_ROWS))

    def hashed(n: int):
        return F.pmod(F.xxhash64("id"), F.lit(n))

    def cells(df: DataFrame, cell) -> DataFrame:
        return df.select("id", "vec", cell.cast("long").alias("cell"))

    left = cells(
        rows.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))),
        hashed(shards) * blocks + F.col("_b"),
    )
    right = cells(
        asks.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))),
        F.col("_s") * blocks + hashed(blocks),
    )

    def by_length(t: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        ids = t["id"].to_numpy()
        vecs = t["vec"].combine_chunks()
        if isinstance(vecs, pa.ChunkedArray):
            vecs = pa.concat_arrays(vecs.chunks) if vecs.num_chunks else pa.array([], vecs.type)
        lengths = vecs.value_lengths().to_numpy(zero_copy_only=False)
        flat, ends = vecs.flatten().to_numpy(zero_copy_only=False), np.cumsum(lengths)
        out = {}
        for d in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == d)
            out[d] = ids[at], flat[(ends[at] - d)[:, None] + np.arange(d)]
        return out

    def search(have: pa.Table, ask: pa.Table) -> pa.Table:
        found: list[tuple[int, int, float]] = []
        data = by_length(have)
        for d, (query_ids, q) in by_length(ask).items():
            if d in data and d in pivots:
                found += search_shard(*data[d], query_ids, q, pivots[d], k, prefix)
            elif d in data:  # a length that no pivot has: every row is a candidate
                ids, x = data[d]
                for own, v in zip(query_ids.tolist(), q, strict=True):
                    scores = (x * v).sum(axis=1)
                    ranked = sorted((-s, i) for s, i in zip(scores, ids.tolist(), strict=True) if i != own)
                    found += [(own, i, -s) for s, i in ranked[:k]]
        columns = list(zip(*found, strict=True)) or [[], [], []]
        types = (pa.int64(), pa.int64(), pa.float64())
        return pa.table(
            [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
            names=["query_id", "vec_id", "score"],
        )

    found = (
        left.groupBy("cell")
        .cogroup(right.groupBy("cell"))
        .applyInArrow(search, "query_id long, vec_id long, score double")
    )
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )

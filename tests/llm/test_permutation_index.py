import numpy as np

from kindred.llm import permutation_index as pi


def test_footrule_credit():
    rng = np.random.default_rng(3)
    posted = np.array([rng.permutation(20)[:8] for _ in range(30)])
    asked = np.array([rng.permutation(20)[:8] for _ in range(5)])
    credit = pi.footrule_credit(posted, asked, 20)
    most = 2 * sum(range(1, 9))
    for i, a in enumerate(asked):
        for j, b in enumerate(posted):
            at, bt = {p: n for n, p in enumerate(a)}, {p: n for n, p in enumerate(b)}
            distance = sum(abs(at.get(p, 8) - bt.get(p, 8)) for p in at.keys() | bt.keys())
            assert most - 2 * credit[i, j] == distance


def brute(rows, queries, k):
    out = set()
    for i, q in queries:
        scores = sorted((-float((np.array(q) * np.array(v)).sum()), n) for n, v in rows if n != i)
        out |= {(i, r + 1, n, -s) for r, (s, n) in enumerate(scores[:k])}
    return out


def frame(spark, rows):
    rows = [(i, v, "x", 1.0) for i, v in rows]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, id string, score double")


def test_odd_rows(spark):
    good = [(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [1.0, 1.0]), (4, [1.0, 1.0]), (5, [1.0, 1.0])]
    odd = [(6, None), (7, []), (8, [0.0, 0.0]), (9, [1.0, None]), (10, [float("nan"), 1.0]),
           (11, [float("inf"), 1.0]), (None, [1.0, 1.0]), (3, [1.0, 1.0]), (12, [1.0, 2.0, 3.0])]
    df = frame(spark, good + odd)
    got = {tuple(r) for r in pi.nearest(df, df.filter("vec_id in (1, 3, 8, 12)"), k=3).collect()}
    assert got == brute(good, [good[0], good[2]], 3)
    nothing = frame(spark, [])
    assert pi.nearest(nothing, nothing).count() == 0
    assert pi.nearest(df, nothing).count() == 0 == pi.nearest(nothing, df).count()


def test_recall_and_copies(spark, monkeypatch):
    monkeypatch.setattr(pi, "SHARD_ROWS", 1500)
    monkeypatch.setattr(pi, "LEAST", 100)
    monkeypatch.setattr(pi, "QUERY_ROWS", 40)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4500, 32)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[3000:] = x[7]  # a third of all rows are copies
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    queries = rows[::50]
    df = frame(spark, rows)
    got = {tuple(r) for r in pi.nearest(df, df.filter("vec_id % 50 = 0")).collect()}
    want = brute(rows, queries, 20)
    pairs = lambda s: {(a, c) for a, _, c, _ in s}
    assert len(got) == len(want)
    assert len(pairs(got) & pairs(want)) >= 0.9 * len(want)
    copies = [q for q, _ in queries if q >= 3000]
    assert {g for g in got if g[0] in copies} == {w for w in want if w[0] in copies}


def test_recall_of_unequal_lengths():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4096, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    pivots = []
    for v in x:
        if not pivots or len(pivots) < pi.PIVOTS and (np.stack(pivots) @ v).max() < pi.APART:
            pivots.append(v)
    for spread in (0.0, 0.5, 1.0):
        rows = x * np.exp(spread * rng.normal(size=(4096, 1)))
        scores = rows[:64] @ rows.T
        scores[np.arange(64), np.arange(64)] = -np.inf
        want = {(i, j) for i, best in enumerate(np.argsort(-scores, axis=1)[:, :20].tolist()) for j in best}
        ids = np.arange(4096)
        found = pi.search_shard(ids, rows, ids[:64], rows[:64], np.stack(pivots), 20, pi.PREFIX)
        assert len({(i, j) for i, j, _ in found} & want) >= 0.97 * len(want)

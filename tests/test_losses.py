import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.operators.losses import Head, class_losses

ITEMS = "i long, v array<double>, a int, b int"


def slow_loss(v, label, classes, scale, margin):
    """One item against all classes, a class at a time."""
    if v is None or label is None or not 0 <= label < len(classes):
        return None
    scores = []
    for n, w in enumerate(classes):
        s = float(np.dot(v, w))
        if margin is not None:
            s /= math.hypot(*v) * math.hypot(*w)
            if n == label:
                if s > math.cos(math.pi - margin):
                    s = math.cos(math.acos(max(-1.0, min(1.0, s))) + margin)
                else:
                    s -= math.sin(math.pi - margin) * margin
        scores.append(scale * s)
    top = max(scores)
    return math.log(sum(math.exp(s - top) for s in scores)) + top - scores[label]


def tables(spark, n_classes):
    rng = np.random.default_rng(4)
    rows = [(i // 2, rng.normal(size=6).tolist(), i % 5, i % n_classes) for i in range(60)]
    rows += [(99, None, 1, 1), (100, [1.0] * 6, None, 2), (101, [2.0] * 6, 1, n_classes + 7), (102, [1.0] * 6, -1, 0)]
    near = [rng.normal(size=6).tolist() for _ in range(5)]
    far = [(-np.array(rows[i % 60][1])).tolist() for i in range(n_classes)]  # labels that are opposite
    frame = lambda ws: spark.createDataFrame(list(enumerate(ws)), "class_id long, weights array<double>")
    return rows, near, far, spark.createDataFrame(rows, ITEMS), frame(near), frame(far)


@pytest.mark.parametrize("class_bytes", [1 << 20, 6 * 8 * 10, 0])
def test_losses(spark, class_bytes):
    rows, near, far, items, small, large = tables(spark, 37)
    heads = {"x": Head(small, "a", cosine=False, margin=None, scale=1.0), "y": Head(large, "b")}
    found = class_losses(
        items, heads, row_id="i", vec="v", carry=["b"], class_bytes=class_bytes, class_rows=8, item_rows=16
    )
    got = sorted(((r.i, r.b, r.x, r.y) for r in found.collect()), key=lambda r: r[:2])
    want = [
        (i, b, slow_loss(v, a, near, 1.0, None), slow_loss(v, b, far, 64.0, 0.4))
        for i, v, a, b in rows if v is not None
    ]
    want.sort(key=lambda r: r[:2])
    assert len(got) == len(want)
    for have, expected in zip(got, want, strict=True):
        assert have[:2] == expected[:2]
        for x, y in zip(have[2:], expected[2:], strict=True):
            assert x is None if y is None else x == pytest.approx(y, rel=1e-9, abs=1e-9)


def test_no_array_leaves_a_task(spark):
    _, _, _, items, small, large = tables(spark, 37)
    heads = {"x": Head(small, "a"), "y": Head(large, "b")}
    found = class_losses(items, heads, row_id="i", vec="v")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan and "Join" not in plan


def test_empty(spark):
    _, _, _, items, small, _ = tables(spark, 3)
    none = class_losses(items.limit(0), {"x": Head(small, "a")}, row_id="i", vec="v")
    assert none.count() == 0
    no_class = class_losses(items, {"x": Head(small.limit(0), "a")}, row_id="i", vec="v")
    assert no_class.where(F.col("x").isNotNull()).count() == 0 and no_class.count() == 63

"""Vector expressions on ``ARRAY<FLOAT|DOUBLE>`` columns; arithmetic is in double."""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a lambda variable.

    A plain column would be inlined at each use, which inside a lambda means once per element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(as_double(v), F.lit(0.0), lambda acc, x: acc + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Dot product over both norms; 0 where a vector is zero."""
    scale = norm(a) * norm(b)
    return F.when(scale > 0, dot(a, b) / scale).otherwise(F.lit(0.0))


def squared_l2(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y)))


def l2_normalize(v: Column, zero: str = "zeros") -> Column:
    """Unit vector; a zero vector stays zero (``zero='zeros'``) or becomes NaN (``zero='nan'``)."""
    if zero not in ("zeros", "nan"):
        raise ValueError(f"zero must be 'zeros' or 'nan', not {zero!r}")
    filler = F.lit(0.0) if zero == "zeros" else F.lit(float("nan"))
    return _bind(
        norm(v),
        lambda n: F.transform(as_double(v), lambda x: F.when(n > 0, x / n).otherwise(filler)),
    )


def concat_modalities(*vectors: Column) -> Column:
    """Unit vectors of each modality, one after the other."""
    return F.concat(*[l2_normalize(v) for v in vectors])


def pair_features(u: Column, v: Column) -> Column:
    """``[u, v, |u - v|]``."""
    a, b = as_double(u), as_double(v)
    return F.concat(a, b, F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def mean_of(vectors: Column) -> Column:
    """Element-wise mean of a short array of vectors; NULL if they differ in length or have gaps."""
    total = F.aggregate(
        F.slice(vectors, 2, F.size(vectors)),
        as_double(F.get(vectors, F.lit(0))),
        lambda acc, v: F.zip_with(acc, as_double(v), lambda x, y: x + y),
    )
    mean = F.transform(total, lambda x: x / F.size(vectors))
    return _bind(mean, lambda m: F.when((F.size(vectors) > 0) & ~F.exists(m, lambda x: x.isNull()), m))


def margin_scores(
    scores: Column,
    label: Column,
    scale: float = 64.0,
    margin: float = 0.40,
    easy_margin: bool = False,
) -> Column:
    """Scaled cosine scores with an additive angular margin at the true class."""
    cos_m, sin_m = math.cos(margin), math.sin(margin)
    threshold, fallback = math.cos(math.pi - margin), math.sin(math.pi - margin) * margin

    def with_margin(c: Column) -> Column:
        widened = c * cos_m - F.sqrt(F.greatest(F.lit(0.0), 1.0 - c * c)) * sin_m
        if easy_margin:
            return F.when(c > 0, widened).otherwise(c)
        return F.when(c > threshold, widened).otherwise(c - fallback)

    return F.transform(
        scores, lambda c, i: F.when(i == label, with_margin(c)).otherwise(c) * scale
    )


def cross_entropy(scores: Column, label: Column) -> Column:
    """Softmax cross-entropy of an array of scores against a 0-based class index."""
    return _bind(
        F.array_max(scores),
        lambda top: F.log(F.aggregate(scores, F.lit(0.0), lambda acc, s: acc + F.exp(s - top)))
        + top
        - F.get(scores, label),
    )


def argmax(scores: Column) -> Column:
    """0-based index of the first highest score."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def multitask_loss(lv1: Column, lv2: Column, tag: Column, weights=(10.0, 5.0, 1.0)) -> Column:
    return lv1 * weights[0] + lv2 * weights[1] + tag * weights[2]


def pixel_normalize(pixels: Column, mean, std) -> Column:
    """``(x / 255 - mean) / std`` per channel of interleaved pixels; channel order as in ``pixels``."""
    channels = len(mean)
    means = F.array(*[F.lit(float(m)) for m in mean])
    stds = F.array(*[F.lit(float(s)) for s in std])
    return F.transform(
        pixels,
        lambda x, i: (x / F.lit(255.0) - F.get(means, i % channels)) / F.get(stds, i % channels),
    )

"""Quality rules under weak supervision.

Each rule votes good, votes bad or abstains. Votes are summed into patterns over the whole corpus,
expectation-maximisation estimates from the pattern counts how far every rule can be trusted, and a
document is kept by its posterior probability of being good instead of by all rules passing.
"""

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.columns import per_text, rows_of, text_hash
from kindred.session import materialize

WINDOW = 8  # words
SYMBOLS = b"#*$%&|<>"
FEATURES = [
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_upper",
    "n_digits",
    "n_marked_words",
    "n_distinct_words",
    "n_lines",
    "n_stutters",
]


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a run of ``window`` words found twice or more in the text."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    run = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    width = 1
    while width < window:  # runs of 1, 2, 4, 8 words get dense ids, so equal ids are equal runs
        step = min(width, window - width)
        pairs = run[: len(run) - step] * (int(run.max()) + 1) + run[step:]
        values, run = np.unique(pairs, return_inverse=True)
        width += step
        if len(values) == len(pairs):
            return 0
    again = np.bincount(run)[run] > 1
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, np.flatnonzero(again), 1)
    np.add.at(edges, np.flatnonzero(again) + window, -1)
    return int((np.cumsum(edges) > 0).sum())


def text_features(data: bytes) -> tuple[int, ...]:
    words = data.split()
    spaces = sum(data.count(c) for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
    continued = len(data.translate(None, bytes(range(0x80)) + bytes(range(0xC0, 0x100))))
    lines = data.split(b"\n")
    filled = [x for x in lines if x.split(None, 1)]
    return (
        len(words),
        len(data) - continued - spaces,
        sum(data.count(bytes([c])) for c in SYMBOLS),
        len(filled) - len(set(filled)),
        repeated_words(words),
        len(data) - len(data.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")),
        len(data) - len(data.translate(None, b"0123456789")),
        sum(1 for w in words if not w[-1:].isalnum() and w[-1] < 0x80 and w[-2:-1] == w[-1:]),
        len(set(words)),
        len(filled),
        sum(map(bytes.__eq__, words, words[1:])),
    )


def features(
    docs: DataFrame, text: str = "text", key: str = "doc_id", also: Sequence[str] = ()
) -> DataFrame:
    """The counts that the rules look at, one row per row of ``docs``; a null text counts as empty.

    Columns in ``also`` are handed on.
    """
    keys = [key, *also]
    own = ", ".join(f"`{k}` {docs.select(f'`{k}`').schema[0].dataType.simpleString()}" for k in keys)
    schema = f"{own}, " + ", ".join(f"{f} long" for f in FEATURES)
    return per_text(docs, text, keys, schema, text_features)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _share(a: str, b: str) -> Column:
    return F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))


def rules() -> dict[str, Column]:
    """Votes ``g``, ``b`` or ``-`` (abstains).

    Texts fail in one way at a time, so a rule about one kind of fault says nothing where that fault
    is missing; only the last two rules, which look at several signs together, speak for a text.
    A rule abstains on texts too short for it.
    """

    def bad(fault: Column, speaks: Column) -> Column:
        return F.when(speaks & fault, "b").otherwise("-")

    some, many = F.col("n_words") >= 10, F.col("n_words") >= 50
    symbols, marked = _share("n_symbols", "n_words"), _share("n_marked_words", "n_words")
    upper, digits = _share("n_upper", "word_chars"), _share("n_digits", "word_chars")
    repeats, doubled = _share("n_repeat_words", "n_words"), _share("n_dup_lines", "n_lines")
    variety, mean_length = _share("n_distinct_words", "n_words"), _share("word_chars", "n_words")
    stutters = _share("n_stutters", "n_words")
    plain = (symbols <= 0.05) & (marked <= 0.05) & (upper <= 0.15) & (digits <= 0.3)
    fresh = (repeats <= 0.3) & (doubled <= 0.3) & (stutters <= 0.1)
    usual = mean_length.between(3, 10) & (variety >= 0.2) & (stutters <= 0.1)
    return {
        "symbols": bad(symbols >= 0.15, some),
        "marked": bad(marked >= 0.15, some),
        "upper": bad(upper >= 0.3, some),
        "digits": bad(digits >= 0.5, some),
        "repeats": bad(repeats >= 0.3, many),
        "dup_lines": bad(doubled >= 0.4, F.col("n_lines") >= 4),
        "stutters": bad(stutters >= 0.2, some),
        "length": bad((mean_length < 2) | (mean_length > 14), some),
        "prose": F.when(some & plain & usual, "g").otherwise("-"),
        "fresh": F.when(some & plain & fresh, "g").otherwise("-"),
    }


def fit_rules(
    patterns: dict[str, int], rounds: int = 100, prior: float = 0.8
) -> tuple[float, np.ndarray, dict[str, float]]:
    """Class share, outcome probabilities [rule, good/bad, g/b/-] and each pattern's posterior.

    ``prior`` is the share of good documents that the first round starts from. The first posterior
    is the vote balance, so that class 0 means good; outcome counts are smoothed by one.
    """
    names = sorted(patterns)
    if not names:
        return prior, np.zeros((0, 2, 3)), {}
    codes = np.array([["gb-".index(c) for c in p] for p in names])
    counts = np.array([patterns[p] for p in names], float)
    hot = np.eye(3)[codes]  # pattern, rule, outcome
    balance = hot[:, :, 0].sum(1) - 2.0 * hot[:, :, 1].sum(1) + np.log(prior / (1 - prior))
    good = 1 / (1 + np.exp(-balance))
    share, table = prior, np.zeros((codes.shape[1], 2, 3))
    for _ in range(rounds):
        weights = np.stack([good * counts, (1 - good) * counts])  # class, pattern
        table = np.einsum("cp,pro->rco", weights, hot) + 1.0
        table /= table.sum(2, keepdims=True)
        share = (weights[0].sum() + 1) / (counts.sum() + 2)
        logs = np.einsum("pro,rco->pc", hot, np.log(table)) + np.log([share, 1 - share])
        before, good = good, 1 / (1 + np.exp(np.clip(logs[:, 1] - logs[:, 0], -500, 500)))
        if np.abs(before - good).max() < 1e-12:
            break
    return share, table, dict(zip(names, good.tolist(), strict=True))


def judge(docs: DataFrame, text: str = "text", key: str = "doc_id", least: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: the counts, ``base_failed``, ``posterior`` and ``kept``.

    A null text is an empty one and fails by its length. Repeated rows each count and each return;
    a null key stays null. An empty table gives no rows. Other columns of ``docs`` are not looked
    at, whatever their names. At most 3^10 vote patterns with their counts reach the driver.
    """
    return _judged(docs, text, key, least, [])


def _judged(docs: DataFrame, text: str, key: str, least: float, also: list[str]) -> DataFrame:
    counted = materialize(features(docs, text, key, also), "quality-features")
    votes = F.concat(*rules().values()).alias("votes")
    patterns = counted.groupBy(votes).count().collect()  # 3^10 rows at most
    _, _, posterior = fit_rules({r.votes: r["count"] for r in patterns})
    spark = docs.sparkSession
    known = spark.createDataFrame(
        sorted(posterior.items()) or [("", 0.0)], "votes string, posterior double"
    )
    joined = counted.withColumn("votes", votes).join(F.broadcast(known), "votes", "left")
    failed = base_failed()
    return joined.withColumn("base_failed", failed).withColumn(
        "kept", ~failed & (F.col("posterior") >= least)
    )


def keep_good(
    docs: DataFrame, text: str = "text", key: str = "doc_id", null_keys: bool = False
) -> DataFrame:
    """The rows of ``docs`` that :func:`judge` keeps, with all their columns.

    Rows of one key with other texts are judged each. Rows with null keys go, unless ``null_keys``.
    """
    marked = docs.select(F.col(f"`{key}`"), F.col(f"`{text}`"), text_hash(text).alias("text_hash"))
    kept = _judged(marked, text, key, 0.5, ["text_hash"]).filter("kept")
    if not null_keys:
        kept = kept.filter(F.col(f"`{key}`").isNotNull())
    return rows_of(docs, kept, text, key)

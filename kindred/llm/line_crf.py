"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad from its own features and those of its neighbours; the chain
prefers neighbouring lines to agree. A document's score is the mean of its lines' marginal
probabilities, weighted by line length, put through a monotone calibration.
"""

import re
import zlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.columns import per_text, rows_of, text_hash

SAMPLE_DOCS = 4000  # labelled rows that the fit may hold; chosen by hash
SAMPLE_CHARS = 40_000  # characters of a row that the fit may hold; scoring takes all texts whole
HASHED = 256  # columns for hashed word shapes
LONG_LINE = 400  # words; longer lines count as several, so that features stay comparable
SYMBOLS = b"#*$%&|<>"
UPPER, DIGITS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"
SHAPES = bytes.maketrans(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", b"A" * 26 + b"a" * 26 + b"0" * 10
)
WORDY = bytes(range(0x80, 0x100))  # bytes of letters outside ASCII count as one small letter
SHAPES = SHAPES.translate(bytes.maketrans(WORDY, b"a" * len(WORDY)))
RUNS = re.compile(rb"(.)\1+", re.DOTALL)
NUMERIC = 12


def shape(word: bytes) -> bytes:
    """The word's kinds of characters, runs of one kind shortened to one."""
    return RUNS.sub(rb"\1", word.translate(SHAPES))


def lines_of(data: bytes) -> list[list[bytes]]:
    """The words of each line that has some; very long lines in parts."""
    out = []
    for line in data.split(b"\n"):
        words = line.split()
        out += [words[i : i + LONG_LINE] for i in range(0, len(words), LONG_LINE)]
    return out


def shape_places(words: list[bytes], shapes: dict[bytes, int]) -> list[int]:
    """The hashed column of each word's shape; ``shapes`` remembers words met before."""
    places = list(map(shapes.get, words))
    if None in places:
        if len(shapes) > 200_000:
            shapes.clear()
        for i, (w, place) in enumerate(zip(words, places, strict=True)):
            if place is None:
                places[i] = place = zlib.crc32(shape(w)) % HASHED
                if len(w) <= 40:
                    shapes[w] = place
    return places


def line_features(lines: list[list[bytes]], shapes: dict[bytes, int]) -> np.ndarray:
    """One row per line: counts and shares of the line, then hashed word shapes as shares."""
    counts = np.array([len(words) for words in lines], float)
    numeric = np.empty((len(lines), NUMERIC))
    seen: set[bytes] = set()
    used: set[bytes] = set()
    for i, words in enumerate(lines):
        joined = b" ".join(words)
        size, distinct = len(joined), set(words)
        numeric[i] = (
            1.0,
            0.0,
            size,
            size - len(joined.translate(None, SYMBOLS)),
            size - len(joined.translate(None, UPPER)),
            size - len(joined.translate(None, DIGITS)),
            len(distinct),
            sum(map(bytes.__eq__, words, words[1:])),
            joined in seen,
            len(distinct & used) / len(distinct),
            joined[-1:] in b".!?",
            words[0][:1].isupper() or words[0][0] >= 0xC3,
        )
        seen.add(joined)
        used |= distinct
    numeric[:, 1] = np.log1p(counts) / 3
    numeric[:, 4:6] *= 3 / numeric[:, 2:3]
    numeric[:, 2] /= counts * 10
    numeric[:, 3] /= counts
    numeric[:, 6] = 1 - numeric[:, 6] / counts
    numeric[:, 7] /= counts
    places = np.array(shape_places([w for words in lines for w in words], shapes))
    at = np.repeat(np.arange(len(lines)) * HASHED, counts.astype(int)) + places
    hashed = np.bincount(at, minlength=len(lines) * HASHED).reshape(len(lines), HASHED)
    return np.hstack([numeric, hashed / counts[:, None]])


def with_neighbours(x: np.ndarray) -> np.ndarray:
    """A line's features, and the numeric ones of the line before and after it (zeros: none)."""
    own = x[:, :NUMERIC]
    blank = np.zeros((1, NUMERIC))
    before, after = np.vstack([blank, own[:-1]]), np.vstack([own[1:], blank])
    return np.hstack([x, before, after]) if len(x) else np.zeros((0, x.shape[1] + 2 * NUMERIC))


@dataclass
class Model:
    weights: np.ndarray  # of a line being good rather than bad
    chain: np.ndarray  # 2 x 2, log-potentials of neighbouring labels
    slope: float = 1.0
    shift: float = 0.0
    empty: float = 0.0  # score of a text without words


def forward_backward(emit: np.ndarray, chain: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals [line, label], pairwise marginals summed over the chain, and log Z."""
    n = len(emit)
    forward, backward = np.empty((n, 2)), np.zeros((n, 2))
    forward[0] = emit[0]
    for i in range(1, n):
        forward[i] = emit[i] + np.logaddexp(forward[i - 1, 0] + chain[0], forward[i - 1, 1] + chain[1])
    for i in range(n - 2, -1, -1):
        ahead = emit[i + 1] + backward[i + 1]
        backward[i] = np.logaddexp(chain[:, 0] + ahead[0], chain[:, 1] + ahead[1])
    log_z = np.logaddexp(*forward[-1])
    marginals = np.exp(forward + backward - log_z)
    pairs = np.zeros((2, 2))
    if n > 1:
        joint = forward[:-1, :, None] + chain + (emit[1:] + backward[1:])[:, None, :] - log_z
        pairs = np.exp(joint).sum(0)
    return marginals, pairs, float(log_z)


def chain_marginals(scores: np.ndarray, chain: np.ndarray) -> np.ndarray:
    """Probability of label good for each line; the same recursion on probability ratios."""
    a, b = np.exp(chain)
    odds = np.exp(np.clip(scores, -60, 60)).tolist()
    n = len(odds)
    ahead = [1.0] * n  # message from the right, good over bad
    for i in range(n - 2, -1, -1):
        r = odds[i + 1] * ahead[i + 1]
        ahead[i] = (b[0] + b[1] * r) / (a[0] + a[1] * r)
    out, behind = [], 1.0
    for i in range(n):
        total = odds[i] * behind * ahead[i]
        out.append(total / (1 + total))
        r = odds[i] * behind
        behind = (a[1] + b[1] * r) / (a[0] + b[0] * r)
    return np.array(out)


def pooled(marginals: np.ndarray, lengths: np.ndarray) -> float:
    return float((marginals * lengths).sum() / lengths.sum())


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def fit(texts: list[bytes], labels: list[int], rounds: int = 60, ridge: float = 1e-4) -> Model:
    """Maximise the conditional likelihood of the lines' labels, which are their document's.

    Gradient steps with momentum and per-weight scaling over all lines at once; then the document
    scores are calibrated by a logistic fit of one slope and shift.
    """
    docs = [(lines_of(t), y) for t, y in zip(texts, labels, strict=True)]
    base = (sum(labels) + 1) / (len(labels) + 2) if labels else 0.5
    docs = [(lines, y) for lines, y in docs if lines]
    shapes: dict[bytes, int] = {}
    parts = [with_neighbours(line_features(lines, shapes)).astype(np.float32) for lines, _ in docs]
    dim = NUMERIC * 3 + HASHED
    model = Model(np.zeros(dim), np.zeros((2, 2)), empty=0.0)
    if len({y for _, y in docs}) < 2:
        model.weights[0] = np.log(base / (1 - base))
        return model
    x = np.vstack(parts)
    sizes = np.array([len(p) for p in parts])
    ends = np.cumsum(sizes)
    y = np.repeat([y for _, y in docs], sizes)
    weight = np.repeat(1 / sizes, sizes)  # every document counts once
    m1, m2 = np.zeros(dim + 4), np.zeros(dim + 4)
    order = np.argsort(-sizes, kind="stable")
    for step in range(1, rounds + 1):
        good = x @ model.weights.astype(np.float32)
        marginals, pairs = batch_marginals(good, model.chain, ends - sizes, sizes, order)
        slope = x.T @ ((marginals - y) * weight).astype(np.float32) / len(docs)
        slope = slope + ridge * model.weights
        seen = np.zeros((2, 2))
        for label in (0, 1):
            seen[label, label] = sum((n - 1) / n for n, (_, d) in zip(sizes, docs, strict=True) if d == label)
        chain_slope = (pairs - seen) / len(docs) + 0.02 * model.chain
        g = np.concatenate([slope, chain_slope.ravel()])
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        move = 0.15 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
        model.weights -= move[:dim]
        model.chain -= move[dim:].reshape(2, 2)
    raw = np.array([raw_score(lines, model, shapes) for lines, _ in docs])
    target = np.array([d for _, d in docs], float)
    for _ in range(300):
        error = _sigmoid(model.slope * raw + model.shift) - target
        model.slope = max(0.05, model.slope - 0.5 * float((error * raw).mean()))
        model.shift -= 0.5 * float(error.mean())
    return model


def batch_marginals(good, chain, starts, sizes, order):
    """Forward-backward over many chains at once, longest first so that active ones are a prefix."""
    starts, sizes = starts[order], sizes[order]
    longest = int(sizes[0])
    active = [int((sizes > t).sum()) for t in range(longest)]
    emit = lambda t, k: np.stack([np.zeros(k), good[starts[:k] + t]], 1)
    forward = [emit(0, len(sizes))]
    for t in range(1, longest):
        k = active[t]
        f = forward[-1][:k]
        forward.append(emit(t, k) + np.logaddexp(f[:, :1] + chain[0], f[:, 1:] + chain[1]))
    backward = np.zeros((len(sizes), 2))
    log_z = np.empty(len(sizes))
    for t in range(longest):
        k = active[t]
        last = np.flatnonzero(sizes[:k] == t + 1)
        log_z[last] = np.logaddexp(forward[t][last, 0], forward[t][last, 1])
    out, pairs = np.empty(len(good)), np.zeros((2, 2))
    for t in range(longest - 1, -1, -1):
        k = active[t]
        out[starts[:k] + t] = np.exp(forward[t][:, 1] + backward[:k, 1] - log_z[:k])
        if t:
            ahead = emit(t, k) + backward[:k]
            joint = forward[t - 1][:k, :, None] + chain + ahead[:, None, :] - log_z[:k, None, None]
            pairs += (np.exp(joint) / sizes[:k, None, None]).sum(0)
            backward[:k] = np.logaddexp(chain[:, 0] + ahead[:, :1], chain[:, 1] + ahead[:, 1:])
    return out, pairs


def raw_score(lines: list[list[bytes]], model: Model, shapes: dict[bytes, int]) -> float:
    """The log-odds of the length-weighted mean of the lines' marginals."""
    scores = with_neighbours(line_features(lines, shapes)) @ model.weights
    lengths = np.array([sum(map(len, words)) for words in lines], float)
    p = np.clip(pooled(chain_marginals(scores, model.chain), lengths), 1e-6, 1 - 1e-6)
    return float(np.log(p / (1 - p)))


def score_text(data: bytes, model: Model, shapes: dict[bytes, int]) -> float:
    lines = lines_of(data)
    return float(_sigmoid(model.slope * raw_score(lines, model, shapes) + model.shift)) if lines else model.empty


def held_out(key: str = "doc_id"):
    """Rows kept apart from every fit: CRC-32 of the id as text divides by 5."""
    return F.coalesce(F.crc32(F.col(f"`{key}`").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(
    docs: DataFrame,
    labels: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    limit: int = SAMPLE_DOCS,
    longest: int = SAMPLE_CHARS,
) -> Model:
    """Fit on at most ``limit`` labelled documents that aren't held out, chosen by a hash of the id.

    The sample is bounded by ``limit`` rows of at most ``longest`` characters each.
    Labels other than 0 and 1 and null labels or ids are passed over; a document labelled both ways
    counts as bad. The texts of the sample, not of the corpus, reach the driver.
    """
    known = (
        labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").alias("_key"))
        .agg(F.min("quality").alias("_quality"))
        .filter(~held_out("_key"))
    )
    # twice the limit, as some are too long or not in ``docs``; bounded, so fit to be broadcast
    some = known.orderBy(F.xxhash64("_key"), "_key").limit(2 * limit)
    texts = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text"))
    found = (
        texts.filter(F.coalesce(F.char_length("_text"), F.lit(0)) <= longest)
        .join(F.broadcast(some), "_key")
        .orderBy(F.xxhash64("_key"), "_key", "_text")
        .limit(limit)
        .collect()
    )
    return fit([(r._text or "").encode() for r in found], [r._quality for r in found])


def score(
    docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id", also: Sequence[str] = ()
) -> DataFrame:
    """``key`` and ``score`` (0 to 1) of every row from its whole text.

    Null and empty texts, and texts of white space, score 0. Repeated rows score each, null keys
    stay; an empty table gives no rows; other columns than those in ``also`` are left out.
    """
    keys = [key, *also]
    own = ", ".join(f"`{k}` {docs.select(f'`{k}`').schema[0].dataType.simpleString()}" for k in keys)
    shapes: dict[bytes, int] = {}
    return per_text(
        docs, text, keys, f"{own}, score double", lambda data: (score_text(data, model, shapes),)
    )


def keep_good(
    docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", least: float = 0.3
) -> DataFrame:
    """The rows of ``docs``, all columns, that score ``least`` or more.

    Rows of one key with other texts, and rows with null keys, are judged each by its own text.
    """
    marked = docs.select(F.col(f"`{key}`"), F.col(f"`{text}`"), text_hash(text).alias("text_hash"))
    scored = score(marked, train(docs, labels, text, key), text, key, ["text_hash"])
    return rows_of(docs, scored.filter(F.col("score") >= least), text, key)

import zlib
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

import kindred.llm.queries  # noqa: F401
from kindred.llm import line_crf
from kindred.llm.registry import QUERIES

GOOD = "The river was calm and the boats went home before night.\nPeople spoke of the weather.\n"
BAD = "$$$ BUY NOW ### 100% 999 | | |\nBUY BUY BUY <<<>>> 12345 $$$\n"


def by_enumeration(scores, chain):
    """Marginals, pairwise marginals summed over the chain and log Z, from every labelling."""
    n = len(scores)
    mass, marginals, pairs = 0.0, np.zeros((n, 2)), np.zeros((2, 2))
    for labels in product((0, 1), repeat=n):
        steps = list(zip(labels, labels[1:], strict=False))
        weight = np.exp(sum(s for s, y in zip(scores, labels, strict=True) if y) + sum(chain[a, b] for a, b in steps))
        mass += weight
        for i, y in enumerate(labels):
            marginals[i, y] += weight
        for a, b in steps:
            pairs[a, b] += weight
    return marginals / mass, pairs / mass, np.log(mass)


def test_shape_of_the_whole_word():
    assert line_crf.shape(b"a" * 41 + b"-9A") == b"a-0A"
    assert line_crf.shape(b"Zo\xc3\xa9--12\n\n") == b"Aa-0\n"


@pytest.mark.parametrize("n", [1, 2, 5, 9])
def test_marginals_equal_those_of_all_labellings(n):
    rng = np.random.default_rng(n)
    for scale in (0.1, 2.0, 6.0):
        scores, chain = rng.normal(0, scale, n), rng.normal(0, scale, (2, 2))
        marginals, pairs, log_z = by_enumeration(scores, chain)
        got = line_crf.forward_backward(np.stack([np.zeros(n), scores], 1), chain)
        assert np.allclose(got[0], marginals) and np.allclose(got[1], pairs) and np.isclose(got[2], log_z)
        assert np.allclose(line_crf.chain_marginals(scores, chain), marginals[:, 1])


def test_batches_of_chains_equal_single_ones():
    rng = np.random.default_rng(3)
    sizes = np.array([3, 1, 7, 7, 2, 12, 1])
    ends, chain = np.cumsum(sizes), rng.normal(0, 1.5, (2, 2))
    good = rng.normal(0, 2, sizes.sum())
    order = np.argsort(-sizes, kind="stable")
    marginals, pairs = line_crf.batch_marginals(good, chain, ends - sizes, sizes, order)
    want = np.zeros((2, 2))
    for end, n in zip(ends, sizes, strict=True):
        own = good[end - n : end]
        one, both, _ = line_crf.forward_backward(np.stack([np.zeros(n), own], 1), chain)
        assert np.allclose(marginals[end - n : end], one[:, 1])
        want += both / n
    assert np.allclose(pairs, want)


def test_gradient_of_a_long_chain_stays_finite():
    marginals = line_crf.chain_marginals(np.full(20_000, -500.0), np.array([[9.0, -9.0], [-9.0, 9.0]]))
    assert np.isfinite(marginals).all() and marginals.max() < 1e-6


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int")


def corpus(make_docs, n=60):
    """Even ids good, odd ids bad, each a little different."""
    return make_docs([(i, (BAD if i % 2 else GOOD) * (1 + i % 3) + f"{i}") for i in range(n)])


def test_labels_of_held_out_rows_are_not_seen(spark, make_docs):
    docs = corpus(make_docs)
    kept_apart = {i for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 0}
    got = docs.select("doc_id", line_crf.held_out().alias("h")).collect()
    assert {r.doc_id for r in got if r.h} == kept_apart and 0 < len(kept_apart) < 30
    truth = [(i, 1 - i % 2) for i in range(60)]
    flipped = [(i, 1 - y if i in kept_apart else y) for i, y in truth]
    first, second = (line_crf.train(docs, labelled(spark, rows)) for rows in (truth, flipped))
    assert np.array_equal(first.weights, second.weights) and np.array_equal(first.chain, second.chain)
    assert (first.slope, first.shift) == (second.slope, second.shift)


def test_odd_labels_are_passed_over_and_bad_wins(spark, make_docs):
    docs = corpus(make_docs)
    truth = [(i, 1 - i % 2) for i in range(60)]
    odd = [(2, None), (None, 1), (4, 7), (999, 1), (1, 0), (1, 1)]
    a, b = line_crf.train(docs, labelled(spark, truth)), line_crf.train(docs, labelled(spark, truth + odd))
    assert np.array_equal(a.weights, b.weights)
    bounded = line_crf.train(docs, labelled(spark, truth), limit=10)
    assert not np.array_equal(a.weights, bounded.weights)
    none = line_crf.train(docs, labelled(spark, []))
    assert line_crf.score_text(GOOD.encode(), none, {}) == pytest.approx(0.5)


def test_scores_of_whole_texts(spark, make_docs):
    model = line_crf.train(corpus(make_docs), labelled(spark, [(i, 1 - i % 2) for i in range(60)]))
    texts = [GOOD, BAD, None, "", " \n\t\n", GOOD * 3000, GOOD + BAD * 2000, "word " * 100_000, "x" * 300_000, "é\n" * 50]
    docs = make_docs([*enumerate(texts), (0, GOOD), (None, GOOD), (None, None)])
    rows = line_crf.score(docs, model).collect()
    assert len(rows) == len(texts) + 3

    def plainly(text):
        """The score by the slow recursion, from features of all lines."""
        lines = line_crf.lines_of((text or "").encode())
        if not lines:
            return 0.0
        emit = line_crf.with_neighbours(line_crf.line_features(lines, {})) @ model.weights
        emit = np.clip(emit, -60, 60)
        marginals = line_crf.forward_backward(np.stack([np.zeros(len(emit)), emit], 1), model.chain)[0][:, 1]
        lengths = np.array([sum(map(len, words)) for words in lines], float)
        p = np.clip(float((marginals * lengths).sum() / lengths.sum()), 1e-6, 1 - 1e-6)
        return 1 / (1 + np.exp(-(model.slope * np.log(p / (1 - p)) + model.shift)))

    for r in rows:
        text = texts[r.doc_id] if r.doc_id is not None else None
        if r.doc_id is not None:
            assert r.score == pytest.approx(plainly(text), abs=1e-6), r.doc_id
    by = {r.doc_id: r.score for r in rows if r.doc_id is not None}
    assert by[0] > 0.7 > 0.3 > by[1] and by[2] == by[3] == by[4] == 0.0
    assert by[5] > 0.7 and by[6] < 0.3  # the end of a long text counts as its beginning
    assert sorted(r.score for r in rows if r.doc_id is None) == pytest.approx([0.0, by[0]])
    assert line_crf.score(make_docs([]), model).count() == 0


def test_keep_good_keeps_columns_and_rows(spark, make_docs):
    docs = corpus(make_docs)
    # rows of one unlabelled id, which the fit does not see
    extra = make_docs([(100, GOOD), (100, GOOD), (100, BAD), (None, GOOD), (None, BAD)]).withColumn("_kept_key", F.lit("x"))
    all_rows = docs.withColumn("_kept_key", F.lit("y")).unionByName(extra)
    kept = line_crf.keep_good(all_rows, labelled(spark, [(i, 1 - i % 2) for i in range(60)]))
    assert kept.columns == all_rows.columns
    rows = kept.collect()
    assert sorted(r.doc_id for r in rows if r._kept_key == "y") == list(range(0, 60, 2))
    assert sorted((r.doc_id is None, r.text) for r in rows if r._kept_key == "x") == [(False, GOOD)] * 2 + [(True, GOOD)]
    assert line_crf.keep_good(docs.limit(0), labelled(spark, [])).count() == 0


def test_accuracy_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality")
    scored = QUERIES["op9_quality_classifier"](spark, folder)
    assert scored.count() == spark.read.parquet(f"{folder}/documents.parquet").count()
    rows = scored.join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 50 and len({r.quality for r in rows}) == 2
    assert all(r.predicted == (r.score >= 0.3) for r in rows)
    good = np.array([r.score for r in rows if r.quality == 1])
    bad = np.array([r.score for r in rows if r.quality == 0])
    above = (good[:, None] > bad).mean() + (good[:, None] == bad).mean() / 2
    assert above > 0.95
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.9

import random
import re

import pytest
from pyspark.sql import functions as F

from kindred.llm import near_dup
from kindred.llm.components import connected

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lower)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute(rows):
    """Component of every row by comparing all sets with all."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            r = root(i)
            least[r] = min(least.get(r, key), key)
    out = []
    for i, (key, _) in enumerate(rows):
        component = least.get(root(i)) if sets[i] else key
        out.append((key, len(sets[i]), component, key is not None and key == component))
    return sorted(out, key=str)


def corpus(rng):
    vocab = [f"w{i}" for i in range(3000)]
    say = lambda n: rng.choices(vocab, k=n)

    def edited(words, edits):
        words = list(words)
        for _ in range(edits):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        return words

    base, passage = say(150), say(60)
    docs = [edited(base, rng.randint(0, 8)) for _ in range(120)]  # near copies on both sides of 75 %
    docs += [say(rng.randint(20, 200)) + passage + say(rng.randint(5, 60)) for _ in range(80)]
    docs += [edited(passage, rng.randint(0, 3)) + say(rng.randint(0, 20)) for _ in range(60)]
    docs += [say(rng.randint(1, 90)) for _ in range(60)]
    for _ in range(20):  # chains
        words = say(80)
        for _ in range(5):
            words = edited(words, 1)
            docs.append(words)
    docs += [say(4), say(1), say(20000)]
    docs += [docs[0]] * 40
    texts = [" ".join(d) for d in docs] + [None, "", " \n", "A b C", "a B c", "é É"]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    return [*rows, (None, texts[0]), (None, "alone here"), (3, texts[3]), (3, texts[200])]


@pytest.mark.parametrize("short", [64, 6])
def test_components_equal_brute_force(make_docs, monkeypatch, short):
    monkeypatch.setattr(near_dup, "SHORT_LIST", short)
    monkeypatch.setattr(near_dup, "BLOCK", 16)
    monkeypatch.setattr(near_dup, "ACROSS", 32)
    rows = corpus(random.Random(11))
    got = near_dup.near_duplicates(make_docs(rows)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_connected(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 180)] + [(7, 7), (300, 299), (299, 300)]
    random.Random(2).shuffle(chain)
    got = {r.v: r.root for r in connected(spark.createDataFrame(chain, "u long, v long")).collect()}
    want = {i: 0 for i in range(1, 61)} | {i: 100 for i in range(101, 180)} | {300: 299}
    assert got == want
    assert connected(spark.createDataFrame([], "u long, v long")).count() == 0


def test_keep_one_of_odd_rows(make_docs):
    text, other, third = "one two three four five six", "seven eight nine ten eleven", "a b c d e f"
    rows = [(2, text), (2, text), (7, text), (2, other), (1, other), (None, third), (None, third),
            (None, text), (5, None), (5, None)]
    kept = sorted(((r.doc_id, r.text) for r in near_dup.keep_one(make_docs(rows)).collect()), key=str)
    assert kept == [(1, other), (2, text), (5, None), (None, third)]


def test_keep_one(make_docs):
    docs = make_docs([(5, "one two three four five six"), (2, "one two three four five SIX"), (9, None), (4, "other")])
    kept = near_dup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 4, 9]


def test_empty(make_docs):
    assert near_dup.near_duplicates(make_docs([])).count() == 0
    assert near_dup.near_duplicates(make_docs([(1, None)])).select(F.max("component_id")).first()[0] == 1

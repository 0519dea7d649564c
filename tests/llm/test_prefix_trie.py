import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from kindred.llm import prefix_trie

KIND = "conv_id long, turn long, role string, text string, depth int, node string"


def ordered(rows):
    """The turns of each conversation in order."""
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))

    def place(t):
        _, _, role, text = t
        digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
        return (*t[:2], role[:32], text[:32], digest)

    return {c: [t[2:] for t in sorted(turns, key=place)] for c, turns in convs.items()}


def rebuilt(convs):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        donor = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        out[c] = convs.get(donor, [])[:h] + turns[h:]
    return out


def expected(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)

    def sums(node):
        below = [sums(k) for k in kids.get(node, [])]
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        leaves = sum(b[0] for b in below) if below else 1
        return leaves, (len(members[node]) - 1) * words + sum(b[1] for b in below)

    out = []
    for node, held in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in held if len(convs[c]) == len(node)))
        parent = min(members[node[:-1]]) if node else None
        out.append(
            (min(held), len(node), parent, len(held), len(kids.get(node, [])), *sums(node),
             hashlib.sha256(ends.encode()).hexdigest())
        )
    return sorted(out, key=str)


def found(spark, rows, bits=None):
    df = spark.createDataFrame([(*r, 9, "x") for r in rows], KIND).repartition(3)
    turns, convs = prefix_trie.branched(
        prefix_trie.numbered_turns(df, "conv_id", "turn", "role", "text")
    )
    return sorted((tuple(r) for r in prefix_trie.trie(turns, convs, bits).collect()), key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-30, 200), n):
        turns = [("user", "hi there"), ("assistant", rng.choice(["hello", "hello  you"]))]
        turns += [(rng.choice(["user", None]), rng.choice(["a b", "", None, f"é{c}"])) for _ in range(4)]
        rows += [(c, t, *turn) for t, turn in enumerate(turns[: rng.randint(1, 6)])]
    return rows


@pytest.mark.parametrize("bits", [2, None])
def test_equals_plain_trie(spark, monkeypatch, bits):
    """A sketch of a few cells proves nothing single; the result is the same."""
    monkeypatch.setattr(prefix_trie, "CHUNK_BITS", 1)
    rows = corpus(3, 70)
    assert found(spark, rows, bits) == expected(rebuilt(ordered(rows)))


def test_odd_rows(spark):
    rows = [(None, 1, "user", "x"), (20, None, None, None), (20, None, "user", "w " * 60_000)]
    rows += [(20, 3, "b", "same"), (20, 3, "a", "same"), (20, 3, "a", "same")]  # ties, repeated rows
    rows += [(c, t, "user", "copy") for c in range(300, 700) for t in range(3)]  # a large group of copies
    rows += [(777, 1, "user", "alone")]
    assert found(spark, rows) == expected(rebuilt(ordered(rows)))
    assert found(spark, []) == []


def test_sketch_never_counts_too_few(spark):
    digests = [hashlib.sha256(str(i % 700).encode()).hexdigest() for i in range(900)]
    df = spark.createDataFrame([(d,) for d in digests], "node string").repartition(5)
    counts = prefix_trie.sketch(df, "node", 12)
    plain = np.zeros_like(counts, dtype=int)
    for d in digests:
        for r in range(prefix_trie.SKETCH_ROWS):
            plain[r, int(d[8 * r : 8 * r + 8], 16) >> 20] += 1
    assert (counts == np.minimum(plain, 2)).all()
    out = prefix_trie.screened(df, counts, {"node": "single"}).collect()
    twice = {d for d in digests if digests.count(d) > 1}
    assert not any(r.single for r in out if r.node in twice)
    assert sum(r.single for r in out) > 400


def test_running_sums_of_long_keys(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK_BITS", 2)
    rows = [(k, p, k + p) for k, n in ((1, 23), (2, 4), (3, 1)) for p in range(1, n + 1)]
    df = spark.createDataFrame(rows, "k int, p int, v long")
    out = {(r.k, r.p): r.v for r in prefix_trie.running(df, "k", "p", ["v"]).collect()}
    assert out == {(k, p): sum(k + i for i in range(1, p + 1)) for k, p, _ in rows}

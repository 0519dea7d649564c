import hashlib
import random

import pytest
from pyspark.sql import functions as F

from kindred.llm import merkle, ordering


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], row["text"]]
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(nodes):
    """The root, and the siblings of each node from the lowest level up."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for p, i in zip(paths, at, strict=True):
            p += [nodes[i ^ 1]] if i ^ 1 < len(nodes) else []
        nodes = [digest(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
        at = [i // 2 for i in at]
    return nodes[0], paths


def expected(rows):
    groups = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r))):
        groups.setdefault("" if r["lang"] is None else "=" + r["lang"], []).append(r)
    order = sorted(groups, key=str.encode)
    trees = {g: tree([leaf(r) for r in groups[g]]) for g in order}
    root, above = tree([trees[g][0] for g in order])
    return sorted(
        (
            str(r["doc_id"]), leaf(r), trees[g][0], root,
            digest(*trees[g][1][n], *above[order.index(g)]),
        )
        for g in order
        for n, r in enumerate(groups[g])
    )


KIND = "doc_id long, source string, lang string, n_chars long, text string, grp string, position int, key string"


def frame(spark, rows):
    return spark.createDataFrame([(*r.values(), "x", 3, None) for r in rows], KIND)


def rows_of(n, langs, seed=1):
    rng = random.Random(seed)
    return [
        {
            "doc_id": i * 3 - 50, "source": rng.choice([None, "", "s"]), "lang": rng.choice(langs),
            "n_chars": rng.choice([None, i]), "text": rng.choice([None, "", f"é{i}\n", "w" * 40]),
        }
        for i in range(n)
    ]


def found(docs):
    proofs = merkle.prove(docs)
    assert proofs.columns == ["doc_id", "leaf", "subroot", "root", "path"]
    whole = proofs.withColumn("folded", merkle.fold(F.col("leaf"), F.col("path"))).withColumn(
        "proof", merkle.siblings_digest(F.col("path"))
    )
    out = whole.collect()
    assert all(r.folded == r.root for r in out)
    return sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof) for r in out)


@pytest.mark.parametrize("bits", [3, 12])
def test_equals_plain_trees(spark, monkeypatch, bits):
    monkeypatch.setattr(merkle, "BITS", bits)
    rows = rows_of(77, ["en", "en", "en", None, "", "é"]) + rows_of(1, ["one"])
    assert found(frame(spark, rows).repartition(5)) == expected(rows)


@pytest.mark.parametrize("n", [1, 2, 5])
def test_sizes_of_one_group(spark, monkeypatch, n):
    monkeypatch.setattr(merkle, "BITS", 1)
    rows = rows_of(n, ["en"])
    assert found(frame(spark, rows)) == expected(rows)


def test_odd_rows(spark):
    same = {"doc_id": 4, "source": "s", "lang": "en", "n_chars": 1, "text": "t" * 200_000}
    null = dict.fromkeys(same)
    rows = [same] * 300 + [null, null, same | {"text": "u"}, same | {"doc_id": None}]
    assert found(frame(spark, rows)) == expected(rows)
    assert merkle.prove(frame(spark, [])).count() == 0


def test_tampering_is_seen(spark):
    rows = rows_of(50, ["en", "de"])
    changed = merkle.framed_digest([F.concat(F.col(c).cast("string"), F.lit("!")) for c in merkle.FIELDS])
    out = merkle.prove(frame(spark, rows), carry={"changed": changed})
    assert out.where(merkle.fold(F.col("changed"), F.col("path")) == F.col("root")).count() == 0


def test_positions(spark):
    rows = [(g, n, i) for i, (g, n) in enumerate([("a", None), ("a", 1), ("a", 1), ("b", 5)] * 200)]
    df = spark.createDataFrame(rows, "g string, n int, position int").drop("position")
    out = ordering.in_order(df.repartition(7), ["g"], ["n"], "test").collect()
    assert sorted(r.position for r in out if r.g == "a") == list(range(600))
    assert {r.position for r in out if r.n is None} == set(range(200))
    assert sorted(r.position for r in out if r.g == "b") == list(range(200))


def test_hot_keys_are_joined_alike(spark):
    rows = spark.createDataFrame([(1,)] * 500 + [(i,) for i in range(2, 300)] + [(None,)], "k int")
    sized = rows.groupBy("k").agg(F.count("*").alias("n"))
    out = ordering.split_join(rows, sized, ["k"], "n", 800).groupBy("k").agg(F.max("n"), F.count("*"))
    assert sorted(tuple(r) for r in out.collect()) == [(1, 500, 500), *[(i, 1, 1) for i in range(2, 300)]]

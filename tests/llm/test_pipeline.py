import random

import corpus_pipeline


def test_stages(spark, tmp_path):
    rng = random.Random(1)
    say = lambda n: " ".join("".join(rng.choices("abcdeinrst", k=rng.randint(2, 8))) for _ in range(n))
    line = lambda: "".join(say(12).capitalize() + ".\n" for _ in range(4))
    clean = [line() for _ in range(120)]
    extra = line()
    junk = [" ".join(w + "###" for w in say(60).split()) for _ in range(40)]
    texts = clean + junk + [clean[0] + "tail", clean[1], extra + 'password = "abcdefgh12"', None, ""]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, kind)
    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, 0) for i in range(120)] + [(i, 0, 0) for i in range(120, 160)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    sizes = []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{folder}/stage-{n}"
        stage(spark, docs, folder).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        if n < 4:
            assert docs.columns == before.columns
            sizes.append(docs.count())
        if n == 3:
            kept = {r.doc_id: r.text for r in docs.collect()}
    assert sizes == [123, 123, 121, 121]
    assert set(kept) == {*range(120), 162}
    assert kept[162] == extra + '[SECRET]"' and kept[5] == clean[5]
    packed = docs.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert all(r["sum(length)"] == r["max(doc_tokens)"] for r in packed)
    # documents that fit a sequence may stay whole, so there may be just a piece of each
    assert corpus_pipeline.run(spark, folder).count() == docs.count() >= 121
    assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} == set(kept)


def test_stages_with_columns_named_as_their_own(spark, tmp_path):
    """Extra columns come back as they were, and an empty table passes."""
    clean = [f"The river runs past the old mill and on to town {i}.\n" * 6 for i in range(30)]
    names = ["_kept_key", "_kept_hash", "_key", "_hash", "_spans", "_own_hash", "text_hash", "kept", "spans"]
    kind = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(
        f"{n} string" for n in names
    )
    rows = [(i, t, "en", "s", len(t), *[f"{n}-{i}" for n in names]) for i, t in enumerate(clean)]
    labels = [(i, i % 2, 0) for i in range(30)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, empty = spark.createDataFrame(rows, kind), spark.createDataFrame([], kind)
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        for r in out.collect():
            assert all(r[n] == f"{n}-{r.doc_id}" for n in names), name
        assert stage(spark, empty, str(tmp_path)).count() == 0
    assert corpus_pipeline.STAGES[4][1](spark, docs, str(tmp_path)).count() >= 30

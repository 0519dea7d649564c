from collections import Counter

import pandas as pd
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window
from pyspark.sql import functions as F

from kindred.functions.hashing import hash_unit
from kindred.operators import embed as M
from kindred.operators import evaluate as E
from kindred.operators import sampling as S
from kindred.operators.ranking import blocked_index, running_sums, shuffled_index
from kindred.operators.scoring import best_class, class_scores, dense_classes
from kindred.operators.tokens import build_vocabulary, tokenize_pad


def hot_rows(spark, rows=300):
    """Half of the rows in one group, a third in one block of it."""
    n = F.col("id")
    return spark.range(rows).select(
        n.alias("row"),
        F.when(n % 2 == 0, "hot").otherwise(F.concat(F.lit("g"), n % 5)).alias("grp"),
        F.when(n % 3 == 0, "same").otherwise(F.concat(F.lit("b"), n % 17)).alias("block"),
        hash_unit("t", n).alias("u"),
        (n * 37 % 101).alias("step"),
    )


@pytest.mark.parametrize("bucket_rows", [6, 500_000])
def test_shuffled_index_is_the_row_number(spark, bucket_rows):
    df = hot_rows(spark)
    window = Window.partitionBy("grp").orderBy("u", "row")
    got = shuffled_index(df, "u", "row", ["grp"], bucket_rows=bucket_rows)
    wrong = got.withColumn("n", F.row_number().over(window) - 1).where("n <> idx")
    assert got.count() == 300 and wrong.count() == 0


@pytest.mark.parametrize("bucket_rows", [6, 500_000])
def test_blocks_are_contiguous(spark, bucket_rows):
    got = blocked_index(hot_rows(spark), ["grp"], "block", "u", "row", bucket_rows).toPandas()
    assert len(got) == 300
    for _, group in got.groupby("grp"):
        assert sorted(group.idx) == list(range(len(group)))
        assert (group.group_rows == len(group)).all()
        for _, block in group.groupby("block"):
            start = block.block_start.iloc[0]
            assert sorted(block.idx) == list(range(start, start + len(block)))
            assert (block.block_rows == len(block)).all()


def test_running_sums_of_small_groups_shuffle_once(spark):
    df = hot_rows(spark)
    plan = running_sums(df, ["grp"], "step", {"s": F.col("row")}, ["row"])
    assert plan._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_rows_in_small_files_are_not_broadcast(spark, tmp_path):
    n = F.col("id")
    rows = spark.range(5000).select(
        (n * 0).alias("lv1"), (n * 0).alias("tag"), (n % 7).alias("lv2"),
        F.concat(F.lit("name "), n % 50).alias("name"), "id",
        F.concat(F.lit("title "), n % 90).alias("title"),
    )
    rows.write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    members = rows.select("*", F.explode(F.array(*[F.lit(i) for i in range(6)])).alias("kind"))
    members = members.withColumn("u", hash_unit("t", F.col("id")))
    index = blocked_index(members, ["kind"], "title", "u", "id")
    for df in (index, S.mine_pairs(rows, seed="s", **NAMES)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


@pytest.mark.parametrize("bucket_rows", [6, 500_000])
def test_running_sums(spark, bucket_rows):
    df = hot_rows(spark)
    got = running_sums(df, ["grp"], "step", {"s": F.col("row")}, ["row"], bucket_rows)
    window = Window.partitionBy("grp").orderBy("step", "row").rowsBetween(Window.unboundedPreceding, 0)
    wrong = got.withColumn("n", F.sum("row").over(window)).where("n <> s")
    assert got.count() == 300 and wrong.count() == 0


def test_weighted_sample_evens_out_classes(spark):
    df = spark.range(4000).select("id", F.when(F.col("id") < 3000, "big").when(F.col("id") < 3990, "mid").otherwise("rare").alias("c"))
    rows = S.weighted_sample(df, "id", "c", "s", bucket_rows=100).collect()
    counts = Counter(r["c"] for r in rows)
    assert len(rows) == 4000
    assert all(abs(n - 4000 / 3) < 150 for n in counts.values())
    rare = Counter(r["id"] for r in rows if r["c"] == "rare")
    assert len(rare) == 10 and min(rare.values()) > 80


PAIR = "id int, name string, title string, lv1 string, lv2 string, tag int"
NAMES = dict(row_id="id", name="name", title="title", lv1="lv1", lv2="lv2", tag="tag")


def pair_rows():
    return [
        (n, f"n{n % 40}", f"t{n % 90}", f"a{n % 3}", f"a{n % 3}|{n % 7}", -1 if n % 11 == 0 else n % 13)
        for n in range(1500)
    ]


@pytest.mark.parametrize("bucket_rows", [20, 500_000])
def test_pairs_obey_their_rule(spark, bucket_rows):
    data = pair_rows()
    df = spark.createDataFrame(data, PAIR)
    rows = S.mine_pairs(df, seed="s", bucket_rows=bucket_rows, **NAMES).collect()
    by_id = {r[0]: r for r in data}
    assert len(rows) == 1500
    kinds = Counter()
    for r in rows:
        q = by_id[r["id"]]
        kinds[r["kind"]] += 1
        if r["kind"] == "self":
            assert r["title"] == r["query"] and r["label"] == 1 and r["cand_id"] is None
            continue
        c = by_id[r["cand_id"]]
        assert r["title"] == c[2] and r["label"] == (0 if r["kind"].startswith("other") else 1)
        assert {
            "same lv1": c[3] == q[3] and c[1] != q[1],
            "same lv2": c[4] == q[4] and c[1] != q[1],
            "same tag": c[5] == q[5] and c[1] != q[1] and q[5] != -1,
            "other tag": c[4] == q[4] and c[5] != q[5] and c[2] != q[2] and q[5] != -1,
            "other lv2": c[3] == q[3] and c[4] != q[4] and c[2] != q[2],
            "other lv1": c[3] != q[3] and c[2] != q[2],
        }[r["kind"]], r
    assert set(kinds) >= {"same lv1", "same lv2", "same tag", "other lv2", "other lv1", "self"}
    # A row keeps its own title only for want of a draw (0.3 of all rows) or of a candidate.
    assert 300 < kinds["self"] < 600


def test_title_clash_on_every_draw_still_finds_the_one_candidate(spark):
    """All other groups repeat the query's title but for a single row."""
    data = [(n, "n", "same", "a", "a", 1) for n in range(40)]
    data += [(100 + n, "n", "same", f"z{n % 4}", "z", 1) for n in range(400)]
    data += [(999, "n", "unique", "z1", "z", 1)]
    rows = S.mine_pairs(spark.createDataFrame(data, PAIR), seed="x", **NAMES).collect()
    negative = [r for r in rows if r["kind"] == "other lv1" and r["id"] < 100]
    assert negative and all(r["cand_id"] == 999 for r in negative)


def test_lonely_row_pairs_with_itself(spark):
    df = spark.createDataFrame([(1, "n", "t", "a", "a", 1)], PAIR)
    assert [tuple(r) for r in S.mine_pairs(df, seed="s", **NAMES).collect()] == [
        (1, "t", "t", 1, "self", None)
    ]
    assert S.mine_pairs(df, seed="s", allow_self=False, **NAMES).count() == 0


def test_batches(spark):
    df = spark.range(107)
    rows = S.batch_rows(df, "id", "s", 10, bucket_rows=9).toPandas()
    assert len(rows) == 100 and rows.id.is_unique
    assert rows.groupby("batch_id").slot.apply(lambda s: sorted(s) == list(range(10))).all()
    assert S.batch_rows(df, "id", "s", 10, drop_last=False).count() == 107
    order = [r["id"] for r in S.shuffle_rows(df, "id", "s").collect()]
    places = {r["id"]: r["position"] for r in S.shuffled_positions(df, "id", "s", 9).collect()}
    assert sorted(places, key=places.get) == order


def test_class_weights_keep_rows_without_label(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "i int, c string")
    got = {r["i"]: (r["class_count"], r["weight"]) for r in S.class_weights(df, "c").collect()}
    assert got == {1: (2, 0.5), 2: (2, 0.5), 3: (1, 1.0)}


def test_tokens(spark):
    df = spark.createDataFrame([(1, "b a b"), (2, "c a"), (3, ""), (4, None)], "i int, t string")
    vocabulary = build_vocabulary(df, [F.col("t")], 2)
    assert {r["word"]: r["token_id"] for r in vocabulary.collect()} == {"a": 2, "b": 3}
    rows = tokenize_pad(df, "i", {"x": F.col("t")}, vocabulary, 4).collect()
    got = {r["i"]: (r["x"]["input_ids"], r["x"]["attention_mask"]) for r in rows}
    assert got == {
        1: ([3, 2, 3, 0], [1, 1, 1, 0]),
        2: ([1, 2, 0, 0], [1, 1, 0, 0]),
        3: ([0, 0, 0, 0], [0, 0, 0, 0]),
        4: ([0, 0, 0, 0], [0, 0, 0, 0]),
    }


@pytest.mark.parametrize("class_rows, class_bytes", [(2, 0), (100, 0), (100, 1 << 20)])
def test_class_scores_in_chunks(spark, class_rows, class_bytes):
    items = spark.createDataFrame([(n % 20, [float(n % 20), 1.0]) for n in range(22)], "i int, v array<float>")
    classes = spark.createDataFrame(
        [(c, [1.0, float(c)], 0.5 * c) for c in range(5)], "c int, w array<float>, b double"
    )
    scored = class_scores(
        items, classes, row_id="i", vec="v", class_id="c", weights="w", bias="b", item_rows=3,
        class_rows=class_rows, class_bytes=class_bytes,
    )
    rows = scored.collect()
    assert len(rows) == 22  # rows of one id are scored each
    got = {r["i"]: r["scores"] for r in rows}
    assert got == {n: pytest.approx([n + c + 0.5 * c for c in range(5)]) for n in range(20)}
    best = best_class(items, classes, row_id="i", vec="v", class_id="c", weights="w", bias="b").collect()
    assert len(best) == 22 and {(r["class_id"], r["score"] == r["i"] + 6.0) for r in best} == {(4, True)}
    assert class_scores(items, classes.limit(0), row_id="i", vec="v", class_id="c", weights="w").first()["scores"] == []


def test_class_ids_with_gaps(spark):
    items = spark.createDataFrame([(1, [1.0, 2.0])], "i int, v array<float>")
    classes = spark.createDataFrame([("x", [1.0, 0.0]), ("z", [0.0, 1.0])], "name string, w array<float>")
    numbered = dense_classes(classes, "name")
    assert class_scores(items, numbered, row_id="i", vec="v", class_id="class_place", weights="w").first()["scores"] == [1.0, 2.0]
    gaps = numbered.withColumn("class_place", F.col("class_place") * 5)
    with pytest.raises(ValueError, match="gaps"):
        class_scores(items, gaps, row_id="i", vec="v", class_id="class_place", weights="w")
    ragged = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "i int, v array<float>").coalesce(1)
    with pytest.raises(Exception, match="different lengths"):
        class_scores(ragged, numbered, row_id="i", vec="v", class_id="class_place", weights="w").collect()


def test_mean_vector_passes_over_missing_vectors(spark):
    df = spark.createDataFrame([(1, [2.0, 4.0]), (1, None), (1, [4.0, 8.0])], "k int, v array<double>")
    for dims in (2, None):
        assert M.mean_vector(df, ["k"], F.col("v"), dims=dims).first()["vec"] == [3.0, 6.0]
    for dims in (1, None):
        odd = df.unionByName(spark.createDataFrame([(1, [1.0])], df.schema))
        with pytest.raises(Exception):
            M.mean_vector(odd, ["k"], F.col("v"), dims=dims).collect()


def test_null_groups_and_outliers(spark):
    rows = [(None, float(i), 1) for i in range(30)] + [("a", float(i), 1) for i in range(9)] + [(None, 1e12, 1)]
    df = spark.createDataFrame(rows, "g string, o double, x int")
    summed = running_sums(df, ["g"], "o", {"s": F.col("x")}, bucket_rows=8).collect()
    want = {(g, o): n + 1 for g in (None, "a") for n, o in enumerate(sorted(r[1] for r in rows if r[0] == g))}
    assert {(r["g"], r["o"]): r["s"] for r in summed} == want
    numbered = shuffled_index(df.withColumn("u", (F.xxhash64("o") % 1000 + 1000) / 2000), "u", "o", ["g"], bucket_rows=8)
    assert sorted(r["idx"] for r in numbered.where("g is null").collect()) == list(range(31))


def test_metrics(spark):
    df = spark.createDataFrame([(0, 0), (1, 0), (1, 1), (2, 1)], "p int, l int")
    assert E.accuracy(df, F.col("p"), F.col("l")).collect()[0]["accuracy"] == 0.5
    f1 = E.micro_f1(df, F.col("p"), F.col("l")).collect()[0]
    assert (f1["tp"], f1["fp"], f1["fn"], f1["micro_f1"]) == (2, 2, 2, 0.5)
    report = E.precision_recall_at_1(df, F.col("p"), F.array("l", F.lit(2))).collect()[0]
    assert (report["precision_at_1"], report["recall_at_1"]) == (0.75, 0.375)


def test_mean_pool_stops_at_the_first_gap(spark):
    df = spark.createDataFrame(
        [("a", 0, 1, [1.0]), ("a", 1, 2, [3.0]), ("a", 1, 9, [99.0]), ("a", 3, 3, [99.0]), ("b", 1, 4, [5.0])],
        "item string, n int, row int, v array<double>",
    )
    got = M.mean_pool_images(df, "item", "n", "row", "v").collect()
    assert [(r["item"], r["images"], r["vec"]) for r in got] == [("a", 2, [2.0])]


def test_masked_pool(spark):
    df = spark.createDataFrame(
        [(1, [1.0, 2.0], 1), (1, [3.0, 4.0], 1), (1, [9.0, 9.0], 0), (2, [5.0, 5.0], 0)],
        "i int, v array<double>, m int",
    )
    got = {r["i"]: r["vec"] for r in M.masked_mean_pool(df, "i", "v", "m").collect()}
    assert got == {1: [2.0, 3.0], 2: None}


def test_masked_pool_adds_up_before_the_shuffle(spark):
    n = F.col("id")
    df = spark.range(9000, numPartitions=2).select(
        (n % 300).alias("i"), F.array(n.cast("double"), F.lit(1.0)).alias("v"),
        F.when(n % 7 != 0, (n % 2).cast("int")).alias("m"),
    )
    pooled = M.masked_mean_pool(df, "i", "v", "m", 2)
    summed = M.masked_mean_pool(df, "i", "v", "m")
    assert "ObjectHashAggregate" not in pooled._jdf.queryExecution().executedPlan().toString()
    want = {r["i"]: r["vec"] for r in summed.collect()}
    got = {r["i"]: r["vec"] for r in pooled.collect()}
    assert len(got) == 300 and set(got) == set(want)
    for i, vec in want.items():
        assert got[i] == (None if vec is None else pytest.approx(vec))
    with pytest.raises(Exception, match="has not 3 elements"):
        M.masked_mean_pool(df, "i", "v", "m", 3).collect()


def test_sentence_vector_counts_repeats(spark):
    words = spark.createDataFrame([("a", [1.0]), ("b", [4.0])], "word string, vec array<double>")
    df = spark.createDataFrame([(1, "a a b unknown"), (2, "unknown")], "i int, t string")
    got = {r["i"]: r["vec"] for r in M.sentence_vectors(df, "i", F.col("t"), words).collect()}
    assert got == {1: [2.0]}


def test_texts_are_split_once_for_sentence_vectors(spark):
    words = spark.createDataFrame([("a", [1.0]), ("b", [4.0])], "word string, vec array<double>")
    df = spark.createDataFrame([(1, "a a b unknown"), (2, "unknown")], "i int, t string")
    for frequent in (0, 1, 10):
        got = M.sentence_vectors(df, "i", F.col("t"), words, 1, frequent)
        assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()
        assert [tuple(r) for r in got.collect()] == [(1, [2.0])]


def test_failed_rows_are_reported(spark):
    def load():
        def model(batch: pd.DataFrame):
            if (batch["t"] == "bad").any():
                raise ValueError("no")
            return [[float(len(t))] for t in batch["t"]]

        return model

    df = spark.createDataFrame([(1, "ab"), (2, "bad"), (3, "c")], "i int, t string").coalesce(1)
    got = {r["i"]: (r["vec"], r["error"]) for r in M.embed_batch(df, "i", ["t"], load).collect()}
    assert got == {1: ([2.0], None), 2: (None, "ValueError: no"), 3: ([1.0], None)}


def test_text_classifier_learns_word_pairs(spark):
    data = [("red cup big", 0.0), ("cup red big", 1.0)] * 20
    df = spark.createDataFrame(data, "t string, y double")
    model = M.text_classifier(df, "t", "y", features=1 << 10, epochs=20)
    scored = model.transform(df).select("y", "prediction", vector_to_array("probability").alias("p"))
    assert scored.where("y <> prediction").count() == 0

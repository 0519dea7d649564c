"""Embedding tables that are refreshed, merged and published."""

import os
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from kindred.operators import merge as M
from kindred.operators import sampling as S
from kindred.operators.embed import sentence_vectors
from kindred.plans import jobs
from kindred.session import materialize, remove_scratch, scratch_path, shared_folder
from kindred.sources import files as R
from kindred.sources import tables as W

PATTERN = r"item=([^/]+)/"
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def load_length_model():
    def model(batch):
        if batch["title"].str.contains("odd").any():
            raise ValueError("cannot embed")
        return [[float(len(t)), 1.0] for t in batch["title"]]

    return model


@pytest.fixture
def vector_files(spark):
    """a and b have a file, c one that holds no numbers."""
    path = scratch_path(spark, "files")
    good = spark.createDataFrame([("a", [3.0, 4.0]), ("b", [0.0, 2.0])], "item string, vec array<double>")
    R.write_vector_files(good, "item", "vec", path)
    bad = spark.createDataFrame([("c", "x y")], "item string, value string")
    bad.write.partitionBy("item").mode("append").text(path)
    return path


def test_null_keys_of_lists_are_one_key(spark):
    schema = "area int, item string, neighbours array<string>"
    first = spark.createDataFrame([(None, "i", ["x"]), (1, "i", ["y"])], schema)
    second = spark.createDataFrame([(None, "i", ["z", "x"]), (2, None, ["w"])], schema)
    got = {(r.area, r.item): r.neighbours for r in M.merge_neighbours(first, second, ["area", "item"]).collect()}
    assert got == {(None, "i"): ["x", "z"], (1, "i"): ["y"], (2, None): ["w"]}


def test_rows_without_label_are_drawn(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, None)], "id long, label string")
    many = spark.range(3000).select((F.col("id") + 10).alias("id"), F.lit("b").alias("label"))
    drawn = S.weighted_sample(rows.unionByName(many), "id", "label", "seed").groupBy("label").count()
    got = {r["label"]: r["count"] for r in drawn.collect()}
    assert set(got) == {"a", "b", None} and sum(got.values()) == 3003
    assert all(800 < n < 1200 for n in got.values())


def test_a_word_that_is_listed_twice_counts_once(spark):
    texts = spark.createDataFrame([(1, "x y")], "id int, text string")
    vectors = spark.createDataFrame([("x", [0.0]), ("y", [3.0]), ("y", [3.0])], "word string, vec array<double>")
    for frequent in (0, 1, 10):
        got = sentence_vectors(texts, "id", F.col("text"), vectors, frequent=frequent).collect()
        assert [r.vec for r in got] == [[1.5]]


def test_repeated_items_and_vectors_give_one_row(spark):
    items = spark.createDataFrame([("a",), ("a",), ("b",), (None,), ("c",)], "k string")
    cache = spark.createDataFrame(
        [("a", [3.0, 4.0]), ("a", [1.0, 0.0]), ("b", [None, 1.0]), (None, [1.0]), ("gone", [1.0])],
        "k string, v array<double>",
    )
    rows = jobs.refresh_embeddings(items, cache, key="k", vec="v", name="e", day="d").collect()
    assert [tuple(r) for r in rows] == [("a", "[0.6,0.8]", "d")]
    told = jobs.vectors_of_items(items, cache, key="k", vec="v").where("error is not null").collect()
    assert {(r.k, r.error) for r in told} == {(None, "no key"), ("b", "vector can't be read"), ("c", "no vector")}


def test_refresh_publishes_and_leaves_no_staging(spark, vector_files):
    schema = W.embedding_schema("k", "e")
    old = spark.createDataFrame([("old", "[1.0]", "d0")], "k string, e string, modifydate string")
    W.write_table(old, "refreshed", schema, scratch_path(spark, "refreshed"))
    items = spark.createDataFrame([("a",), ("a",), ("c",), ("d",), (None,)], "k string")

    def run():
        return jobs.refresh_from_files(
            items, vector_files, "refreshed", key="k", key_pattern=PATTERN, name="e", day="d1", partitions=3
        )

    for _ in range(2):
        errors = {(r.k, r.error) for r in run().collect()}
        assert errors == {("c", "vector can't be read"), ("d", "no vector"), (None, "no key")}
        assert [tuple(r) for r in spark.table("refreshed").collect()] == [("a", "[0.6,0.8]", "d1")]
    assert not [n for n in os.listdir(shared_folder(spark)) if n.startswith("staging-")]


def test_output_partitions_asked_for(spark):
    schema = W.embedding_schema("k", "e")
    rows = spark.range(1000).select(
        F.col("id").cast("string").alias("k"), F.lit("x").alias("e"), F.lit("d").alias("modifydate")
    )
    W.write_table(rows, "in_five", schema, scratch_path(spark, "in_five"), partitions=5)
    assert len(spark.table("in_five").inputFiles()) == 5
    W.stage_and_publish(rows, "in_five", schema, partitions=3)
    assert len(spark.table("in_five").inputFiles()) == 3


def bucketed(spark):
    """Three tables whose keys overlap in every way; repeated keys in the first."""
    made = {}
    for name, keys in {"x": "abcg", "y": "bcdf", "z": "acdeh"}.items():
        rows = [(k, f"{name}{k}") for k in keys] + ([("a", "xA"), ("b", None)] if name == "x" else [])
        df = spark.createDataFrame(rows, f"k string, {name} string")
        W.write_bucketed(df, f"part_{name}", W.embedding_schema("k", name, stamp=False), "k", 3)
        made[name] = (spark.table(f"part_{name}"), df)
    return made


def test_wide_merge_of_buckets_shuffles_nothing(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = bucketed(spark)
        wide = M.merge_bucketed([t for t, _ in made.values()], "k", "d")
        plan = wide._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Broadcast" not in plan
        got = {tuple(r) for r in wide.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    value = lambda n, k, keys: f"{n}{k}" if k in keys else ""
    want = {(k, value("x", k, "abcg"), value("y", k, "bcdf"), value("z", k, "acdeh"), "d") for k in "abcdefgh"}
    assert got == want
    plain = M.merge_modalities([df for _, df in made.values()], "k", "d")
    assert plain._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert {tuple(r) for r in plain.collect()} == want


def test_tables_that_share_columns_are_refused(spark):
    a = spark.createDataFrame([("1", "x")], "k string, a string")
    with pytest.raises(ValueError, match="share columns"):
        M.merge_modalities([a, a], "k")


def test_wide_table_and_its_errors(spark, vector_files):
    products = spark.createDataFrame(
        [("a", "red tea", "5"), ("a", "green tea", None), ("b", "odd thing", "1"), ("d", "??", None), (None, "tea", "1")],
        "k string, product_name string, first_level_category_name string",
    ).selectExpr("*", "null::string as product_title", "'' as second_level_category_name")
    words = spark.createDataFrame([("tea", [1.0, 0.0]), ("red", [0.0, 1.0])], "word string, vec array<double>")
    errors = jobs.multimodal_table(
        products, words, load_length_model, vector_files, "wide", key="k", key_pattern=PATTERN, day="d", buckets=2
    )
    got = {r.k: (r.fasttext_emb, r.bert_emb, r.cv_emb) for r in spark.table("wide").collect()}
    assert got == {
        "a": ("0.5,0.5", "7.0,1.0", "3.0,4.0"),
        "b": ("", "", "0.0,2.0"),
        "d": ("", "2.0,1.0", ""),
    }
    assert {(r.k, r.modality, r.error) for r in errors.collect()} == {
        ("b", "fasttext_emb", "no known word in the title"),
        ("d", "fasttext_emb", "no known word in the title"),
        ("b", "bert_emb", "ValueError: cannot embed"),
        ("c", "cv_emb", "vector can't be read"),
    }


def test_one_model_run_for_table_and_errors(spark):
    items = spark.createDataFrame([("1", "odd"), ("2", "ok")], "k string, title string")
    old = spark.createDataFrame([], "k string, e string, modifydate string")
    args = {"key": "k", "inputs": ["title"], "load_model": load_length_model}
    tried = materialize(jobs.embedding_attempts(items, old, **args), "tried")
    table = jobs.incremental_embeddings(items, old, name="e", day="d", tried=tried, **args)
    assert [r.k for r in table.collect()] == ["2"]
    assert "MapInPandas" not in table._jdf.queryExecution().optimizedPlan().toString()


def test_only_scratch_is_removed(spark):
    with pytest.raises(ValueError, match="no scratch path"):
        remove_scratch(spark, "/somewhere/else")

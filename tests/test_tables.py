import os
import sys
from datetime import datetime

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from kindred.functions.keys import has_text
from kindred.operators import tables as T
from kindred.operators.merge import append_embeddings, merge_modalities
from kindred.operators.similar import latest_rows
from kindred.plans import jobs
from kindred.session import scratch_path
from kindred.sources import files, kv, media
from kindred.sources import tables as W
from kindred.streaming.incremental import publish_arrivals

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def test_attributes_are_maximised_apart(spark):
    df = spark.createDataFrame([(1, "a", "z"), (1, "b", None), (2, None, None)], "k int, x string, y string")
    got = {r["k"]: (r["x"], r["y"]) for r in T.product_dim(df, "k", {"x": "x", "y": "y"}).collect()}
    assert got == {"1": ("b", "z"), "2": (None, None)}


def test_latest_row_is_whole(spark):
    df = spark.createDataFrame(
        [("a", "d1", 9), ("a", "d2", 1), ("a", "d2", 0)], "k string, d string, v int"
    )
    assert [tuple(r) for r in latest_rows(df, ["k"], ["d", "v"]).collect()] == [("a", "d2", 1)]


def test_recent_days_have_no_upper_bound_unless_given(spark):
    df = spark.createDataFrame([("2024-01-01",), ("2024-01-05",), ("2024-02-01",)], "dt string")
    assert T.scan_recent_days(df, "2024-01-08", 7).count() == 3
    assert T.scan_recent_days(df, "2024-01-09", 7).count() == 2
    assert T.scan_recent_days(df, "2024-01-09", 7, end_day="2024-01-09").count() == 1


def test_day_filter_reads_one_partition(spark):
    path = scratch_path(spark, "daily")
    spark.range(10).withColumn("dt", F.concat(F.lit("2024-01-0"), F.col("id") % 3 + 1)).write.partitionBy(
        "dt"
    ).parquet(path)
    plan = T.scan_day(spark.read.parquet(path), "2024-01-02")._jdf.queryExecution().executedPlan()
    assert "PartitionFilters: [isnotnull(dt" in plan.toString()


def test_images_are_numbered_across_ranges(spark):
    """One item owns most media, so its numbers come from several ranges."""
    data = [("hot", n * n, f"u{n}", "PRIMARY") for n in range(60)] + [("b", 5, "x", "PRIMARY")]
    data += [("b", 4, "no", "DETAIL")]
    media_df = spark.createDataFrame(data, "spusn string, id bigint, url string, kind string")
    products = spark.createDataFrame([("hot",), ("b",), ("none",)], "spu string")
    rows = T.rank_images(
        products,
        media_df,
        item="spu",
        media_item="spusn",
        media_id="id",
        url="url",
        kinds=["PRIMARY"],
        kind="kind",
        bucket_rows=7,
    ).collect()
    got = {(r["spu"], r["url"]): r["img_id"] for r in rows}
    expected = {("hot", f"u{n}"): str(n) for n in range(60)}
    assert got == expected | {("b", "x"): "0", ("none", None): None}


def test_quarantine_splits_all_rows(spark):
    df = spark.createDataFrame([(1, "a"), (2, ""), (None, None)], "n int, s string")
    good, bad = T.quarantine(df, {"n": F.col("n") > 0, "s": has_text(F.col("s"))})
    assert [tuple(r) for r in good.collect()] == [(1, "a")]
    assert {(r["n"], r["error"]) for r in bad.collect()} == {(2, "s"), (None, "n,s")}


def test_append_and_stamp(spark):
    old = spark.createDataFrame([("a", "[1]", "d1")], "k string, e string, modifydate string")
    new = spark.createDataFrame([("b", None)], "k string, e string")
    assert {tuple(r) for r in append_embeddings(old, new, "d2").collect()} == {
        ("a", "[1]", "d2"),
        ("b", "", "d2"),
    }
    assert {r["modifydate"] for r in append_embeddings(old, new, "d2", stamp="new").collect()} == {
        "d1",
        "d2",
    }


def test_modalities_fill_gaps(spark):
    a = spark.createDataFrame([("1", "x")], "k string, a string")
    b = spark.createDataFrame([("2", "y")], "k string, b string")
    got = {tuple(r) for r in merge_modalities([a, b], "k", "d").collect()}
    assert got == {("1", "x", "", "d"), ("2", "", "y", "d")}


def load_length_model():
    def model(batch):
        if (batch["k"] == "bad").any():
            raise ValueError("cannot embed")
        return [[float(len(k)), 1.0] for k in batch["k"]]

    return model


def test_job_reads_the_table_it_overwrites_and_can_run_again(spark):
    schema = W.embedding_schema("k", "emb")
    first = spark.createDataFrame([("old", "[1.0]", "d0")], "k string, emb string, modifydate string")
    W.write_table(first, "published", schema, scratch_path(spark, "published"))
    items = spark.createDataFrame([("old",), ("new1",), ("bad",)], "k string")

    def run(day):
        table = jobs.incremental_embeddings(
            items,
            spark.table("published"),
            key="k",
            inputs=["k"],
            load_model=load_length_model,
            name="emb",
            day=day,
        )
        W.stage_and_publish(table, "published", schema)
        return sorted((r["k"], r["emb"], r["modifydate"]) for r in spark.table("published").collect())

    once = run("d1")
    assert [(k, d) for k, _, d in once] == [("new1", "d1"), ("old", "d1")]
    assert run("d1") == once


def test_items_that_arrive_as_files(spark):
    source, checkpoint = scratch_path(spark, "arrivals"), scratch_path(spark, "progress")
    schema = W.embedding_schema("k", "emb")
    empty = spark.createDataFrame([], "k string, emb string, modifydate string")
    W.write_table(empty, "arrived", schema, scratch_path(spark, "arrived"))

    def publish(batch):
        table = jobs.incremental_embeddings(
            batch.select("k").distinct(),
            batch.sparkSession.table("arrived"),
            key="k",
            inputs=["k"],
            load_model=load_length_model,
            name="emb",
            day="d1",
        )
        W.stage_and_publish(table, "arrived", schema)

    def arrive(*keys):
        spark.createDataFrame([(k,) for k in keys], "k string").write.mode("append").parquet(source)
        stream = spark.readStream.schema("k string").parquet(source)
        publish_arrivals(stream, publish, checkpoint).awaitTermination()
        spark.catalog.refreshTable("arrived")
        return sorted(r["k"] for r in spark.table("arrived").collect())

    assert arrive("a", "b") == ["a", "b"]
    assert arrive("b", "c") == ["a", "b", "c"]


# --- key-value rows ----------------------------------------------------------------------------


def test_published_rows(spark):
    lists = spark.createDataFrame(
        [(1, "a", ["x", "y"]), (2, "a", ["z"]), (1, "b", [])],
        "area int, s string, neighbours array<string>",
    )
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    rows = kv.kv_rows(lists, F.col("s"), now, 3600, keep=["area"])
    assert {(r["area"], r["key"], r["value"]) for r in rows.collect()} == {
        (1, "a", "x,y"),
        (2, "a", "z"),
    }
    winner = kv.one_value_per_key(rows, "area").collect()
    assert [(r["key"], r["value"]) for r in winner] == [("a", "z")]
    assert winner[0]["expire_at"] == datetime(2024, 1, 1, 1)


def test_writer_sends_batches(spark, tmp_path):
    folder = str(tmp_path)

    def connect():
        def store(batch):
            name = f"{folder}/{batch[0][0]}"
            with open(name, "w") as out:
                out.write("\n".join(k for k, _, _ in batch))

        return store

    rows = spark.range(25).select(
        F.col("id").cast("string").alias("key"),
        F.lit("v").alias("value"),
        F.current_timestamp().alias("expire_at"),
    )
    kv.write_kv(rows.coalesce(1), connect, batch=10)
    sizes = [len((tmp_path / n).read_text().split()) for n in os.listdir(folder)]
    assert sorted(sizes) == [5, 10, 10]


def test_one_value_per_key_is_sent(spark, tmp_path):
    folder = str(tmp_path)

    def connect():
        def store(batch):
            for key, value, _ in batch:
                with open(f"{folder}/{key}", "a") as out:
                    out.write(value + ";")

        return store

    rows = [("k", "a", 1), ("k", "c", 0), ("k", "b", 2), ("m", "x", 1)]
    df = spark.createDataFrame(rows, "key string, value string, area_id int")
    df = df.withColumn("expire_at", F.current_timestamp()).repartition(4)
    kv.write_kv(df, connect)
    assert (tmp_path / "k").read_text() == "c;" and (tmp_path / "m").read_text() == "x;"
    kv.write_kv(df, connect, order="area_id")
    assert (tmp_path / "k").read_text() == "c;b;"


# --- media -------------------------------------------------------------------------------------


def test_fetch_reports_failures_and_goes_on(spark):
    def connect():
        def get(url):
            if "boom" in url:
                raise OSError("no route")
            return (404, b"not found") if "gone" in url else (200, url.encode())

        return get

    wanted = spark.createDataFrame(
        [("a", 0, "u/ok"), ("a", 1, "u/gone"), ("b", 0, "u/boom"), ("c", 0, "u/have"), ("d", 0, None)],
        "item string, n int, url string",
    )
    existing = spark.createDataFrame([("/m/c/0.jpg",)], "path string")
    manifest = media.fetch_manifest(wanted, existing, "/m")
    got = {r["path"]: r for r in media.fetch(manifest, connect, partitions=2, threads=3).collect()}
    assert set(got) == {"/m/a/0.jpg", "/m/a/1.jpg", "/m/b/0.jpg"}
    assert bytes(got["/m/a/0.jpg"]["content"]) == b"u/ok"
    assert got["/m/a/1.jpg"]["content"] is None and got["/m/a/1.jpg"]["status"] == 404
    assert got["/m/b/0.jpg"]["error"] == "OSError: no route"


# --- files -------------------------------------------------------------------------------------


def test_labelled_lines(spark, tmp_path):
    (tmp_path / "t.txt").write_text("__label__a  one two \n\n   \n__label__b\n__label__c x\nno label\n__label__d __label__e y\n")
    rows = files.read_labelled_lines(spark, str(tmp_path)).collect()
    assert [(r["label"], r["text"]) for r in rows] == [
        ("a", "one two"), ("b", ""), ("c", "x"), ("", "no label"), ("d", "y")
    ]
    assert [r["labels"] for r in rows][-2:] == [[], ["d", "e"]]


def test_word_list_keeps_quotes(spark, tmp_path):
    (tmp_path / "w.txt").write_text('"\nand\n\'s\n')
    assert [r[0] for r in files.read_word_list(spark, str(tmp_path)).collect()] == ['"', "and", "'s"]


def test_vector_files(spark, tmp_path):
    for name, body in {"1": "1.5\n-2e-1\n", "2": "1.5\nx\n", "3": ""}.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "emb.txt").write_text(body)
    read = files.read_vector_files(spark, str(tmp_path), r"/([^/]+)/emb\.txt$").collect()
    assert sorted((r["item"], r["vec"]) for r in read) == [
        ("1", pytest.approx([1.5, -0.2])), ("2", None)
    ]  # an empty file has no row


def test_required_columns(spark):
    df = spark.createDataFrame([("a", 1), (None, 2)], "k string, e int")
    schema = W.embedding_schema("k", "e")
    good, odd = W.without_required(df.withColumn("modifydate", F.lit("d")), schema)
    assert [tuple(r) for r in W.as_typed(good, schema).collect()] == [("a", "1", "d")]
    assert [r["e"] for r in odd.collect()] == [2]
    with pytest.raises(Exception, match="a row has no k"):
        W.as_typed(df.withColumn("modifydate", F.lit("d")), schema).collect()

"""File readers, on files that Spark first writes from the given tables."""

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import functions as F

from catalog.base import ITEM_VECTORS, item_vectors, query, r5_sql, table, unnested, unnested_sql
from catalog.texts import words_sql
from kindred.functions.text import words
from kindred.operators.merge import one_row_per_key
from kindred.session import scratch_path
from kindred.sources import files as R
from kindred.sources import images as I

PART = "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"
SIDE = 8  # images of 8 x 8 grey pixels, one per vector element


@query("scan_csv", "select * from part")
def scan_csv(spark, folder):
    path = scratch_path(spark, "csv")
    table(spark, folder, "part").write.csv(path, header=True)
    return R.read_csv(spark, path, PART)


@query(
    "scan_wordlist",
    f"select distinct word as stopword from (select unnest({words_sql('text')}) as word from documents)",
)
def scan_wordlist(spark, folder):
    path = scratch_path(spark, "words")
    found = table(spark, folder, "documents").select(F.explode(words(F.col("text"))).alias("word"))
    found.distinct().write.text(path)
    return R.read_word_list(spark, path)


@query(
    "scan_vector_files",
    f"with {ITEM_VECTORS}, t as (select spu_sn as item, embedding::DOUBLE[] as vec from ("
    "select *, row_number() over (partition by spu_sn order by dt desc, row_id desc) as n "
    "from item_vectors) where n = 1) " + unnested_sql("t", "item", "vec"),
)
def scan_vector_files(spark, folder):
    path = scratch_path(spark, "vectors")
    rows = item_vectors(spark, folder).select("spu_sn", "dt", "row_id", "embedding")
    latest = one_row_per_key(rows, "spu_sn", ["dt", "row_id"])
    R.write_vector_files(latest, "spu_sn", "embedding", path)
    read = R.read_vector_files(spark, path, r"item=([^/]+)/")
    return unnested(read, ["item"], F.col("vec").cast("array<double>"))


COLOURS = {1: 0, 3: 2, 4: 6}  # channels: kind of colour in a PNG header


def png(pixels, channels: int = 1) -> bytes:
    """A PNG of SIDE x SIDE pixels: grey, or R, G, B, or these and alpha."""

    def chunk(kind: bytes, body: bytes) -> bytes:
        check = zlib.crc32(kind + body)
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", check)

    width = SIDE * channels
    lines = b"".join(b"\0" + bytes(pixels[y * width : (y + 1) * width]) for y in range(SIDE))
    header = struct.pack(">IIBBBBB", SIDE, SIDE, 8, COLOURS[channels], 0, 0, 0)
    return (
        b"\x89PNG\r\n\x1a\n"
        + chunk(b"IHDR", header)
        + chunk(b"IDAT", zlib.compress(lines))
        + chunk(b"IEND", b"")
    )


def write_images(spark, folder, root: str) -> None:
    """``{root}/{label}/{row id}.png`` for every vector, and next to it a file that is no image."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                store, path = fs.FileSystem.from_uri(f"{root}/{row.lv2}/{row.row_id}.png")
                store.create_dir(path.rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(path) as out:
                    out.write(png([int(p) for p in row.pixels]))
                with store.open_output_stream(path[: -len("png")] + "broken") as out:
                    out.write(b"no image")
            yield batch[["row_id"]]

    pixels = F.transform("embedding", lambda e: F.floor((e.cast("double") + 1.0) * 127.5))
    rows = item_vectors(spark, folder).select("row_id", "lv2", pixels.alias("pixels"))
    rows.repartition(8, "row_id").mapInPandas(write, "row_id bigint").count()


@query(
    "scan_images",
    """select vec_id as row_id, 8 as height, 8 as width, 1 as channels,
      list_sum(list_transform(embedding::DOUBLE[], lambda e: floor((e + 1.0) * 127.5))) as pixel_sum
    from embeddings""",
)
def scan_images(spark, folder):
    root = scratch_path(spark, "images")
    write_images(spark, folder, root)
    total = F.aggregate(I.pixel_values("data").cast("array<double>"), F.lit(0.0), lambda acc, x: acc + x)
    return I.read_images(spark, root).select(
        F.regexp_extract("origin", r"/(\d+)\.png$", 1).cast("bigint").alias("row_id"),
        "height",
        "width",
        "channels",
        total.alias("pixel_sum"),
    )


@query(
    "scan_class_folders",
    "select cast(label as varchar) as label, vec_id as row_id from embeddings",
)
def scan_class_folders(spark, folder):
    root = scratch_path(spark, "images")
    write_images(spark, folder, root)
    row_id = F.regexp_extract("path", r"/(\d+)\.png$", 1).cast("bigint")
    return I.read_class_folders(spark, root, "*.png").select("label", row_id.alias("row_id"))


# Colour images: red as the vector says, green its complement, blue half of it; of every fourth row
# grey, of every fourth with an alpha channel.
@query(
    "normalized_pixels",
    """with p as (select vec_id as row_id, list_transform(embedding::DOUBLE[],
        lambda e: floor((e + 1.0) * 127.5)) as red from embeddings),
    coloured as (select row_id, unnest(red) as red, unnest(range(0, 64)) as i, row_id % 4 = 0 as grey from p),
    rgb as (select row_id, i, 0 as c, red as x from coloured
      union all select row_id, i, 1, case when grey then red else 255 - red end from coloured
      union all select row_id, i, 2, case when grey then red else floor(red / 2) end from coloured)
    select row_id, cast(3 * i + c as integer) as pos, """
    + r5_sql(
        """(x / 255.0::DOUBLE - list_extract(cast([0.485, 0.456, 0.406] as DOUBLE[]), c + 1))
      / list_extract(cast([0.229, 0.224, 0.225] as DOUBLE[]), c + 1)"""
    )
    + " as value from rgb",
)
def normalized_pixels(spark, folder):
    root = scratch_path(spark, "colours")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                red = [int(p) for p in row.pixels]
                kind = row.row_id % 4
                channels = {0: 1, 1: 4}.get(kind, 3)
                body = [v for r in red for v in (r, 255 - r, r // 2, 200)[: 1 if kind == 0 else channels]]
                store, path = fs.FileSystem.from_uri(f"{root}/{row.row_id}.png")
                store.create_dir(path.rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(path) as out:
                    out.write(png(body, channels))
            yield batch[["row_id"]]

    pixels = F.transform("embedding", lambda e: F.floor((e.cast("double") + 1.0) * 127.5))
    rows = item_vectors(spark, folder).select("row_id", pixels.alias("pixels"))
    rows.repartition(8, "row_id").mapInPandas(write, "row_id bigint").count()
    row_id = F.regexp_extract("origin", r"/(\d+)\.png$", 1).cast("bigint")
    images = I.read_images(spark, root).withColumn("row_id", row_id)
    return unnested(I.normalized_pixels(images), ["row_id"], "pixels")

"""Image readers."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.functions.vectors import pixel_normalize

# Channel means and deviations of the usual pretrained image models, as R, G, B.
RGB_MEAN = (0.485, 0.456, 0.406)
RGB_STD = (0.229, 0.224, 0.225)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Decoded images (``origin, height, width, channels, data``); undecodable files are skipped."""
    images = (
        spark.read.format("image")
        .option("dropInvalid", True)
        .option("recursiveFileLookup", True)
        .load(path)
    )
    return images.select(
        "image.origin",
        "image.height",
        "image.width",
        F.col("image.nChannels").alias("channels"),
        "image.data",
    )


def read_class_folders(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files of a folder-per-class tree with the parent folder as ``label``; contents are not read."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .load(path)
    )
    return files.select(
        "path", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("label"), "length"
    )


@F.pandas_udf(T.ArrayType(T.FloatType()))
def pixel_values(data: pd.Series) -> pd.Series:
    """Bytes of a decoded image as numbers 0..255, in stored (B, G, R) order."""
    return data.map(lambda b: np.frombuffer(b, dtype=np.uint8).astype(np.float32))


@F.pandas_udf(T.ArrayType(T.FloatType()))
def rgb_values(data: pd.Series, channels: pd.Series) -> pd.Series:
    """Bytes of a decoded image as numbers 0..255 in R, G, B order, pixel by pixel.

    Of one channel (grey) each value stands three times, of four (B, G, R, A) the last is left out.
    NULL where the bytes are no whole number of pixels or the channels are others.
    """

    def one(data, channels):
        if data is None or channels not in (1, 3, 4) or len(data) % channels:
            return None
        pixels = np.frombuffer(data, dtype=np.uint8).reshape(-1, int(channels))
        rgb = np.repeat(pixels, 3, axis=1) if channels == 1 else pixels[:, 2::-1]
        return rgb.astype(np.float32).ravel()

    return pd.Series([one(d, c) for d, c in zip(data, channels, strict=True)], dtype=object)


def normalized_pixels(images: DataFrame) -> DataFrame:
    """``images``, as :func:`read_images` gives them, with ``pixels``: R, G, B, each ``(x / 255 - mean)
    / deviation`` of its channel. NULL where the stored bytes are no pixels."""
    return images.withColumn("pixels", pixel_normalize(rgb_values("data", "channels"), RGB_MEAN, RGB_STD))

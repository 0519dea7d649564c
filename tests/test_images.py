"""Pixels of decoded images."""

import pytest
from pyspark.sql import functions as F

from kindred.sources import images as I


def test_pixels_come_as_red_green_blue(spark):
    rows = [
        (1, 3, bytearray([30, 20, 10, 6, 5, 4])),  # stored B, G, R
        (2, 4, bytearray([30, 20, 10, 99, 6, 5, 4, 0])),
        (3, 1, bytearray([7, 8])),
        (4, 3, bytearray([1, 2])),
        (5, 2, bytearray([1, 2])),
        (6, 3, None),
        (7, 3, bytearray()),
        (8, None, bytearray([1, 2, 3])),
    ]
    images = spark.createDataFrame(rows, "i int, channels int, data binary")
    got = {r.i: r.v for r in images.select("i", I.rgb_values("data", "channels").alias("v")).collect()}
    assert got[1] == got[2] == [10, 20, 30, 4, 5, 6]
    assert got[3] == [7, 7, 7, 8, 8, 8]
    assert got[4] is got[5] is got[6] is got[8] is None and got[7] == []
    normal = I.normalized_pixels(images).where("i = 1").select(F.explode("pixels")).collect()
    want = [(v / 255 - m) / s for v, m, s in zip([10, 20, 30, 4, 5, 6], I.RGB_MEAN * 2, I.RGB_STD * 2, strict=True)]
    assert [r[0] for r in normal] == pytest.approx(want, rel=1e-6)

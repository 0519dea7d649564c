import math

import pytest
from pyspark.sql import functions as F

from kindred.functions import codec, keys, text
from kindred.functions import vectors as V


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).collect()[0]["x"]


def titles(spark, rows):
    df = spark.createDataFrame(rows, "a string, b string, n string, t string")
    title = text.gen_title(F.col("a"), F.col("b"), F.col("n"), F.col("t"))
    return [r[0] for r in df.select(title).collect()]


def test_title(spark):
    rows = [
        ("1food2", "sna3ck", "cola 330", "  fresh　cola 12 "),
        ("food", "snack", "cola", None),
        (None, None, None, None),
        ("a\x1cb", " c", "d\n\te", "9"),
    ]
    assert titles(spark, rows) == [
        "food snack cola 330 fresh cola",
        "food snack cola",
        "",
        "a b c d e",
    ]


def test_title_stays_in_the_jvm(spark):
    df = spark.createDataFrame([("a", "b", "c", "d")], "a string, b string, n string, t string")
    title = text.gen_title(F.col("a"), F.col("b"), F.col("n"), F.col("t"))
    plan = df.select(text.clean_title(title))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_clean_title(spark):
    cases = {
        "【福利秒杀】好茶": "好茶",
        "【直播专用1元秒杀】茶【x】": "茶x",
        "源本茶[赠品]": "茶",
        "a[b] c [d]e": "ae",
        "a[b(c)]d": "a[b(c)]d",
        "[a](b)[c]": "(b)",
    }
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    got = [r[0] for r in df.select(text.clean_title(F.col("s"))).collect()]
    assert got == list(cases.values())
    kept = text.clean_title(F.col("s"), (), stop_words=["the", "of"])
    assert one(spark, kept, s="the cup of tea") == "cup tea"


def test_phrases_are_removed_in_order(spark):
    assert one(spark, text.remove_phrases(F.col("s"), ["ab", "abc"]), s="abcx") == "cx"
    assert one(spark, text.remove_phrases(F.col("s"), ["abc", "ab"]), s="abcx") == "x"


@pytest.mark.parametrize(
    "value, expected",
    [("12.0", "12"), ("12", "12"), ("nan", ""), ("abc", ""), (None, ""), ("3e3", "3000"),
     ("9007199254740993", "9007199254740993"), ("1e30", ""), ("-3.7", "-3")],
)
def test_canonical_id(spark, value, expected):
    df = spark.createDataFrame([(value,)], "v string")
    assert df.select(keys.canonical_id(F.col("v"))).collect()[0][0] == expected


def test_missing_ids_are_not_positive(spark):
    df = spark.createDataFrame([("1",), ("0.5",), ("nan",), (None,), ("-1",), ("x",)], "v string")
    assert [r["v"] for r in df.where(keys.is_positive_id(F.col("v"))).collect()] == ["1", "0.5"]


def test_vector_with_a_missing_element(spark):
    df = spark.createDataFrame([([1.0, None, 3.0],), ([],), (None,)], "v array<double>")
    assert [r[0] for r in df.select(codec.encode_vector(F.col("v"))).collect()] == [None, "[]", None]


def test_dates_and_keys(spark):
    assert one(spark, keys.shift_date("2024-03-01", -7)) == "2024-02-23"
    assert one(spark, keys.dated_key("2024-03-01", F.lit("S1"))) == "20240301:S1"
    assert one(spark, keys.media_path("/r", F.lit("s"), F.lit(3))) == "/r/s/3.jpg"


def test_vector_text_round_trip(spark):
    values = [1.5, -2e-7, 3e8, 0.1]
    df = spark.createDataFrame([(values,)], "v array<float>")
    for brackets in (True, False):
        encoded = codec.encode_vector(F.col("v"), brackets)
        back, v = df.select(codec.decode_vector(encoded), "v").collect()[0]
        assert back == v
    decoded = one(spark, codec.decode_vector(F.lit("[1e-05,2]")))
    assert decoded == pytest.approx([1e-5, 2.0])
    assert one(spark, codec.decode_vector(F.lit("[1,x]"))) is None
    assert one(spark, codec.decode_vector(F.lit(""))) is None


def vec(*values):
    return F.array(*[F.lit(float(v)) for v in values])


def test_normalize_and_zero_rules(spark):
    assert one(spark, V.l2_normalize(vec(3, 4))) == [0.6, 0.8]
    assert one(spark, V.l2_normalize(vec(0, 0))) == [0.0, 0.0]
    assert all(math.isnan(x) for x in one(spark, V.l2_normalize(vec(0, 0), zero="nan")))


def test_small_vector_functions(spark):
    assert one(spark, V.dot(vec(1, 2), vec(3, 4))) == 11
    assert one(spark, V.cosine(vec(1, 0), vec(0, 0))) == 0
    assert one(spark, V.squared_l2(vec(1, 2), vec(3, 5))) == 13
    assert one(spark, V.pair_features(vec(1, 2), vec(3, 1))) == [1, 2, 3, 1, 2, 1]
    assert one(spark, V.argmax(vec(1, 5, 5))) == 1
    assert one(spark, V.mean_of(F.array(vec(1, 2), vec(3, 6)))) == [2, 4]


def test_norm_is_evaluated_once_per_row(spark):
    df = spark.createDataFrame([([1.0],)], "v array<double>").select(V.l2_normalize(F.col("v")).alias("u"))
    plan = df._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("sqrt") == 1


@pytest.mark.parametrize("easy", [True, False])
@pytest.mark.parametrize("cosine", [0.9, -0.2, -0.99])
def test_margin(spark, easy, cosine):
    m, s = 0.4, 64.0
    got = one(spark, V.margin_scores(vec(cosine, 0.3), F.lit(0), s, m, easy))
    widened = math.cos(math.acos(cosine) + m)
    if easy:
        expected = widened if cosine > 0 else cosine
    else:
        keeps = cosine > math.cos(math.pi - m)
        expected = widened if keeps else cosine - math.sin(math.pi - m) * m
    assert got == pytest.approx([expected * s, 0.3 * s])


def test_cross_entropy_of_large_scores(spark):
    got = one(spark, V.cross_entropy(vec(1000, 999), F.lit(1)))
    assert got == pytest.approx(math.log(1 + math.e))
    assert one(spark, V.multitask_loss(F.lit(1.0), F.lit(2.0), F.lit(3.0))) == 23


def test_pixels(spark):
    got = one(spark, V.pixel_normalize(vec(255, 0, 0, 0), (0.5, 0.4, 0.3), (0.5, 0.2, 0.1)))
    assert got == pytest.approx([1, -2, -3, -1])

from __future__ import annotations

import random

import oracles
from pyspark.sql import functions as F

from capframe.fixed_values import CLASSES
from capframe.functions import sequences as S
from capframe.functions import text as T

CAPTIONS = [
    None, "", " ", "NA", "null", 'a "quoted", word', "line\nbreak", "back\\slash\\", "12345", "x" * 50,
    "one two three four five six seven eight nine ten eleven twelve", "İstanbul", "Café-O'Neil", "naïve élan",
    "don't stop - now!", "a,b;c:d(e)f.g?h!i", "...!!!", "\t tab", "ÀÉÎ words ßtrasse", "日本 food 料理", "KELVIN K sign",
]

OUTPUTS = [
    "Food.", "drinks", "menu or food", "\tfood\n", " Menu ", "\x1cmenu2\x1f", "éfood", "foodé", "food_", "food1",
    "food́", "", "   ", "the OUTSIDE inside", "in-side outside", "Inside/outside", "nothing here ", "FOOD food drink",
    "_menu menu", "menu٣ drink", "drink　",
]


def test_tokens(spark, sf):
    rng = random.Random(1)
    letters = "aB1 .,-'é(\n_"
    texts = CAPTIONS + ["".join(rng.choices(letters, k=rng.randrange(60))) for _ in range(300)]
    texts += [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    wide = letters + "😀日ßİ\u0301\u00a0\t;!?:"
    texts += ["".join(rng.choices(wide, k=rng.randrange(300, 900))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = df.select("i", T.tokenize(F.col("t")).alias("ten"), T.tokenize(F.col("t"), None).alias("all"),
                    T.tokenize(F.col("t"), 3).alias("three"), T.tokenize(F.col("t"), 64).alias("most"),
                    T.tokenize(F.col("t"), 70).alias("more")).collect()
    for row in got:
        assert row.ten == oracles.tokens(texts[row.i]), texts[row.i]
        assert row.three == oracles.tokens(texts[row.i], 3)
        assert row.most == oracles.tokens(texts[row.i], 64)
        assert row.more == oracles.tokens(texts[row.i], 70)
        assert row.all == oracles.tokens(texts[row.i], None)


def test_parse_label_and_strip(spark):
    rng = random.Random(2)
    words = ["food", "Menu", "drink", "inside", "outside", "foods", "é", "_", " ", ".", "\n", "a"]
    texts = OUTPUTS + ["".join(rng.choices(words, k=rng.randrange(6))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for row in df.select("i", T.parse_label(F.col("t")).alias("p"), T.strip(F.col("t")).alias("s")).collect():
        assert row.p == oracles.parse(texts[row.i], CLASSES), repr(texts[row.i])
        assert row.s == texts[row.i].strip(), repr(texts[row.i])


def test_parse_label_other_lists(spark):
    texts = ["label lab", "lab-label", "labels", "la lab label"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for labels in (["la", "lab", "label"], ["label", "lab", "la"]):
        for row in df.select("i", T.parse_label(F.col("t"), labels).alias("p")).collect():
            assert row.p == oracles.parse(texts[row.i], labels)


def test_path_and_missing(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " "), (4, "x")], "photo_id int, caption string")
    rows = df.select(T.image_path(F.col("photo_id"), "a/").alias("p"), T.is_missing(F.col("caption")).alias("m")).collect()
    assert [r.p for r in rows] == ["a/1.jpg", "a/2.jpg", "a/3.jpg", "a/4.jpg"]
    assert [r.m for r in rows] == [False, True, False, False]


def test_sequences(spark):
    df = spark.createDataFrame([([3, 0, 7, 5],), ([],), ([1] * 6,)], "ids array<int>")
    rows = df.select(
        S.pad_right(F.col("ids"), 5).alias("p"),
        S.mask_labels(F.col("ids"), 0, 7).alias("m"),
        S.mask_labels(F.col("ids"), None, 7).alias("i"),
        S.mask_labels(F.col("ids"), None, None).alias("n"),
        S.trim_prefix(F.col("ids"), F.array(F.lit(3), F.lit(0))).alias("t"),
    ).collect()
    assert [r.p for r in rows] == [[3, 0, 7, 5, 0], [0] * 5, [1] * 6]
    assert [r.m for r in rows] == [[3, -100, -100, 5], [], [1] * 6]
    assert [r.i for r in rows] == [[3, 0, -100, 5], [], [1] * 6]
    assert [r.n for r in rows] == [[3, 0, 7, 5], [], [1] * 6]
    assert [r.t for r in rows] == [[7, 5], [], [1] * 4]

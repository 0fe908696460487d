from __future__ import annotations

import random

import oracles
import pytest
from pyspark.sql import functions as F

from capframe.catalogue import views
from capframe.functions.text import tokenize
from capframe.operators import lookup as L
from capframe.operators import vocabulary as V


def frame(spark, texts):
    df = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "photo_id long, ord long, caption string")
    return df.repartition(5).withColumn("tokens", tokenize(F.col("caption")))


def word_ids(vocab):
    return {r.word: r.id for r in vocab.table.collect()}


def test_vocabulary_on_documents(spark, sf):
    rows = views.captions(spark, sf).withColumn("tokens", tokenize(F.col("caption")))
    texts = [r.caption for r in rows.orderBy("ord").collect()]
    expected = oracles.vocabulary([oracles.tokens(t) for t in texts])
    vocab = V.build_vocabulary(rows, "tokens", "ord")
    assert word_ids(vocab) == expected
    assert vocab.size == len(expected) + 2


def test_edges(spark):
    texts = ["b a", "a b", "c a b", "c", "one two three four five six seven eight nine ten late", None, "", "late", "late"]
    rows = frame(spark, texts)
    vocab = V.build_vocabulary(rows, "tokens", "ord")
    # b comes first, c and late (once cut off after ten tokens) occur twice only
    assert word_ids(vocab) == {"b": 2, "a": 3}
    assert V.build_vocabulary(rows, "tokens", "ord", min_freq=100).size == 2


def test_order_column_decides(spark):
    texts = ["x y", "y x", "x y"]
    rows = frame(spark, texts)
    turned = rows.withColumn("ord", -F.col("ord"))
    assert word_ids(V.build_vocabulary(rows, "tokens", "ord")) == {"x": 2, "y": 3}
    assert word_ids(V.build_vocabulary(turned, "tokens", "ord")) == {"x": 2, "y": 3}
    texts = ["y x", "y x", "x y"]
    assert word_ids(V.build_vocabulary(frame(spark, texts).withColumn("ord", -F.col("ord")), "tokens", "ord")) == {"x": 2, "y": 3}


@pytest.mark.parametrize("broadcast_rows", [10**6, 10, 0])
@pytest.mark.parametrize("joins", [16, 1])
def test_encode_all_forms(spark, broadcast_rows, joins, monkeypatch):
    monkeypatch.setattr(V, "HOT_KEYS", 4)
    monkeypatch.setattr(V, "_JOINS", joins)
    rng = random.Random(3)
    words = ["the"] * 30 + ["dog", "cat", "food", "menu"] * 5 + [f"w{chr(97 + i)}" for i in range(20)]
    texts = [None, ""] + [" ".join(rng.choices(words, k=rng.randrange(14))) for _ in range(200)]
    rows = frame(spark, texts)
    vocab = V.build_vocabulary(rows, "tokens", "ord")
    got = V.encode(rows, "tokens", vocab, "photo_id", broadcast_rows=broadcast_rows)
    assert got.columns == [*rows.columns, "token_ids"]
    expected = oracles.vocabulary([oracles.tokens(t) for t in texts])
    assert got.count() == len(texts)
    for row in got.collect():
        assert row.token_ids == oracles.encode(oracles.tokens(texts[row.photo_id]), expected)
        assert len(row.token_ids) == 10 and all(0 <= i < vocab.size for i in row.token_ids)


def test_a_hot_word_of_other_rows_is_spread(spark, monkeypatch):
    """A word that is rare where the vocabulary was counted and hot where it is used."""
    monkeypatch.setattr(L, "HOT_KEYS", 3)
    learned = frame(spark, ["common words here", "common words here", "rare", "rare", "seldom seen", "seldom seen"] + ["common"] * 20)
    vocab = V.build_vocabulary(learned, "tokens", "ord", min_freq=2)
    ids = word_ids(vocab)
    texts = ["rare rare rare", "rare unknown common"] * 50 + ["seldom rare", "never", ""]
    used = frame(spark, texts)
    got = V.encode(used, "tokens", vocab, "photo_id", broadcast_rows=2).collect()
    assert len(got) == len(texts)
    for row in got:
        own = [ids.get(w, 1) for w in texts[row.photo_id].split()]
        assert row.token_ids == own + [0] * (10 - len(own))


def test_long_sequences_go_by_word(spark):
    texts = ["a b c d e " * 8] * 3
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "photo_id long, caption string")
    rows = df.withColumn("tokens", tokenize(F.col("caption"), 40))
    vocab = V.build_vocabulary(rows, "tokens", "photo_id")
    got = V.encode(rows, "tokens", vocab, "photo_id", max_len=40).first().token_ids
    assert got == [2, 3, 4, 5, 6] * 8


def test_whole_lists_are_encoded_in_their_rows(spark):
    """Without a row per token or a shuffle, and as by word: also for absent lists and words, and for keys that repeat."""
    lists = [["a", "b", "a"], None, [], ["c", None, "a"], ["b"] * 50]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(lists)], "photo_id long, tokens array<string>")
    vocab = V.build_vocabulary(rows, "tokens", "photo_id", min_freq=2)
    coded = V.encode_whole(rows, "tokens", vocab, "photo_id")
    plan = coded._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Exchange" not in plan
    a, b = (word_ids(vocab)[w] for w in "ab")
    assert {r.photo_id: r.ids for r in coded.collect()} == {0: [a, b, a], 1: [], 2: [], 3: [1, 1, a], 4: [b] * 50}
    again = rows.union(rows.where("photo_id in (0, 3)")).union(rows.select(F.lit(None).cast("long"), "tokens"))
    one, other = V.encode_whole(again, "tokens", vocab, "photo_id"), V.encode_whole(again, "tokens", vocab, "photo_id", broadcast_rows=0)
    assert one.columns == other.columns == ["photo_id", "tokens", "ids"]
    assert sorted((r.photo_id, r.ids) for r in one.collect()) == sorted((r.photo_id, r.ids) for r in other.collect())


def test_lookup_with_hot_and_null_keys(spark, monkeypatch):
    monkeypatch.setattr(L, "HOT_KEYS", 3)
    keys = [7] * 500 + [8] * 400 + [None] * 50 + list(range(100, 200)) + [9999] * 300
    df = spark.createDataFrame(list(enumerate(keys)), "i int, k long")
    table = spark.createDataFrame([(k, f"v{k}") for k in [7, *range(100, 150)]], "k long, v string")
    for limit in (1000, 0):
        got = {r.i: r.v for r in L.lookup(df, table, "k", ["i"], limit).collect()}
        assert len(got) == len(keys)
        listed = {7, *range(100, 150)}
        assert all(got[i] == (f"v{k}" if k in listed else None) for i, k in enumerate(keys))

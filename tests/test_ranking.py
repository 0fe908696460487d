from __future__ import annotations

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from capframe.operators import ranking as R


def shuffled_ids(spark, n):
    ids = list(range(n))
    random.Random(n).shuffle(ids)
    return spark.createDataFrame([(i, f"c{i}") for i in ids], "photo_id long, caption string").repartition(7)


def test_sizes_match_float_form():
    for n in range(2, 3000):
        held = math.ceil(0.3 * n)
        test = math.ceil(held * 2 / 3)
        assert R.split_sizes(n) == (n - held, held - test, test)
    assert R.split_sizes(7) == (4, 1, 2)
    assert R.split_sizes(10) == (7, 1, 2)
    assert R.split_sizes(20_000) == (14_000, 2_000, 4_000)


def digest(i):
    return hashlib.md5(f"42|{i}".encode()).hexdigest()


@pytest.mark.parametrize("n", [1, 2, 7, 10, 1000])
@pytest.mark.parametrize("small", [20_000, 3])
def test_split(spark, n, small, monkeypatch):
    monkeypatch.setattr(R, "_SMALL", small)
    monkeypatch.setattr(R, "_HEX", 1 if small == 3 else 4)
    got = {r.photo_id: r.split for r in R.with_split(shuffled_ids(spark, n), ["photo_id"]).collect()}
    order = sorted(range(n), key=digest)
    train, valid, test = R.split_sizes(n)
    expected = ["train"] * train + ["valid"] * valid + ["test"] * test
    assert [got[i] for i in order] == expected


def test_split_ignores_captions_and_places(spark):
    rows = shuffled_ids(spark, 300)
    other = rows.withColumn("caption", F.lit("new")).repartition(2)
    a = {tuple(r) for r in R.with_split(rows, ["photo_id"]).select("photo_id", "split").collect()}
    b = {tuple(r) for r in R.with_split(other, ["photo_id"]).select("photo_id", "split").collect()}
    c = {tuple(r) for r in R.with_split(rows, ["photo_id"], seed=1).select("photo_id", "split").collect()}
    assert a == b and a != c


def test_split_refuses_repeated_keys(spark, monkeypatch):
    rows = spark.createDataFrame([(1,)] * 50, "photo_id long")
    with pytest.raises(ValueError):
        R.with_split(rows, ["photo_id"])
    monkeypatch.setattr(R, "_SMALL", 5)
    with pytest.raises(ValueError):
        R.with_split(rows, ["photo_id"])


def test_global_row_number(spark):
    rows = [(random.Random(i).randrange(50), f"k{i:04d}") for i in range(2000)]
    df = spark.createDataFrame(rows, "a int, b string").repartition(9)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        numbered = R.global_row_number(df, "a", "b").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert [(r.a, r.b) for r in sorted(numbered, key=lambda r: r.rn)] == sorted(rows)
    assert sorted(r.rn for r in numbered) == list(range(1, 2001))


def test_seeded_order(spark):
    df = shuffled_ids(spark, 500)
    numbered = {r.photo_id: r.rn for r in R.seeded_row_number(df, ["photo_id"]).collect()}
    order = sorted(range(500), key=digest)
    assert [numbered[i] for i in order] == list(range(1, 501))
    assert [r.photo_id for r in R.shuffle_rows(df, ["photo_id"]).collect()] == order


def test_batches(spark):
    rows = R.with_batches(shuffled_ids(spark, 300), "photo_id", size=128).collect()
    assert {(r.photo_id, r.batch_id, r.batch_pos) for r in rows} == {(i, i // 128, i % 128) for i in range(300)}
    one = R.epoch_batches(shuffled_ids(spark, 300), ["photo_id"], 1).collect()
    two = R.epoch_batches(shuffled_ids(spark, 300), ["photo_id"], 2).collect()
    place = lambda rows: {(r.photo_id, r.batch_id, r.batch_pos) for r in rows}
    assert place(one) != place(two)
    assert sorted((r.batch_id, r.batch_pos) for r in one) == [(i // 128, i % 128) for i in range(300)]


def test_running_total_in_ranges(spark):
    rows = [(f"f{i // 40:02d}", i % 40, (i * 7) % 11) for i in range(800)]
    mixed = random.Random(5).sample(rows, len(rows))
    df = spark.createDataFrame(mixed, "file string, start long, n long").repartition(6)
    got = {(r.file, r.start): r.before for r in R.running_total(df, "n", "file", "start").collect()}
    total, expected = 0, {}
    for file, start, n in rows:
        expected[file, start] = total
        total += n
    assert got == expected
    assert R.running_total(df.where("false"), "n", "file", "start").count() == 0

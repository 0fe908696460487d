from __future__ import annotations

import math
import random

import oracles
import pytest
from pyspark.sql import functions as F

from capframe.functions import vectors as V
from capframe.functions.draws import gaussian, whole
from capframe.operators import embeddings as E
from capframe.operators import ranking as R
from capframe.operators import trainlog as T


def vectors(n, dim=6, seed=1):
    rng = random.Random(seed)
    return [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(n)]


def frame(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "photo_id long, vector array<double>")


def test_vector_functions(spark):
    a, b = vectors(2)
    df = spark.createDataFrame([(a, b, 2)], "a array<double>, b array<double>, label int")
    c, d = F.col("a"), F.col("b")
    row = df.select(
        V.cosine(c, d).alias("cos"), V.add(c, d).alias("add"), V.perturb(c, d, 0.5).alias("near"),
        V.argmax(c).alias("top"), V.softmax(c).alias("soft"), V.cross_entropy(c, F.col("label")).alias("loss"),
        V.linear_scores(c, [b, a], [0.5, -1.0]).alias("lin"), V.mean_tokens(F.array(c, d), 6).alias("mean"),
        V.map_to_tokens(F.array(c, d), 2, 3).alias("map"), V.cosine(F.array(F.lit(0.0)), F.array(F.lit(0.0))).alias("zero"),
        V.argmax(F.array(F.lit(1.0), F.lit(3.0), F.lit(3.0))).alias("tie"),
    ).first()
    total = sum(math.exp(x) for x in a)
    assert row.cos == pytest.approx(oracles.cosine(a, b))
    assert row["add"] == pytest.approx([x + y for x, y in zip(a, b)])
    assert row.near == pytest.approx([x + 0.5 * y for x, y in zip(a, b)])
    assert row.top == a.index(max(a)) and row.tie == 1 and row.zero == 0
    assert row.soft == pytest.approx([math.exp(x) / total for x in a])
    assert row.loss == pytest.approx(-math.log(math.exp(a[2]) / total))
    assert row.lin == pytest.approx([sum(x * y for x, y in zip(a, b)) + 0.5, sum(x * x for x in a) - 1])
    assert row.mean == pytest.approx([(x + y) / 2 for x, y in zip(a, b)])
    assert [list(t) for t in row.map] == [[x, y] for x, y in zip(a, b)]


@pytest.mark.parametrize("size", [1, 2, 5, 100])
def test_negatives(spark, size):
    values = vectors(101)
    rows = R.with_batches(frame(spark, values), "photo_id", size=size)
    rows = rows.withColumn("near", F.col("vector")).withColumn("batch_size", E.batch_rows(101, size))
    neg = E.negative_position(F.col("batch_pos"), F.col("batch_size"), whole(1, F.col("photo_id")))
    pairs = E.negative_pairs(rows, "vector", "near", neg).collect()
    single = 101 if size == 1 else 1 if 101 % size == 1 else 0
    assert len(pairs) == 101 - single
    for r in pairs:
        assert r.neg_pos != r.batch_pos and 0 <= r.neg_pos < r.batch_size
        assert r.neg_vector == values[r.batch_id * size + r.neg_pos]


def test_negatives_are_uniform(spark):
    df = spark.range(20000).select(E.negative_position(F.lit(2), F.lit(5), whole(3, F.col("id"))).alias("j"))
    counts = {r.j: r["count"] for r in df.groupBy("j").count().collect()}
    assert set(counts) == {0, 1, 3, 4}
    assert all(abs(c - 5000) < 400 for c in counts.values())


def test_info_nce(spark):
    a, b, c = vectors(10, seed=1), vectors(10, seed=2), vectors(10, seed=3)
    df = spark.createDataFrame([(0, *t) for t in zip(a, b, c)], "batch_id int, v array<double>, p array<double>, neg_vector array<double>")
    expected = sum(math.log1p(math.exp((oracles.cosine(x, z) - oracles.cosine(x, y)) / 0.2)) for x, y, z in zip(a, b, c)) / 10
    assert E.info_nce(df, "v", "p").first().loss == pytest.approx(expected)


def test_gaussian_is_keyed_and_normal(spark):
    df = spark.range(2000)
    one = {r.id: r.g for r in df.repartition(3).select("id", gaussian(F.col("id"), 4, 7).alias("g")).collect()}
    two = {r.id: r.g for r in df.repartition(5).select("id", gaussian(F.col("id"), 4, 7).alias("g")).collect()}
    assert one == two
    flat = [x for g in one.values() for x in g]
    mean = sum(flat) / len(flat)
    assert abs(mean) < 0.05 and abs(sum((x - mean) ** 2 for x in flat) / len(flat) - 1) < 0.06


def test_contrastive_total(spark):
    one = spark.createDataFrame([(0, 1.0), (1, 2.0)], "batch_id int, loss double")
    two = spark.createDataFrame([(0, 0.5)], "batch_id int, loss double")
    total = E.contrastive_total({"image": one, "text": two}, {"image": 1.0, "text": 2.0})
    assert {r.batch_id: r.contrastive_loss for r in total.collect()} == {0: 2.0, 1: 2.0}


def test_long_vectors_are_pooled_alike(spark, monkeypatch):
    df = frame(spark, vectors(30)).withColumn("g", F.col("photo_id") % 3)
    flat = {r.g: (r.n, r["mean"]) for r in E.mean_by_group(df, "g", "vector", 6).collect()}
    monkeypatch.setattr(E, "_FLAT", 2)
    for r in E.mean_by_group(df, "g", "vector", 6).collect():
        assert (r.n, r["mean"]) == (flat[r.g][0], pytest.approx(flat[r.g][1]))


def test_pooling_and_lookup(spark):
    values = vectors(30)
    df = frame(spark, values).withColumn("g", F.col("photo_id") % 3)
    pooled = {r.g: r["mean"] for r in E.mean_by_group(df, "g", "vector", 6).collect()}
    for g in range(3):
        assert pooled[g] == pytest.approx([sum(v[i] for v in values[g::3]) / 10 for i in range(6)])
    ids = spark.createDataFrame([(1, [3, 0, 99]), (2, [])], "photo_id long, ids array<long>")
    table = frame(spark, values).withColumnRenamed("photo_id", "id")
    places = table.where("id < 3").selectExpr("cast(id as int) AS pos", "vector AS position")
    for limit in (1000, 0, None):
        for few in (["vector"], ["photo_id"]):
            with pytest.raises(Exception, match="no vector for id 99"):
                E.lookup_vectors(ids, "photo_id", "ids", table, None, limit).select(*few).collect()
        with pytest.raises(Exception, match="no position for pos 2"):
            E.lookup_vectors(ids, "photo_id", "ids", table, places.where("pos < 2"), limit, [0.0] * 6).count()
        rows = E.lookup_vectors(ids, "photo_id", "ids", table, places, limit, [7.0] * 6).collect()
        got = {(r.photo_id, r.pos): r.vector for r in rows}
        assert set(got) == {(1, 0), (1, 1), (1, 2)}
        assert got[1, 0] == pytest.approx([x + y for x, y in zip(values[3], values[0])])
        assert got[1, 2] == pytest.approx([7.0 + y for y in values[2]])


def test_broadcast_bound_follows_the_width(spark):
    narrow = spark.createDataFrame([(0, [1.0] * 4), (1, None)], "id long, vector array<double>")
    wide = spark.createDataFrame([(0, [1.0] * 400)], "id long, vector array<double>")
    assert E.vector_rows(narrow) == 100 * E.vector_rows(wide)
    assert E.vector_rows(narrow.where("id > 5")) == E.VECTOR_BYTES // 8


def test_layer_scores(spark):
    layer = F.array(*[F.struct(F.array(F.lit(a), F.lit(b)).alias("weights"), F.lit(c).alias("bias")) for a, b, c in [(1.0, 2.0, 0.5), (-1.0, 0.0, 0.0)]])
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    assert [r.s for r in df.select(V.layer_scores(F.col("v"), layer).alias("s")).collect()] == [[11.5, -3.0], [0.5, 0.0]]


def test_epoch_losses(spark):
    df = spark.createDataFrame([("r", 1, 1.0, 2.0), ("r", 1, 3.0, 4.0)], "run string, epoch int, pred_loss double, contrastive_loss double")
    row = T.epoch_losses(df).first()
    assert (row.pred_loss, row.contrastive_loss, row.total_loss) == pytest.approx((2.0, 3.0, 2.15))


@pytest.mark.parametrize("chunk", [100_000, 7, 1])
def test_early_stopping(spark, chunk, monkeypatch):
    monkeypatch.setattr(T, "_CHUNK", chunk)
    rng = random.Random(4)
    runs = [[round(rng.random(), 1) for _ in range(30)] for _ in range(60)]
    runs += [[0.9, 0.1, 0.1, 0.1, 0.1, 0.1, 0.95, 0.99], [0.0] * 5 + [0.5] * 9]
    runs += [[0.0] * 12, [0.1, 0.1, 0.1, 0.1, 0.1], [0.1 * i for i in range(12)], [0.5, 0.4, 0.4, 0.4, 0.9]]
    rows = [(r, e, s) for r, values in enumerate(runs) for e, s in enumerate(values, start=1)]
    df = spark.createDataFrame(rows, "run int, epoch int, score double")
    got = {r.run: r for r in T.early_stopping(df, patience=4).collect()}
    for i, values in enumerate(runs):
        best, stop = oracles.early_stop(values, 4)
        assert (got[i].best_epoch, got[i].stop_epoch) == (best, stop)
        assert got[i].epochs == (stop or len(values))
    top = {r.run: r.best_epoch for r in T.best_epoch(df).collect()}
    assert all(top.get(i) == (v.index(max(v)) + 1 if max(v) > 0 else None) for i, v in enumerate(runs))

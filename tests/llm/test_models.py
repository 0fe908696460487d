"""Quality and toxicity: held-out accuracy, labels kept apart, odd inputs, and the numeric parts by definition."""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from capframe.llm import quality, toxicity
from capframe.llm.queries import op5_toxicity, op9_quality

SF = "/root/testdata/sf0.1"


def auc(scores, y):
    scores, y = np.array(scores), np.array(y, dtype=bool)
    ones, zeros = scores[y][:, None], scores[~y][None]
    return ((ones > zeros) + 0.5 * (ones == zeros)).mean()


@pytest.mark.parametrize(
    "query, label, modulus, rest", [(op5_toxicity, "toxic", 5, 0), (op9_quality, "quality", 3, 1)]
)
def test_held_out_accuracy(spark, query, label, modulus, rest):
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = query(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == rest)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [(r.score, r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    scores, predicted, y = zip(*held)
    assert auc(scores, y) > 0.9
    assert np.mean(np.array(predicted) == np.array(y)) > 0.9


def test_held_out_labels_are_not_read(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    turned = lambda name, m, r: labels.withColumn(
        name, F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % m == r, 1 - F.col(name)).otherwise(F.col(name))
    )
    stats = quality.document_stats(docs)
    a, b = quality.fit(stats, labels), quality.fit(stats, turned("quality", 3, 1))
    assert np.allclose(a.weights, b.weights) and np.allclose(a.values, b.values)
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, turned("toxic", 5, 0))
    assert a.words == b.words and np.allclose(a.weights, b.weights)


def test_model_edges(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    train = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(1, None, "a"), (2, "", "b"), (None, "some words", "c"), (4, "x" * 200_000, "d"), (5, "q " * 60_000, "e"), (5, "again", "e")]
    odd = spark.createDataFrame(rows, "doc_id long, text string, quality_score string")
    model = quality.fit(quality.document_stats(train), labels)
    scored = {r.doc_id: r.score for r in quality.score(quality.document_stats(odd), model).collect()}
    assert abs(scored[1] - scored[2]) < 1e-9
    kept = quality.keep_good(odd, model)
    assert kept.columns == odd.columns and kept.count() <= 6
    found = toxicity.score(odd, toxicity.fit(train, labels)).collect()
    assert len(found) == 6 and all(0 <= r.score <= 1 for r in found)
    for none in (labels.where("false"), labels.where("toxic = 0 and quality = 1")):
        flat = quality.score(quality.document_stats(odd), quality.fit(quality.document_stats(train), none)).collect()
        assert len({r.score for r in flat}) == 1
        assert {r.score for r in toxicity.score(odd, toxicity.fit(train, none)).collect()} == {0.0}
    empty = odd.where("false")
    assert quality.score(quality.document_stats(empty), model).count() == 0
    assert toxicity.score(empty, toxicity.fit(empty, labels)).count() == 0


def test_isotonic_by_definition():
    rng = np.random.default_rng(0)
    y, w = rng.random(12), rng.integers(1, 5, 12).astype(float)
    _, got = quality.isotonic(np.arange(12.0), y, w)
    mean = lambda a, b: np.average(y[a : b + 1], weights=w[a : b + 1])
    want = [max(min(mean(a, b) for b in range(i, 12)) for a in range(i + 1)) for i in range(12)]
    assert np.allclose(got, want)


def test_fourier_features_approximate_the_kernel():
    rng = np.random.default_rng(0)
    n, waves = quality.N_STATS, 20_000
    model = quality.QualityModel(
        np.zeros(n), np.ones(n), rng.normal(size=(n, waves)) / np.sqrt(n / 2), rng.uniform(0, 2 * np.pi, waves), None, np.zeros(0), np.zeros(0)
    )
    x = rng.normal(size=(6, n))
    z = model.expand(x)[:, :-1]
    exact = np.exp(-((x[:, None] - x[None]) ** 2).sum(axis=2) / n)
    assert np.abs(z @ z.T - exact).max() < 0.05


def test_marginals_by_enumeration():
    """Forward-backward against the sum over all tag sequences."""
    rng = np.random.default_rng(3)
    field = toxicity.Field(*(rng.normal(size=n) for n in (3, 4, 4, 4, 4)), rng.normal(size=(2, 2)), rng.normal(size=1))
    docs = [rng.integers(0, 48, n) for n in (1, 5, 8, 0, 3)]
    for codes, got in zip(docs, toxicity.Lanes(docs).marginals(field)):
        n = len(codes)
        bucket, shape, length = codes // 16, codes % 16 // 4, codes % 4
        before, after = np.append(3, bucket[:-1])[:n], np.append(bucket[1:], 3)[:n]
        emit = field.bucket[bucket] + field.shape[shape] + field.length[length] + field.before[before] + field.after[after]
        total, toxic = 0.0, np.zeros(n)
        for tags in itertools.product((0, 1), repeat=n):
            e = sum(emit[i] for i in range(n) if tags[i]) + sum(field.step[a, b] for a, b in zip(tags, tags[1:]))
            weight = np.exp(e + (field.start[0] if n and tags[0] else 0))
            total += weight
            toxic += weight * np.array(tags)
        assert np.allclose(got, toxic / total)


def test_spans_point_at_toxic_words(spark):
    docs = [(i, f"the quiet garden holds number {i} and zorgblat idiots walk by") for i in range(40)]
    docs += [(100 + i, f"the quiet garden holds number {i} and gentle people walk by") for i in range(60)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 100)) for i, _ in docs], "doc_id long, toxic int")
    rows = {r.doc_id: r for r in toxicity.score(table, toxicity.fit(table, labels)).collect()}
    for i, text in docs:
        words = {text[int(s) : int(e)] for s, e in (x.split(":") for x in rows[i].spans.split(",") if x)}
        assert words <= {"zorgblat", "idiots"} and bool(words) == (i < 100) == bool(rows[i].predicted)

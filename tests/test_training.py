"""Learned token vectors, the network trained by epochs, and runs that go on after they died."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from capframe.functions.text import tokenize
from capframe.operators import captions as C
from capframe.operators import vocabulary as V
from capframe.operators.trainlog import best_epoch, early_stopping
from capframe.plans import baselines as B
from capframe.plans import examples, inference, network, word_vectors
from capframe.plans.prepare import prepare
from capframe.sources import models


def planted(rows=400):
    """Captions in which two words stand in the same company, and two others in another."""
    rng = random.Random(4)
    for i in range(rows):
        group, name = ("sea", ["boat", "ship"]) if i % 2 else ("sky", ["plane", "jet"])
        company = [f"{group}{rng.randrange(6)}" for _ in range(6)]
        company.insert(rng.randrange(7), rng.choice(name))
        yield i, " ".join(f"{w[:-1]}{chr(97 + int(w[-1]))}" if w[-1].isdigit() else w for w in company), group


@pytest.fixture(scope="module")
def coded(spark):
    rows = spark.createDataFrame(list(planted()), "photo_id long, caption string, label string").withColumn("ord", F.col("photo_id"))
    return prepare(rows)


@pytest.fixture(scope="module")
def learned(coded):
    return word_vectors.learn_token_vectors(coded.table, "token_ids", coded.vocabulary, dim=16, rounds=15)


def test_words_in_one_company_lie_together(coded, learned):
    vectors = {r.id: np.array(r.vector) for r in learned.collect()}
    assert sorted(vectors) == list(range(coded.vocabulary.size))
    assert not vectors[0].any() and not vectors[1].any()  # padding, and unknown words, of which there are none
    ids = {r.word: r.id for r in coded.vocabulary.table.collect()}
    near = lambda a, b: vectors[ids[a]] @ vectors[ids[b]] / np.linalg.norm(vectors[ids[a]]) / np.linalg.norm(vectors[ids[b]])
    for a, b, other in (("boat", "ship", "jet"), ("plane", "jet", "ship")):
        assert near(a, b) > near(a, other) + 0.2


def test_unknown_words_share_a_vector_and_nothing_is_too_large(spark, coded, monkeypatch):
    rows = spark.createDataFrame([(i, f"same words rare{chr(97 + i)}") for i in range(9)], "photo_id long, caption string")
    rows = rows.withColumn("tokens", tokenize(F.col("caption"))).withColumn("ord", F.col("photo_id"))
    vocab = V.build_vocabulary(rows, "tokens", "ord")
    ids = V.encode(rows, "tokens", vocab, "photo_id")
    vectors = {r.id: r.vector for r in word_vectors.learn_token_vectors(ids, "token_ids", vocab, dim=4).collect()}
    assert any(vectors[1]) and not any(vectors[0])
    none = word_vectors.learn_token_vectors(ids.where("false"), "token_ids", vocab, dim=4)
    assert {tuple(r.vector) for r in none.collect()} == {(0.0,) * 4}
    monkeypatch.setattr(word_vectors, "MOST_BYTES", 10)
    with pytest.raises(ValueError, match="min_freq"):
        word_vectors.learn_token_vectors(ids, "token_ids", vocab)


@pytest.fixture(scope="module")
def fused(coded, learned):
    texts = word_vectors.text_vectors(coded.table, "photo_id", "token_ids", learned, dim=16)
    noise = F.array((F.col("photo_id") % 5).cast("double"), F.lit(1.0)).alias("image_vector")
    return coded.table.select("photo_id", "label_id", "split", noise).join(texts, "photo_id")


def test_held_out_accuracy_of_the_network(fused, tmp_path):
    judged, trained = network.run_network(fused, str(tmp_path / "n"), 2, hidden=8, epochs=8, patience=2, steps=10)
    rows = judged.collect()
    assert len(rows) == 80 and np.mean([r.label_id == r.pred_id for r in rows]) > 0.95
    rule = early_stopping(trained.history, patience=2).first()
    assert rule.epochs == trained.history.count() and rule.best_epoch == trained.best == best_epoch(trained.history).first().best_epoch


def test_a_lost_driver_goes_on_after_its_last_epoch(fused, tmp_path, monkeypatch):
    folder, fits = str(tmp_path / "n"), []
    ready = network.fuse(fused)
    train, valid = ready.where("split = 'train'"), ready.where("split = 'valid'")
    real = network._epoch_model

    def counted(train, path, *rest):
        fits.append(path)
        if len(fits) == 3:
            raise KeyboardInterrupt
        return real(train, path, *rest)

    monkeypatch.setattr(network, "_epoch_model", counted)
    options = dict(epochs=5, patience=9, steps=2)
    with pytest.raises(KeyboardInterrupt):
        network.train_network(train, valid, [18, 4, 2], folder, **options)
    went_on = network.train_network(train, valid, [18, 4, 2], folder, **options)
    assert [p[-1] for p in fits] == ["1", "2", "3", "3", "4", "5"]
    monkeypatch.undo()
    straight = network.train_network(train, valid, [18, 4, 2], str(tmp_path / "m"), **options)
    scores = lambda t: [(r.epoch, round(r.score, 9)) for r in sorted(t.history.collect())]
    assert scores(went_on) == scores(straight) and went_on.best == straight.best
    assert np.allclose(went_on.model.weights.toArray(), straight.model.weights.toArray(), atol=1e-6)
    again = network.train_network(train, valid, [18, 4, 2], folder, **options)
    assert scores(again) == scores(straight)


def test_a_network_never_above_zero_has_no_best_epoch(fused, tmp_path):
    ready = network.fuse(fused)
    trained = network.train_network(ready.where("split = 'train'"), ready.where("false"), [18, 4, 2], str(tmp_path / "n"), epochs=9, patience=2, steps=1)
    assert trained.best is None and trained.history.count() == 2


def test_the_matrix_fits_only_what_is_missing(coded, fused, tmp_path):
    vectors = B.with_image_vector(fused, "image_vector").select("photo_id", "image_vector")
    table = coded.table.join(vectors, "photo_id")
    tables, fits = {"raw": table, "completed": table}, []

    def make(value, most=99):
        fits.append(value)
        if len(fits) > most:
            raise KeyboardInterrupt
        return B.classifier(value)

    store = str(tmp_path / "store")
    with pytest.raises(KeyboardInterrupt):
        B.run_matrix(tables, grid=(0.1,), make=lambda v: make(v, 2), store=store)
    first = B.run_matrix(tables, grid=(0.1,), make=make, store=store)
    assert len(fits) == 3 + 4  # two were done, the third died, and four more make six
    again = B.run_matrix(tables, grid=(0.1,), make=make, store=store)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(again) == rows(first) and len(fits) == 7
    assert {r.config: r.f1 for r in first.where("class = 0").collect()}["text_raw"] > 0.95  # held out


def test_a_model_is_fitted_once(spark, tmp_path):
    fitted = []

    def fit():
        fitted.append(1)
        return B.Pipeline(stages=B.feature_stages(False, True, 8)).fit(spark.createDataFrame([(["a"],)], "tokens array<string>"))

    for _ in range(2):
        model = models.fit_once(spark, str(tmp_path / "m"), fit)
    assert len(fitted) == 1 and len(model.stages) == 3


def test_encoder_outputs_go_back_batch_by_batch(spark):
    rows = spark.range(300).select("id", F.array(*[F.col("id").cast("float")] * 4).alias("x")).coalesce(1)

    def encoder():
        def encode(frame):
            assert len(frame) <= 16
            return [None if x[0] == 7 else np.outer(np.asarray(x), [1, 2, 3]) for x in frame["x"]]

        return encode

    got = {r.id: r.y for r in rows.select("id", inference.infer(encoder, {"x": F.col("x")}, "array<array<float>>", 16).alias("y")).collect()}
    assert got[7] is None and got[5] == [[5.0, 10.0, 15.0]] * 4 and len(got) == 300


def test_counts_come_with_the_write(spark, coded, tmp_path):
    rows = [(1, None), (2, ""), (3, "x"), (4, "y")]
    photos = spark.createDataFrame(rows, "photo_id long, caption string")
    seen, counts = C.with_report(photos)
    seen.write.parquet(str(tmp_path / "t"))
    assert counts.get == C.caption_report(photos).first().asDict()
    photos = photos.withColumn("label", F.lit("x")).withColumn("ord", F.col("photo_id"))
    none = prepare(photos, photos.where("false"))
    assert none.counts["rows"] == none.counts["broken"] == 4 and none.counts["kept"] == 0
    some = prepare(photos, photos.where("photo_id > 1"))
    assert (some.counts["broken"], some.counts["with_caption"], some.counts["without_caption"]) == (1, 2, 1)


def test_conversations(spark):
    turns = spark.createDataFrame([(1, 2, "user", "b"), (1, 1, "system", None), (1, 10, "user", "c"), (2, 1, "user", "")], "conv_id long, turn int, role string, text string")
    got = {r.conv_id: r.rendered for r in examples.rendered_conversations(turns).collect()}
    line = lambda role, text: f"<|im_start|>{role}\n{text}<|im_end|>\n"
    assert got == {1: line("system", "") + line("user", "b") + line("user", "c"), 2: line("user", "")}
    open_ = examples.rendered_conversations(turns, generation=True).where("conv_id = 2").first().rendered
    assert open_ == line("user", "") + "<|im_start|>assistant\n"

"""Baselines, streams and the shape of physical plans."""

from __future__ import annotations

import re
import threading

import pytest
from pyspark.sql import functions as F

from capframe.catalogue import views
from capframe.catalogue.queries import QUERIES
from capframe.functions.text import tokenize
from capframe.operators import vocabulary as V
from capframe.plans import baselines as B
from capframe.plans.prepare import prepare
from capframe.session import materialize
from capframe.sources.models import load_best, save_best
from capframe.streaming.captions import encode_captions


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def prepared(spark, sf):
    table = prepare(views.captions(spark, sf)).table
    features = F.array((F.col("photo_id") % 3).cast("double"), (F.col("photo_id") % 5).cast("double"))
    return B.with_image_vector(table.withColumn("features", features), "features").drop("features")


def test_selection_and_model_files(spark, prepared, tmp_path):
    known = prepared.where("label_id IS NOT NULL")
    train, valid = known.where("split = 'train'"), known.where("split = 'valid'")
    fitted = B.fit_best(train, valid, image=False, text=True, grid=(10.0, 0.01))
    history = {r.epoch: r.score for r in fitted.history.collect()}
    assert fitted.best == max(sorted(history), key=lambda e: history[e])
    save_best(fitted.model, str(tmp_path / "m"))
    save_best(fitted.model, str(tmp_path / "m"))
    again = load_best(str(tmp_path / "m"))
    rows = lambda m: sorted(tuple(r) for r in B.predict(m, valid).collect())
    assert rows(again) == rows(fitted.model)


def test_run_matrix(prepared):
    scores = B.run_matrix({"raw": prepared}, ["text", "image", "both"], grid=(0.1,))
    assert {r.config for r in scores.collect()} == {"text_raw", "image_raw", "both_raw"}
    wide = B.compare_matrix(scores, "text_raw", ["text_raw", "both_raw"])
    assert set(wide.columns) == {"class", "text_raw", "both_raw", "both_raw_delta"}
    with pytest.raises(ValueError):
        B.run_config(prepared, image=False, text=False)


def test_the_matrix_fits_at_once_on_features_written_once(prepared, tmp_path, monkeypatch):
    together, written = threading.Barrier(4), []  # two configurations of two candidates each

    class Meeting:
        def __init__(self, value):
            self.value = value

        def fit(self, rows):
            together.wait(90)
            return B.classifier(self.value, 3).fit(rows)

    monkeypatch.setattr(B, "materialize", lambda df, name: written.append(name) or materialize(df, name))
    rows = lambda scores: sorted(tuple(r) for r in scores.collect())
    at_once = rows(B.run_matrix({"raw": prepared}, ["text", "image"], (0.1, 0.01), Meeting))
    assert written == ["features"]
    in_turn = B.run_matrix({"raw": prepared}, ["text", "image"], (0.1, 0.01), lambda v: B.classifier(v, 3), str(tmp_path / "store"))
    assert at_once == rows(in_turn) and {r[0] for r in at_once} == {"text_raw", "image_raw"}


def test_perceptron_on_fused_features(prepared):
    make = lambda seed: B.perceptron(B.TEXT_DIM + 2, 4, hidden=4, seed=int(seed)).setMaxIter(3)
    rows = B.run_config(prepared, image=True, text=True, grid=(1,), make=make).collect()
    assert rows and {r.pred_id for r in rows} <= {0, 1, 2, 3}


def test_vocabulary_scope(spark, sf):
    photos = views.captions(spark, sf)
    every, train = prepare(photos), prepare(photos, vocab_scope="train")
    assert train.vocabulary.size < every.vocabulary.size
    with pytest.raises(ValueError):
        prepare(photos, vocab_scope="test")


def test_stream_encodes_like_a_table(spark, sf, tmp_path):
    rows = views.captions(spark, sf).select("photo_id", "ord", "caption")
    tokens = rows.withColumn("tokens", tokenize(F.col("caption")))
    vocab = V.build_vocabulary(tokens, "tokens", "ord")
    source = str(tmp_path / "in")
    rows.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = encode_captions(stream, vocab).writeStream.format("memory").queryName("coded").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    table = V.encode(tokens, "tokens", vocab, "photo_id")
    pairs = lambda df: {r.photo_id: r.token_ids for r in df.select("photo_id", "token_ids").collect()}
    assert pairs(spark.table("coded")) == pairs(table)
    with pytest.raises(ValueError):
        encode_captions(stream, vocab, max_len=99)


JVM_ONLY = """tokens all_tokens caption_halves complete_rows image_paths split_exact label_encoded prompts rendered_prompts
training_examples parse_label stripped encoded_captions metrics_observed metrics_fixed mean_pool infonce centroid_argmax
map_to_tokens epoch_loss early_stop top_words_by_label image_geometry image_augmentation""".split()

NO_SHUFFLE = "tokens all_tokens caption_halves complete_rows split_exact label_encoded prompts parse_label encoded_captions".split()


@pytest.mark.parametrize("name", JVM_ONLY)
def test_no_python_workers(spark, sf, name):
    plan = plan_of(QUERIES[name](spark, sf))
    assert "Python" not in plan and "InPandas" not in plan


@pytest.mark.parametrize("name", NO_SHUFFLE)
def test_no_shuffle_of_rows(spark, sf, name):
    plan = plan_of(QUERIES[name](spark, sf))
    assert "Exchange hashpartitioning" not in plan and "Exchange SinglePartition" not in plan


def test_scan_reads_only_what_is_needed(spark, sf):
    assert "ReadSchema: struct<doc_id:bigint>" in plan_of(QUERIES["split_exact"](spark, sf))
    assert "text:string" not in plan_of(QUERIES["split_counts_by_label"](spark, sf))


def test_top_words_limit_runs_before_the_shuffle(spark, sf):
    assert plan_of(QUERIES["top_words_by_label"](spark, sf)).count("WindowGroupLimit") >= 1


def test_hot_keys_are_spread(spark, sf):
    plan = plan_of(QUERIES["vector_lookup_shuffled"](spark, sf))
    assert re.search(r"Exchange hashpartitioning\(_key#\w+, _spread#\w+", plan)

from __future__ import annotations

import json
import pathlib

import numpy as np
import pictures
import pytest

from capframe.plans import examples, runs
from capframe.session import scratch_dir
from capframe.sources import images as S
from capframe.sources import photos as P

COLOURS = {"food": (200, 30, 30), "drink": (30, 30, 200), "menu": (220, 220, 220)}
N = 60


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("run")
    (root / "images").mkdir()
    rng = np.random.default_rng(5)
    records = []
    for i in range(N):
        label = list(COLOURS)[i % 3]
        pixels = pictures.plain(30, 40, COLOURS[label]) ^ rng.integers(0, 8, (30, 40, 3), np.uint8)
        body = pictures.png(pixels)
        (root / "images" / f"p{i:02d}.jpg").write_bytes(body if i % 20 else body[:60])
        records.append({"photo_id": f"p{i:02d}", "caption": "" if i % 4 == 0 else f"some {label} here", "label": label})
    (root / "photos.json").write_text(json.dumps(records))
    return root


def test_completion_then_classification(spark, data):
    def captioner():
        return lambda frame: ["a photo " + p[-7:-4] for p in frame["image_path"]]

    photos = P.read_photos(spark, str(data / "photos.json"))
    valid = S.valid_photos(spark, str(data / "images"))
    for fmt in ("parquet", "csv"):
        runs.completion(photos, valid, str(data / "images"), captioner, str(data / f"done_{fmt}"), fmt)
    done = P.read_completed(spark, str(data / "done_csv"))
    rows = {r.photo_id: r.caption for r in done.collect()}
    assert len(rows) == N - 3 and rows["p04"] == "a photo p04" and rows["p01"] == "some drink here"
    assert rows == {r.photo_id: r.caption for r in spark.read.parquet(str(data / "done_parquet")).collect()}

    def answerer():
        return lambda frame: ["Drink" if "drink" in r.split("Caption:")[-1] else "food" for r in frame["request"]]

    scores = runs.prompted(done, answerer, str(data / "prompted"), run_id="r1")
    got = {(r.config, r["class"]): r for r in scores.collect()}
    assert len(got) == 15 and got["text", "inside"].f1 == 0
    answers = spark.read.parquet(str(data / "prompted/answers"))
    assert answers.count() == 3 * 12
    assert spark.read.json(str(data / "prompted/metrics")).count() == 3
    assert not list(pathlib.Path(scratch_dir(spark)).glob("run-*"))


def test_supervised(spark, data):
    photos = P.read_photos(spark, str(data / "photos.json"))
    vectors = runs.colour_vectors(spark, str(data / "images"))
    scores = runs.supervised({"raw": photos}, vectors, str(data / "results"), grid=(0.01,), run_id="r1")
    rows = scores.collect()
    assert {r.config for r in rows} == {"text_raw", "image_raw", "both_raw"}
    assert all(r.f1 == 1.0 for r in rows if r.config == "image_raw")
    assert {r["class"] for r in rows if r.config == "image_raw"} <= set(COLOURS)
    assert spark.read.json(str(data / "results")).where("run_id = 'r1'").count() == 3
    assert not list(pathlib.Path(scratch_dir(spark)).glob("run-*"))


def test_training_rows(spark, data):
    photos = P.read_photos(spark, str(data / "photos.json"))
    rows = runs.caption_training_rows(photos, S.valid_photos(spark, str(data / "images")), str(data / "images"))
    made = examples.training_examples(S.keep_existing(rows, S.list_files(spark, str(data / "images")), strict=True))
    assert made.count() == N - N // 4

from __future__ import annotations

import math
import os

import numpy as np
import pictures
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from capframe.functions import pixels as P
from capframe.operators import images as I
from capframe.plans.prepare import prepare
from capframe.sources import images as S

GOOD = {"a", "b", "c", "d.v1"}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("photos")
    pictures.write_folder(path)
    return path


def ids(df):
    return {r.photo_id for r in df.select("photo_id").collect()}


def test_validity(spark, folder):
    assert ids(S.valid_photos(spark, str(folder))) == GOOD
    assert ids(S.valid_photos(spark, str(folder), decode=False)) == GOOD | {"cut"}
    photos = spark.createDataFrame([(i,) for i in [*GOOD, "cut", "text", "empty", "missing"]], "photo_id string")
    assert ids(S.keep_valid(photos, S.valid_photos(spark, str(folder)))) == GOOD
    broken = spark.createDataFrame([("a",), ("text",)], "photo_id string")
    assert ids(S.drop_broken(photos, broken)) == {"b", "c", "d.v1", "cut", "empty", "missing"}


def test_existing_files(spark, folder):
    files = S.list_files(spark, str(folder))
    assert "content" not in files.columns
    photos = spark.createDataFrame([("a",), ("cut",), ("missing",)], "photo_id string")
    assert ids(S.keep_existing(photos, files)) == {"a", "cut"}
    assert ids(S.keep_existing(photos.where("photo_id <> 'missing'"), files, strict=True)) == {"a", "cut"}
    with pytest.raises(PySparkException, match="image not found: missing"):
        S.keep_existing(photos, files, strict=True).collect()


def test_verdicts_are_kept_and_refreshed(spark, tmp_path):
    folder, table = tmp_path / "photos", str(tmp_path / "verdicts")
    pictures.write_folder(folder)
    for name in os.listdir(folder):
        os.utime(folder / name, (1_700_000_000, 1_700_000_000))
    first = S.refresh_verdicts(spark, str(folder), table)
    assert ids(first.where("valid")) == GOOD
    assert {"cut", "text"} <= ids(first.where("not valid"))
    before = spark.read.parquet(table).count()
    S.refresh_verdicts(spark, str(folder), table)
    assert spark.read.parquet(table).count() == before
    (folder / "text.jpg").write_bytes(pictures.png(pictures.plain(5, 5, (1, 2, 3))))
    (folder / "new.jpg").write_bytes(pictures.png(pictures.plain(5, 5, (1, 2, 3))))
    again = S.refresh_verdicts(spark, str(folder), table)
    assert ids(again.where("valid")) == GOOD | {"text", "new"}
    assert spark.read.parquet(table).count() == before + 2


def brute_resize(pixels, height, width):
    """Triangle filter, pixel by pixel, whole-number weights."""

    def line(values, size):
        scale = len(values) / size
        reach = max(scale, 1.0)
        out = []
        for i in range(size):
            centre = (i + 0.5) * scale
            low, high = max(int(centre - reach + 0.5), 0), min(int(centre + reach + 0.5), len(values))
            weights = [max(0.0, 1 - abs((j - centre + 0.5) / reach)) for j in range(low, high)]
            total = sum(weights)
            whole = [int(0.5 + w / total * (1 << 22)) for w in weights]
            value = (sum(w * int(v) for w, v in zip(whole, values[low:high])) + (1 << 21)) >> 22
            out.append(min(max(value, 0), 255))
        return out

    wide = np.array([[line(row[:, c], width) for c in range(3)] for row in pixels]).transpose(0, 2, 1)
    return np.array([[line(wide[:, x, c], height) for c in range(3)] for x in range(width)]).transpose(2, 0, 1)


@pytest.mark.parametrize("shape", [(9, 13), (13, 9), (20, 20), (5, 31)])
def test_resize_matches_brute_force(shape):
    pixels = np.random.default_rng(1).integers(0, 256, (*shape, 3), np.uint8)
    for height, width in [(8, 8), (7, 15), (26, 18), shape]:
        assert np.array_equal(P.resize(pixels, height, width), brute_resize(pixels, height, width))


def test_geometry(spark):
    sizes = [(h, w) for h in (3, 200, 256, 257, 300, 1023) for w in (4, 224, 255, 256, 301)]
    df = spark.createDataFrame(sizes, "height int, width int")
    for r in I.plan_eval(df).collect():
        h, w = r.height, r.width
        expected = (int(256 * h / w), 256) if h >= w else (256, int(256 * w / h))
        assert (r.resized_height, r.resized_width) == expected
        assert (r.crop_top, r.crop_left) == tuple(round((x - 224) / 2) for x in expected)


def test_eval_tensors(spark, folder):
    images = S.read_images(spark, str(folder))
    rows = {r.photo_id: r for r in I.with_tensor(I.plan_eval(images)).collect()}
    assert set(rows) == GOOD
    colours = {"a": (10, 20, 30), "b": (50, 50, 50), "c": (1, 2, 3)}
    for name, row in rows.items():
        tensor = np.array(row.tensor, np.float32).reshape(row.shape)
        assert tensor.shape == (3, 224, 224)
        if name in colours:
            assert np.allclose(tensor, np.array(colours[name]).reshape(3, 1, 1) / 255)
    pixels = np.random.default_rng(0).integers(0, 256, (280, 257, 3), np.uint8)
    small = brute_resize(pixels, math.floor(256 * 280 / 257), 256)
    top, left = round((small.shape[0] - 224) / 2), 16
    expected = small[top : top + 224, left : left + 224].transpose(2, 0, 1) / 255
    assert np.allclose(np.array(rows["d.v1"].tensor).reshape(3, 224, 224), expected, atol=1e-6)


def test_training_crops(spark, folder):
    images = S.read_images(spark, str(folder))
    planned = I.plan_train(images, epoch=1)
    other = {r.photo_id: (r.crop_top, r.crop_left, r.flip) for r in I.plan_train(images, epoch=2).collect()}
    offsets = {r.photo_id: r for r in planned.collect()}
    rows = {r.photo_id: r.tensor for r in I.with_tensor(planned).collect()}
    assert any((r.crop_top, r.crop_left, r.flip) != other[i] for i, r in offsets.items())
    pixels = np.random.default_rng(0).integers(0, 256, (280, 257, 3), np.uint8)
    r = offsets["d.v1"]
    framed = np.zeros((r.resized_height + 16, r.resized_width + 16, 3))
    framed[8:-8, 8:-8] = brute_resize(pixels, r.resized_height, r.resized_width)
    crop = framed[r.crop_top : r.crop_top + 224, r.crop_left : r.crop_left + 224]
    assert crop.shape == (224, 224, 3)
    crop = crop[:, ::-1] if r.flip else crop
    assert np.allclose(np.array(rows["d.v1"]).reshape(3, 224, 224), crop.transpose(2, 0, 1) / 255, atol=1e-6)


def test_augmentation_spreads(spark):
    df = spark.range(4000).selectExpr("cast(id as string) AS photo_id", "300 AS height", "256 AS width")
    rows = I.plan_train(df, epoch=1).agg(
        F.min("crop_top"), F.max("crop_top"), F.min("crop_left"), F.max("crop_left"), F.avg(F.col("flip").cast("int"))
    ).first()
    assert tuple(rows)[:4] == (0, 92, 0, 48) and abs(rows[4] - 0.5) < 0.05


def test_colour_features(spark, folder):
    images = S.read_images(spark, str(folder)).where("photo_id = 'a'")
    row = I.with_colour_features(I.plan_eval(images)).first().image_features
    assert len(row) == 27 and np.allclose(row[:3], np.array([10, 20, 30]) / 255)
    assert row[3] == row[11] == row[19] == 1.0


def test_prepare_with_images(spark, folder):
    rows = [("a", "good food", "food", 0), ("cut", "rare words rare words rare words", "lost", 1), ("b", "good food good food", "menu", 2)]
    photos = spark.createDataFrame(rows, "photo_id string, caption string, label string, ord long")
    done = prepare(photos, S.valid_photos(spark, str(folder)))
    assert {r.label for r in done.labels.collect()} == {"food", "menu"}
    assert {r.word for r in done.vocabulary.table.collect()} == {"good", "food"}
    got = {r.photo_id: r for r in done.table.collect()}
    assert got["a"].token_ids == [2, 3] + [0] * 8 and got["b"].label_id == 1

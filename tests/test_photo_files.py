"""Photo files: awkward names, damaged and missing files, verdicts taken in once, jobs that fail half-way."""

from __future__ import annotations

import os

import pictures
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from capframe.functions import pixels
from capframe.operators import images as I
from capframe.sources import batches as B
from capframe.sources import images as S
from capframe.sources import photo_files as P

NAMES = ["plain", "with space", "a[1]", "100%", "50%25", "p%20q", "éà", "日本", "plus+x", "hash#1", "q?x", "star*", "{b}", "back\\s", "semi;x"]


def folder_of(path, names=NAMES):
    path.mkdir()
    for n, name in enumerate(names):
        (path / f"{name}.png").write_bytes(pictures.png(pictures.plain(2, 3, (n, 2, 3))))
    (path / "cut [2].png").write_bytes(pictures.png(pictures.plain(9, 9, (1, 2, 3)))[:45])
    (path / "text %.png").write_bytes(b"no picture")
    (path / "empty é.png").write_bytes(b"")
    return str(path)


def ids(df):
    return sorted(r.photo_id for r in df.select("photo_id").collect())


def valid(df):
    return sorted(r.photo_id for r in df.where("valid").collect())


def test_names_are_read_as_they_are(spark, tmp_path):
    folder = folder_of(tmp_path / "photos here")
    photos = spark.createDataFrame([(n,) for n in [*NAMES, "cut [2]", "text %", "empty é", "missing"]], "photo_id string")
    assert ids(S.read_images(spark, folder)) == sorted(NAMES)
    assert ids(S.keep_valid(photos, S.valid_photos(spark, folder))) == sorted(NAMES)
    assert ids(S.keep_valid(photos, S.valid_photos(spark, folder, decode=False))) == sorted([*NAMES, "cut [2]"])
    assert ids(S.keep_existing(photos, S.list_files(spark, folder))) == sorted([*NAMES, "cut [2]", "text %"])
    there = P.list_photos(spark, folder)
    assert ids(S.keep_existing(photos, there)) == sorted([*NAMES, "cut [2]", "text %", "empty é"])
    with pytest.raises(PySparkException, match="image not found: missing"):
        S.keep_existing(photos, there, strict=True).collect()


@pytest.mark.parametrize("most", [4, 10_000])
def test_verdicts_of_awkward_names(spark, tmp_path, most, monkeypatch):
    """By name, in waves or not, and by folder: the same verdicts."""
    folder, table = folder_of(tmp_path / "photos here"), str(tmp_path / "verdicts")
    whole = S.list_files(spark, folder)
    fresh = whole.where("photo_id <> 'plain'")
    few = spark.createDataFrame([(i,) for i in range(100)], "i int")  # a listing much larger than what is fresh
    for listing in (whole, whole.crossJoin(few)):
        got = S.decoded(fresh, folder, listing, most=most)
        assert sorted(S_stem(r.path) for r in got.collect()) == sorted(set(NAMES) - {"plain"})
    assert valid(S.refresh_verdicts(spark, folder, table)) == sorted(NAMES)
    assert spark.read.parquet(table).count() == len(NAMES) + 2


def S_stem(path):
    return path.rsplit("/", 1)[1].removesuffix(".png")


def test_late_rewritten_and_repeated_listings(spark, tmp_path):
    folder, table = folder_of(tmp_path / "photos", ["a", "b c"]), str(tmp_path / "verdicts")
    S.refresh_verdicts(spark, folder, table, batch="monday")
    (tmp_path / "photos" / "late [1].png").write_bytes(pictures.png(pictures.plain(2, 2, (1, 1, 1))))
    os.utime(tmp_path / "photos" / "late [1].png", (1_000_000, 1_000_000))
    # A batch of that name is there: a writer that comes twice changes nothing.
    assert valid(S.refresh_verdicts(spark, folder, table, batch="monday")) == ["a", "b c"]
    assert valid(S.refresh_verdicts(spark, folder, table)) == ["a", "b c", "late [1]"]
    (tmp_path / "photos" / "a.png").write_bytes(b"damaged now")
    os.utime(tmp_path / "photos" / "a.png", (2_000_000, 2_000_000))  # older than the verdict on the good file
    assert valid(S.refresh_verdicts(spark, folder, table)) == ["b c", "late [1]"]
    rows = spark.read.parquet(table).count()
    assert valid(S.refresh_verdicts(spark, folder, table)) == ["b c", "late [1]"]
    assert spark.read.parquet(table).count() == rows


def test_batches_come_in_once(spark, tmp_path):
    table = str(tmp_path / "t")
    rows = spark.createDataFrame([(1,), (2,)], "x long")
    assert B.read_batches(spark, table, "x long").count() == 0
    assert B.append_once(rows, table, "one") and not B.append_once(rows, table, "one")
    rows.write.parquet(f"{table}/_writing-killed")  # what a writer leaves that died before its rename
    assert B.append_once(rows.where("x = 1"), table, "two")
    assert sorted(tuple(r) for r in B.read_batches(spark, table, "x long").collect()) == [(1, "one"), (1, "two"), (2, "one")]
    with pytest.raises(ValueError):
        B.append_once(rows, table, "a/b")


def test_race_for_one_name(spark, tmp_path, monkeypatch):
    """Two writers that both found no such batch: the second rename does not overwrite."""
    table = str(tmp_path / "t")
    monkeypatch.setattr(B, "path_exists", lambda spark, path: False)
    assert B.append_once(spark.createDataFrame([(1,)], "x long"), table, "one")
    assert not B.append_once(spark.createDataFrame([(2,)], "x long"), table, "one")
    monkeypatch.undo()
    assert [r.x for r in B.read_batches(spark, table, "x long").collect()] == [1]
    assert not [f for f in os.listdir(table) if f.startswith("_")]


def test_written_photos_come_back(spark, tmp_path):
    data = [bytearray([i, 2, 3] * 6) for i in range(len(NAMES))]
    rows = spark.createDataFrame([(n, d, 2, 3, 3) for n, d in zip(NAMES, data)], "photo_id string, data binary, height int, width int, n_channels int")
    grey = spark.createDataFrame([("grey", bytearray(range(6)), 2, 3, 1), ("alpha", bytearray(range(24)), 2, 3, 4)], rows.schema)
    files = I.with_png(rows.unionByName(grey)).withColumn("name", F.concat("photo_id", F.lit(".png")))
    folder = str(tmp_path / "out %")
    P.write_photos(files.repartition(3), folder)
    back = {r.photo_id: bytes(r.data) for r in S.read_images(spark, folder, recursiveFileLookup=True).collect()}
    assert back == {**dict(zip(NAMES, map(bytes, data))), "grey": bytes(range(6)), "alpha": bytes(range(24))}
    assert not [f for f in os.listdir(folder) if f.startswith("_")]
    P.write_photos(files.where("photo_id = 'plain'").withColumn("name", F.lit("more.png")), folder)  # adds
    assert S.read_images(spark, folder, recursiveFileLookup=True).count() == len(NAMES) + 3


def test_a_failed_job_leaves_no_photos(spark, tmp_path):
    folder = str(tmp_path / "out")
    rows = spark.createDataFrame([(f"f{i}.png", bytearray(b"x")) for i in range(20)] + [("a/b.png", bytearray(b"x"))], "name string, content binary")
    with pytest.raises(PySparkException, match="no file can be written"):
        P.write_photos(rows.repartition(4), folder)
    # A task that was still running may write after the job is given up, but only where no reader looks.
    assert all(f.startswith(P.WRITING) for f in (os.listdir(folder) if os.path.exists(folder) else []))


def test_unfinished_jobs_are_not_seen(spark, tmp_path):
    """A driver that died before the end of the job leaves folders that no reader enters."""
    folder = tmp_path / "out"
    aside = folder / f"{P.WRITING}dead" / "0-0"
    aside.mkdir(parents=True)
    (aside / "lost.png").write_bytes(pictures.png(pictures.plain(2, 2, (1, 1, 1))))
    rows = spark.createDataFrame([("kept.png", bytearray(pictures.png(pictures.plain(2, 2, (1, 1, 1)))))], "name string, content binary")
    P.write_photos(rows, str(folder))
    assert ids(S.read_images(spark, str(folder), recursiveFileLookup=True)) == ["kept"]
    assert ids(P.list_photos(spark, str(folder))) == ["kept"]


def test_png_of_every_kind():
    for channels in (1, 3, 4):
        pixel = pictures.plain(2, 3, tuple(range(channels)))
        assert pixels.png(pixel) == pictures.png(pixel)

from __future__ import annotations

import json
import pathlib

import pytest
from pyspark.sql import functions as F

from capframe import session
from capframe.session import drop_scratch, materialize, run_scratch, scratch_dir
from capframe.sources import photos as P
from capframe.sources import reports

CAPTIONS = [None, "", " ", "NA", "null", 'a "quoted" word', "a, b", "line\nbreak\r\nand more", "tail\\", 'say ""x""', "é日本"]


def test_json_array(spark, tmp_path):
    records = [{"photo_id": f"p{i}", "caption": c, "label": "food", "stars": i} for i, c in enumerate(CAPTIONS)]
    path = tmp_path / "photos.json"
    path.write_text(json.dumps(records, indent=1))
    rows = P.read_photos(spark, str(path), extra="stars int").collect()
    assert [(r.photo_id, r.caption, r.stars) for r in rows] == [(f"p{i}", c, i) for i, c in enumerate(CAPTIONS)]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(f"p{i}", c, "food", f"x/p{i}.jpg") for i, c in enumerate(CAPTIONS)],
                               "photo_id string, caption string, label string, image_path string")
    P.write_table(df, str(tmp_path / "t"), "csv")
    got = {r.photo_id: r.caption for r in P.read_completed(spark, str(tmp_path / "t")).collect()}
    assert got == {f"p{i}": c or "" for i, c in enumerate(CAPTIONS)}
    P.write_table(df, str(tmp_path / "p"))
    assert {r.caption for r in spark.read.parquet(str(tmp_path / "p")).collect()} == set(CAPTIONS)
    with pytest.raises(ValueError):
        P.write_table(df, str(tmp_path / "x"), "xml")


def test_source_order_over_files_and_blocks(spark, tmp_path):
    expected, n = [], 0
    for f in range(3):
        lines = []
        for _ in range(200 * (f + 1)):
            lines.append(json.dumps({"photo_id": f"p{n}", "caption": "c" * (n % 50)}))
            expected.append(f"p{n}")
            n += 1
        (tmp_path / f"part-{f}.json").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = P.with_source_order(P.read_photos(spark, str(tmp_path), lines=True)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [r.photo_id for r in sorted(rows, key=lambda r: r.ord)] == expected
    assert sorted(r.ord for r in rows) == list(range(n))


def test_source_order_of_one_array(spark, tmp_path):
    path = tmp_path / "photos.json"
    path.write_text(json.dumps([{"photo_id": f"p{i}"} for i in range(500)]))
    rows = P.with_source_order(P.read_photos(spark, str(path))).collect()
    assert [r.photo_id for r in sorted(rows, key=lambda r: r.ord)] == [f"p{i}" for i in range(500)]


def test_timestamp(spark):
    assert spark.range(1).select(reports.timestamp_suffix().alias("t")).where(F.col("t").rlike(r"^\d{8}_\d{6}$")).count() == 1


def test_scratch(spark):
    assert scratch_dir(spark).startswith(spark.conf.get("spark.checkpoint.dir"))
    table = materialize(spark.range(10).withColumn("x", F.rand()), "t")
    assert sorted(table.collect()) == sorted(table.collect())
    assert "Range" not in table._jdf.queryExecution().toString()


def test_scratch_of_a_run(spark):
    def tables():
        return {p.name for p in pathlib.Path(scratch_dir(spark)).rglob("*") if p.name.startswith("scratched")}

    outer = materialize(spark.range(3), "scratched-outer")
    before = tables()
    with run_scratch(spark):
        inner = materialize(spark.range(4), "scratched-inner")
        with run_scratch(spark):
            materialize(inner, "scratched-nested")
            result = materialize(inner, "scratched-result", kept=True)
        assert inner.count() == 4 and len(tables() - before) == 2
    assert result.count() == 4 and outer.count() == 3 and len(tables() - before) == 1
    with pytest.raises(RuntimeError), run_scratch(spark):
        materialize(spark.range(5), "scratched-failed")
        raise RuntimeError("the run fails")
    assert len(tables() - before) == 1


def test_scratch_of_an_application(spark, tmp_path, monkeypatch):
    folder = tmp_path / "application"
    monkeypatch.setattr(session, "scratch_dir", lambda _: str(folder))
    table = materialize(spark.range(7), "t")
    assert table.count() == 7 and any(folder.iterdir())
    assert drop_scratch(spark) and not folder.exists()
    assert not drop_scratch(spark)

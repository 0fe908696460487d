from __future__ import annotations

import json
import random

import oracles
import pytest
from pyspark.errors import PySparkException

from capframe.fixed_values import CLASSES
from capframe.operators import compare as C
from capframe.operators import labels as L
from capframe.operators import metrics as M
from capframe.sources import reports


def pairs_frame(spark, pairs):
    return spark.createDataFrame([(i, t, p) for i, (t, p) in enumerate(pairs)], "photo_id int, label string, pred string")


def random_pairs(seed=5, n=400):
    rng = random.Random(seed)
    return [(rng.choice(CLASSES[:4]), rng.choice(CLASSES + ["junk text", None])) for _ in range(n)]


def same(got, expected):
    assert set(got) == set(expected)
    for c, values in expected.items():
        assert got[c] == pytest.approx(values)


def as_dict(df):
    return {r["class"]: (r.precision, r.recall, r.f1, r.support) for r in df.collect()}


def test_fixed_classes(spark):
    pairs = random_pairs()
    df = pairs_frame(spark, pairs)
    got = M.class_metrics(df, "label", "pred", CLASSES)
    same(as_dict(got), oracles.scores(pairs, CLASSES))
    assert M.macro_f1(got).first().macro_f1 == pytest.approx(sum(v[2] for v in oracles.scores(pairs, CLASSES).values()) / 5)


def test_observed_classes(spark):
    pairs = random_pairs(6)
    classes = sorted({c for p in pairs for c in p if c})
    got = M.class_metrics(pairs_frame(spark, pairs), "label", "pred")
    same(as_dict(got), oracles.scores(pairs, classes))


def test_absent_class_and_labels_outside_the_list(spark):
    pairs = [("food", "food"), ("other", "food"), (None, "menu"), ("menu", "junk")]
    got = as_dict(M.class_metrics(pairs_frame(spark, pairs), "label", "pred", CLASSES))
    assert got["food"] == (0.5, 1.0, pytest.approx(2 / 3), 1)
    assert got["drink"] == (0.0, 0.0, 0.0, 0)
    assert got["menu"] == (0.0, 0.0, 0.0, 1)
    empty = pairs_frame(spark, pairs).where("false")
    assert as_dict(M.class_metrics(empty, "label", "pred", CLASSES)) == {c: (0.0, 0.0, 0.0, 0) for c in CLASSES}


def test_fixed_classes_in_groups_without_labels(spark):
    """Groups come from the counted rows: one scan, and a group none of whose rows has a label keeps its classes."""
    rows = [("a", "food", "food"), ("a", "food", "free text"), ("a", "other", "menu"), ("a", None, "menu"), ("b", None, "food"), (None, "menu", None)]
    df = spark.createDataFrame(rows, "config string, label string, pred string")
    got = {(r.config, r["class"]): (r.tp, r.predicted, r.support) for r in M.class_counts(df, "label", "pred", ["food", "menu"], ["config"]).collect()}
    assert got == {
        ("a", "food"): (1, 1, 2), ("a", "menu"): (0, 1, 0),
        ("b", "food"): (0, 0, 0), ("b", "menu"): (0, 0, 0),
        (None, "food"): (0, 0, 0), (None, "menu"): (0, 0, 1),
    }
    plan = M.class_counts(df, "label", "pred", ["food", "menu"], ["config"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") <= 1
    empty = M.class_counts(df.where("false"), "label", "pred", ["food"]).collect()
    assert [tuple(r) for r in empty] == [("food", 0, 0, 0)]


def test_micro_precision(spark):
    pairs = random_pairs(7)
    share = sum(t == p for t, p in pairs) / len(pairs)
    assert M.micro_precision(pairs_frame(spark, pairs), "label", "pred").first()[0] == pytest.approx(share)


def test_pairing_guard(spark):
    df = pairs_frame(spark, random_pairs(8, 20))
    truth, predictions = df.select("photo_id", "label"), df.select("photo_id", "pred")
    assert M.pair_predictions(truth, predictions, "photo_id", "label", "pred").count() == 20
    short = predictions.where("photo_id <> 3")
    with pytest.raises(PySparkException, match="differ"):
        M.pair_predictions(truth, short, "photo_id", "label", "pred").collect()
    assert tuple(M.unpaired_counts(truth, short, "photo_id").first()) == (19, 1, 0)


def test_label_ids(spark):
    df = spark.createDataFrame([("b",), (None,), ("é",), ("a",), ("b",), ("Z",)], "label string")
    table = L.label_ids(df)
    assert {r.label: r.label_id for r in table.collect()} == {"Z": 0, "a": 1, "b": 2, "é": 3}
    coded = L.with_label_id(df, table)
    assert {(r.label, r.label_id) for r in coded.collect()} == {("b", 2), (None, None), ("é", 3), ("a", 1), ("Z", 0)}
    named = L.with_label_name(coded.drop("label"), table, "label_id", "name")
    assert {r.name for r in named.collect()} == {"b", None, "é", "a", "Z"}
    unknown = spark.createDataFrame([(1,), (9,)], "label_id int")
    with pytest.raises(PySparkException, match="no label"):
        L.with_label_name(unknown, table, "label_id", "name").collect()
    assert L.label_ids(df.where("false")).count() == 0


def test_many_labels_are_numbered_in_parallel(spark, monkeypatch):
    monkeypatch.setattr(L, "MOST_LABELS", 3)
    df = spark.createDataFrame([(f"l{i:03d}",) for i in range(50)] * 2, "label string")
    table = L.label_ids(df)
    assert {r.label: r.label_id for r in table.collect()} == {f"l{i:03d}": i for i in range(50)}
    assert {r.label_id for r in L.with_label_id(df, table).collect()} == set(range(50))


def test_compare_and_report(spark, tmp_path):
    a, b = random_pairs(9), random_pairs(10)
    df = pairs_frame(spark, a).selectExpr("*", "'text' AS config").unionByName(
        pairs_frame(spark, b).selectExpr("*", "'both' AS config")
    )
    scores = M.class_metrics(df, "label", "pred", CLASSES, by=["config"])
    wide = {r["class"]: r for r in C.compare_configs(scores, ["text", "both"], "text").collect()}
    for c in CLASSES:
        text, both = oracles.scores(a, CLASSES)[c][2], oracles.scores(b, CLASSES)[c][2]
        assert (wide[c].text, wide[c].both, wide[c].both_delta) == pytest.approx((text, both, both - text))
    body = {r.config: json.loads(r.json) for r in reports.metrics_json(scores, ["config"], pretty=True).collect()}
    assert set(body["text"]["per_class"]) == set(CLASSES)
    assert body["both"]["per_class"]["food"]["support"] == oracles.scores(b, CLASSES)["food"][3]
    reports.write_metrics(scores, str(tmp_path / "out"), ["config"])
    back = spark.read.json(str(tmp_path / "out"))
    assert back.count() == 2 and {"run_id", "per_class", "macro_f1", "config"} == set(back.columns)
    # Two runs of the same second are two runs.
    reports.write_metrics(scores, str(tmp_path / "out"), ["config"])
    assert spark.read.json(str(tmp_path / "out")).groupBy("run_id").count().where("count = 2").count() == 2
    lines = {r["class"]: r.line for r in reports.report_lines(M.class_metrics(pairs_frame(spark, [("food", "food")]), "label", "pred")).collect()}
    assert lines == {"food": "food: precision 1.0000, recall 1.0000, f1 1.0000, support 1"}
    answers = C.predictions_wide(df, "photo_id", ["text", "both"]).collect()
    assert all((r.pred_text, r.pred_both) == (a[r.photo_id][1], b[r.photo_id][1]) for r in answers)

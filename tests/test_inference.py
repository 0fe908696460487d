from __future__ import annotations

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from capframe.fixed_values import CAPTION_PROMPT, IMAGE_PROMPT, TEXT_PROMPT
from capframe.functions import prompts as P
from capframe.functions import sequences as S
from capframe.plans import examples, inference

ROWS = [(f"p{i}", None if i % 7 == 3 else "" if i % 5 == 0 else f"caption {i} {{caption}} $1", "food", f"x/p{i}.jpg") for i in range(60)]


@pytest.fixture(scope="module")
def photos(spark):
    return spark.createDataFrame(ROWS, "photo_id string, caption string, label string, image_path string").repartition(3)


def test_prompt_by_modality(spark):
    df = spark.createDataFrame([("a.jpg", "x"), (None, "x {caption}"), ("a.jpg", None)], "p string, c string")
    both, text, image = (r[0] for r in df.select(P.classification_prompt(F.col("p"), F.col("c"))).collect())
    assert image == IMAGE_PROMPT
    assert text == TEXT_PROMPT.replace("{caption}", "x {caption}")
    assert "its caption" in both and "\nCaption:\nx\n" in both
    nothing = spark.createDataFrame([(None, None)], "p string, c string")
    with pytest.raises(PySparkException, match="neither"):
        nothing.select(P.classification_prompt(F.col("p"), F.col("c"))).collect()
    with pytest.raises(ValueError):
        P.check_modalities(False, False)


def test_messages_and_rendering(spark):
    df = spark.createDataFrame([("a.jpg", "x"), (None, "y")], "p string, c string")
    rows = df.select(P.inference_messages(F.col("c"), F.col("p")).alias("m")).collect()
    first, second = rows[0].m[0], rows[1].m[0]
    assert [tuple(p) for p in first.content] == [("image", "a.jpg", None), ("text", None, "x")]
    assert [tuple(p) for p in second.content] == [("text", None, "y")]
    tags = P.ChatTags("<", ">", "[img]", "bot")
    lines = df.select(
        P.render(P.inference_messages(F.col("c"), F.col("p")), tags, generation=True).alias("on"),
        P.render(P.training_messages(F.col("p"), F.col("c"), "go"), tags).alias("off"),
    ).collect()
    assert [r.on for r in lines] == ["<user\n[img]x><bot\n", "<user\ny><bot\n"]
    assert lines[0].off == "<user\n[img]go><assistant\nx>"


def test_training_examples(photos):
    rows = {r.photo_id: r for r in examples.training_examples(photos).collect()}
    assert set(rows) == {r[0] for r in ROWS if r[1] is not None}
    m = rows["p1"].messages
    assert [x.role for x in m] == ["user", "assistant"]
    assert m[0].content[0].image == "x/p1.jpg" and m[0].content[1].text == CAPTION_PROMPT
    assert m[1].content[0].text == rows["p1"].caption


def test_padded_batches(spark):
    lists = [[5] * (i % 4) + [9] for i in range(10)]
    df = spark.createDataFrame(list(enumerate(lists)), "i int, ids array<int>")
    rows = {r.i: r for r in examples.padded_batches(df, "ids", "i", size=4, image_id=9).collect()}
    for i, ids in enumerate(lists):
        batch = lists[i // 4 * 4 : i // 4 * 4 + 4]
        padded = ids + [0] * (max(map(len, batch)) - len(ids))
        assert rows[i].input_ids == padded
        assert rows[i].labels == [-100 if x in (0, 9) else x for x in padded]


def test_batches_are_padded_without_a_shuffle_of_their_rows(spark):
    """The longest of each batch are few: they are joined by broadcast to rows too many for it."""
    df = spark.range(2000).select("id", F.transform(F.sequence(F.lit(0), F.col("id") % 30), lambda x: F.hash(x, "id")).alias("ids"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "5000")
    try:
        rows = examples.padded_batches(df, "ids", "id", size=100, pad_id=None, image_id=0)
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
        assert rows.columns == ["batch_id", "id", "ids", "batch_pos", "input_ids", "labels"]
        same = F.col("labels") == S.mask_labels(F.col("input_ids"), None, 0)
        assert rows.where(same & (F.size("input_ids") == 30)).count() == 2000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_completion(spark, photos, tmp_path):
    made = str(tmp_path / "made")

    def factory():
        with open(made, "a") as f:
            f.write("x")
        sizes = []

        def model(frame):
            sizes.append(len(frame))
            assert list(frame.columns) == ["image_path", "prompt"] and max(sizes) <= 128
            return ["from " + p for p in frame["image_path"]]

        return model

    done = inference.complete_captions(photos, factory)
    rows = done.collect()
    expected = {r[0]: f"from {r[3]}" if r[1] == "" else r[1] for r in ROWS}
    assert {r.photo_id: r.caption for r in rows} == expected and len(rows) == len(ROWS)
    assert [r.photo_id for r in rows] != sorted(expected)
    assert done.columns == photos.columns


def test_factory_runs_once_per_task(spark, tmp_path):
    made = str(tmp_path / "made")

    def factory():
        with open(made, "a") as f:
            f.write("x")
        return lambda frame: [int(v) + 1 for v in frame["v"]]

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        df = spark.range(0, 100, 1, 2).withColumn("y", inference.infer(factory, {"v": F.col("id")}, "long", 4))
        assert all(r.y == r.id + 1 for r in df.where("y > 0").collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(open(made).read()) == 2


def test_wrong_number_of_outputs(spark):
    df = spark.range(0, 5, 1, 1).withColumn("y", inference.infer(lambda: lambda frame: ["x"], {"v": F.col("id")}))
    with pytest.raises(PySparkException, match="1 outputs for 5"):
        df.collect()


def test_classification(photos):
    def factory():
        return lambda frame: [
            f" {'drink' if p is None else 'Food.' if 'Caption:' in r else 'no idea '} " for p, r in zip(frame["image_path"], frame["request"])
        ]

    rows = inference.classify(photos, factory).collect()
    assert len(rows) == 3 * len(ROWS)
    assert {r.config: r.pred for r in rows} == {"text": "drink", "image_text": "food", "image": "no idea"}
    only = inference.classify(photos, factory, ["image"])
    assert only.count() == len(ROWS)


def test_user_encoder_gives_vectors(spark):
    def factory():
        import numpy as np

        return lambda frame: [np.array([len(p), 1.0], dtype="float32") for p in frame["image_path"]]

    df = spark.createDataFrame([("a.jpg",), ("long.jpg",)], "image_path string")
    rows = df.select("image_path", inference.infer(factory, {"image_path": F.col("image_path")}, "array<float>").alias("v")).collect()
    assert {r.image_path: r.v for r in rows} == {"a.jpg": [5.0, 1.0], "long.jpg": [8.0, 1.0]}

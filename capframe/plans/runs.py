"""End-to-end runs: supervised baselines, caption completion, prompted classification."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capframe.fixed_values import CLASSES, SEED
from capframe.functions.prompts import ChatTags, Templates
from capframe.functions.text import image_path
from capframe.operators.captions import drop_incomplete
from capframe.operators.embeddings import pair_modalities
from capframe.operators.images import plan_eval, with_colour_features
from capframe.operators.labels import with_label_name
from capframe.operators.metrics import class_metrics
from capframe.operators.ranking import with_split
from capframe.plans.baselines import GRID, MODALITIES, run_matrix, with_image_vector
from capframe.plans.inference import CONFIGS, Factory, classify, complete_captions
from capframe.plans.prepare import prepare
from capframe.session import materialize, run_scratch
from capframe.sources.images import keep_valid, read_images
from capframe.sources.photos import with_source_order, write_table
from capframe.sources.reports import write_metrics


def with_paths(photos: DataFrame, folder: str, suffix: str = ".jpg") -> DataFrame:
    return photos.withColumn("image_path", image_path(F.col("photo_id"), folder.rstrip("/") + "/", suffix))


def colour_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """``photo_id, image_vector`` of the readable images; stored, as every configuration reads it."""
    features = with_colour_features(plan_eval(read_images(spark, folder)))
    return materialize(with_image_vector(features, "image_features").select("photo_id", "image_vector"), "colours")


def supervised(
    variants: dict[str, DataFrame],
    image_vectors: DataFrame,
    out: str,
    modalities: Sequence[str] = tuple(MODALITIES),
    grid: Sequence[float] = GRID,
    run_id: str | None = None,
    store: str | None = None,
) -> DataFrame:
    """Scores per class of every variant and modality, also written as JSON to ``out``.

    With ``store``, a folder, fitted pipelines are kept there and a run that died goes on with them.

    ``variants`` are photo tables (raw, completed) read from files; ``image_vectors`` has
    ``photo_id, image_vector``. A photo without a vector counts as broken.
    """
    named = None
    with run_scratch(image_vectors.sparkSession):
        for name, photos in variants.items():
            ready = prepare(with_source_order(photos), image_vectors)
            table = pair_modalities(ready.table, image_vectors, "photo_id")
            scores = run_matrix({name: table}, modalities, grid, store=store).withColumn("label_id", F.col("class").cast("int"))
            # Ids are given per variant, so each variant's scores take their names from its own labels.
            own = with_label_name(scores.drop("class"), ready.labels, "label_id", "class").drop("label_id")
            named = own if named is None else named.unionByName(own)
        named = materialize(named, "scores", kept=True)
    write_metrics(named, out, ["config"], run_id)
    return named


def completion(
    photos: DataFrame, valid: DataFrame, folder: str, factory: Factory, out: str, fmt: str = "parquet", tags: ChatTags = ChatTags()
) -> None:
    """Photos with readable images and complete captions, in seeded random order, written to ``out``."""
    with run_scratch(photos.sparkSession):
        kept = materialize(keep_valid(with_paths(photos, folder), valid), "valid")
        write_table(complete_captions(kept, factory, tags), out, fmt)


def prompted(
    completed: DataFrame,
    factory: Factory,
    out: str,
    configs: Sequence[str] = tuple(CONFIGS),
    labels: Sequence[str] = CLASSES,
    templates: Templates = Templates(),
    tags: ChatTags = ChatTags(),
    seed: int = SEED,
    run_id: str | None = None,
) -> DataFrame:
    """Answers for the test split, written to ``out/answers``, and their scores, to ``out/metrics``.

    Returns the scores: one row per configuration and class.
    """
    spark = completed.sparkSession
    with run_scratch(spark):
        test = with_split(completed, ["photo_id"], seed).where(F.col("split") == "test")
        answers = classify(test, factory, configs, labels, templates, tags)
        write_table(answers, f"{out}/answers")
    answers = spark.read.schema(answers.schema).parquet(f"{out}/answers")
    scores = class_metrics(answers, "label", "pred", labels, by=["config"])
    write_metrics(scores, f"{out}/metrics", ["config"], run_id)
    return scores


def caption_training_rows(photos: DataFrame, valid: DataFrame, folder: str) -> DataFrame:
    """Rows a caption model is tuned on: readable image, caption given and not empty."""
    kept = keep_valid(with_paths(photos, folder), valid)
    return drop_incomplete(kept.where(~F.col("caption").eqNullSafe(F.lit(""))))

"""The fused two-layer network, trained epoch by epoch with early stopping on the validation split."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capframe.fixed_values import PATIENCE, SEED
from capframe.operators.metrics import class_metrics, macro_f1
from capframe.operators.trainlog import early_stopping
from capframe.session import delete_path, materialize, move_once, path_exists
from capframe.sources.batches import append_once, read_batches
from capframe.sources.models import without_summary

EPOCHS = 500
STEPS = 5  # optimiser steps of an epoch
HIDDEN = 64
LOG = "run string, epoch int, loss double, score double"


@dataclass(frozen=True)
class Trained:
    """The network of the best epoch (of the last one if none was above 0), that epoch, and all epochs."""

    model: MultilayerPerceptronClassificationModel
    best: int | None
    history: DataFrame


def fuse(pairs: DataFrame, parts: Sequence[str] = ("image_vector", "text_vector")) -> DataFrame:
    """``features``: the arrays of both modalities, one after the other."""
    return pairs.withColumn("features", array_to_vector(F.concat(*parts)))


def _epoch_model(train: DataFrame, path: str, layers: list[int], before, steps: int, seed: int):
    """The network after one more epoch, and its loss; a network that is there already is read."""
    spark = train.sparkSession
    if path_exists(spark, path):
        return MultilayerPerceptronClassificationModel.load(path), None
    start = MultilayerPerceptronClassifier(labelCol="label_id", layers=layers, seed=seed, maxIter=steps, tol=1e-9)
    model = (start if before is None else start.setInitialWeights(before.weights)).fit(train)
    loss = float(model.summary().objectiveHistory[-1])
    aside = f"{path}.writing"
    model.write().overwrite().save(aside)
    if not move_once(spark, aside, path):
        delete_path(spark, aside)
    return without_summary(model), loss


def train_network(
    train: DataFrame,
    valid: DataFrame,
    layers: Sequence[int],
    folder: str,
    epochs: int = EPOCHS,
    patience: int = PATIENCE,
    steps: int = STEPS,
    seed: int = SEED,
    run: str = "network",
) -> Trained:
    """Train on (label_id, features) until ``patience`` epochs in a row bring no better macro-F1 on ``valid``.

    Each epoch starts from the weights of the one before. Its network is kept in ``folder`` and then
    its line in the log, so a driver that is lost goes on after the last line when it is called with
    the same folder, and a finished run is not trained again.
    """
    spark = train.sparkSession
    models, log = f"{folder}/{run}-epoch-%05d", f"{folder}/{run}-log"
    lines = read_batches(spark, log, LOG).drop("batch").orderBy("epoch").collect()  # at most ``epochs`` lines
    lines = [tuple(line) for line in lines]
    last = lambda: MultilayerPerceptronClassificationModel.load(models % len(lines)) if lines else None
    model = last()
    train, valid = train.select("label_id", "features").persist(), valid.select("label_id", "features").persist()
    try:
        while True:
            history = spark.createDataFrame(lines, LOG)
            seen = early_stopping(history, patience=patience).first()
            if len(lines) >= epochs or (seen and seen.stop_epoch is not None):
                break
            epoch = len(lines) + 1
            model, loss = _epoch_model(train, models % epoch, list(layers), model, steps, seed)
            scores = class_metrics(model.transform(valid), "label_id", "prediction")
            line = (run, epoch, loss, macro_f1(scores).first().macro_f1 or 0.0)
            append_once(spark.createDataFrame([line], LOG).coalesce(1), log, f"epoch-{epoch:05d}")
            lines.append(line)
    finally:
        train.unpersist()
        valid.unpersist()
    best = seen.best_epoch if seen else None
    chosen = MultilayerPerceptronClassificationModel.load(models % (best or len(lines)))
    return Trained(chosen, best, history)


def run_network(
    table: DataFrame, folder: str, classes: int, hidden: int = HIDDEN, **options
) -> tuple[DataFrame, Trained]:
    """Test rows (photo_id, label_id, pred_id) judged by the chosen network, and the training.

    ``table`` has ``photo_id, label_id, split`` and the arrays ``image_vector`` and ``text_vector``.
    """
    known = table.where(F.col("label_id").isNotNull())
    ready = materialize(fuse(known).select("photo_id", "label_id", "split", "features"), "fused")
    row = ready.select("features").first()
    inputs = len(row.features) if row else 1
    train, valid = ready.where("split = 'train'"), ready.where("split = 'valid'")
    trained = train_network(train, valid, [inputs, hidden, classes], folder, **options)
    judged = trained.model.transform(ready.where("split = 'test'"))
    return judged.select("photo_id", "label_id", F.col("prediction").cast("int").alias("pred_id")), trained

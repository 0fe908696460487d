"""spark.ml classifiers on text, image or both, chosen on the validation split."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from contextvars import copy_context
from dataclasses import dataclass
from functools import partial
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import IDF, HashingTF, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.util import HasTrainingSummary
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capframe.functions.prompts import check_modalities
from capframe.operators.compare import compare_configs
from capframe.operators.metrics import class_metrics, macro_f1, micro_precision
from capframe.operators.trainlog import best_epoch
from capframe.session import materialize
from capframe.sources.models import fit_once, without_summary

GRID = (0.1, 0.01, 0.001)  # regularisation tried by default
TEXT_DIM = 1 << 12  # hashed words: a fixed size whatever the vocabulary
AT_ONCE = 3  # candidates, and configurations, that are fitted at the same time
TASK_ROWS = 60_000  # training rows for which a step of a fit is given a task


def feature_stages(image: bool, text: bool, text_dim: int = TEXT_DIM) -> list:
    """From ``tokens`` and ``image_vector`` to ``features``: hashed weighted words, image values, or both."""
    check_modalities(image, text)
    stages, parts = [], []
    if text:
        stages += [HashingTF(numFeatures=text_dim, inputCol="tokens", outputCol="_tf")]
        stages += [IDF(inputCol="_tf", outputCol="_tfidf")]
        parts.append("_tfidf")
    if image:
        parts.append("image_vector")
    return stages + [VectorAssembler(inputCols=parts, outputCol="features")]


def classifier(reg: float = 0.01, max_iter: int = 50) -> LogisticRegression:
    return LogisticRegression(labelCol="label_id", regParam=reg, maxIter=max_iter, family="multinomial")


def perceptron(inputs: int, classes: int, hidden: int = 64, seed: int = 42) -> MultilayerPerceptronClassifier:
    """Two-layer network on fused features; for few inputs, as its hidden layer is dense."""
    return MultilayerPerceptronClassifier(labelCol="label_id", layers=[inputs, hidden, classes], seed=seed, maxIter=50)


def with_image_vector(df: DataFrame, column: str) -> DataFrame:
    """Array features as the vector the pipelines read."""
    return df.withColumn("image_vector", array_to_vector(F.col(column)))


@dataclass(frozen=True)
class Fitted:
    """The chosen model, its place in the grid (null: never above 0), and the score of every candidate."""

    model: PipelineModel
    best: int | None
    history: DataFrame


def _at_once(spark: SparkSession, calls: Sequence[Callable]) -> list:
    """Results of the calls in their order, each run by a thread of the driver, ``AT_ONCE`` at a time.

    A step of a fit is a job of few short tasks: one fit alone leaves most cores idle.
    """
    if len(calls) < 2:
        return [call() for call in calls]
    ours = [inheritable_thread_target(spark)(partial(copy_context().run, call)) for call in calls]
    with ThreadPool(min(len(calls), AT_ONCE)) as pool:
        return pool.map(lambda call: call(), ours, chunksize=1)


def fit_best(
    train: DataFrame,
    valid: DataFrame,
    image: bool,
    text: bool,
    grid: Sequence[float] = GRID,
    make: Callable[[float], Estimator] = classifier,
) -> Fitted:
    """One model ``make(value)`` per grid value; the one with the highest validation macro-F1, the first on ties."""
    spark = train.sparkSession
    features = Pipeline(stages=feature_stages(image, text)).fit(train)
    # A fit takes hundreds of steps, each a job: tasks of a few rows cost more than they do.
    tasks = max(1, -(-train.count() // TASK_ROWS))
    ready = features.transform(train).select("label_id", "features").coalesce(tasks).persist()
    checked = features.transform(valid).select("label_id", "features").persist()
    made = [make(value) for value in grid]
    ready.count()  # the rows are kept before the candidates read them at once
    models, predicted = [], None
    for i, model in enumerate(_at_once(spark, [partial(m.fit, ready) for m in made]), start=1):
        models.append(without_summary(model) if isinstance(model, HasTrainingSummary) else model)
        own = models[-1].transform(checked).select("label_id", "prediction", F.lit(i).alias("candidate"))
        predicted = own if predicted is None else predicted.unionByName(own)
    # All candidates are scored in one job.
    macro = macro_f1(class_metrics(predicted, "label_id", "prediction", by=["candidate"]), ["candidate"])
    micro = micro_precision(predicted, "label_id", "prediction", ["candidate"])
    found = {r.candidate: r for r in macro.join(micro, "candidate", "left").collect()}
    scores = []
    for i, value in enumerate(grid, start=1):
        r = found.get(i)
        scores.append(("grid", i, float(value), (r and r.macro_f1) or 0.0, (r and r.micro_precision) or 0.0))
    ready.unpersist()
    checked.unpersist()
    history = spark.createDataFrame(scores, "run string, epoch int, value double, score double, micro_precision double")
    top = best_epoch(history).first()
    best = top.best_epoch if top else None
    return Fitted(PipelineModel([*features.stages, models[(best or 1) - 1]]), best, history)


def predict(model: PipelineModel, df: DataFrame, keep: Sequence[str] = ("photo_id", "label_id")) -> DataFrame:
    """``pred_id`` per row."""
    return model.transform(df).select(*keep, F.col("prediction").cast("int").alias("pred_id"))


def _features(table: DataFrame, image: bool, text: bool) -> DataFrame:
    """The labelled rows. Fitting reads them many times: written once, in the columns it needs."""
    inputs = ["tokens"] * text + ["image_vector"] * image
    known = table.where(F.col("label_id").isNotNull()).select("photo_id", "label_id", "split", *inputs)
    return materialize(known, "features")


def _fit_and_predict(
    known: DataFrame,
    image: bool,
    text: bool,
    grid: Sequence[float],
    make: Callable[[float], Estimator],
    store: str | None,
) -> DataFrame:
    train, valid = known.where(F.col("split") == "train"), known.where(F.col("split") == "valid")

    def fit() -> PipelineModel:
        return fit_best(train, valid, image, text, grid, make).model

    model = fit_once(known.sparkSession, store, fit) if store else fit()
    return predict(model, known.where(F.col("split") == "test"))


def run_config(
    table: DataFrame,
    image: bool,
    text: bool,
    grid: Sequence[float] = GRID,
    make: Callable[[float], Estimator] = classifier,
    store: str | None = None,
) -> DataFrame:
    """Test predictions of the model chosen for one modality; ``table`` has ``split`` and ``label_id``.

    With ``store``, a path, the fitted pipeline is kept there, and one found there is not fitted again.
    """
    return _fit_and_predict(_features(table, image, text), image, text, grid, make, store)


MODALITIES = {"text": (False, True), "image": (True, False), "both": (True, True)}


def run_matrix(
    tables: dict[str, DataFrame],
    modalities: Sequence[str] = tuple(MODALITIES),
    grid: Sequence[float] = GRID,
    make: Callable[[float], Estimator] = classifier,
    store: str | None = None,
) -> DataFrame:
    """``config, class, precision, recall, f1, support`` of every data variant and modality.

    ``tables`` maps a variant (raw, completed) to its prepared table, whose features are written once
    for all modalities. With ``store``, a folder, each configuration's pipeline is kept under its name,
    and a run that starts again fits only the rest; configurations then come one after the other, so
    that each is kept as soon as it can be. Without, ``AT_ONCE`` of them are fitted at a time.
    """
    spark = next(iter(tables.values())).sparkSession
    image, text = (any(use) for use in zip(*(MODALITIES[m] for m in modalities)))
    configs, calls = [], []
    for variant, table in tables.items():
        known = _features(table, image, text)
        for modality in modalities:
            config = f"{modality}_{variant}"
            configs.append(config)
            path = f"{store}/{config}" if store else None
            calls.append(partial(_fit_and_predict, known, *MODALITIES[modality], grid, make, path))
    scored = None
    for config, predicted in zip(configs, [call() for call in calls] if store else _at_once(spark, calls)):
        predicted = predicted.withColumn("config", F.lit(config))
        scored = predicted if scored is None else scored.unionByName(predicted)
    return class_metrics(scored, "label_id", "pred_id", by=["config"])


def compare_matrix(metrics: DataFrame, baseline: str, configs: Sequence[str]) -> DataFrame:
    return compare_configs(metrics, configs, baseline)

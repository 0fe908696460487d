"""Fitted pipelines on disk."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.ml import Model, PipelineModel
from pyspark.sql import SparkSession

from capframe.session import delete_path, move_once, path_exists


def save_best(model: PipelineModel, path: str) -> None:
    """Keep a model as the best so far, in place of the one before."""
    model.write().overwrite().save(path)


def load_best(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def fit_once(spark: SparkSession, path: str, fit: Callable[[], PipelineModel]) -> PipelineModel:
    """The pipeline kept under ``path``, fitted only if there is none.

    It is saved aside and comes into place by one rename, so a run that dies leaves either a whole
    pipeline or none; of two runs at once the first one's is kept and read by both.
    """
    if not path_exists(spark, path):
        aside = f"{path}.writing-{uuid.uuid4().hex}"
        fit().write().save(aside)
        if not move_once(spark, aside, path):
            delete_path(spark, aside)
    return PipelineModel.load(path)


def without_summary(model: Model) -> Model:
    """A fitted model without the summary of its training, which holds on to the session and the training rows.

    Tasks are sent the model; a session that has observed a write cannot be sent along with it.
    """
    nothing = model._java_obj.getClass().getClassLoader().loadClass("scala.None$").getField("MODULE$").get(None)
    model._java_obj.setSummary(nothing)
    return model

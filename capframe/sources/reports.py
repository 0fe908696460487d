"""Metric reports: nested JSON per run."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capframe.fixed_values import TIMESTAMP_FORMAT


def timestamp_suffix() -> Column:
    """Time of the query as ``yyyyMMdd_HHmmss``."""
    return F.date_format(F.current_timestamp(), TIMESTAMP_FORMAT)


def nest_metrics(metrics: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``per_class`` (map of class to scores) and ``macro_f1`` per run; one entry per class."""
    scores = F.struct("precision", "recall", "f1", "support")
    entry = F.struct(F.col("class").cast("string").alias("key"), scores.alias("value"))
    return metrics.groupBy(*by).agg(
        F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("per_class"),
        F.avg("f1").alias("macro_f1"),
    )


def metrics_json(metrics: DataFrame, by: Sequence[str] = (), pretty: bool = False) -> DataFrame:
    """Nested metrics as one JSON string per run."""
    options = {"pretty": "true"} if pretty else {}
    body = F.to_json(F.struct("per_class", "macro_f1"), options)
    return nest_metrics(metrics, by).select(*by, body.alias("json"))


def report_lines(metrics: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One printable line per class."""
    line = F.format_string(
        "%s: precision %.4f, recall %.4f, f1 %.4f, support %d",
        F.col("class").cast("string"), "precision", "recall", "f1", "support",
    )
    return metrics.select(*by, "class", line.alias("line"))


def write_metrics(metrics: DataFrame, path: str, by: Sequence[str], run_id: str | None = None) -> None:
    """Nested metrics as JSON, in a folder per run; the configuration ``by`` stays a column.

    Without ``run_id`` a run has the time as its name, and a random end: runs of one second stay apart.
    """
    run = F.lit(run_id) if run_id else F.concat_ws("_", timestamp_suffix(), F.lit(uuid.uuid4().hex[:8]))
    nest_metrics(metrics, by).withColumn("run_id", run).write.mode("append").partitionBy("run_id").json(path)

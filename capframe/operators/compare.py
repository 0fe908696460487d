"""Comparison of configurations by their scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def compare_configs(scores: DataFrame, configs: Sequence[str], baseline: str, value: str = "f1") -> DataFrame:
    """One row per class, one column per configuration and its difference to the baseline."""
    wide = scores.groupBy("class").pivot("config", list(configs)).agg(F.first(value))
    deltas = [
        (F.col(f"`{c}`") - F.col(f"`{baseline}`")).alias(f"{c}_delta") for c in configs if c != baseline
    ]
    return wide.select("class", *[F.col(f"`{c}`") for c in configs], *deltas)


def predictions_wide(
    predictions: DataFrame, key: str, configs: Sequence[str], pred: str = "pred", prefix: str = "pred_"
) -> DataFrame:
    """One row per ``key`` with a prediction column named by each configuration.

    Partitioned by key first: a row per key and configuration leaves nothing to combine before
    the shuffle, and so the rows are sorted once.
    """
    chosen = [F.first(F.when(F.col("config") == c, F.col(pred)), ignorenulls=True).alias(prefix + c) for c in configs]
    return predictions.repartition(key).groupBy(key).agg(*chosen)

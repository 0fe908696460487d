"""Training logs: loss averages, early stopping, best epoch."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from capframe.fixed_values import CONTRASTIVE_WEIGHT, PATIENCE


def total_loss(pred_loss: Column, contrastive_loss: Column, weight: float = CONTRASTIVE_WEIGHT) -> Column:
    return pred_loss + F.lit(weight) * contrastive_loss


def epoch_losses(
    batches: DataFrame,
    by: Sequence[str] = ("run", "epoch"),
    pred_loss: str = "pred_loss",
    contrastive_loss: str = "contrastive_loss",
    weight: float = CONTRASTIVE_WEIGHT,
) -> DataFrame:
    """Means of the batch means: prediction, contrastive and weighted total loss."""
    p, c = F.col(pred_loss), F.col(contrastive_loss)
    return batches.groupBy(*by).agg(
        F.avg(p).alias("pred_loss"),
        F.avg(c).alias("contrastive_loss"),
        F.avg(total_loss(p, c, weight)).alias("total_loss"),
        F.count("*").alias("batches"),
    )


_CHUNK = 100_000  # epochs of one run that one task goes through


def _earlier(rows: DataFrame, run: str, values: dict[str, tuple[Column, Callable]]) -> DataFrame:
    """Rows with values gathered over the chunks of their run before their own.

    ``values`` gives an aggregate over a chunk and the function that combines chunks.
    """
    chunks = rows.groupBy(run, "_chunk").agg(*[inside.alias(name) for name, (inside, _) in values.items()])
    before = W.partitionBy(run).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    carried = [combine(name).over(before).alias(name) for name, (_, combine) in values.items()]
    return rows.join(chunks.select(run, "_chunk", *carried), [run, "_chunk"])


def early_stopping(
    log: DataFrame, run: str = "run", epoch: str = "epoch", score: str = "score", patience: int = PATIENCE
) -> DataFrame:
    """``run, epochs, best_epoch, best_score, stop_epoch`` of a log with one row per run and epoch.

    An epoch improves when its score is strictly above every earlier one and above 0. The run
    stops at the ``patience``-th epoch in a row without improvement (null: never); the best
    epoch is the last improvement until then (null: none).

    Runs of more than ``_CHUNK`` epochs are cut at epoch numbers, and what earlier chunks found is
    carried into each, so a run with most of the log is not one task's work.
    """
    longest = log.groupBy(run).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    cut = longest > _CHUNK
    rows = log.select(run, epoch, score).withColumn(
        "_chunk", F.col(epoch) - F.pmod(F.col(epoch), F.lit(_CHUNK)) if cut else F.lit(0)
    )
    if cut:
        rows = _earlier(rows, run, {"_rows": (F.count("*"), F.sum), "_top": (F.max(score), F.max)})
    else:
        rows = rows.withColumn("_rows", F.lit(0)).withColumn("_top", F.lit(0.0))
    ordered = W.partitionBy(run, "_chunk").orderBy(epoch)
    before = ordered.rowsBetween(W.unboundedPreceding, -1)
    until = ordered.rowsBetween(W.unboundedPreceding, 0)
    best_before = F.greatest(F.max(score).over(before), F.col("_top"), F.lit(0.0))
    rows = rows.withColumn("_i", F.coalesce("_rows", F.lit(0)).cast("long") + F.row_number().over(ordered))
    rows = rows.withColumn("_better", F.col(score) > best_before)
    # Improvements only grow in place, epoch and score, so the last one is the largest of each.
    last = {f"_last{c}": F.max(F.when(F.col("_better"), F.col(c))) for c in ("_i", epoch, score)}
    for name, largest in last.items():
        rows = rows.withColumn(name + "_here", largest.over(until))
    if cut:
        rows = _earlier(rows, run, {name: (largest, F.max) for name, largest in last.items()})
        known = {name: F.coalesce(name + "_here", name) for name in last}
    else:
        known = {name: F.col(name + "_here") for name in last}
    last_i, last_epoch, last_score = known.values()
    stop = F.when(F.col("_i") - F.coalesce(last_i, F.lit(0)) >= patience, F.col("_i"))
    rows = rows.select(run, epoch, stop.alias("_stop"), last_epoch.alias("_epoch"), last_score.alias("_score"))

    def at_stop(value: str) -> Column:
        return F.when(F.min("_stop").isNull(), F.max(value)).otherwise(F.min_by(value, "_stop"))

    return rows.groupBy(run).agg(
        F.coalesce(F.min("_stop"), F.count("*")).alias("epochs"),
        at_stop("_epoch").alias("best_epoch"),
        at_stop("_score").alias("best_score"),
        F.min(F.when(F.col("_stop").isNotNull(), F.col(epoch))).alias("stop_epoch"),
    )


def best_epoch(log: DataFrame, run: str = "run", epoch: str = "epoch", score: str = "score") -> DataFrame:
    """Epoch of the highest score per run, the earliest on ties; a run never above 0 gives none."""
    ranked = log.where(F.col(score) > 0)
    top = F.max(F.struct(F.col(score).alias("s"), (-F.col(epoch)).alias("e")))
    return ranked.groupBy(run).agg(top.alias("_top")).select(
        run, (-F.col("_top.e")).alias("best_epoch"), F.col("_top.s").alias("best_score")
    )

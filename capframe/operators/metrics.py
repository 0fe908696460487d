"""Classification scores from counted (label, prediction) pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OBSERVED = "observed"


def pair_predictions(truth: DataFrame, predictions: DataFrame, key: str, label: str, pred: str) -> DataFrame:
    """``key, label, pred`` joined by key; a key on one side only fails the job."""
    left = truth.select(key, F.col(label).alias("label"), F.lit(True).alias("_t"))
    right = predictions.select(key, F.col(pred).alias("pred"), F.lit(True).alias("_p"))
    both = F.col("_t").isNotNull() & F.col("_p").isNotNull()
    error = F.raise_error(F.concat(F.lit(f"label and prediction differ at {key} "), F.col(key).cast("string")))
    # The guard filters, so it holds whichever columns are read later.
    joined = left.join(right, key, "full").where(F.when(both, F.lit(True)).otherwise(error.cast("boolean")))
    return joined.select(key, "label", "pred")


def unpaired_counts(truth: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """``paired, only_truth, only_pred``: how the keys of both sides match up."""
    left = truth.select(key, F.lit(1).alias("_t"))
    right = predictions.select(key, F.lit(1).alias("_p"))
    t, p = F.col("_t").isNotNull(), F.col("_p").isNotNull()
    return left.join(right, key, "full").agg(
        F.count_if(t & p).alias("paired"),
        F.count_if(t & ~p).alias("only_truth"),
        F.count_if(~t & p).alias("only_pred"),
    )


def confusion(df: DataFrame, label: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """``label, pred, n`` per group ``by``."""
    return df.groupBy(*by, F.col(label).alias("label"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def _entry(name: Column, tp: Column, predicted: Column, support: Column) -> Column:
    return F.struct(
        name.alias("class"), tp.alias("tp"), predicted.alias("predicted"), support.alias("support")
    )


def class_counts(
    df: DataFrame, label: str, pred: str, classes: Sequence | str = OBSERVED, by: Sequence[str] = ()
) -> DataFrame:
    """``class, tp, predicted, support`` per group.

    ``observed`` classes are those in labels or predictions. A list fixes the classes: others
    count as misses, and a listed class without rows stays with zeros. Rows without a label
    are not scored.
    """
    scored = F.col(label).isNotNull()
    zero = F.lit(0).cast("long")
    listed = []
    if classes == OBSERVED:
        rows = df.where(scored)
    else:
        # Free text outside the list becomes null first, so the counted table stays classes x classes.
        # A row without a label has neither class there, but still shows that its group exists.
        known = {c: F.col(c).isin(*classes) for c in (label, pred)}
        rows = df.withColumns({c: F.when(scored & known[c], F.col(c)) for c in (label, pred)})
        listed = [_entry(F.lit(c), zero, zero, zero) for c in classes]
    pairs = confusion(rows, label, pred, by)
    n = F.col("n")
    hit = F.when(F.col("label") == F.col("pred"), n).otherwise(zero)
    sides = [_entry(F.col("label"), hit, zero, n), _entry(F.col("pred"), zero, n, zero)]
    entries = pairs.select(*by, F.explode(F.array(*sides, *listed)).alias("e"))
    if listed and not by:
        # Listed classes stay even when there are no rows at all.
        entries = entries.unionByName(df.sparkSession.range(1).select(F.explode(F.array(*listed)).alias("e")))
    return (
        entries.select(*by, "e.*")
        .where(F.col("class").isNotNull())
        .groupBy(*by, "class")
        .agg(*[F.sum(c).alias(c) for c in ("tp", "predicted", "support")])
    )


def class_metrics(
    df: DataFrame, label: str, pred: str, classes: Sequence | str = OBSERVED, by: Sequence[str] = ()
) -> DataFrame:
    """``class, precision, recall, f1, support`` per group; a ratio without a denominator is 0."""
    counts = class_counts(df, label, pred, classes, by)

    def ratio(top: Column, bottom: Column) -> Column:
        return F.when(bottom == 0, F.lit(0.0)).otherwise(top.cast("double") / bottom)

    tp, predicted, support = F.col("tp"), F.col("predicted"), F.col("support")
    return counts.select(
        *by,
        "class",
        ratio(tp, predicted).alias("precision"),
        ratio(tp, support).alias("recall"),
        ratio(2 * tp, predicted + support).alias("f1"),
        "support",
    )


def macro_f1(metrics: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Unweighted mean of the F1 of all classes."""
    return metrics.groupBy(*by).agg(F.avg("f1").alias("macro_f1"))


def micro_precision(df: DataFrame, label: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Share of labelled rows predicted right."""
    right = F.coalesce(F.col(label) == F.col(pred), F.lit(False)).cast("double")
    return df.where(F.col(label).isNotNull()).groupBy(*by).agg(F.avg(right).alias("micro_precision"))

"""Embedding tables: pairing, pooling, lookup, negatives and the contrastive loss."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capframe.fixed_values import BATCH_SIZE, TEMPERATURE
from capframe.functions import vectors as V
from capframe.operators.lookup import lookup

_FLAT = 256
VECTOR_BYTES = 50 << 20  # broadcast bound for vectors


def pair_modalities(images: DataFrame, texts: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Image and text features of the same photo; ``left`` keeps photos without text."""
    return images.join(texts, key, how)


def mean_by_group(df: DataFrame, group: str, vector: str, dim: int) -> DataFrame:
    """Element-wise mean vector and row count per group; partial sums are combined before the shuffle.

    Up to ``_FLAT`` values the sums are columns of one aggregate, beyond that one row per value.
    """
    if dim > _FLAT:
        # Every place of every row, as in the flat form: null and short vectors count alike in both.
        places = F.explode(F.sequence(F.lit(0), F.lit(dim - 1))).alias("pos")
        values = df.select(group, vector, places).select(group, "pos", F.get(vector, F.col("pos")).alias("v"))
        means = values.groupBy(group, "pos").agg(F.count("*").alias("n"), F.avg(F.col("v").cast("double")).alias("m"))
        ordered = F.sort_array(F.collect_list(F.struct("pos", "m")))
        return means.groupBy(group).agg(F.max("n").alias("n"), F.transform(ordered, lambda p: p["m"]).alias("mean"))
    means = [F.avg(F.get(vector, F.lit(i)).cast("double")).alias(f"_m{i}") for i in range(dim)]
    pooled = df.groupBy(group).agg(F.count("*").alias("n"), *means)
    return pooled.select(group, "n", F.array(*[f"_m{i}" for i in range(dim)]).alias("mean"))


def vector_rows(table: DataFrame, vector: str = "vector", most_bytes: int = VECTOR_BYTES) -> int:
    """Rows of ``table`` that may be broadcast: fewer, the wider its widest vector."""
    width = table.agg(F.max(F.size(vector))).first()[0]
    return most_bytes // (8 * max(width or 1, 1))


def lookup_vectors(
    df: DataFrame,
    key: str,
    ids: str,
    table: DataFrame,
    positions: DataFrame | None = None,
    broadcast_rows: int | None = None,
    missing: Sequence[float] | None = None,
) -> DataFrame:
    """``key, pos, id, vector``: one row per place of ``ids`` with its row of ``table`` (``id, vector``).

    An id without a vector takes ``missing``; without that, it fails the job. ``positions``
    (``pos, position``) holds one vector per place, added on top; a place beyond them fails too.
    Tables of up to ``broadcast_rows`` rows are broadcast, by default as many as ``VECTOR_BYTES`` hold.
    """
    places = df.select(key, F.posexplode(ids).alias("pos", "id"))
    most = vector_rows(table) if broadcast_rows is None else broadcast_rows
    found = lookup(places, table.select("id", "vector"), "id", [key, "pos"], most)
    if missing is not None:
        found = found.withColumn("vector", F.coalesce("vector", F.array(*[F.lit(float(x)) for x in missing])))
    found = _all_there(found, "vector", "id")
    if positions is None:
        return found.select(key, "pos", "id", "vector")
    added = positions.select("pos", "position")
    most = vector_rows(added, "position") if broadcast_rows is None else broadcast_rows
    found = _all_there(lookup(found, added, "pos", [key, "pos"], most), "position", "pos")
    return found.select(key, "pos", "id", V.add(F.col("vector"), F.col("position")).alias("vector"))


def _all_there(df: DataFrame, vector: str, by: str) -> DataFrame:
    """``df``, failing the job at a row without ``vector``; a filter, so it holds whatever is read later."""
    error = F.raise_error(F.concat(F.lit(f"no {vector} for {by} "), F.coalesce(F.col(by).cast("string"), F.lit("null"))))
    return df.where(F.when(F.col(vector).isNotNull(), F.lit(True)).otherwise(error.cast("boolean")))


def negative_position(position: Column, size: Column, draw: Column) -> Column:
    """Another place in a batch of ``size``, uniform for a uniform ``draw`` >= 0; null in a batch of one."""
    step = F.when(size > 1, F.pmod(draw, F.nullif(size - 1, F.lit(0))))
    return ((position + 1 + step) % size).cast("int")


def batch_rows(rows: int, size: int = BATCH_SIZE, batch: str = "batch_id") -> Column:
    """Rows in a batch of ``with_batches`` over ``rows`` rows: ``size``, or less in the last one."""
    return F.least(F.lit(size), F.lit(rows) - F.col(batch) * size).cast("int")


def negative_pairs(
    df: DataFrame, vector: str, other: str, negative: Column, batch: str = "batch_id", pos: str = "batch_pos"
) -> DataFrame:
    """Rows with ``neg_pos`` and ``neg_vector``, the ``other`` vector at that place of the batch.

    Joined on (batch, place), which is unique, so no batch is gathered whatever its size.
    Rows without a negative (a batch of one) give none.
    """
    right = df.select(F.col(batch), F.col(pos).alias("neg_pos"), F.col(other).alias("neg_vector"))
    return df.withColumn("neg_pos", negative).join(right, [batch, "neg_pos"])


def info_nce(
    pairs: DataFrame,
    vector: str,
    positive: str,
    by: Sequence[str] = ("batch_id",),
    negative: str = "neg_vector",
    temperature: float = TEMPERATURE,
) -> DataFrame:
    """Mean contrastive loss with one positive and one negative per row, per group ``by``."""
    pos = V.cosine(F.col(vector), F.col(positive))
    neg = V.cosine(F.col(vector), F.col(negative))
    loss = F.log1p(F.exp((neg - pos) / F.lit(temperature)))
    return pairs.groupBy(*by).agg(F.avg(loss).alias("loss"), F.count("*").alias("n"))


def contrastive_total(losses: dict[str, DataFrame], weights: dict[str, float], by: Sequence[str] = ("batch_id",)) -> DataFrame:
    """Weighted sum of the losses of several modalities per group ``by``."""
    parts = None
    for name, frame in losses.items():
        part = frame.select(*by, (F.col("loss") * F.lit(float(weights[name]))).alias("loss"))
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy(*by).agg(F.sum("loss").alias("contrastive_loss"))

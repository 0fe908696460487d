"""Left join to a lookup table, safe for hot keys and for tables too large to broadcast."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capframe.session import materialize

BROADCAST_ROWS = 1_000_000  # narrow rows: a word or label with its id
HOT_KEYS = 10_000


def share(total: int, parts: int) -> Column:
    """Rows that make one in ``parts`` of ``total``; at most ``parts`` groups can have as many."""
    return F.lit(total / parts if parts else float("inf"))


def hot_keys(df: DataFrame, key: str, most: int = HOT_KEYS) -> DataFrame:
    """Keys that hold at least one in ``most`` of the rows; there cannot be more than ``most``."""
    counts = materialize(df.groupBy(key).agg(F.count("*").alias("_n")), "counts")
    total = counts.agg(F.sum("_n")).first()[0] or 0
    return counts.where(F.col(key).isNotNull() & (F.col("_n") >= share(total, most))).select(key)


def lookup(
    df: DataFrame,
    table: DataFrame,
    key: str,
    spread: Sequence[str],
    broadcast_rows: int = BROADCAST_ROWS,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Left join of ``df`` to ``table`` (unique on ``key``).

    A table of at most ``broadcast_rows`` rows, counted here, is broadcast. Beyond that the hot
    keys (at most ``HOT_KEYS``, by their share of the rows) are answered from a broadcast, and
    the rest meet the table in a shuffle join on the key and its hash. Rows already answered have
    no key there and the hash of ``spread`` instead, so no partition receives a hot key.
    """
    if table.count() <= broadcast_rows:
        return df.join(F.broadcast(table), key, "left")
    values = [c for c in table.columns if c != key]
    hot = hot_keys(df, key) if hot is None else hot
    matched = table.join(F.broadcast(hot), key, "left_semi")
    head = hot.join(F.broadcast(matched), key, "left").select(
        F.col(key).alias("_hot"), *[F.col(c).alias(f"_hot_{c}") for c in values]
    )
    tail = table.select(F.col(key).alias("_key"), F.xxhash64(key).alias("_spread"), *values)
    answered = F.col("_hot").isNotNull() | F.col(key).isNull()
    sides = (
        df.join(F.broadcast(head), F.col(key) == F.col("_hot"), "left")
        .withColumn("_key", F.when(~answered, F.col(key)))
        .withColumn("_spread", F.when(answered, F.xxhash64(*spread)).otherwise(F.xxhash64(key)))
    )
    joined = sides.join(tail.hint("merge"), ["_key", "_spread"], "left")
    return joined.select(*df.columns, *[F.coalesce(f"_hot_{c}", c).alias(c) for c in values])

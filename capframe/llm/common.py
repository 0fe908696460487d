"""Helpers the training-data operators share."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from capframe.session import materialize, ship_package

__all__ = ["fresh", "label_rows", "materialize", "read", "remainder", "ship_package", "small_batches", "summed_products"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; Python workers get this package first."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20  # texts a Python worker holds at a time


def small_batches(spark: SparkSession) -> None:
    """Have this session's Python workers take whole texts in small batches, so several fit beside the JVM.

    No row is left out; a caller's own, smaller settings stay.
    """
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key).removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a longer one if ``df`` has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def label_rows(labels: DataFrame, name: str, held_out: tuple[int, int]) -> DataFrame:
    """doc_id and ``y`` of the rows to learn from: not held out, 0 or 1, one row per id.

    ``held_out`` is (modulus, remainder). Repeated ids take their largest label; null ids and
    labels other than 0 and 1 are left out.
    """
    modulus, kept_back = held_out
    usable = labels.where(
        F.col("doc_id").isNotNull() & F.col(name).isin(0, 1) & (remainder(F.col("doc_id"), modulus) != kept_back)
    )
    return usable.groupBy("doc_id").agg(F.max(name).cast("int").alias("y"))


def summed_products(df: DataFrame, matrices, width: int) -> np.ndarray:
    """Sum over all rows of x x^T: tasks sum their own rows, Spark adds up the entries.

    ``matrices`` turns an Arrow batch's pandas frame into an (n, width) array. What reaches the
    driver is one matrix, whatever the number of rows.
    """
    upper = np.triu_indices(width)

    def partial(frames: Iterable):
        import pandas as pd

        total = np.zeros((width, width))
        for frame in frames:
            x = matrices(frame)
            total += x.T @ x
        yield pd.DataFrame({"i": upper[0].astype("int32"), "j": upper[1].astype("int32"), "v": total[upper]})

    sums = df.mapInPandas(partial, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    out = np.zeros((width, width))
    for i, j, v in sums.collect():
        out[i, j] = out[j, i] = v
    return out

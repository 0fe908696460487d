"""Tables that grow by named batches, each applied once."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from capframe.session import delete_path, move_once, path_exists


def append_once(df: DataFrame, table: str, batch: str) -> bool:
    """Add ``df`` to a Parquet table as ``batch``; False, and nothing added, if it has one of that name.

    Rows are written aside, where no reader looks, and come into the table by one rename that never
    overwrites. A writer that dies leaves the table as it was; one that comes second changes nothing.
    """
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.-]*", batch):
        raise ValueError(f"batch name {batch!r} has other characters than letters, digits, _, . and -")
    spark, target = df.sparkSession, f"{table}/batch={batch}"
    if path_exists(spark, target):
        return False
    aside = f"{table}/_writing-{uuid.uuid4().hex}"
    df.write.parquet(aside)
    if move_once(spark, aside, target):
        return True
    delete_path(spark, aside)
    return False


def read_batches(spark: SparkSession, table: str, schema: str) -> DataFrame:
    """All rows of the table, none if there is no table yet, with the name of their ``batch``."""
    schema = f"{schema}, batch string"
    return spark.read.schema(schema).parquet(table) if path_exists(spark, table) else spark.createDataFrame([], schema)

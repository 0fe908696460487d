"""Label ids: assignment, lookup and the way back to names."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capframe.operators.lookup import lookup
from capframe.operators.ranking import global_row_number

MOST_LABELS = 10_000


def label_ids(df: DataFrame, label: str = "label") -> DataFrame:
    """``label, label_id`` of the distinct non-null labels, numbered from 0 in sorted order.

    Up to ``MOST_LABELS`` labels are sorted on the driver; more are numbered in parallel.
    """
    distinct = df.where(F.col(label).isNotNull()).select(F.col(label).alias("label")).distinct()
    head = distinct.limit(MOST_LABELS + 1).collect()
    if len(head) > MOST_LABELS:
        numbered = global_row_number(distinct, "label")
        return numbered.select("label", (F.col("rn") - 1).cast("int").alias("label_id"))
    names = sorted((r.label for r in head), key=_sort_key)
    kind = distinct.schema["label"].dataType.simpleString()
    table = pa.table({"label": names, "label_id": pa.array(range(len(names)), pa.int32())})
    return df.sparkSession.createDataFrame(table, f"label {kind}, label_id int")


def _sort_key(name):
    return name.encode() if isinstance(name, str) else name


def _spread(df: DataFrame) -> list[str]:
    """Columns that tell rows apart; maps cannot be hashed."""
    return [name for name, kind in df.dtypes if "map<" not in kind]


def with_label_id(df: DataFrame, labels: DataFrame, label: str = "label") -> DataFrame:
    """Rows with ``label_id``, null where the label is null or not listed."""
    table = labels.select(F.col("label").alias(label), "label_id")
    return lookup(df, table, label, spread=_spread(df), broadcast_rows=MOST_LABELS)


def with_label_name(df: DataFrame, labels: DataFrame, id_col: str, out: str) -> DataFrame:
    """Rows with the name of a label id; an id not listed fails the job."""
    table = labels.select(F.col("label_id").alias(id_col), F.col("label").alias(out))
    named = lookup(df, table, id_col, spread=_spread(df), broadcast_rows=MOST_LABELS)
    missing = F.raise_error(F.concat(F.lit(f"no label for {id_col} "), F.col(id_col).cast("string")))
    checked = F.when(F.col(out).isNull() & F.col(id_col).isNotNull(), missing.cast("string")).otherwise(F.col(out))
    return named.withColumn(out, checked)

"""Photo metadata in JSON, CSV and Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from capframe.operators.lookup import BROADCAST_ROWS
from capframe.operators.ranking import running_total
from capframe.session import materialize

PHOTO_FIELDS = [
    T.StructField("photo_id", T.StringType()),
    T.StructField("caption", T.StringType()),
    T.StructField("label", T.StringType()),
]

CSV_OPTIONS = {
    "header": True,
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def photo_schema(extra: str | None = None) -> T.StructType:
    """Schema of the photo records; ``extra`` is a DDL list of further keys to keep."""
    more = T._parse_datatype_string(extra).fields if extra else []
    return T.StructType(PHOTO_FIELDS + list(more))


def read_photos(spark: SparkSession, path: str, extra: str | None = None, lines: bool = False) -> DataFrame:
    """Records from JSON: arrays of records, or one record per line with ``lines``.

    An array cannot be cut, so each such file is read by one task. Large data belongs in lines
    or in many files, which are read in parallel.
    """
    return spark.read.schema(photo_schema(extra)).json(path, multiLine=not lines)


def read_completed(spark: SparkSession, path: str, extra: str | None = None) -> DataFrame:
    """Completed captions from CSV; CSV cannot tell an empty caption from none, so both are empty here."""
    schema = T.StructType(photo_schema(extra).fields + [T.StructField("image_path", T.StringType())])
    table = spark.read.schema(schema).csv(path, multiLine=True, enforceSchema=False, **CSV_OPTIONS)
    return table.withColumn("caption", F.coalesce("caption", F.lit("")))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Result table as Parquet, or as CSV and JSON lines for exchange."""
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer.csv(path, **CSV_OPTIONS)
    elif fmt in ("json", "parquet"):
        getattr(writer, fmt)(path)
    else:
        raise ValueError(f"unknown format {fmt}")


def with_source_order(df: DataFrame, out: str = "ord") -> DataFrame:
    """Rows of a file source with their position from 0: files by path, then places within a file.

    The rows are written once with the file, the block and the place within the task that read
    them. Each block's offset is the number of rows before it, so nothing is sorted or shuffled
    but one row per block, in ranges.
    """
    block = F.struct("_metadata.file_path", "_metadata.file_block_start").alias("_block")
    table = materialize(df.select(df["*"], block, F.monotonically_increasing_id().alias("_seq")), "ingest")
    blocks = table.groupBy("_block").agg(F.count("*").alias("_n"), F.min("_seq").alias("_first"))
    blocks = running_total(blocks, "_n", "_block.file_path", "_block.file_block_start", out="_before")
    offsets = materialize(blocks.select("_block", "_first", "_before"), "blocks")
    if offsets.count() <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    return (
        table.join(offsets, "_block")
        .withColumn(out, F.col("_before") + F.col("_seq") - F.col("_first"))
        .drop("_block", "_seq", "_before", "_first")
    )

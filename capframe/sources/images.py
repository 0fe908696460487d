"""Image files: listing, decoding, validity and the table of known verdicts."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from capframe.session import materialize, scratch_dir
from capframe.sources.batches import append_once, read_batches

# The first bytes of JPEG, PNG, GIF and BMP files.
MAGIC = ["FFD8FF", "89504E470D0A1A0A", "474946383761", "474946383961", "424D"]


def file_stem(path: Column) -> Column:
    """File name without folder and suffix: the photo id."""
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def read_images(spark: SparkSession, folder: str, **options) -> DataFrame:
    """``photo_id, height, width, n_channels, data`` of the files that decode, others dropped.

    Decoded in the JVM. ``data`` holds rows of pixels, channels in the order blue, green, red.
    """
    rows = spark.read.format("image").options(dropInvalid=True, **options).load(folder)
    return rows.select(
        file_stem(_path(F.col("image.origin"))).alias("photo_id"),
        F.col("image.height").alias("height"),
        F.col("image.width").alias("width"),
        F.col("image.nChannels").alias("n_channels"),
        F.col("image.data").alias("data"),
    )


def list_files(spark: SparkSession, folder: str, **options) -> DataFrame:
    """``photo_id, path, modified, length`` of the files in a folder; contents are not read."""
    rows = spark.read.format("binaryFile").options(**options).load(folder)
    return rows.select(
        file_stem(F.col("path")).alias("photo_id"),
        "path",
        F.col("modificationTime").alias("modified"),
        "length",
    )


def valid_photos(spark: SparkSession, folder: str, decode: bool = True, **options) -> DataFrame:
    """``photo_id`` of the readable images: fully decoded, or known by their first bytes only."""
    if decode:
        return read_images(spark, folder, **options).select("photo_id")
    rows = spark.read.format("binaryFile").options(**options).load(folder)
    start = F.hex(F.substring("content", 1, 8))
    known = F.lit(False)
    for magic in MAGIC:
        known = known | start.startswith(magic)
    return rows.where(known).select(file_stem(F.col("path")).alias("photo_id"))


def keep_valid(df: DataFrame, valid: DataFrame, key: str = "photo_id") -> DataFrame:
    """Rows with a readable image; missing and empty files count as broken."""
    return df.join(valid.select(key), key, "left_semi")


def drop_broken(df: DataFrame, broken: DataFrame, key: str = "photo_id") -> DataFrame:
    """Rows not in a list of broken images."""
    return df.join(broken.select(key), key, "left_anti")


def keep_existing(df: DataFrame, files: DataFrame, key: str = "photo_id", strict: bool = False) -> DataFrame:
    """Rows whose file exists; ``strict`` fails the job at the first row without one."""
    if not strict:
        return df.join(files.select(key), key, "left_semi")
    there = files.select(key).distinct().withColumn("_there", F.lit(True))
    error = F.raise_error(F.concat(F.lit("image not found: "), F.col(key).cast("string"))).cast("boolean")
    return df.join(there, key, "left").where(F.coalesce("_there", error)).drop("_there")


VERDICTS = "photo_id string, path string, modified timestamp, length long, valid boolean, seen long"


def refresh_verdicts(spark: SparkSession, folder: str, table: str, batch: str | None = None, **options) -> DataFrame:
    """``photo_id, path, modified, valid`` of all files, kept in a Parquet table.

    The whole folder is listed, without reading contents, so files that arrive late with an old time
    are seen. Files not in the table as they are now are decoded, each judged by its own path, and
    appended as one batch; a file's latest verdict counts.
    """
    listing = list_files(spark, folder, **options)
    return apply_listing(listing, table, lambda fresh: decoded(fresh, folder, listing, **options), batch)


def apply_listing(
    listing: DataFrame, table: str, judge: Callable[[DataFrame], DataFrame], batch: str | None = None
) -> DataFrame:
    """Verdicts after a listing (photo_id, path, modified, length) was taken into ``table``.

    Files whose path, time and length are not in the table are judged: ``judge`` gets them and gives
    (path, valid). They come in as ``batch``, by default named after what they are, and a batch comes
    in once: a listing applied again, or a writer that died and starts anew, changes nothing that is
    there. Of several states of a file the one taken in last counts, of equals the later one.
    """
    spark = listing.sparkSession
    known = read_batches(spark, table, VERDICTS)
    state = ["path", "modified", "length"]
    fresh = materialize(listing.select("photo_id", *state).join(known.select(*state), state, "left_anti"), "fresh")
    print_, files = fresh.agg(F.sum(F.xxhash64(*state).cast("decimal(38,0)")), F.count("*")).first()
    if files:
        seen = (known.agg(F.max("seen")).first()[0] or 0) + 1
        verdicts = fresh.join(judge(fresh).select("path", "valid"), "path", "left").select(
            "photo_id", *state, F.coalesce("valid", F.lit(False)).alias("valid"), F.lit(seen).cast("long").alias("seen")
        )
        append_once(verdicts, table, batch or f"{files}-{int(print_) % 2**64:016x}")
    return latest_verdicts(read_batches(spark, table, VERDICTS))


def decoded(fresh: DataFrame, folder: str, listing: DataFrame, most: int = 10_000, **options) -> DataFrame:
    """(path, valid) of the files of ``fresh`` that decode.

    If they are most of the folder, the folder is read. Else they are read by name, ``most`` at a
    time, so that a few new files never cost a pass over the old ones.
    """
    spark, files = fresh.sparkSession, fresh.count()
    if 2 * files >= listing.count() and files > most:
        readers = [[folder]]
    else:
        waves = max(1, -(-files // most))
        dealt = fresh.select("path", F.pmod(F.xxhash64("path"), F.lit(waves)).alias("wave"))
        readers = ([r.path for r in dealt.where(F.col("wave") == w).collect()] for w in range(waves))
        options = {}
    good = f"{scratch_dir(spark)}/readable-{uuid.uuid4().hex}"
    for names in readers:
        for i in range(0, len(names), 1000):
            whole = names == [folder]
            some = names[i : i + 1000]
            rows = spark.read.format("image").options(dropInvalid=True, **options).load(some if whole else [_literal(n) for n in some])
            rows.select(_same(_path(F.col("image.origin"))).alias("same")).write.mode("append").parquet(good)
    readable = spark.read.schema("same string").parquet(good).distinct()
    return fresh.select("path", _same(F.col("path")).alias("same")).join(readable, "same", "left_semi").select(
        "path", F.lit(True).alias("valid")
    )


def _literal(path: str) -> str:
    """A path whose characters stand for themselves where patterns are read."""
    return re.sub(r"([\\\[\]{}*?])", r"\\\1", path)


def _path(origin: Column) -> Column:
    """Path of an image as the file is named: the source gives it with percent signs and hex digits."""
    return F.url_decode(F.replace(origin, F.lit("+"), F.lit("%2B")))


def _same(path: Column) -> Column:
    """Path without scheme and doubled slashes, so that listing and decoder agree."""
    return F.regexp_replace(F.regexp_replace(path, r"^[a-z0-9]+:/+", "/"), "/+", "/")


def latest_verdicts(verdicts: DataFrame) -> DataFrame:
    """One row per photo: of its files, each by its latest verdict, a readable one if there is one."""
    last = F.max_by(F.struct("modified", "valid"), F.struct("seen", "modified", "length"))
    files = verdicts.groupBy("photo_id", "path").agg(last.alias("_v"))
    best = F.max_by(F.struct("path", "_v.modified", "_v.valid"), F.struct("_v.valid", "_v.modified", "path"))
    return files.groupBy("photo_id").agg(best.alias("_f")).select("photo_id", "_f.*")

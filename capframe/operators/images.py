"""Image rows to tensors and features: geometry as expressions, pixels in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from capframe.fixed_values import CROP_TO, RESIZE_TO, SEED, TRAIN_PADDING
from capframe.functions import pixels as P
from capframe.functions.draws import whole

_CHUNK = 16  # images per output batch: some 10 MB of floats at 224 x 224

_PLAN = ["resized_height", "resized_width", "pad", "crop_top", "crop_left", "crop_size", "flip"]


def resized_size(height: Column, width: Column, size: int = RESIZE_TO) -> tuple[Column, Column]:
    """Height and width with the shorter side at ``size``, the longer one rounded down."""
    def longer(a: Column, b: Column) -> Column:
        return F.floor(F.lit(size) * a / b).cast("int")

    tall = height >= width
    return (
        F.when(tall, longer(height, width)).otherwise(F.lit(size)),
        F.when(tall, F.lit(size)).otherwise(longer(width, height)),
    )


def centre_offset(length: Column, size: int = CROP_TO) -> Column:
    """Start of the centred crop; halves round to the even number."""
    return F.bround((length - F.lit(size)) / 2).cast("int")


def plan_eval(df: DataFrame, resize_to: int = RESIZE_TO, crop_to: int = CROP_TO) -> DataFrame:
    """Resize and centre-crop geometry per image."""
    height, width = resized_size(F.col("height"), F.col("width"), resize_to)
    return (
        df.withColumn("resized_height", height)
        .withColumn("resized_width", width)
        .withColumn("pad", F.lit(0))
        .withColumn("crop_top", centre_offset(F.col("resized_height"), crop_to))
        .withColumn("crop_left", centre_offset(F.col("resized_width"), crop_to))
        .withColumn("crop_size", F.lit(crop_to))
        .withColumn("flip", F.lit(False))
    )


def plan_train(
    df: DataFrame,
    epoch: int,
    key: str = "photo_id",
    seed: int = SEED,
    resize_to: int = RESIZE_TO,
    crop_to: int = CROP_TO,
    pad: int = TRAIN_PADDING,
) -> DataFrame:
    """Resize, padded random crop and random flip, drawn from key, seed and epoch."""
    height, width = resized_size(F.col("height"), F.col("width"), resize_to)

    def draw(what: str, choices: Column) -> Column:
        return (whole(seed, epoch, what, F.col(key)) % choices).cast("int")

    return (
        df.withColumn("resized_height", height)
        .withColumn("resized_width", width)
        .withColumn("pad", F.lit(pad))
        .withColumn("crop_top", draw("top", F.col("resized_height") + 2 * pad - crop_to + 1))
        .withColumn("crop_left", draw("left", F.col("resized_width") + 2 * pad - crop_to + 1))
        .withColumn("crop_size", F.lit(crop_to))
        .withColumn("flip", draw("flip", F.lit(2)) == 1)
    )


def _transform(data, height, width, channels, resized_height, resized_width, pad, top, left, size, flip):
    image = P.resize(P.from_spark(data, height, width, channels), resized_height, resized_width)
    image = P.pad_and_crop(image, pad, top, left, size)
    return image[:, ::-1] if flip else image


def _images(series: tuple[pd.Series, ...]) -> Iterator[list[np.ndarray]]:
    """Transformed images of an Arrow batch, a few at a time."""
    rows = list(zip(*series))
    for start in range(0, len(rows), _CHUNK):
        yield [_transform(*row) for row in rows[start : start + _CHUNK]]


@F.pandas_udf(T.ArrayType(T.FloatType()))
def _tensor(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
    for series in batches:
        for images in _images(series):
            yield pd.Series([P.to_tensor(image).ravel() for image in images], dtype=object)


@F.pandas_udf(T.ArrayType(T.FloatType()))
def _colour(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
    bins = 8
    for series in batches:
        for images in _images(series):
            rows = []
            for image in images:
                flat = image.reshape(-1, 3)
                shares = [np.bincount(flat[:, c].astype(np.int64) * bins // 256, minlength=bins) / len(flat) for c in range(3)]
                rows.append(np.concatenate([flat.mean(axis=0) / 255, *shares]).astype(np.float32))
            yield pd.Series(rows, dtype=object)


def _inputs() -> list[Column]:
    return [F.col(c) for c in ["data", "height", "width", "n_channels", *_PLAN]]


def with_tensor(planned: DataFrame, out: str = "tensor") -> DataFrame:
    """Planned images as channel-first floats in [0, 1], flattened, with ``shape``."""
    side = F.col("crop_size")
    return planned.select(
        "*", _tensor(*_inputs()).alias(out), F.array(F.lit(3), side, side).alias("shape")
    ).drop("data", "n_channels", *_PLAN)


def with_colour_features(planned: DataFrame, out: str = "image_features") -> DataFrame:
    """Planned images as mean colour and eight-bin histogram per channel: 27 floats."""
    return planned.withColumn(out, _colour(*_inputs())).drop("data", "n_channels", *_PLAN)


@F.pandas_udf(T.BinaryType())
def _png(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
    for series in batches:
        yield pd.Series([P.png_of_spark(*row) for row in zip(*series)], dtype=object)


def with_png(df: DataFrame, out: str = "content") -> DataFrame:
    """Image rows (``data, height, width, n_channels``) with the bytes of a PNG file of each."""
    return df.withColumn(out, _png("data", "height", "width", "n_channels"))

"""Pixel helpers in numpy, for single images of shape ``[height, width, channels]`` and type uint8."""

from __future__ import annotations

import struct
import zlib
from functools import lru_cache

import numpy as np

_BITS = 22  # fixed-point digits of the resampling weights


@lru_cache(maxsize=1024)
def _taps(size_in: int, size_out: int) -> tuple[np.ndarray, np.ndarray]:
    """Antialiased bilinear weights: the first input of each output, and its few weights as whole numbers."""
    scale = size_in / size_out
    width = max(scale, 1.0)
    centres = (np.arange(size_out) + 0.5) * scale
    taps = min(size_in, int(np.ceil(2 * width)) + 1)
    first = np.clip(np.ceil(centres - width - 0.5).astype(np.int64), 0, size_in - taps)
    distance = np.abs(first[:, None] + np.arange(taps) + 0.5 - centres[:, None]) / width
    weights = np.maximum(0.0, 1.0 - distance)
    weights /= weights.sum(axis=1, keepdims=True)
    return first, np.floor(weights * (1 << _BITS) + 0.5).astype(np.int64)


def _resample(pixels: np.ndarray, taps: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Weighted sums along the first axis, tap by tap, rounded to bytes."""
    first, weights = taps
    sums = np.full((len(first), *pixels.shape[1:]), 1 << (_BITS - 1), dtype=np.int64)
    shape = (-1,) + (1,) * (pixels.ndim - 1)
    for k in range(weights.shape[1]):
        sums += weights[:, k].reshape(shape) * pixels[first + k]
    return np.clip(sums >> _BITS, 0, 255).astype(np.uint8)


def resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Antialiased bilinear resize: columns first, then rows, bytes in between."""
    if pixels.shape[1] != width:
        pixels = _resample(pixels.swapaxes(0, 1), _taps(pixels.shape[1], width)).swapaxes(0, 1)
    if pixels.shape[0] != height:
        pixels = _resample(pixels, _taps(pixels.shape[0], height))
    return pixels


def from_spark(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Red, green, blue pixels of a Spark image: grey is repeated, alpha is dropped."""
    pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    if channels == 1:
        return np.repeat(pixels, 3, axis=2)
    return pixels[:, :, 2::-1]


def pad_and_crop(pixels: np.ndarray, pad: int, top: int, left: int, size: int) -> np.ndarray:
    """Square of ``size`` from an image with a black border of ``pad``."""
    if pad:
        pixels = np.pad(pixels, ((pad, pad), (pad, pad), (0, 0)))
    return pixels[top : top + size, left : left + size]


def to_tensor(pixels: np.ndarray) -> np.ndarray:
    """Channel-first floats in [0, 1]."""
    return (pixels.transpose(2, 0, 1) / np.float32(255)).astype(np.float32)


# PNG colour types of grey, colour, and colour with alpha.
_COLOUR_TYPE = {1: 0, 3: 2, 4: 6}


def png(pixels: np.ndarray) -> bytes:
    """PNG file of an image ``[height, width, channels]`` of 1, 3 or 4 channels."""
    height, width, channels = pixels.shape

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    lines = np.zeros((height, 1 + width * channels), np.uint8)  # each led by its filter, none
    lines[:, 1:] = pixels.reshape(height, -1)
    head = struct.pack(">IIBBBBB", width, height, 8, _COLOUR_TYPE[channels], 0, 0, 0)
    body = zlib.compress(lines.tobytes())
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", body) + chunk(b"IEND", b"")


def png_of_spark(data: bytes, height: int, width: int, channels: int) -> bytes:
    """PNG file of a Spark image: grey stays grey, colours change order, alpha stays last."""
    pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return png(pixels if channels == 1 else np.dstack([pixels[:, :, 2::-1], pixels[:, :, 3:]]))

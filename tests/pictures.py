"""PNG files made from the standard library."""

from __future__ import annotations

import struct
import zlib

import numpy as np

COLOUR_TYPE = {1: 0, 3: 2, 4: 6}


def png(pixels: np.ndarray) -> bytes:
    """Bytes of an image ``[height, width, channels]`` with 1, 3 or 4 channels."""
    height, width, channels = pixels.shape

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    rows = b"".join(b"\0" + pixels[y].astype(np.uint8).tobytes() for y in range(height))
    head = struct.pack(">IIBBBBB", width, height, 8, COLOUR_TYPE[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def plain(height, width, colour) -> np.ndarray:
    return np.tile(np.array(colour, np.uint8), (height, width, 1))


def write_folder(folder) -> None:
    """Readable images a to d; broken ones cut, text and empty."""
    folder.mkdir(parents=True, exist_ok=True)
    rng = np.random.default_rng(0)
    (folder / "a.jpg").write_bytes(png(plain(3, 4, (10, 20, 30))))
    (folder / "b.jpg").write_bytes(png(plain(300, 400, (50,))))
    (folder / "c.jpg").write_bytes(png(plain(40, 30, (1, 2, 3, 128))))
    (folder / "d.v1.jpg").write_bytes(png(rng.integers(0, 256, (280, 257, 3), np.uint8)))
    whole = png(rng.integers(0, 256, (50, 50, 3), np.uint8))
    (folder / "cut.jpg").write_bytes(whole[: len(whole) // 2])
    (folder / "text.jpg").write_bytes(b"no picture")
    (folder / "empty.jpg").write_bytes(b"")

"""256 x 256 RGBA PNG from a pixel table, without an image library."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE = 256


def encode(rgba: bytes, size: int = SIZE) -> bytes:
    def chunk(name: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    rows = b"".join(b"\0" + rgba[4 * size * i : 4 * size * (i + 1)] for i in range(size))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">2I5B", size, size, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def decode(png: bytes) -> bytes:
    """RGBA of a PNG that encode() made."""
    at, data = 8, b""
    while at < len(png):
        n = struct.unpack(">I", png[at : at + 4])[0]
        if png[at + 4 : at + 8] == b"IDAT":
            data += png[at + 8 : at + 8 + n]
        at += 12 + n
    raw = zlib.decompress(data)
    return b"".join(raw[i * (4 * SIZE + 1) + 1 : (i + 1) * (4 * SIZE + 1)] for i in range(SIZE))


def tiles(pixels: DataFrame, *keys: str) -> DataFrame:
    """(keys, png) from (keys, pi, pj, r, g, b, a): at most 65,536 pixels meet for a tile; one blank tile for an empty table without keys."""

    def draw(f: pd.DataFrame) -> pd.DataFrame:
        named = {k: f[k].iloc[0] for k in keys}
        image = np.zeros((SIZE, SIZE, 4), np.uint8)
        f = f[f["pi"] >= 0]
        image[f["pi"], f["pj"]] = f[["r", "g", "b", "a"]].to_numpy(np.int64) & 255
        return pd.DataFrame([{**named, "png": encode(image.tobytes())}])

    if not keys:
        blank = pixels.sparkSession.createDataFrame([(-1, 0, 0, 0, 0, 0)], "pi int, pj int, r int, g int, b int, a int")
        pixels = pixels.select(*(F.col(c).cast("int").alias(c) for c in ("pi", "pj", "r", "g", "b", "a"))).union(blank)
    schema = ", ".join([*(f"`{k}` {dict(pixels.dtypes)[k]}" for k in keys), "png binary"])
    return pixels.groupBy(*keys).applyInPandas(draw, schema)

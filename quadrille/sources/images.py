"""Pixel tables as PNG files, and PNG or JPEG files as pixel tables."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F


def png(pixels: np.ndarray) -> bytes:
    """A PNG file of (height, width, 3) bytes."""
    h, w, _ = pixels.shape
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    lines = np.concatenate((np.zeros((h, 1), np.uint8), pixels.astype(np.uint8).reshape(h, 3 * w)), axis=1)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def to_png(pixels: DataFrame) -> DataFrame:
    """(img, y, x, r, g, b) -> (img, width, height, payload): one file per image; what is not given is black."""

    def one(key, rows: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros((int(rows["y"].max()) + 1, int(rows["x"].max()) + 1, 3), np.uint8)
        out[rows["y"], rows["x"]] = rows[["r", "g", "b"]].to_numpy()
        return pd.DataFrame({"img": [key[0]], "width": [out.shape[1]], "height": [out.shape[0]], "payload": [png(out)]})

    return pixels.select("img", "y", "x", "r", "g", "b").groupBy("img").applyInPandas(one, "img string, width int, height int, payload binary")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(img, y, x, r, g, b) of the PNG and JPEG files at path, read on the JVM."""
    i = spark.read.format("image").load(path).select(F.col("image.origin").alias("img"), "image.width", "image.height", "image.nChannels", "image.data").where("nChannels >= 3")
    at = i.select("img", "width", "nChannels", "data", F.explode(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1)).alias("p"))
    byte = lambda c: F.conv(F.hex(F.substring("data", F.col("p") * F.col("nChannels") + F.lit(c + 1), F.lit(1))), 16, 10).cast("int")
    return at.select("img", F.floor(F.col("p") / F.col("width")).cast("int").alias("y"), F.pmod("p", "width").alias("x"), byte(2).alias("r"), byte(1).alias("g"), byte(0).alias("b"))

"""Sixteen-bit mono WAV files as signals, and signals as such files."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from quadrille.functions.dims import SAMPLE_RATE


def samples(data: bytes) -> np.ndarray:
    with wave.open(io.BytesIO(data)) as w:
        raw = np.frombuffer(w.readframes(w.getnframes()), "<i2").reshape(-1, w.getnchannels())
    return raw[:, 0] / 32768.0


def encoded(x: np.ndarray, rate: int = SAMPLE_RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.clip(x * 32767.0, -32768, 32767).astype("<i2").tobytes())
    return out.getvalue()


def read_wav(spark: SparkSession, path: str) -> DataFrame:
    """(track, n, x) of all files; the track is the file's name."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                x = samples(content)
                yield pd.DataFrame({"track": name.rsplit("/", 1)[-1].rsplit(".", 1)[0], "n": np.arange(len(x)), "x": x})

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path).select("path", "content").mapInPandas(rows, "track string, n long, x double")


def to_wav(signal: DataFrame, rate: int = SAMPLE_RATE) -> DataFrame:
    """(track, payload binary): a file for each track."""

    def one(key, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"track": [key[0]], "payload": [encoded(rows.sort_values("n")["x"].to_numpy(), rate)]})

    return signal.groupBy("track").applyInPandas(one, "track string, payload binary")

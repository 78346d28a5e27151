"""Streams of positions and frames, with state by track."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from quadrille.functions.dims import FRAMES_PER_SECOND, HOP, basis

POSITIONS = "track string, us long, frame double, speed double, direction int"


def speed_of(points: list[tuple[int, float]]) -> float:
    """Frames a second over the nominal rate; one point says nothing, no time says that it stands."""
    if len(points) < 2:
        return 1.0
    seconds = (points[-1][0] - points[0][0]) / 1e6
    return 0.0 if seconds < 1e-4 else (points[-1][1] - points[0][1]) / seconds / FRAMES_PER_SECOND


class SpeedProcessor(StatefulProcessor):
    """Keeps a track's points of a trailing window."""

    window_us = 250_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        point = StructType([StructField("us", LongType()), StructField("frame", DoubleType())])
        self.points = handle.getListState("points", point)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [tuple(p) for p in self.points.get()] if self.points.exists() else []
        out = []
        for us, frame in sorted(x for part in rows for x in zip(part["us"].tolist(), part["frame"].tolist())):
            held = [p for p in held if p[0] >= us - self.window_us] + [(us, frame)]
            speed = speed_of(held)
            out.append((key[0], us, frame, speed, 1 if speed > 0.02 else -1 if speed < -0.02 else 0))
        self.points.put(held)
        yield pd.DataFrame(out, columns=["track", "us", "frame", "speed", "direction"])

    def close(self) -> None:
        pass


def stream_speed(positions: DataFrame, window_us: int = 250_000) -> DataFrame:
    """(track, us, frame) stream -> its rows with speed and direction."""
    processor = type("Speed", (SpeedProcessor,), {"window_us": window_us})()
    return positions.groupBy("track").transformWithStateInPandas(processor, POSITIONS, "Append", "None")


class OverlapProcessor(StatefulProcessor):
    """Keeps the second half of a track's last frame; a jump drops it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tail = handle.getValueState("tail", StructType([StructField("frame", LongType()), StructField("x", ArrayType(DoubleType()))]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, tail = (None, np.zeros(HOP))
        if self.tail.exists():
            last, x = self.tail.get()
            tail = np.array(x)
        out, inverse = [], basis().T
        frames = sorted(((f, c) for part in rows for f, c in zip(part["frame"].tolist(), part["coeffs"])), key=lambda p: p[0])
        for frame, coeffs in frames:
            y = np.asarray(coeffs, dtype=float) @ inverse
            jumped = last is not None and abs(frame - last) > 1
            out.append((key[0], frame, jumped, (y[:HOP] + (0 if jumped or last is None else tail)).tolist()))
            last, tail = frame, y[HOP:]
        self.tail.update((int(last), tail.tolist()))
        yield pd.DataFrame(out, columns=["track", "frame", "reset", "x"])

    def close(self) -> None:
        pass


def stream_overlap_add(coeffs: DataFrame) -> DataFrame:
    """(track, frame, coeffs) stream -> (track, frame, reset, x): a hop of samples per frame."""
    return coeffs.groupBy("track").transformWithStateInPandas(OverlapProcessor(), "track string, frame long, reset boolean, x array<double>", "Append", "None")

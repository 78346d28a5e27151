"""Masking, step sizes, budget fit and quantisation, many frames at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from quadrille.functions.dims import BAND_HEADER_BITS, BANDS, BUDGET_FACTOR, FRAME_MS, HEADROOM_DB, HOP, MAX_QUANT, MIN_STEP, band_arrays

LAYER_SLICES = (slice(0, 8), slice(8, 24), slice(24, 48))
SEARCHES = 24


def frame_bits(kbps: float) -> int:
    return int(kbps * 1000 * FRAME_MS / 1000)


def thresholds(db: np.ndarray) -> np.ndarray:
    """(frames, bands): the loudest masker's spread, never below the hearing threshold."""
    a = band_arrays()
    levels = np.maximum(db, -80.0)
    return np.maximum(a["hearing"], (levels[:, None, :] + a["spread"][None]).max(axis=2))


def base_steps(db: np.ndarray) -> np.ndarray:
    return np.maximum(10.0 ** ((thresholds(db) - HEADROOM_DB) / 20.0), MIN_STEP)


def band_costs(size: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Estimated bits of each band of each frame; size: magnitudes (frames, 1023)."""
    a = band_arrays()
    per_bin = np.repeat(steps, a["size"], axis=1)
    q = np.rint(size / per_bin)
    bits = np.where(q > 0, np.log2(q + 1.0) + 1.0, 0.0)
    cost = BAND_HEADER_BITS + np.add.reduceat(bits, a["start"], axis=1)
    return np.where(steps <= MIN_STEP, BAND_HEADER_BITS, cost)


def fitted_steps(coeffs: np.ndarray, steps: np.ndarray, budget: float) -> np.ndarray:
    """Steps whose cost fits twice the budget: coarser from the highest layer down where over it, finer
    everywhere where well under it. All frames are bisected together."""
    size, steps, limit = np.abs(coeffs[:, : HOP - 1]), steps.copy(), budget * BUDGET_FACTOR
    for layer in reversed(LAYER_SLICES):
        over = np.flatnonzero(band_costs(size, steps).sum(axis=1) > limit)
        if not len(over):
            break
        low, high = np.ones(len(over)), np.full(len(over), 65536.0)
        for _ in range(SEARCHES):
            mid = (low + high) / 2
            trial = steps[over]
            trial[:, layer] *= mid[:, None]
            fits = band_costs(size[over], trial).sum(axis=1) <= limit
            low, high = np.where(fits, low, mid), np.where(fits, mid, high)
        steps[over, layer] *= high[:, None]
    under = np.flatnonzero(band_costs(size, steps).sum(axis=1) < 0.95 * limit)
    if len(under):
        peak = np.maximum.reduceat(size[under], band_arrays()["start"], axis=1)
        low = np.maximum(1e-6, (peak / (MAX_QUANT * steps[under])).max(axis=1))
        under, low = under[low < 1.0], low[low < 1.0]
        high = np.ones(len(under))
        for _ in range(SEARCHES):
            mid = (low + high) / 2
            fits = band_costs(size[under], steps[under] * mid[:, None]).sum(axis=1) <= limit
            low, high = np.where(fits, low, mid), np.where(fits, mid, high)
        steps[under] *= high[:, None]
    return steps


def quantised(coeffs: np.ndarray, steps: np.ndarray) -> np.ndarray:
    per_bin = np.repeat(steps, band_arrays()["size"], axis=1)
    return np.clip(np.rint(coeffs[:, : HOP - 1] / per_bin), -MAX_QUANT, MAX_QUANT).astype(np.int16)


def band_db(coeffs: np.ndarray) -> np.ndarray:
    a = band_arrays()
    rms = np.sqrt(np.add.reduceat(coeffs[:, : HOP - 1] ** 2, a["start"], axis=1) / a["size"])
    return np.maximum(20 * np.log10(rms + 1e-12), -80.0)


RESULT = "struct<q:array<smallint>,steps:array<double>,bits:array<int>>"


def quantiser(kbps: float):
    """A pandas UDF of coefficient arrays: integers, steps and bits by layer; silent frames get none."""
    budget = frame_bits(kbps)

    @pandas_udf(RESULT)
    def quantise(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for column in batches:
            q = [np.zeros(0, np.int16)] * len(column)
            steps = [np.ones(BANDS)] * len(column)
            bits = [np.zeros(3, np.int32)] * len(column)
            held = np.flatnonzero([x is not None for x in column])
            if len(held):
                c = np.stack([column.iloc[i] for i in held])
                db = band_db(c)
                loud = db.max(axis=1) >= -55.0
                c, held = c[loud], held[loud]
                if len(held):
                    s = fitted_steps(c, base_steps(db[loud]), budget)
                    ints, cost = quantised(c, s), band_costs(np.abs(c[:, : HOP - 1]), s).astype(np.int64)
                    for i, at in enumerate(held):
                        q[at], steps[at] = ints[i], s[i]
                        bits[at] = np.array([cost[i, x].sum() for x in LAYER_SLICES], np.int32)
            yield pd.DataFrame({"q": q, "steps": steps, "bits": bits})

    return quantise


def with_quantised(df: DataFrame, kbps: float, source: str = "target") -> DataFrame:
    done = df.withColumn("done", quantiser(kbps)(F.col(source)))
    return done.select(*df.columns, "done.q", "done.steps", "done.bits")

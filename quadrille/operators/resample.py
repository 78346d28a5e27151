"""Playback speed: linear resampling, stopping, and both ways through stretches of samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from quadrille.functions.dims import DECAY_SECONDS, HOP, SAMPLE_RATE


def _between(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The outputs that fall into a stretch of a track: its samples are a hop and the first of the next."""
    for part in batches:
        tracks, numbers, values = [], [], []
        for row in part.itertuples(index=False):
            n_in, n_out, begin = int(row.n_in), int(row.n_out), int(row.stretch) * HOP
            x, known = np.zeros(HOP + 1), np.zeros(HOP + 1, bool)
            x[row.k], known[row.k] = row.x, True
            # j around those that fall here, then by the place itself, so that each falls into one stretch
            rate = (n_out - 1) / (n_in - 1) if n_in > 1 else 0.0
            low, high = (max(0, int(begin * rate) - 2), min(n_out, int((begin + HOP) * rate) + 3)) if rate else (0, n_out)
            j = np.arange(low, max(low, high))
            p = j * (n_in - 1.0) / (n_out - 1.0) if n_out > 1 else np.zeros(len(j))
            i = np.floor(p).astype(np.int64)
            here = (i >= begin) & (i < begin + HOP)
            j, p, i = j[here], p[here], i[here]
            met = known[i - begin] | known[i - begin + 1]
            j, p, i = j[met], p[met], i[met]
            tracks.append(np.full(len(j), row.track, object))
            numbers.append(j)
            values.append(x[i - begin] * (1 - (p - i)) + x[i - begin + 1] * (p - i))
        if tracks:
            yield pd.DataFrame({"track": np.concatenate(tracks), "n": np.concatenate(numbers), "x": np.concatenate(values)})


def at_speed(samples: DataFrame, speed: float) -> DataFrame:
    """(track, n, x) at a speed of 0 or more: 1 as it is, 0 fading where it stands, else round(n / speed) samples.

    Samples move once, into stretches of a hop, and the first of a hop also into the one before; what falls into a
    stretch is made there. No window over a track, no range join, no table of outputs to be joined."""
    if speed == 1.0:
        return samples
    if speed == 0.0:
        return samples.select("track", "n", (F.col("x") * F.exp(-F.col("n") / F.lit(float(SAMPLE_RATE)) / DECAY_SECONDS)).alias("x"))
    sizes = samples.groupBy("track").agg((F.max("n") + 1).alias("n_in")).withColumn("n_out", F.greatest(F.lit(1), F.rint(F.col("n_in") / speed).cast("long")))
    stretch, k = F.floor(F.col("n") / HOP), F.pmod("n", F.lit(HOP)).cast("int")
    own = F.struct(stretch.alias("stretch"), k.alias("k"))
    before = F.struct((stretch - 1).alias("stretch"), F.lit(HOP).alias("k"))
    placed = samples.select("track", F.explode(F.when((k == 0) & (stretch > 0), F.array(own, before)).otherwise(F.array(own))).alias("at"), "x")
    held = placed.groupBy("track", "at.stretch").agg(F.collect_list(F.struct("at.k", "x")).alias("s"))
    return held.join(sizes, "track").select("track", "stretch", "n_in", "n_out", "s.k", "s.x").mapInPandas(_between, "track string, n long, x double")

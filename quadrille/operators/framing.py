"""Overlapping frames and their transform, forward and back."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType

from quadrille.functions.dims import BANDS, FLOOR_DB, FRAME, GOP, HOP, SILENCE_DB, band_arrays, basis


DOUBLES = ArrayType(DoubleType())


def frame_counts(signal: DataFrame) -> DataFrame:
    """(track, n_frames): one frame more than full hops after the padding in front."""
    return signal.groupBy("track").agg((F.floor((F.max("n") + 1 + HOP) / HOP) + 1).cast("int").alias("n_frames"))


def hops(signal: DataFrame) -> DataFrame:
    """(track, hop, x array of 1024): each sample moves once, missing ones are zero."""
    placed = signal.select("track", F.floor((F.col("n") + HOP) / HOP).cast("int").alias("hop"), F.pmod("n", F.lit(HOP)).cast("int").alias("k"), "x")
    held = placed.groupBy("track", "hop").agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("s"))
    return held.select("track", "hop", _dense(F.col("s.k"), F.col("s.x")).alias("x"))


@pandas_udf(DOUBLES)
def _dense(k: pd.Series, x: pd.Series) -> pd.Series:
    out = []
    for at, values in zip(k, x):
        row = np.zeros(HOP)
        row[np.asarray(at)] = np.asarray(values)
        out.append(row)
    return pd.Series(out)


def frames(signal: DataFrame) -> DataFrame:
    """(track, frame, first, second): the two hops of each frame; a missing hop is null and stands for zeros."""
    parts = hops(signal)
    grid = frame_counts(signal).select("track", F.explode(F.sequence(F.lit(0), F.col("n_frames") - 1)).alias("frame"))
    halves = parts.select("track", F.explode(F.array(F.struct(F.col("hop").alias("frame"), F.lit(0).alias("half")), F.struct((F.col("hop") - 1).alias("frame"), F.lit(1).alias("half")))).alias("f"), "x")
    halves = halves.select("track", "f.frame", F.when(F.col("f.half") == 0, F.col("x")).alias("a"), F.when(F.col("f.half") == 1, F.col("x")).alias("b"))
    both = grid.select("track", "frame", F.lit(None).cast("array<double>").alias("a"), F.lit(None).cast("array<double>").alias("b")).unionByName(halves.where("frame >= 0"))
    return both.groupBy("track", "frame").agg(F.first("a", ignorenulls=True).alias("first"), F.first("b", ignorenulls=True).alias("second"))


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(column), width))
    for i, x in enumerate(column):
        if x is not None:
            out[i] = x
    return out


@pandas_udf(DOUBLES)
def mdct(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """The transform of many frames as one matrix product."""
    b = basis()
    for first, second in batches:
        yield pd.Series(list(_matrix(first, HOP) @ b[:HOP] + _matrix(second, HOP) @ b[HOP:]))


@pandas_udf(DOUBLES)
def imdct(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    b = basis()
    for c in batches:
        yield pd.Series(list(_matrix(c, HOP) @ b.T))


@pandas_udf(DOUBLES)
def band_rms(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    a = band_arrays()
    edges = a["start"]
    for c in batches:
        squares = _matrix(c, HOP)[:, : HOP - 1] ** 2
        yield pd.Series(list(np.sqrt(np.add.reduceat(squares, edges, axis=1) / a["size"])))


def analysed(signal: DataFrame) -> DataFrame:
    """(track, frame, coeffs, rms, db, energy, is_silence, gop_pos, ftype): the analysis of a signal."""
    c = frames(signal).select("track", "frame", mdct("first", "second").alias("coeffs"))
    return typed(c.withColumn("rms", band_rms("coeffs")))


def typed(frames_with_rms: DataFrame, silence_db: float = SILENCE_DB) -> DataFrame:
    weights = F.array(*(F.lit(float(w)) for w in band_arrays()["weight"]))
    df = frames_with_rms.withColumn("db", F.transform("rms", lambda r: F.greatest(20 * F.log10(r + F.lit(1e-12)), F.lit(FLOOR_DB))))
    energy = F.aggregate(F.zip_with("db", weights, lambda d, w: (F.greatest(d, F.lit(FLOOR_DB)) - FLOOR_DB) / -FLOOR_DB * w), F.lit(0.0), lambda s, v: s + v)
    df = df.withColumn("energy", energy).withColumn("is_silence", F.array_max("db") < silence_db).withColumn("gop_pos", F.pmod("frame", F.lit(GOP)).cast("int"))
    return df.withColumn("ftype", F.when(F.col("gop_pos") == 0, "K").when(F.col("is_silence"), "S").otherwise("B"))


def long_bands(analysis: DataFrame) -> DataFrame:
    """(track, frame, band, db, rms)"""
    zipped = F.posexplode(F.arrays_zip("db", "rms"))
    return analysis.select("track", "frame", zipped.alias("band", "z")).select("track", "frame", "band", "z.db", "z.rms")


def long_coeffs(analysis: DataFrame) -> DataFrame:
    return analysis.select("track", "frame", F.posexplode("coeffs").alias("m", "c"))


def overlap_add(coeffs: DataFrame, reverse: bool = False) -> DataFrame:
    """(track, frame, coeffs) -> (track, n, x): (n_frames - 1) hops of samples.

    Each frame hands a half to its own hop and to the next; a hop is the sum of two arrays, so no track is sorted
    as a whole. Reversal turns the order of frames, not the samples inside."""
    if reverse:
        last = coeffs.groupBy("track").agg(F.max("frame").alias("last"))
        coeffs = coeffs.join(last, "track").select("track", (F.col("last") - F.col("frame")).alias("frame"), "coeffs")
    y = coeffs.select("track", "frame", imdct("coeffs").alias("y"))
    halves = y.select("track", F.explode(F.array(F.struct(F.col("frame").alias("hop"), F.slice("y", 1, HOP).alias("x")), F.struct((F.col("frame") + 1).alias("hop"), F.slice("y", HOP + 1, HOP).alias("x")))).alias("h"))
    added = halves.select("track", "h.hop", "h.x").groupBy("track", "hop").agg(F.collect_list("x").alias("xs"))
    both = added.where((F.col("hop") >= 1) & (F.size("xs") == 2))
    whole = both.select("track", "hop", F.zip_with(F.get("xs", F.lit(0)), F.get("xs", F.lit(1)), lambda a, b: a + b).alias("x"))
    return whole.select("track", "hop", F.posexplode("x").alias("k", "x")).select("track", ((F.col("hop") - 1).cast("long") * HOP + F.col("k")).alias("n"), "x")


__all__ = ["BANDS", "FRAME", "analysed", "frame_counts", "frames", "hops", "imdct", "long_bands", "long_coeffs", "mdct", "overlap_add", "typed"]

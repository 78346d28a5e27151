"""Keyframes and frames between them: encoding to integers and decoding back."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType

from quadrille.functions.dims import BANDS, DECAY_PER_FRAME, GOP, HOP, band_arrays, layer_of
from quadrille.operators.framing import analysed, overlap_add
from quadrille.operators.quantise import with_quantised


DOUBLES = ArrayType(DoubleType())


def key_neighbours(analysis: DataFrame) -> DataFrame:
    """Each frame with the coefficients of the keyframes around it; B frames without both become K at place 0.

    Both lookups are equi-joins on (track, frame), dealt by the same key."""
    keys = analysis.where("ftype = 'K'").select("track", F.col("frame").alias("key"), F.col("coeffs").alias("kc"))
    df = analysis.withColumn("k0", F.col("frame") - F.col("gop_pos"))
    df = df.join(keys.select("track", F.col("key").alias("k0"), F.col("kc").alias("before")), ["track", "k0"], "left")
    df = df.withColumn("k1", F.col("k0") + GOP).join(keys.select("track", F.col("key").alias("k1"), F.col("kc").alias("after")), ["track", "k1"], "left")
    promoted = (F.col("ftype") == "B") & (F.col("before").isNull() | F.col("after").isNull())
    return df.withColumn("gop_pos", F.when(promoted, 0).otherwise(F.col("gop_pos"))).withColumn("ftype", F.when(promoted, "K").otherwise(F.col("ftype")))


def lerp(before, after, place):
    t = place / F.lit(float(GOP))
    return F.zip_with(before, after, lambda a, b: (1 - t) * a + t * b)


def encoded(analysis: DataFrame, kbps: float = 12.0) -> DataFrame:
    """(track, frame, ftype, gop_pos, q, steps, bits): K frames as they are, B frames as what interpolation misses."""
    df = key_neighbours(analysis)
    residual = F.zip_with("coeffs", lerp(F.col("before"), F.col("after"), F.col("gop_pos")), lambda c, p: c - p)
    target = F.when(F.col("ftype") == "K", F.col("coeffs")).when(F.col("ftype") == "B", residual)
    return with_quantised(df.select("track", "frame", "ftype", "gop_pos", target.alias("target")), kbps).drop("target")


def layer_alpha(layers: tuple[int, ...]) -> list[float]:
    return [1.0 if layer_of(b) in layers else 0.0 for b in range(BANDS)]


def dequantiser(alpha: list[float]):
    gain = np.array(alpha, dtype=float)

    @pandas_udf(DOUBLES)
    def dequantise(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        size = band_arrays()["size"]
        for q, steps in batches:
            out = []
            for ints, s in zip(q, steps):
                row = np.zeros(HOP)
                if ints is not None and len(ints):
                    # the wire holds steps as 32-bit floats
                    row[: HOP - 1] = np.asarray(ints, float) * np.repeat(np.asarray(s, np.float32).astype(float) * gain, size)
                out.append(row)
            yield pd.Series(out)

    return dequantise


def decoded_coeffs(frames: DataFrame, layers: tuple[int, ...] = (0, 1, 2), alpha: list[float] | None = None) -> DataFrame:
    """(track, frame, coeffs): a K frame that a B frame misses is the last K, fading by frame."""
    values = dequantiser(alpha if alpha is not None else layer_alpha(layers))
    df = frames.withColumn("own", F.when(F.col("ftype") != "S", values("q", "steps")))
    keys = df.where("ftype = 'K'").select("track", F.col("frame").alias("key"), F.col("own").alias("kc"))
    last = keys.groupBy("track").agg(F.max(F.struct("key", "kc")).alias("last"))
    df = df.withColumn("k0", F.when(F.col("ftype") == "B", F.col("frame") - F.col("gop_pos"))).withColumn("k1", F.col("k0") + GOP)
    df = df.join(keys.select("track", F.col("key").alias("k0"), F.col("kc").alias("before")), ["track", "k0"], "left")
    df = df.join(keys.select("track", F.col("key").alias("k1"), F.col("kc").alias("after")), ["track", "k1"], "left").join(last, "track", "left")

    def key(found, at):
        fade = F.pow(F.lit(DECAY_PER_FRAME), F.greatest(F.col(at) - F.col("last.key"), F.lit(0)).cast("double"))
        return F.coalesce(found, F.transform(F.col("last.kc"), lambda c: c * fade), F.array_repeat(F.lit(0.0), HOP))

    between = F.zip_with(lerp(key(F.col("before"), "k0"), key(F.col("after"), "k1"), F.col("gop_pos")), F.col("own"), lambda p, r: p + r)
    coeffs = F.when(F.col("ftype") == "S", F.array_repeat(F.lit(0.0), HOP)).when(F.col("ftype") == "K", F.col("own")).otherwise(between)
    return df.select("track", "frame", coeffs.alias("coeffs"))


def encode(signal: DataFrame, kbps: float = 12.0) -> DataFrame:
    return encoded(analysed(signal), kbps)


def decode(frames: DataFrame, layers: tuple[int, ...] = (0, 1, 2), alpha: list[float] | None = None, reverse: bool = False, speed: float = 1.0) -> DataFrame:
    from quadrille.operators.resample import at_speed

    samples = overlap_add(decoded_coeffs(frames, layers, alpha), reverse or speed < 0)
    return at_speed(samples, abs(speed))


def snr(reference: DataFrame, signal: DataFrame, skip: int = 2048) -> DataFrame:
    """(track, n, snr_db) of the interior; minus infinity where none is left."""
    ends = reference.groupBy("track").agg(F.max("n").alias("a")).join(signal.groupBy("track").agg(F.max("n").alias("b")), "track").select("track", (F.least("a", "b") + 1 - skip).alias("stop"))
    both = reference.join(signal.select("track", "n", F.col("x").alias("y")), ["track", "n"]).where(F.col("n") >= skip).join(ends, "track").where("n < stop")
    found = both.groupBy("track").agg(F.count("*").alias("n"), F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("r"), F.sqrt(F.avg((F.col("x") - F.col("y")) * (F.col("x") - F.col("y")))).alias("e"))
    found = ends.select("track").join(found, "track", "left")
    return found.select("track", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(20 * F.log10(F.col("r") / (F.col("e") + 1e-12)), F.lit(float("-inf"))).alias("snr_db"))

"""Levels at fixed steps: one row a frame, arrays inside, and long forms that leave the arrays once.

Frames of one group of eight are all that a frame needs to know about keyframes, so nothing here sorts or joins a
whole track; only the fixed table of 1023 bins is broadcast."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType, ShortType, StructField, StructType

from quadrille.functions.dims import BANDS, END_OF_BAND, ESCAPE, ESCAPE_BITS, GOP, HIGH_EMPHASIS, HOP, MAX_LEVEL, band_arrays, bin_table, code_table, layer_of
from quadrille.operators.codec import key_neighbours, lerp
from quadrille.operators.framing import DOUBLES, band_rms
from quadrille.operators.quantise import band_costs, band_db, base_steps, quantised, thresholds


def _stacked(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(x, dtype=float) for x in column]) if len(column) else np.zeros((0, HOP))


FIXED = StructType([StructField(n, ArrayType(ShortType()) if n == "q" else DOUBLES) for n in ("thr", "step", "q", "bits")])
CELL = StructType([StructField("steepness", DOUBLES), StructField("direction", ArrayType(IntegerType()))])


@pandas_udf(FIXED)
def at_fixed_steps(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for column in batches:
        c = _stacked(column)
        db = band_db(c)
        steps = base_steps(db)
        out = {"thr": thresholds(db), "step": steps, "q": quantised(c, steps), "bits": band_costs(np.abs(c[:, : HOP - 1]), steps)}
        yield pd.DataFrame({k: list(v) for k, v in out.items()})


def fixed(analysis: DataFrame) -> DataFrame:
    """The analysis with thr, step, q and bits, each an array, at the steps that masking alone asks for."""
    return analysis.withColumn("f", at_fixed_steps("coeffs")).select(*analysis.columns, "f.thr", "f.step", "f.q", "f.bits")


def by_band(levels: DataFrame, column: str) -> DataFrame:
    """(track, frame, band, column) of an array with a value for each band."""
    return levels.select("track", "frame", F.posexplode(column).alias("band", column))


def long_levels(levels: DataFrame) -> DataFrame:
    """(track, frame, band, coeff, m, c, step, q)"""
    zipped = F.posexplode(F.arrays_zip(F.slice("coeffs", 1, HOP - 1).alias("c"), F.col("q").alias("q")))
    long = levels.select("track", "frame", "step", zipped.alias("m", "z"))
    bins = F.broadcast(bin_table(levels.sparkSession))
    return long.join(bins, "m").select("track", "frame", "band", "coeff", "m", "z.c", F.get("step", F.col("band")).alias("step"), "z.q")


def _group() -> Window:
    return Window.partitionBy("track", F.expr(f"frame div {GOP}"))


def with_neighbours(analysis: DataFrame) -> DataFrame:
    """Adds was, k0 and k1 (null where there is none); a B frame without both becomes K at place 0.

    The keyframe of the group is among the frames of the group; whether the next one is there is an equi-join of thin rows."""
    first = F.min(F.when(F.col("ftype") == "K", F.col("frame"))).over(_group())
    df = analysis.withColumn("was", F.col("ftype")).withColumn("k0", F.when(first == F.col("frame") - F.col("gop_pos"), first))
    keys = analysis.where("ftype = 'K'").select("track", F.col("frame").alias("next"))
    df = df.withColumn("next", F.col("frame") - F.col("gop_pos") + GOP).join(keys.withColumn("k1", F.col("next")), ["track", "next"], "left").drop("next")
    promoted = (F.col("ftype") == "B") & (F.col("k0").isNull() | F.col("k1").isNull())
    return df.withColumn("gop_pos", F.when(promoted, 0).otherwise(F.col("gop_pos"))).withColumn("ftype", F.when(promoted, "K").otherwise(F.col("ftype")))


def neighbours(analysis: DataFrame) -> DataFrame:
    """(track, frame, was, k0, k1, ftype, gop_pos)"""
    return with_neighbours(analysis.select("track", "frame", "ftype", "gop_pos")).select("track", "frame", "was", "k0", "k1", "ftype", "gop_pos")


def _latest_key(value: Column) -> Column:
    """Of the latest keyframe up to a frame: a group begins with one, so the group is all there is to look at."""
    upto = _group().orderBy("frame").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.last(F.when(F.col("ftype") == "K", value), ignorenulls=True).over(upto)


def key_frames(analysis: DataFrame) -> DataFrame:
    """(track, frame, key_frame)"""
    return neighbours(analysis).select("track", "frame", _latest_key(F.col("frame")).alias("key_frame"))


def with_key_steps(levels: DataFrame) -> DataFrame:
    """Adds key_step, the steps of the latest keyframe."""
    return with_neighbours(levels).withColumn("key_step", _latest_key(F.col("step")))


def steepness(levels: DataFrame) -> DataFrame:
    """(track, frame, band, coeff, layer, ftype, c, q, steepness, direction) of all frames that aren't silent."""
    df = with_key_steps(levels).where("ftype <> 'S'")
    zipped = F.posexplode(F.arrays_zip(F.slice("coeffs", 1, HOP - 1).alias("c"), F.col("q").alias("q")))
    long = df.select("track", "frame", "ftype", "key_step", zipped.alias("m", "z")).join(F.broadcast(bin_table(levels.sparkSession)), "m")
    layer = F.when(F.col("band") < 8, 0).when(F.col("band") < 24, 1).otherwise(2)
    key = F.col("ftype") == "K"
    raw = F.when(key, F.abs(F.col("z.q").cast("int")) / F.lit(float(MAX_LEVEL))).otherwise(F.abs("z.c") / (F.get("key_step", F.col("band")) * float(MAX_LEVEL) + 1e-12))
    steep = F.least(F.lit(1.0), F.least(F.lit(1.0), raw) * F.when(layer == 2, HIGH_EMPHASIS).otherwise(1.0))
    sign = F.signum(F.when(key, F.col("z.q").cast("double")).otherwise(F.col("z.c"))).cast("int")
    return long.select("track", "frame", "band", "coeff", layer.alias("layer"), "ftype", "z.c", "z.q", steep.alias("steepness"), sign.alias("direction"))


@pandas_udf(CELL)
def cell_arrays(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    a = band_arrays()
    emphasis = np.array([HIGH_EMPHASIS if layer_of(b) == 2 else 1.0 for b in range(BANDS)])
    for coeffs, q, key_step, ftype in batches:
        c, ints = _stacked(coeffs)[:, : HOP - 1], _stacked(q)
        key = (ftype == "K").to_numpy()[:, None]
        raw = np.where(key, np.abs(ints) / MAX_LEVEL, np.abs(c) / (np.repeat(_stacked(key_step), a["size"], axis=1) * MAX_LEVEL + 1e-12))
        steep = np.minimum(1.0, np.minimum(1.0, raw) * np.repeat(emphasis, a["size"]))
        mean = np.add.reduceat(steep, a["start"], axis=1) / a["size"]
        sign = np.sign(np.add.reduceat(np.sign(np.where(key, ints, c)), a["start"], axis=1)).astype(np.int32)
        yield pd.DataFrame({"steepness": list(mean), "direction": list(sign)})


def cells(levels: DataFrame) -> DataFrame:
    """(track, frame, band, steepness, direction): a cell for every band of every frame, flat where it is silent."""
    df = with_key_steps(levels).withColumn("cell", F.when(F.col("ftype") != "S", cell_arrays("coeffs", "q", "key_step", "ftype")))
    flat = F.struct(F.array_repeat(F.lit(0.0), BANDS).alias("steepness"), F.array_repeat(F.lit(0), BANDS).alias("direction"))
    cell = F.coalesce("cell", flat)
    long = df.select("track", "frame", F.posexplode(F.arrays_zip(cell["steepness"].alias("s"), cell["direction"].alias("d"))).alias("band", "z"))
    return long.select("track", "frame", "band", F.round("z.s", 4).alias("steepness"), F.col("z.d").alias("direction"))


def residuals(analysis: DataFrame) -> DataFrame:
    """(track, frame, residual array): what interpolation between keyframes misses, of B frames."""
    df = key_neighbours(analysis).where("ftype = 'B'")
    between = lerp(F.col("before"), F.col("after"), F.col("gop_pos"))
    return df.select("track", "frame", F.zip_with("coeffs", between, lambda c, p: c - p).alias("residual"))


def residual_bands(analysis: DataFrame) -> DataFrame:
    """(track, frame, band, db)"""
    rms = residuals(analysis).select("track", "frame", band_rms("residual").alias("rms"))
    db = F.transform("rms", lambda r: F.greatest(20 * F.log10(r + F.lit(1e-12)), F.lit(-80.0)))
    return by_band(rms.select("track", "frame", db.alias("db")), "db")


def rebuilt(levels: DataFrame) -> DataFrame:
    """(track, frame, m, c): B frames from quantised keyframes and their own quantised residual."""
    # one lookup for both: coefficients in front, what their levels stand for behind
    both = levels.withColumn("coeffs", F.concat("coeffs", dequantised("q", "step")))
    df = key_neighbours(both).where("ftype = 'B'").withColumn("between", lerp(F.col("before"), F.col("after"), F.col("gop_pos")))
    residual = F.zip_with(F.slice("coeffs", 1, HOP), F.slice("between", 1, HOP), lambda c, p: c - p)
    return df.select("track", "frame", F.posexplode(rounded(F.slice("between", HOP + 1, HOP), residual, "step")).alias("m", "c"))


@pandas_udf(DOUBLES)
def dequantised(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    size = band_arrays()["size"]
    for q, step in batches:
        yield pd.Series(list(np.pad(_stacked(q) * np.repeat(_stacked(step), size, axis=1), ((0, 0), (0, 1)))))


@pandas_udf(DOUBLES)
def rounded(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """The bins of bands: base plus the residual in whole steps."""
    size = band_arrays()["size"]
    for base, residual, step in batches:
        per_bin = np.repeat(_stacked(step), size, axis=1)
        yield pd.Series(list(_stacked(base)[:, : HOP - 1] + np.rint(_stacked(residual)[:, : HOP - 1] / per_bin) * per_bin))


@pandas_udf(ArrayType(IntegerType()))
def code_lengths(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Bits that the prefix code takes for each band: levels, escapes, signs, and the end after the last level that isn't zero."""
    a, code = band_arrays(), code_table()
    length = np.array([len(code[i]) for i in range(MAX_LEVEL + 1)] + [len(code[ESCAPE]) + ESCAPE_BITS])
    place = np.concatenate([np.arange(n) for n in a["size"]])
    for column in batches:
        q = _stacked(column).astype(np.int64)
        last = np.maximum.reduceat(np.where(q != 0, place, -1), a["start"], axis=1)
        bits = length[np.minimum(np.abs(q), MAX_LEVEL + 1)] + (q != 0)
        bits = np.add.reduceat(np.where(place <= np.repeat(last, a["size"], axis=1), bits, 0), a["start"], axis=1)
        yield pd.Series(list((bits + np.where((last >= 0) & (last < a["size"] - 1), len(code[END_OF_BAND]), 0)).astype(np.int32)))


def band_peaks(levels: DataFrame) -> DataFrame:
    """(track, band, peak): the largest coefficient of each band, silent frames aside."""
    peaks = with_neighbours(levels).where("ftype <> 'S'").select("track", F.posexplode(peak_arrays("coeffs")).alias("band", "peak"))
    return peaks.groupBy("track", "band").agg(F.max("peak").alias("peak"))


@pandas_udf(DOUBLES)
def peak_arrays(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for column in batches:
        yield pd.Series(list(np.maximum.reduceat(np.abs(_stacked(column)[:, : HOP - 1]), band_arrays()["start"], axis=1)))

"""Signals from ordered tables: (track string, n bigint, x double)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def numbered(df: DataFrame, track: Column, order: list[Column], bucket: Column, value: Column) -> DataFrame:
    """Numbers the rows of each track from 0 in two phases: inside buckets, which follow the order, then by the
    counts of the buckets before. No task holds a whole track."""
    keyed = df.select(track.alias("track"), bucket.alias("bucket"), value.alias("x"), *(c.alias(f"o{i}") for i, c in enumerate(order)))
    counts = keyed.groupBy("track", "bucket").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("track").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select("track", "bucket", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("begin"))
    inside = F.row_number().over(Window.partitionBy("track", "bucket").orderBy(*(f"o{i}" for i in range(len(order)))))
    return keyed.withColumn("nth", inside).join(begins, ["track", "bucket"]).select("track", (F.col("begin") + F.col("nth") - 1).cast("long").alias("n"), "x")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "event_type", "value")


def event_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.least(F.lit(1.0), (F.col("value") - 50) / 500)
    return numbered(_events(spark, sf_dir), F.lit("all"), [F.col("ts"), F.col("event_id")], F.to_date("ts"), x)


def event_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(track, n) of the last sample of event_signal, by a count: nothing is numbered for it."""
    return _events(spark, sf_dir).groupBy(F.lit("all").alias("track")).agg((F.count("*") - 1).alias("n"))


def event_type_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.least(F.lit(1.0), (F.col("value") - 50) / 500)
    return numbered(_events(spark, sf_dir), F.col("event_type"), [F.col("ts"), F.col("event_id")], F.to_date("ts"), x)


#: frequency and amplitude of the three-tone mix
THREE_TONES = ((440.0, 0.5), (2000.0, 0.3), (9000.0, 0.2))


def tones(spark: SparkSession, n: int, parts: tuple[tuple[float, float], ...] = THREE_TONES, track: str = "tones", silent_from: int | None = None) -> DataFrame:
    """Closed-form sines; zero from silent_from on."""
    phase = F.col("id").cast("double") * (2 * 3.141592653589793 / 44100)
    x = sum((F.lit(a) * F.sin(phase * f) for f, a in parts), F.lit(0.0))
    if silent_from is not None:
        x = F.when(F.col("id") < silent_from, x).otherwise(0.0)
    return spark.range(n).select(F.lit(track).alias("track"), F.col("id").alias("n"), x.alias("x"))


def chirp(spark: SparkSession, n: int, low: float = 100.0, high: float = 20000.0, amplitude: float = 0.5, track: str = "chirp") -> DataFrame:
    t = F.col("id").cast("double") / 44100
    phase = 2 * 3.141592653589793 * (low * t + (high - low) / (2 * n / 44100) * t * t)
    return spark.range(n).select(F.lit(track).alias("track"), F.col("id").alias("n"), (amplitude * F.sin(phase)).alias("x"))


def noise(spark: SparkSession, n: int, amplitude: float = 0.1, seed: int = 42, track: str = "noise") -> DataFrame:
    """White noise: each sample is normal, decided by its number and the seed, however the rows are dealt."""
    even = lambda k: (F.pmod(F.xxhash64("id", F.lit(seed + k)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    x = amplitude * F.sqrt(-2 * F.log(even(0))) * F.cos(2 * 3.141592653589793 * even(1))
    return spark.range(n).select(F.lit(track).alias("track"), F.col("id").alias("n"), x.alias("x"))


def ramp(spark: SparkSession, n: int, track: str = "ramp") -> DataFrame:
    """440 Hz in the first half, silence after."""
    return tones(spark, n, ((440.0, 0.5),), track, n // 2)

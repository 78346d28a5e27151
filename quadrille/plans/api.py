"""What a user calls: encode, decode, layout, info, bench, live, camera."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quadrille.functions.dims import FRAME_MS, band_table
from quadrille.operators import codec
from quadrille.sources import container, layout as documents, wav


def encode(spark: SparkSession, path: str, kbps: float = 12.0, mode: int = 1) -> DataFrame:
    """WAV files at path -> (track, payload): containers."""
    return container.to_containers(codec.encode(wav.read_wav(spark, path), kbps), kbps, mode)


def decode(spark: SparkSession, path: str, layers: tuple[int, ...] = (0, 1, 2), alpha: float | None = None, reverse: bool = False, speed: float = 1.0) -> DataFrame:
    """Containers at path -> (track, n, x); only the layers asked for are read."""
    container.register(spark)
    frames = spark.read.format("quadrille").option("layers", ",".join(map(str, layers))).load(path)
    return codec.decode(frames, layers, None if alpha is None else [alpha] * 48, reverse, speed)


def info(files: DataFrame) -> DataFrame:
    """(track, payload) -> what the headers say, and whether the checksums hold."""
    number = lambda at, n: F.conv(F.concat(*(F.hex(F.expr(f"substring(payload, {at + i}, 1)")) for i in reversed(range(n)))), 16, 10).cast("long")
    offsets = [number(at, 4) for at in (17, 21, 25, 29)]
    mode = F.when(number(6, 1) == 1, "discrete").when(number(6, 1) == 2, "gradient").otherwise("unknown")
    facts = files.select("track", number(5, 1).alias("version"), mode.alias("mode"), number(7, 4).alias("sample_rate"), number(11, 4).alias("n_frames"), number(15, 2).alias("bitrate_kbps"), (number(11, 4) * FRAME_MS / 1000).alias("duration_s"), *((offsets[i + 1] - offsets[i]).alias(f"layer{i}_bytes") for i in range(3)), F.length("payload").alias("file_bytes"))
    facts = facts.withColumn("kbps", F.col("file_bytes") * 8 / F.col("duration_s") / 1000)
    return facts.join(container.checked(files).select("track", "crc_ok"), "track")


def layout(frames: DataFrame, mode: int = 1) -> DataFrame:
    """Encoded frames -> (track, document): cells of all bands as JSON. Mode 1 scales levels by the step of the keyframe
    before, mode 2 by the band's peak."""
    spark = frames.sparkSession
    coeffs = codec.decoded_coeffs(frames).select("track", "frame", F.posexplode("coeffs").alias("m", "c"))
    from quadrille.functions.dims import bin_table

    dots = coeffs.join(F.broadcast(bin_table(spark)), "m").join(F.broadcast(band_table(spark).select("band", "layer")), "band").join(frames.select("track", "frame", "ftype", "q", "steps"), ["track", "frame"]).where("ftype <> 'S'")
    if mode == 2:
        scale = dots.groupBy("track", "band").agg(F.max(F.abs("c")).alias("scale"))
        dots = dots.join(scale, ["track", "band"])
    else:
        from pyspark.sql import Window

        before = Window.partitionBy("track").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
        steps = frames.select("track", "frame", F.last(F.when(F.col("ftype") == "K", F.col("steps")), ignorenulls=True).over(before).alias("key_steps"))
        dots = dots.join(steps, ["track", "frame"]).withColumn("scale", F.get("key_steps", "band").cast("float").cast("double") * 31)
    raw = F.least(F.lit(1.0), F.abs("c") / (F.col("scale") + 1e-12))
    steep = F.least(F.lit(1.0), raw * F.when(F.col("layer") == 2, 1.15).otherwise(1.0))
    cells = dots.groupBy("track", "frame", "band").agg(F.round(F.avg(steep), 4).alias("steepness"), F.signum(F.sum(F.signum("c"))).cast("int").alias("direction"))
    grid = frames.select("track", "frame").crossJoin(F.broadcast(band_table(spark).select("band")))
    full = grid.join(cells, ["track", "frame", "band"], "left").fillna(0, ["steepness", "direction"])
    return documents.to_documents(full, band_table(spark))


def bench(signal: DataFrame, rates: tuple[float, ...] = (6.0, 12.0, 32.0, 96.0)) -> DataFrame:
    """(track, snr at each rate): rows of signals, columns of rates."""
    out = None
    for kbps in rates:
        row = codec.snr(signal, codec.decode(codec.encode(signal, kbps))).select("track", F.lit(kbps).alias("kbps"), "snr_db")
        out = row if out is None else out.unionByName(row)
    return out.groupBy("track").pivot("kbps", list(rates)).agg(F.first("snr_db"))


def write_results(reads: DataFrame, path: str) -> None:
    """What was read, a JSON object a line."""
    reads.write.mode("overwrite").json(path)


def write_csv(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").option("header", True).csv(path)

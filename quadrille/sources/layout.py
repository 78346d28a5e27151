"""Layout documents: cells as nested JSON and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

SCHEMA = "track string, n_frames int, n_bands int, frames array<struct<frame_idx:int,silence:boolean,bands:array<struct<band:int,color_a:string,color_b:string,steepness:double,direction:int>>>>"


def to_documents(cells: DataFrame, bands: DataFrame) -> DataFrame:
    """(track, document): cells with their pairs of colours; frames without cells hold an empty list."""
    named = cells.join(F.broadcast(bands.select("band", "color_a", "color_b")), "band")
    frames = named.groupBy("track", "frame").agg(F.array_sort(F.collect_list(F.struct("band", "color_a", "color_b", F.round("steepness", 4).alias("steepness"), "direction"))).alias("bands"))
    whole = frames.groupBy("track").agg(F.array_sort(F.collect_list(F.struct(F.col("frame").alias("frame_idx"), F.forall("bands", lambda b: b["direction"] == 0).alias("silence"), "bands"))).alias("frames"))
    return whole.select("track", F.to_json(F.struct("track", F.size("frames").alias("n_frames"), F.lit(48).alias("n_bands"), "frames")).alias("document"))


def from_documents(documents: DataFrame) -> DataFrame:
    """(track, frame, band, steepness, direction)"""
    d = documents.select(F.from_json("document", SCHEMA).alias("d")).select("d.track", F.explode("d.frames").alias("f"))
    return d.select("track", F.col("f.frame_idx").alias("frame"), F.explode("f.bands").alias("b")).select("track", "frame", "b.band", "b.steepness", "b.direction")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    return from_documents(spark.read.text(path, wholetext=True).select(F.lit(None).cast("string").alias("track"), F.col("value").alias("document")))

"""Queries that go out and come back: coding, containers, files, layouts, and the budget fit."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from quadrille.catalog import query
from quadrille.functions.dims import band_table
from quadrille.operators import codec
from quadrille.operators.framing import analysed
from quadrille.plans import api, dialect
from quadrille.plans.base import RELATIONS, oracle, run
from quadrille.sources import container, layout, signals, wav


RATES = (6.0, 12.0, 32.0, 96.0)


def _encoded(spark: SparkSession, sf_dir: str, kbps: float = 12.0) -> DataFrame:
    return codec.encode(signals.event_signal(spark, sf_dir), kbps)


@query("budget_fit")
def budget_fit(spark, sf_dir):
    return _encoded(spark, sf_dir).select("track", "frame", "ftype", "gop_pos", *(F.col("bits")[i].alias(f"bits_l{i}") for i in range(3)))


@query("encode_levels")
def encode_levels(spark, sf_dir):
    return _encoded(spark, sf_dir).select("track", "frame", "ftype", F.posexplode("q").alias("m", "q"))


@query("decode_samples")
def decode_samples(spark, sf_dir):
    return codec.decode(_encoded(spark, sf_dir)).select("track", "n", F.round("x", 6).alias("x"))


@query("decode_layers")
def decode_layers(spark, sf_dir):
    return codec.decode(_encoded(spark, sf_dir), layers=(0, 1)).select("track", "n", F.round("x", 6).alias("x"))


@query("decode_reversed_double")
def decode_reversed_double(spark, sf_dir):
    return codec.decode(_encoded(spark, sf_dir), speed=-2.0).select("track", "n", F.round("x", 6).alias("x"))


@query("roundtrip_snr")
def roundtrip_snr(spark, sf_dir):
    signal = signals.event_type_signal(spark, sf_dir).unionByName(signals.tones(spark, 16 * 1024)).unionByName(signals.chirp(spark, 16 * 1024))
    return codec.snr(signal, codec.decode(codec.encode(signal, 32.0)))


@query("snr_matrix")
def snr_matrix(spark, sf_dir):
    """Signals by bitrates: a second of each generated signal, coded and decoded."""
    n = 44100
    kinds = [signals.tones(spark, n, ((hz, 0.5),), f"tone{hz:.0f}") for hz in (440.0, 1000.0, 4000.0)]
    kinds += [signals.tones(spark, n), signals.noise(spark, n), signals.chirp(spark, n)]
    report = api.bench(reduce(DataFrame.unionByName, kinds), RATES)
    return report.select("track", *(F.col(f"`{r}`").alias(f"snr_{r:.0f}") for r in RATES))


@query("huffman_roundtrip", "SELECT 'all' AS track, TRUE AS same, CAST((count(*) + 1024) // 1024 + 1 AS BIGINT) AS frames FROM events")
def huffman_roundtrip(spark, sf_dir):
    frames = _encoded(spark, sf_dir)
    back = container.from_containers(container.to_containers(frames)).select("track", "frame", F.col("q").alias("q2"), F.col("ftype").alias("f2"))
    both = frames.join(back, ["track", "frame"])
    return both.groupBy("track").agg(F.min((F.col("q") == F.col("q2")) & (F.col("ftype") == F.col("f2"))).alias("same"), F.count("*").alias("frames"))


@query("crc_check", "SELECT 'all' AS track, TRUE AS crc_ok")
def crc_check(spark, sf_dir):
    return container.checked(container.to_containers(_encoded(spark, sf_dir))).select("track", "crc_ok")


@query("container_info")
def container_info(spark, sf_dir):
    files = container.to_containers(_encoded(spark, sf_dir))
    u32 = lambda at: F.conv(F.concat(*(F.hex(F.expr(f"substring(payload, {at + i}, 1)")) for i in (3, 2, 1, 0))), 16, 10).cast("long")
    offsets = [u32(at) for at in (17, 21, 25, 29)]
    return files.select("track", u32(7).alias("sample_rate"), u32(11).alias("n_frames"), (u32(11) * 1024 / F.lit(44100.0)).alias("duration_s"), *((offsets[i + 1] - offsets[i]).alias(f"layer{i}_bytes") for i in range(3)), F.length("payload").alias("file_bytes"))


@query("wav_roundtrip", "SELECT event_type AS track, count(*) AS samples, TRUE AS close FROM events GROUP BY event_type")
def wav_roundtrip(spark, sf_dir):
    signal = signals.event_type_signal(spark, sf_dir)

    def rows(batches):
        import pandas as pd

        for batch in batches:
            for track, payload in zip(batch["track"], batch["payload"]):
                x = wav.samples(payload)
                yield pd.DataFrame({"track": track, "n": np.arange(len(x)), "y": x})

    back = wav.to_wav(signal).mapInPandas(rows, "track string, n long, y double")
    close = F.abs(F.greatest(F.lit(-1.0), F.col("x")) - F.col("y")) < 1e-4
    return signal.join(back, ["track", "n"]).groupBy("track").agg(F.count("*").alias("samples"), F.min(close).alias("close"))


_CELLS = "SELECT track, frame, band, steepness, direction FROM cells"


@query("layout_json_roundtrip", oracle(_CELLS))
def layout_json_roundtrip(spark, sf_dir):
    return layout.from_documents(layout.to_documents(run(spark, sf_dir, _CELLS), band_table(spark)))


# the same relations over tracks by event type
_BY_TYPE = oracle("SELECT track, frame, ftype, round(energy, 6) AS energy, CAST(1024 AS INT) AS n FROM frames").replace(dialect.duck(RELATIONS["signal"].sql), dialect.duck(RELATIONS["type_signal"].sql))


@query("analysis_rows", _BY_TYPE)
def analysis_rows(spark, sf_dir):
    return analysed(signals.event_type_signal(spark, sf_dir)).select("track", "frame", "ftype", F.round("energy", 6).alias("energy"), F.size("coeffs").alias("n"))

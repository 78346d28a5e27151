"""python -m quadrille encode|decode|layout|info|bench"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession, functions as F

from quadrille.operators import codec
from quadrille.plans import api
from quadrille.sources import container, signals, wav


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quadrille", description="Codec and layouts over files, on Spark")
    sub = p.add_subparsers(dest="command", required=True)
    for name, text in (("encode", "WAV files to containers"), ("decode", "containers to WAV files"), ("layout", "containers to layout documents")):
        c = sub.add_parser(name, help=text)
        c.add_argument("source")
        c.add_argument("target")
    sub.choices["encode"].add_argument("-b", "--bitrate", type=float, default=12.0)
    sub.choices["encode"].add_argument("--mode", type=int, choices=(1, 2), default=1)
    decode = sub.choices["decode"]
    decode.add_argument("--layers", default="0,1,2")
    decode.add_argument("--alpha", type=float)
    decode.add_argument("--reverse", action="store_true")
    decode.add_argument("--speed", type=float, default=1.0)
    sub.choices["layout"].add_argument("--mode", type=int, choices=(1, 2), default=1)
    sub.add_parser("info", help="what headers say").add_argument("source")
    sub.add_parser("bench", help="signal-to-noise ratios of made-up signals").add_argument("target")
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("quadrille").getOrCreate()
    if a.command == "encode":
        api.encode(spark, a.source, a.bitrate, a.mode).write.mode("overwrite").parquet(a.target)
    elif a.command == "decode":
        files = spark.read.parquet(a.source)
        layers = tuple(int(x) for x in a.layers.split(","))
        samples = codec.decode(container.from_containers(files, layers), layers, None if a.alpha is None else [a.alpha] * 48, a.reverse, a.speed)
        wav.to_wav(samples).write.mode("overwrite").parquet(a.target)
    elif a.command == "layout":
        api.layout(container.from_containers(spark.read.parquet(a.source)), a.mode).select("document").write.mode("overwrite").text(a.target)
    elif a.command == "info":
        api.info(spark.read.parquet(a.source)).show(truncate=False)
    else:
        n = 2 * 44100
        both = signals.tones(spark, n).unionByName(signals.chirp(spark, n)).withColumn("x", F.col("x"))
        api.write_csv(api.bench(both), a.target)


if __name__ == "__main__":
    main()

"""Connected components of links, as stars, in Spark and inside one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quadrille.llm.spark_io import written


def join_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each the smallest place of its component) after the links a-b are added."""
    while True:
        apart = labels[a] != labels[b]
        if not apart.any():
            return labels
        a, b = a[apart], b[apart]
        low, high = np.minimum(labels[a], labels[b]), np.maximum(labels[a], labels[b])
        np.minimum.at(labels, high, low)
        while (labels != (hop := labels[labels])).any():
            labels = hop


#: Links that one task joins, 16 bytes each; of more, rounds over the whole cluster make stars.
IN_TASK = 1 << 18


def stars(links: DataFrame, most_rounds: int = 64, in_task: int = IN_TASK) -> DataFrame:
    """Links (u, v) of longs turned into stars (u, v): v is the smallest node of u's component, u != v.

    Few links are joined by one task. Many go through rounds that alternate the large-star and the small-star step, each a
    grouped minimum joined back, until the links no longer change; every round is written, so lineage stays short.
    Rounds grow as the logarithm of the longest path."""
    now = written(_oriented(links), "links")
    seen = _digest(now)
    if seen[0] <= in_task:
        return now.coalesce(1).mapInArrow(_joined, "u long, v long")
    for _ in range(most_rounds):
        now = written(_small(_large(now)), "links")
        fresh = _digest(now)
        if fresh == seen:
            return now
        seen = fresh
    raise RuntimeError("components did not settle")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [[b.column(i).to_numpy(zero_copy_only=False) for i in range(2)] for b in batches]
    if parts:
        u, v = (np.concatenate([p[i] for p in parts]) for i in range(2))
        nodes, places = np.unique(np.concatenate((u, v)), return_inverse=True)
        labels = join_labels(np.arange(len(nodes)), places[: len(u)], places[len(u) :])
        tied = np.flatnonzero(labels != np.arange(len(labels)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[tied]), pa.array(nodes[labels[tied]])], names=["u", "v"])


def _oriented(links: DataFrame) -> DataFrame:
    return links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _large(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return _oriented(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small(links: DataFrame) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    return _oriented(links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))))


def _digest(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

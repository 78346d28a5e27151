"""Images as tables: components of masks, perspective, colour calibration."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F


def runs(mask: DataFrame) -> DataFrame:
    """(img, y, x) -> (img, y, x0, x1): stretches of each row, by gaps and islands."""
    nth = mask.selectExpr("img", "y", "x", "x - row_number() OVER (PARTITION BY img, y ORDER BY x) AS island")
    return nth.groupBy("img", "y", "island").agg(F.expr("min(x) AS x0"), F.expr("max(x) AS x1")).drop("island")


#: Runs that one task joins; more are joined in rounds over the whole cluster.
IN_TASK = 1 << 16


def components(mask: DataFrame, in_task: int = IN_TASK) -> DataFrame:
    """(img, y, x0, x1, label): runs that touch share the smallest label. Few runs are joined by one task; of many, labels
    are halved in distance by hopping over labels of labels, and every round is a checkpoint."""
    spark = mask.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        import tempfile

        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="quadrille-"))
    node = runs(mask).where("img IS NOT NULL").selectExpr("*", "shiftleft(CAST(y AS BIGINT), 32) + x0 AS id").checkpoint()
    if node.count() <= in_task:
        kinds = ", ".join(f"{c} {node.schema[c].dataType.simpleString()}" for c in ("img", "y", "x0", "x1"))
        return node.coalesce(1).mapInPandas(_joined, f"{kinds}, label long")
    a, b = node.alias("a"), node.alias("b")
    touch = a.join(b, (F.col("a.img") == F.col("b.img")) & (F.col("b.y") == F.col("a.y") + 1) & (F.col("b.x0") <= F.col("a.x1")) & (F.col("b.x1") >= F.col("a.x0")))
    links = touch.select(F.col("a.img").alias("img"), F.col("a.id").alias("u"), F.col("b.id").alias("v"))
    links = links.union(links.select("img", "v", "u")).checkpoint()
    labels = node.select("img", "id", F.col("id").alias("label")).checkpoint()
    while True:
        near = links.join(labels.select("img", F.col("id").alias("v"), "label"), ["img", "v"]).groupBy("img", "u").agg(F.min("label").alias("near"))
        low = labels.join(near.withColumnRenamed("u", "id"), ["img", "id"], "left").select("img", "id", F.least("label", F.coalesce("near", "label")).alias("low"), "label")
        hop = low.select("img", F.col("id").alias("low"), F.col("low").alias("lower"))
        fresh = low.join(hop, ["img", "low"], "left").select("img", "id", F.coalesce("lower", "low").alias("label"), (F.coalesce("lower", "low") != F.col("label")).alias("moved")).checkpoint()
        labels = fresh.drop("moved")
        if not fresh.where("moved").limit(1).count():
            return node.join(labels, ["img", "id"]).select("img", "y", "x0", "x1", "label")


def _joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Labels all runs of a table: those of a row are sorted and apart, so what touches one in the next row is a stretch."""
    if not (parts := [b for b in batches if len(b)]):
        return
    all_runs = pd.concat(parts).sort_values(["img", "id"], ignore_index=True)
    img, y, x0, x1 = pd.factorize(all_runs["img"])[0], *(all_runs[c].to_numpy(np.int64) for c in ("y", "x0", "x1"))
    begins = np.append(True, (img[1:] != img[:-1]) | (y[1:] != y[:-1]))[: len(img)]
    row, first = np.cumsum(begins) - 1, np.flatnonzero(begins)
    follows = np.append((img[first[1:]] == img[first[:-1]]) & (y[first[1:]] == y[first[:-1]] + 1), False)[: len(first)]
    at = lambda r, x: (r << 32) + x - x0.min()
    above = np.flatnonzero(follows[row])
    lo = np.searchsorted(at(row, x1), at(row[above] + 1, x0[above]), "left")
    hi = np.searchsorted(at(row, x0), at(row[above] + 1, x1[above]), "right")
    n = hi - lo
    u, v = np.repeat(above, n), np.arange(n.sum()) + np.repeat(lo - np.cumsum(n) + n, n)
    labels = np.arange(len(img))
    while (apart := labels[u] != labels[v]).any():
        u, v = u[apart], v[apart]
        np.minimum.at(labels, np.maximum(labels[u], labels[v]), np.minimum(labels[u], labels[v]))
        while (labels != (hop := labels[labels])).any():
            labels = hop
    yield all_runs[["img", "y", "x0", "x1"]].assign(label=all_runs["id"].to_numpy()[labels])


def blobs(labelled: DataFrame) -> DataFrame:
    """(img, label, area, cx, cy, aspect)"""
    n = "(x1 - x0 + 1)"
    sums = {"area": f"sum{n}", "cx": f"sum((x0 + x1) / 2 * {n}) / sum{n}", "cy": f"sum(y * {n}) / sum{n}", "aspect": "(max(x1) - min(x0) + 1) / (max(y) - min(y) + 1)"}
    return labelled.groupBy("img", "label").agg(*(F.expr(f"{v} AS {k}") for k, v in sums.items()))


def homography(source: list[tuple[float, float]], target: list[tuple[float, float]]) -> np.ndarray:
    """The 3 x 3 map that takes four points to four others."""
    rows, right = [], []
    for (x, y), (u, v) in zip(source, target):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    return np.append(np.linalg.solve(np.array(rows, float), np.array(right, float)), 1.0).reshape(3, 3)


def warp(pixels: DataFrame, h: np.ndarray, width: int, height: int) -> DataFrame:
    """(img, y, x, r, g, b) looked up bilinearly at h of each place of a width x height image: each place asks for its
    four neighbours, an equi-join, and sums what it gets."""
    grid = pixels.select("img").distinct().crossJoin(pixels.sparkSession.range(width * height))
    x, y = F.pmod("id", F.lit(width)).cast("int"), F.floor(F.col("id") / width).cast("int")
    w = h[2, 0] * x + h[2, 1] * y + h[2, 2]
    at = grid.select("img", x.alias("x"), y.alias("y"), ((h[0, 0] * x + h[0, 1] * y + h[0, 2]) / w).alias("u"), ((h[1, 0] * x + h[1, 1] * y + h[1, 2]) / w).alias("v"))
    fu, fv = F.col("u") - F.floor("u"), F.col("v") - F.floor("v")
    corners = F.array(*(F.struct((F.floor("u") + i).cast("int").alias("px"), (F.floor("v") + j).cast("int").alias("py"), ((fu if i else 1 - fu) * (fv if j else 1 - fv)).alias("w")) for i in (0, 1) for j in (0, 1)))
    asked = at.select("img", "x", "y", F.explode(corners).alias("c")).select("img", "x", "y", "c.px", "c.py", "c.w")
    source = pixels.select("img", F.col("x").alias("px"), F.col("y").alias("py"), "r", "g", "b")
    return asked.join(source, ["img", "px", "py"]).groupBy("img", "y", "x").agg(*((F.sum(F.col("w") * F.col(c)) / F.sum("w")).alias(c) for c in "rgb"))


def calibration(observed: np.ndarray, canonical: np.ndarray, least: float = 0.5) -> np.ndarray:
    """The affine map (3 x 4) of Lab colours by least squares over patches that are near enough; identity below six."""
    near = np.maximum(0.0, 1.0 - np.linalg.norm(observed - canonical, axis=1) / 100.0) >= least
    if near.sum() < 6:
        return np.eye(3, 4)
    padded = np.hstack((observed[near], np.ones((int(near.sum()), 1))))
    return np.linalg.lstsq(padded, canonical[near], rcond=None)[0].T

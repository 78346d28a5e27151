"""Reading a photograph of a strip: marks, the quadrilateral they make, its perspective, and the cells inside.

A photograph is a table of pixels (img, y, x, r, g, b). Marks are found by colour, joined to components, and the best
four of them give the map from the strip to the photograph; cells are then read where they lie in the photograph, so
that no pixel but those around the sample points is looked up."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from quadrille.operators.geometry import blobs, components, homography

#: Candidates for the four marks.
MOST_MARKS = 20
LEAST_AREA, LEAST_ASPECT, MOST_SHARE = 9, 0.35, 0.15


def marks(pixels: DataFrame) -> DataFrame:
    """(img, y, x, ...) of magenta pixels, all but their colour."""
    return pixels.where("r > 200 AND g < 50 AND b > 200").drop(*"rgb")


def may_blend_to_mark(a: tuple[int, int, int], b: tuple[int, int, int]) -> bool:
    """Whether `marks` may take a colour on the way from a to b for a mark; a level is allowed for rounding."""
    lo, hi = 0.0, 1.0
    for p, q, sign, bound in zip(a, b, (1, -1, 1), (200, -51, 200)):  # sign * (p + (q - p) * t) >= bound
        start, slope = sign * p - bound, sign * (q - p)
        if slope > 0:
            lo = max(lo, -start / slope)
        elif slope < 0:
            hi = min(hi, -start / slope)
        elif start < 0:
            return False
    return lo <= hi


def mark_blobs(pixels: DataFrame) -> DataFrame:
    """(img, label, area, cx, cy, aspect) of connected marks."""
    return joined(marks(pixels))


def joined(found: DataFrame) -> DataFrame:
    """(img, label, area, cx, cy, aspect) of marks (img, y, x) that touch."""
    return blobs(components(found))


def likely(found: DataFrame, sizes: DataFrame) -> DataFrame:
    """The blobs that may be marks - square, neither specks nor a large part of the image - and their place by area.
    sizes: (img, width, height)."""
    shaped = f"area >= {LEAST_AREA} AND area <= {MOST_SHARE}e0 * width * height AND least(aspect, 1 / aspect) >= {LEAST_ASPECT}e0"
    return found.join(sizes, "img").where(shaped).selectExpr("*", "row_number() OVER (PARTITION BY img ORDER BY area DESC, label) AS place").where(f"place <= {MOST_MARKS}")


_MIDDLE = {c: f"((a.{c} + b.{c} + c.{c} + d.{c}) / 4)" for c in ("cx", "cy")}
_QUAD = ", ".join(f"named_struct('angle', atan2({p}.cy - {_MIDDLE['cy']}, {p}.cx - {_MIDDLE['cx']}), 'cx', {p}.cx, 'cy', {p}.cy, 'label', {p}.label)" for p in "abcd")
_AREA = " + ".join(f"(quad[{i}].cx * quad[{(i + 1) % 4}].cy - quad[{i}].cy * quad[{(i + 1) % 4}].cx)" for i in range(4))
_SPAN = {c: f"greatest(a.{c}, b.{c}, c.{c}, d.{c}) - least(a.{c}, b.{c}, c.{c}, d.{c})" for c in ("cx", "cy")}


def quadrilaterals(candidates: DataFrame) -> DataFrame:
    """(img, score, quad) of every four candidates (img, wanted, place, label, cx, cy): the shoelace area, less the
    further its sides are from the wanted aspect; the points of a quad are in the order of their angles about their middle.
    The few candidates of an image lie in an array that fours are taken from, so no table is joined with itself."""
    four = candidates.where("img IS NOT NULL").groupBy("img", "wanted").agg(F.expr("collect_list(struct(place, label, cx, cy)) AS ps")).selectExpr("img", "wanted", "ps", "explode(ps) AS a")
    for last, following in zip("abc", "bcd"):
        four = four.selectExpr("*", f"explode(filter(ps, p -> p.place > {last}.place)) AS {following}")
    sized = four.selectExpr("img", "wanted", f"array_sort(array({_QUAD})) AS quad", f"{_SPAN['cx']} AS w", f"{_SPAN['cy']} AS h").selectExpr("*", f"abs({_AREA}) / 2 AS area")
    return sized.where("area >= 1 AND h >= 1").selectExpr("img", "area * exp(-abs(ln(w / h / wanted))) AS score", "quad")


def best_quadrilateral(scored: DataFrame) -> DataFrame:
    """(img, score, quad): the best of each image, the first labels on ties."""
    place = "row_number() OVER (PARTITION BY img ORDER BY score DESC, array_sort(transform(quad, p -> p.label))) AS n"
    return scored.selectExpr("*", place).where("n = 1").select("img", "score", "quad")


def corners(best: DataFrame) -> DataFrame:
    """(img, corner, cx, cy, label): the two highest are the top, and of two the left one has the smaller x. Four points
    are sorted inside their row."""
    by_height = "array_sort(transform(quad, p -> struct(p.cy, p.label, p.cx)))"
    points = best.selectExpr("img", f"posexplode(array_sort(transform({by_height}, (p, i) -> struct(i >= 2 AS low, p.cx, p.label, p.cy)))) AS (i, p)")
    return points.selectExpr("img", "element_at(array('TL', 'TR', 'BL', 'BR'), i + 1) AS corner", "p.cx", "p.cy", "p.label")


def solved(found: DataFrame) -> DataFrame:
    """(img, h array of 9): the map that takes the unit square to the corners; images without four are left out."""

    def one(key, rows: pd.DataFrame) -> pd.DataFrame:
        at = {c: (x, y) for c, x, y in zip(rows["corner"], rows["cx"], rows["cy"])}
        if len(at) < 4:
            return pd.DataFrame({"img": [], "h": []})
        h = homography([(0, 0), (1, 0), (1, 1), (0, 1)], [at[c] for c in ("TL", "TR", "BR", "BL")])
        return pd.DataFrame({"img": [key[0]], "h": [h.ravel().tolist()]})

    return found.groupBy("img").applyInPandas(one, "img string, h array<double>")


def mapped(points: DataFrame) -> DataFrame:
    """points (img, ..., s, t in the unit square, h) with u and v, where the map h takes them, in place of h."""
    row = lambda i: f"(h[{3 * i}] * s + h[{3 * i + 1}] * t + h[{3 * i + 2}])"
    return points.selectExpr("*", f"{row(0)} / {row(2)} AS u", f"{row(1)} / {row(2)} AS v").drop("h")


def placed(points: DataFrame, maps: DataFrame) -> DataFrame:
    """points (img, ..., s, t in the unit square) with u and v, where they lie in the photograph."""
    return mapped(points.join(maps, "img"))


def sampled(points: DataFrame, pixels: DataFrame | Callable[[DataFrame], DataFrame]) -> DataFrame:
    """points (img, ..., u, v) with r, g, b: each asks for its four neighbours, an equi-join, and sums what it gets.
    pixels: a table, or what adds r, g, b to places (img, y, x, ...) and leaves out those outside of the photograph."""
    keys = points.columns
    fu, fv = F.col("u") - F.floor("u"), F.col("v") - F.floor("v")
    near = F.array(*(F.struct((F.floor("u") + i).cast("int").alias("x"), (F.floor("v") + j).cast("int").alias("y"), ((fu if i else 1 - fu) * (fv if j else 1 - fv)).alias("w")) for i in (0, 1) for j in (0, 1)))
    asked = points.select(*keys, F.explode(near).alias("c")).select(*keys, "c.x", "c.y", "c.w")
    met = pixels(asked) if callable(pixels) else asked.join(pixels.select("img", "y", "x", "r", "g", "b"), ["img", "y", "x"])
    return met.groupBy(*keys).agg(*((F.sum(F.col("w") * F.col(c)) / F.sum("w")).alias(c) for c in "rgb"))


def noisy(pixels: DataFrame, sigma: float, seed: int = 42) -> DataFrame:
    """Gaussian noise on every channel, drawn anew for each pixel and clipped."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for c, salt in zip("rgb", (1, 2, 3)):
                # two uniform numbers from the pixel's place: the same whatever the partitions are
                key = (part["y"].to_numpy(np.uint64) << np.uint64(32)) + part["x"].to_numpy(np.uint64)
                a, b = _uniform(key, 2 * salt + seed * 8), _uniform(key, 2 * salt + 1 + seed * 8)
                part[c] = np.clip(np.rint(part[c] + sigma * np.sqrt(-2 * np.log(a)) * np.cos(2 * np.pi * b)), 0, 255).astype(int)
            yield part

    return pixels.mapInPandas(rows, pixels.schema)


def _uniform(key: np.ndarray, salt: int) -> np.ndarray:
    x = key + np.uint64(salt) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) * 2.0**-53 + 2.0**-54


def blurred(pixels: DataFrame, radius: float) -> DataFrame:
    """A Gaussian blur: a pass along each axis, in which every pixel hands its share to those around it."""
    reach = max(1, int(3 * radius + 0.5))
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / radius) ** 2)
    shares = F.array(*(F.struct(F.lit(k - reach).alias("d"), F.lit(float(w)).alias("w")) for k, w in enumerate(weights)))
    out = pixels
    for axis in ("x", "y"):
        edge = out.groupBy("img").agg(F.max(axis).alias("edge"))
        handed = out.withColumn("p", F.explode(shares)).withColumn(axis, F.col(axis) + F.col("p.d")).where(F.col(axis) >= 0)
        sums = handed.groupBy("img", "y", "x").agg(*((F.sum(F.col("p.w") * F.col(c)) / F.sum("p.w")).alias(c) for c in "rgb"))
        out = sums.join(edge, "img").where(F.col(axis) <= F.col("edge")).drop("edge")
    return out.select("img", "y", "x", *(F.rint(c).cast("int").alias(c) for c in "rgb"))

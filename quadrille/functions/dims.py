"""Fixed dimensions of the codec: bands, spreading, palette, code table."""

from __future__ import annotations

import heapq
import math
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession

# fixed values of the format
SAMPLE_RATE, FRAME, HOP, GOP = 44100, 2048, 1024, 8
LAYER_BANDS = (8, 16, 24)
BANDS = sum(LAYER_BANDS)
FLOOR_DB, SILENCE_DB = -80.0, -55.0
HEADROOM_DB, MIN_STEP, MAX_QUANT = 3.0, 1e-7, 2047
BUDGET_FACTOR, BAND_HEADER_BITS = 2.0, 2.0
DECAY_SECONDS = 0.060
MAX_LEVEL, HIGH_EMPHASIS, DIRECTION_THRESHOLD = 31, 1.15, 0.008
CODE_DECAY, ESCAPE, END_OF_BAND, ESCAPE_BITS = 0.4, 32, 33, 12
FRAME_MS = 1000.0 * HOP / SAMPLE_RATE
DECAY_PER_FRAME = math.exp(-FRAME_MS / 1000.0 / DECAY_SECONDS)
FRAMES_PER_SECOND = SAMPLE_RATE / HOP

# fixed values: palette and the pairs that bands of a layer go through in turn
PALETTE = {
    "black": (0, 0, 0),
    "white": (255, 255, 255),
    "red": (220, 50, 50),
    "green": (50, 180, 50),
    "blue": (50, 50, 220),
    "yellow": (240, 220, 0),
    "cyan": (0, 210, 210),
    "purple": (160, 50, 200),
}
LAYER_PAIRS = (
    (("black", "white"), ("blue", "yellow"), ("black", "yellow")),
    (("black", "white"), ("green", "purple"), ("blue", "yellow")),
    (("black", "white"), ("green", "purple"), ("blue", "yellow"), ("black", "yellow"), ("yellow", "purple"), ("red", "green"), ("black", "cyan"), ("green", "blue")),
)
#: By layer: least colour difference, least step, pairs to pick.
LAYER_LIMITS = ((70.0, 5.0, 3), (55.0, 3.5, 3), (40.0, 2.0, 8))

#: SQL for the bands, which both engines run: i, layer, local, lo, hi.
BAND_SQL = """
    SELECT i AS band, CASE WHEN i < 8 THEN 0 WHEN i < 24 THEN 1 ELSE 2 END AS layer,
      CASE WHEN i < 8 THEN i WHEN i < 24 THEN i - 8 ELSE i - 24 END AS local_band,
      CASE WHEN i < 8 THEN 20e0 + 780e0 * i / 8e0 WHEN i < 24 THEN 800e0 * pow(7.5e0, (i - 8) / 16e0) ELSE 6000e0 * pow(3.675e0, (i - 24) / 24e0) END AS hz_lo,
      CASE WHEN i < 7 THEN 20e0 + 780e0 * (i + 1) / 8e0 WHEN i < 24 THEN 800e0 * pow(7.5e0, (i - 7) / 16e0) ELSE 6000e0 * pow(3.675e0, (i - 23) / 24e0) END AS hz_hi
    FROM RANGE(0, 48) t"""


@lru_cache(maxsize=1)
def band_edges() -> tuple[tuple[float, float], ...]:
    def edge(i: int) -> float:
        if i <= 8:
            return 20.0 + 780.0 * i / 8
        return 800.0 * 7.5 ** ((i - 8) / 16) if i <= 24 else 6000.0 * 3.675 ** ((i - 24) / 24)

    return tuple((edge(i), edge(i + 1)) for i in range(BANDS))


@lru_cache(maxsize=1)
def band_bins() -> tuple[tuple[int, int], ...]:
    out = []
    for lo, hi in band_edges():
        # edges are rounded at 1e-9 so that a power's last digit never moves a bin
        a, b = int(round(lo * FRAME / SAMPLE_RATE, 9)), int(round(hi * FRAME / SAMPLE_RATE, 9))
        out.append((a, min(HOP - 1, max(b, a + 1))))
    return tuple(out)


def layer_of(band: int) -> int:
    return 0 if band < 8 else 1 if band < 24 else 2


def band_pair(band: int) -> tuple[str, str]:
    layer = layer_of(band)
    local = band - (0, 8, 24)[layer]
    return LAYER_PAIRS[layer][local % len(LAYER_PAIRS[layer])]


@lru_cache(maxsize=1)
def band_arrays() -> dict[str, np.ndarray]:
    """Starts and sizes of bands in bins, centre, weight, hearing threshold, Bark, spreading."""
    centre = np.array([(lo + hi) / 2 for lo, hi in band_edges()])
    khz = np.maximum(centre, 20.0) / 1000.0
    hearing = 3.64 * khz**-0.8 - 6.5 * np.exp(-0.6 * (khz - 3.3) ** 2) + 0.001 * khz**4 - 96.0
    bark = 13.0 * np.arctan(0.00076 * centre) + 3.5 * np.arctan((centre / 7500.0) ** 2)
    apart = bark[:, None] - bark[None, :]
    bins = np.array(band_bins())
    weight = np.select([centre < 100, centre < 300, centre < 1000, centre < 4000, centre < 8000, centre < 12000], [0.25, 0.55, 0.80, 1.00, 0.75, 0.45], 0.20)
    return {"start": bins[:, 0], "size": bins[:, 1] - bins[:, 0], "centre": centre, "weight": weight, "hearing": hearing, "bark": bark, "spread": np.where(apart >= 0, -14.0 - 25.0 * apart, -14.0 + 40.0 * apart)}


def band_table(spark: SparkSession) -> DataFrame:
    """band_dim: one row for each of the 48 bands; small enough to broadcast always."""
    a = band_arrays()
    rows = []
    for b, ((lo, hi), (p, q)) in enumerate(zip(band_edges(), band_bins())):
        layer = layer_of(b)
        rows.append((b, layer, b - (0, 8, 24)[layer], lo, hi, p, q, float(a["centre"][b]), float(a["weight"][b]), float(a["hearing"][b]), float(a["bark"][b]), *band_pair(b)))
    return spark.createDataFrame(rows, "band int, layer int, local_band int, hz_lo double, hz_hi double, bin_lo int, bin_hi int, fc double, weight double, ath_dbfs double, bark double, color_a string, color_b string")


def bin_table(spark: SparkSession) -> DataFrame:
    """bin_dim: each coded coefficient with its band; an equi-join stands for the range lookup."""
    rows = [(m, b, m - p) for b, (p, q) in enumerate(band_bins()) for m in range(p, q)]
    return spark.createDataFrame(rows, "m int, band int, coeff int")


@lru_cache(maxsize=1)
def code_table() -> dict[int, str]:
    """Prefix code of magnitudes 0..31, the escape and the end of a band, as bit strings."""
    weight = {k: math.exp(-CODE_DECAY * k) for k in range(MAX_LEVEL + 1)}
    weight[ESCAPE] = max(math.exp(-CODE_DECAY * (MAX_LEVEL + 1)) / (1.0 - math.exp(-CODE_DECAY) + 1e-15), 1e-9)
    weight[END_OF_BAND] = math.exp(-CODE_DECAY * 4)
    total = sum(weight.values())
    # each entry holds the symbols below it and grows their codes from the front
    codes = dict.fromkeys(weight, "")
    queue = [(w / total, n, (s,)) for n, (s, w) in enumerate(weight.items())]
    heapq.heapify(queue)
    born = len(queue)
    while len(queue) > 1:
        (wa, _, zero), (wb, _, one) = heapq.heappop(queue), heapq.heappop(queue)
        for bit, side in (("0", zero), ("1", one)):
            for s in side:
                codes[s] = bit + codes[s]
        heapq.heappush(queue, (wa + wb, born, zero + one))
        born += 1
    return codes


def code_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, len(c), c) for s, c in sorted(code_table().items())], "symbol int, len int, bits string")


@lru_cache(maxsize=1)
def basis() -> np.ndarray:
    """2048 x 1024: sine window times cosine, orthonormal under overlap-add."""
    n, m = np.arange(FRAME), np.arange(HOP)
    window = np.sin(np.pi / FRAME * (n + 0.5))
    return window[:, None] * np.cos(np.pi / HOP * np.outer(n + 0.5 + HOP / 2, m + 0.5)) * math.sqrt(2.0 / HOP)

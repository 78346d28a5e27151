"""Queries of the layout: cells, pixels, reading back, and what happens to images."""

from __future__ import annotations

import math

from quadrille.functions.colour_sql import with_rgb
from quadrille.plans.base import shared
from quadrille.plans.colour_queries import LAB, PROJECTED

_M2 = "least(1e0, least(1e0, abs(q.c) / (p.peak + 1e-12)) * (CASE WHEN d.layer = 2 THEN 1.15e0 ELSE 1e0 END))"
shared("layout_cells_mode1", "SELECT track, frame, band, coeff, layer, round(steepness, 6) AS steepness, direction FROM levels")
shared("layout_cells_mode2", f"""SELECT q.track, q.frame, q.band, q.coeff, round({_M2}, 6) AS steepness, CAST(sign(q.c) AS INT) AS direction FROM loud q
  JOIN band_dim d ON d.band = q.band JOIN peaks p ON p.track = q.track AND p.band = q.band""")
shared("band_peaks", "SELECT track, band, round(peak, 9) AS peak FROM peaks")
shared("band_summary", "SELECT track, frame, band, steepness, direction FROM cells")
shared("dot_counts", "SELECT track, layer, count(*) AS dots, CAST(sum(CASE WHEN direction = 0 THEN 1 ELSE 0 END) AS BIGINT) AS flat FROM levels GROUP BY track, layer")
shared("layer_dots", "SELECT track, frame, band, coeff, round(steepness, 4) AS steepness FROM levels WHERE layer IN (0, 2) AND band >= 4 AND band < 30")

WIDTH = 8
_CELL_COLOURS = """(SELECT c.track, c.frame, c.band, c.steepness, c.direction, a.r AS ar, a.g AS ag, a.b AS ab, b.r - a.r AS vr, b.g - a.g AS vg, b.b - a.b AS vb
  FROM cells c JOIN band_dim d ON d.band = c.band JOIN palette a ON a.name = d.color_a JOIN palette b ON b.name = d.color_b)"""
_BLEND = "(CASE WHEN direction = 0 OR steepness < 0.001e0 THEN 0e0 WHEN direction > 0 THEN (i / {w}e0) * steepness ELSE (1e0 - i / {w}e0) * steepness END)"
PIXELS = f"""(SELECT track, frame, band, i AS px, frame * {WIDTH} + i AS x, ar, ag, ab, vr, vg, vb, floor(ar + vr * {_BLEND.format(w=WIDTH)}) AS r, floor(ag + vg * {_BLEND.format(w=WIDTH)}) AS g, floor(ab + vb * {_BLEND.format(w=WIDTH)}) AS b
  FROM {_CELL_COLOURS} c CROSS JOIN RANGE(0, {WIDTH}) t)"""
shared("strip_pixels", f"SELECT track, band, x, CAST(r AS INT) AS r, CAST(g AS INT) AS g, CAST(b AS INT) AS b FROM {PIXELS} v")
# one flat colour for a cell: half its way through the colour space, or the first colour where it has no direction
_HALF = with_rgb(f"""(SELECT c.track, c.frame, c.band, c.direction = 0 OR c.steepness < 0.001e0 AS flat, a.r AS ar, a.g AS ag, a.b AS ab, a.lab_l + (b.lab_l - a.lab_l) * 0.5e0 * c.steepness AS l, a.lab_a + (b.lab_a - a.lab_a) * 0.5e0 * c.steepness AS aa,
  a.lab_b + (b.lab_b - a.lab_b) * 0.5e0 * c.steepness AS bb FROM cells c JOIN band_dim d ON d.band = c.band JOIN {LAB} a ON a.name = d.color_a JOIN {LAB} b ON b.name = d.color_b)""", "l", "aa", "bb")
shared("cell_midpoint", f"SELECT track, frame, band, CASE WHEN flat THEN ar ELSE red END AS r, CASE WHEN flat THEN ag ELSE green END AS g, CASE WHEN flat THEN ab ELSE blue END AS b FROM {_HALF} v")
# a cell is read at a quarter and at three quarters; at this width both fall on pixels
_SIDES = PROJECTED.format(table=f"(SELECT * FROM {PIXELS} v WHERE px = {WIDTH // 4} OR px = {3 * WIDTH // 4})")
_READ = f"""(SELECT track, frame, band, least(1e0, 2e0 * abs(diff)) AS steepness, CASE WHEN abs(diff) < 0.008e0 THEN 0 WHEN diff > 0e0 THEN 1 ELSE -1 END AS direction, conf FROM
  (SELECT track, frame, band, sum(CASE WHEN px = {WIDTH // 4} THEN -t ELSE t END) AS diff, avg(conf) AS conf FROM {_SIDES} s GROUP BY track, frame, band) d)"""
shared("strip_read", f"SELECT track, frame, band, round(steepness, 6) AS steepness, direction, round(conf, 6) AS conf FROM {_READ} v")
shared("alpha_by_band", f"SELECT track, band, round(avg(conf), 6) AS alpha FROM {_READ} v GROUP BY track, band")
_BOTH = f"(SELECT c.track, c.frame, c.band, d.layer, abs(r.steepness - c.steepness) AS err, CASE WHEN r.direction = c.direction THEN 1e0 ELSE 0e0 END AS hit FROM cells c JOIN {_READ} r ON r.track = c.track AND r.frame = c.frame AND r.band = c.band JOIN band_dim d ON d.band = c.band)"
shared("read_accuracy", f"SELECT track, round(avg(err), 6) AS steepness_mae, round(max(err), 6) AS steepness_max, round(avg(hit), 6) AS direction_accuracy, CAST(sum(1e0 - hit) AS BIGINT) AS direction_errors, count(*) AS n_cells FROM {_BOTH} v GROUP BY track")
shared("accuracy_rollup", f"SELECT coalesce(CAST(layer AS INT), -1) AS layer, round(avg(err), 6) AS mae, round(avg(hit), 6) AS accuracy, count(*) AS n_cells FROM {_BOTH} v GROUP BY ROLLUP (layer)")
shared("failure_flags", f"""SELECT layer, accuracy, accuracy < (CASE WHEN layer = 0 THEN 0.85e0 WHEN layer = 1 THEN 0.80e0 ELSE 0.70e0 END) AS failed,
  CASE WHEN accuracy >= 0.90e0 THEN 'A' WHEN accuracy >= 0.75e0 THEN 'B' WHEN accuracy >= 0.55e0 THEN 'C' ELSE 'F' END AS camera_grade,
  CASE WHEN accuracy >= 0.95e0 THEN 'A' WHEN accuracy >= 0.90e0 THEN 'B' WHEN accuracy >= 0.80e0 THEN 'C' ELSE 'F' END AS monitor_grade FROM (SELECT layer, round(avg(hit), 6) AS accuracy FROM {_BOTH} v GROUP BY layer) a""")
shared("confidence_heat", f"SELECT track, frame, band, CAST(floor(255e0 * (1e0 - conf)) AS INT) AS red, CAST(floor(255e0 * conf) AS INT) AS green FROM {_READ} v")

# degradations of pixels
shared("degrade_fade", f"SELECT track, band, x, f.i AS tenth, CAST(floor(r * (1e0 - f.i / 10e0) + 128e0 * (f.i / 10e0)) AS INT) AS r FROM {PIXELS} v CROSS JOIN RANGE(1, 6) f")
shared("degrade_cast", f"SELECT track, band, x, CAST(least(255e0, floor(r * 1.2e0)) AS INT) AS r, CAST(floor(g * 0.9e0) AS INT) AS g, CAST(floor(b * 0.8e0) AS INT) AS b FROM {PIXELS} v")
shared("degrade_blur", f"""SELECT v.track, band, x, CAST(floor(sum(r * w) / sum(w) + 1e-9) AS INT) AS r FROM
  (SELECT p.track, p.band, p.x + k.i - 2 AS x, p.r, CASE abs(k.i - 2) WHEN 0 THEN 6e0 WHEN 1 THEN 4e0 ELSE 1e0 END AS w FROM {PIXELS} p CROSS JOIN RANGE(0, 5) k) v
  JOIN counts n ON n.track = v.track WHERE x >= 0 AND x < n.n_frames * {WIDTH} GROUP BY v.track, band, x""")
# conditions of the sweep: pixels that a cell is read at, after each of them
_SIDE_PIXELS = f"(SELECT * FROM {PIXELS} v WHERE px = {WIDTH // 4} OR px = {3 * WIDTH // 4})"
_KEYS = "track, frame, band, px, x, ar, ag, ab, vr, vg, vb"
_POINTWISE = "(SELECT * FROM (VALUES ('baseline', 0e0), ('fade', 0.1e0), ('fade', 0.2e0), ('fade', 0.3e0), ('fade', 0.5e0), ('noise', 5e0), ('noise', 10e0), ('noise', 20e0), ('noise', 40e0), ('cast', 1e0)) AS t(kind, level))"


def _even(seed: float) -> str:
    """SQL: a number in 0 to 1 that pixel and seed decide."""
    v = f"(sin((x * 48 + band) * 12.9898e0 + {seed!r}e0) * 43758.5453e0)"
    return f"({v} - floor({v}))"


def _condition(channel: str, cast: float, seed: float) -> str:
    normal = f"sqrt(-2e0 * ln(greatest(1e-9, {_even(seed)}))) * cos({2 * math.pi!r}e0 * {_even(seed + 39.425)})"
    return f"""CAST(floor(CASE kind WHEN 'fade' THEN {channel} * (1e0 - level) + 128e0 * level + 1e-9 WHEN 'noise' THEN least(255e0, greatest(0e0, {channel} + level * {normal}))
      WHEN 'cast' THEN least(255e0, {channel} * {cast!r}e0 + 1e-9) ELSE {channel} END) AS DOUBLE) AS {channel}"""


_CHANGED = f"SELECT {_KEYS}, kind, level, {_condition('r', 1.2, 11.0)}, {_condition('g', 0.9, 23.0)}, {_condition('b', 0.8, 37.0)} FROM {_SIDE_PIXELS} s CROSS JOIN {_POINTWISE} k"
_TAPS = "(SELECT level, d.i - 24 AS d, exp(-(d.i - 24) * (d.i - 24) / (2e0 * level * level)) AS w FROM (SELECT CAST(v AS DOUBLE) AS level FROM (VALUES (1), (2), (3), (5), (8)) AS t(v)) s CROSS JOIN RANGE(0, 49) d WHERE abs(d.i - 24) <= 3e0 * level)"
_BLURRED = f"""SELECT s.{_KEYS.replace(', ', ', s.')}, 'blur' AS kind, level, {", ".join(f"CAST(floor(sum(n.{c} * w) / sum(w) + 1e-9) AS DOUBLE) AS {c}" for c in "rgb")}
  FROM (SELECT p.*, level, p.x + d AS near_x, w FROM {_SIDE_PIXELS} p CROSS JOIN {_TAPS} k) s JOIN {PIXELS} n ON n.track = s.track AND n.band = s.band AND n.x = s.near_x GROUP BY s.{_KEYS.replace(', ', ', s.')}, level"""
_SWEPT = PROJECTED.format(table=f"({_CHANGED} UNION ALL {_BLURRED})")
shared("degrade_sweep", f"""SELECT s.kind, s.level, d.layer, round(avg(conf), 6) AS alpha, round(avg(abs(least(1e0, 2e0 * abs(diff)) - c.steepness)), 6) AS mae,
  round(avg(CASE WHEN (CASE WHEN abs(diff) < 0.008e0 THEN 0 WHEN diff > 0e0 THEN 1 ELSE -1 END) = c.direction THEN 1e0 ELSE 0e0 END), 6) AS accuracy FROM
  (SELECT track, frame, band, kind, level, sum(CASE WHEN px = {WIDTH // 4} THEN -t ELSE t END) AS diff, avg(conf) AS conf FROM {_SWEPT} v GROUP BY track, frame, band, kind, level) s
  JOIN cells c ON c.track = s.track AND c.frame = s.frame AND c.band = s.band JOIN band_dim d ON d.band = s.band GROUP BY s.kind, s.level, d.layer""")

# geometry
shared("strip_rows", "SELECT band, 4 * (47 - band) + CASE WHEN band < 8 THEN 4 WHEN band < 24 THEN 2 ELSE 0 END AS top, 4 * (47 - band) + CASE WHEN band < 8 THEN 4 WHEN band < 24 THEN 2 ELSE 0 END + 2 AS sample_y FROM band_dim")
shared("strip_markers", f"SELECT track, frame, frame * {WIDTH} AS x FROM grid WHERE frame % 43 = 0")
_R = "sqrt(pow(x.i - 59.5e0, 2e0) + pow(y.i - 59.5e0, 2e0))"
_TH = f"(atan2(x.i - 59.5e0, 59.5e0 - y.i) + CASE WHEN atan2(x.i - 59.5e0, 59.5e0 - y.i) < 0e0 THEN {2 * math.pi!r}e0 ELSE 0e0 END)"
shared("disc_polar_map", f"""SELECT px, py, CASE WHEN rad < 8e0 THEN 'hole' WHEN rad < 10e0 THEN 'label' WHEN rad >= 58e0 THEN 'outside' ELSE 'audio' END AS zone, CASE WHEN rad >= 10e0 AND rad < 58e0 THEN CAST(floor(rad - 10e0) AS INT) ELSE -1 END AS band,
  CAST(floor(round(theta / {2 * math.pi!r}e0 * 96e0, 9)) AS INT) % 96 AS frame FROM (SELECT x.i AS px, y.i AS py, {_R} AS rad, {_TH} AS theta FROM RANGE(0, 120) x CROSS JOIN RANGE(0, 120) y) v""")
shared("spiral_map", """SELECT rpm, per_rev, f.i AS frame, CAST(least(f.i // per_rev, 400 // per_rev - 1) AS INT) AS rev, CAST(f.i % per_rev AS INT) AS place, round(1e0 / (400 // per_rev), 9) AS sub_band FROM
  (SELECT v AS rpm, CAST(RINT(44100e0 / 1024e0 / (v / 60e0)) AS INT) AS per_rev FROM (SELECT 33 AS v UNION ALL SELECT 45 AS v UNION ALL SELECT 78 AS v) r) p CROSS JOIN RANGE(0, 400) f""")
shared("disc_sample_points", "SELECT band, f.i AS frame, s.i AS side, round((60e0 + (band + 0.5e0) * 5e0) * sin((f.i + 0.25e0 + 0.5e0 * s.i) * 0.0654498469e0), 6) AS dx, round(-(60e0 + (band + 0.5e0) * 5e0) * cos((f.i + 0.25e0 + 0.5e0 * s.i) * 0.0654498469e0), 6) AS dy FROM band_dim CROSS JOIN RANGE(0, 96) f CROSS JOIN RANGE(0, 2) s")
shared("bilinear_sample", f"""SELECT s.track, s.band, s.sx, round(sum(p.r * CASE WHEN p.x = floor(s.sx) THEN 1e0 - (s.sx - floor(s.sx)) ELSE s.sx - floor(s.sx) END), 6) AS r FROM
  (SELECT track, band, frame * {WIDTH} + 1.3e0 AS sx FROM cells) s JOIN {PIXELS} p ON p.track = s.track AND p.band = s.band AND (p.x = CAST(floor(s.sx) AS INT) OR p.x = CAST(floor(s.sx) AS INT) + 1) GROUP BY s.track, s.band, s.sx""")
shared("print_tiles", """SELECT track, CAST(frame // per_tile AS INT) AS tile, count(*) AS frames, min(frame) AS first_frame, round(max(cell_mm) * count(*), 6) AS width_mm FROM
  (SELECT g.track, g.frame, greatest(0.3e0, least(10e0, 30e0 / c.n_frames)) AS cell_mm, CAST(greatest(1e0, floor(10e0 / greatest(0.3e0, least(10e0, 30e0 / c.n_frames)))) AS INT) AS per_tile FROM grid g JOIN counts c ON c.track = g.track) v GROUP BY track, frame // per_tile""")
shared("window_frames", "SELECT track, frame, frame - 2 AS local_frame FROM grid WHERE frame >= 2 AND frame < 2 + 33")
shared("gif_thinning", "SELECT i AS frame, CAST(i // greatest(1, 1000 // 120) AS INT) AS shown FROM RANGE(0, 1000) t WHERE i % greatest(1, 1000 // 120) = 0 AND i // greatest(1, 1000 // 120) < 120")
shared("video_cadence", "SELECT i AS video_frame, CAST(floor(i * (44100e0 / 1024e0 / 30e0)) AS INT) AS audio_frame FROM RANGE(0, 300) t")
shared("warp_scale", "SELECT i AS width, CAST(least(16e0, greatest(4e0, ceil(i * 4e0 / 300e0))) AS INT) AS scale FROM RANGE(100, 1500) t WHERE i % 100 = 0")

# runs in a made-up mask of squares
_MASK = "(SELECT x.i AS x, y.i AS y FROM RANGE(0, 60) x CROSS JOIN RANGE(0, 40) y WHERE (x.i >= 3 AND x.i < 9 AND y.i >= 2 AND y.i < 8) OR (x.i >= 50 AND x.i < 56 AND y.i >= 3 AND y.i < 9) OR (x.i >= 4 AND x.i < 10 AND y.i >= 30 AND y.i < 36) OR (x.i >= 49 AND x.i < 55 AND y.i >= 31 AND y.i < 37) OR (x.i >= 25 AND x.i < 28 AND y.i >= 15 AND y.i < 17))"
shared("longest_run", f"SELECT y, max(n) AS longest FROM (SELECT y, x - k AS island, count(*) AS n FROM (SELECT y, x, row_number() OVER (PARTITION BY y ORDER BY x) AS k FROM {_MASK} m) v GROUP BY y, x - k) w GROUP BY y")
shared("border_scan", f"SELECT min(y) AS first_row, max(y) AS last_row FROM (SELECT y, max(n) AS longest FROM (SELECT y, x - k AS island, count(*) AS n FROM (SELECT y, x, row_number() OVER (PARTITION BY y ORDER BY x) AS k FROM {_MASK} m) v GROUP BY y, x - k) w GROUP BY y) z WHERE longest >= 5")

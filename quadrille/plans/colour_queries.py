"""Queries over colours and colour pairs."""

from __future__ import annotations

from quadrille.functions.colour_sql import ciede2000, linear, with_lab, with_rgb
from quadrille.plans.base import shared

LAB = with_lab("palette")
_PAIR_LAB = f"""(SELECT p.name AS color_a, p.ord AS ord_a, q.name AS color_b, q.ord AS ord_b, p.lab_l AS l1, p.lab_a AS a1, p.lab_b AS b1, q.lab_l AS l2, q.lab_a AS a2, q.lab_b AS b2
  FROM {LAB} p JOIN {LAB} q ON p.ord < q.ord)"""
_PAIR_DE = f"(SELECT color_a, color_b, ord_a, ord_b, de FROM {ciede2000(_PAIR_LAB)} d)"
#: ten steps of an even way through the colour space, as colours that can be shown, and the difference of neighbours
_WAY = f"(SELECT p.*, i AS step, l1 + (l2 - l1) * (i / 10e0) AS wl, a1 + (a2 - a1) * (i / 10e0) AS wa, b1 + (b2 - b1) * (i / 10e0) AS wb FROM {_PAIR_LAB} p CROSS JOIN RANGE(0, 11) t)"
_STEPS = f"(SELECT x.color_a, x.color_b, x.step, x.wl AS l1, x.wa AS a1, x.wb AS b1, y.wl AS l2, y.wa AS a2, y.wb AS b2 FROM {_WAY} x JOIN {_WAY} y ON x.color_a = y.color_a AND x.color_b = y.color_b AND y.step = x.step + 1)"
_MONO = f"(SELECT color_a, color_b, min(de) AS mono FROM {ciede2000(_STEPS)} m GROUP BY color_a, color_b)"
_SCORES = f"""(SELECT d.color_a, d.color_b, d.ord_a, d.ord_b, round(d.de, 2) AS delta_e, round(m.mono, 3) AS min_step, round(2e0 * d.de * (10e0 * m.mono) / (d.de + 10e0 * m.mono + 1e-9), 2) AS composite
  FROM {_PAIR_DE} d JOIN {_MONO} m ON m.color_a = d.color_a AND m.color_b = d.color_b)"""

shared("color_linear", f"SELECT name, round({linear('r')}, 9) AS red, round({linear('g')}, 9) AS green, round({linear('b')}, 9) AS blue FROM palette")
shared("color_lab", f"SELECT name, round(lab_l, 6) AS l, round(lab_a, 6) AS a, round(lab_b, 6) AS b FROM {LAB} v")
shared("color_lab_lerp", f"""SELECT color_a, color_b, step, red, green, blue FROM {with_rgb(f"(SELECT color_a, color_b, i AS step, l1 + (l2 - l1) * (i / 8e0 + 0.003e0) AS l, a1 + (a2 - a1) * (i / 8e0 + 0.003e0) AS a, b1 + (b2 - b1) * (i / 8e0 + 0.003e0) AS b FROM {_PAIR_LAB} p CROSS JOIN RANGE(0, 8) t)", 'l', 'a', 'b')} v""")
shared("color_cmyk", """SELECT name, CAST(RINT(100e0 * CASE WHEN k < 1e0 THEN (c - k) / (1e0 - k) ELSE 0e0 END) AS INT) AS cyan, CAST(RINT(100e0 * CASE WHEN k < 1e0 THEN (m - k) / (1e0 - k) ELSE 0e0 END) AS INT) AS magenta,
  CAST(RINT(100e0 * CASE WHEN k < 1e0 THEN (y - k) / (1e0 - k) ELSE 0e0 END) AS INT) AS yellow, CAST(RINT(100e0 * k) AS INT) AS black
  FROM (SELECT name, 1e0 - r / 255e0 AS c, 1e0 - g / 255e0 AS m, 1e0 - b / 255e0 AS y, least(1e0 - r / 255e0, 1e0 - g / 255e0, 1e0 - b / 255e0) AS k FROM palette) v""")
shared("ink_cap", """SELECT name, cap, round((c - k + m - k + y - k) / greatest(1e0 - k, 1e-9) * 100e0 + k * 100e0, 6) AS asked,
  round(((c - k + m - k + y - k) / greatest(1e0 - k, 1e-9) * 100e0 + k * 100e0) * least(1e0, cap / greatest((c - k + m - k + y - k) / greatest(1e0 - k, 1e-9) * 100e0 + k * 100e0, 1e-9)), 6) AS ink
  FROM (SELECT name, 1e0 - r / 255e0 AS c, 1e0 - g / 255e0 AS m, 1e0 - b / 255e0 AS y, least(1e0 - r / 255e0, 1e0 - g / 255e0, 1e0 - b / 255e0) AS k FROM palette) v
  CROSS JOIN (SELECT 300e0 AS cap UNION ALL SELECT 150e0 AS cap) c""")
shared("ciede2000_pairs", f"SELECT color_a, color_b, round(de, 2) AS delta_e FROM {_PAIR_DE} v")
shared("pair_monotonicity", f"SELECT color_a, color_b, round(mono, 3) AS min_step FROM {_MONO} v")
shared("pair_scores", f"SELECT color_a, color_b, delta_e, min_step, composite FROM {_SCORES} v")
shared("pair_grade", f"""SELECT color_a, color_b, CASE WHEN delta_e > 60e0 AND min_step > 4e0 THEN 'A' WHEN delta_e > 40e0 AND min_step > 2e0 THEN 'B' WHEN delta_e > 25e0 THEN 'C' ELSE 'F' END AS grade,
  CASE WHEN delta_e > 80e0 AND min_step > 6e0 THEN 'A+' WHEN delta_e > 60e0 AND min_step > 4e0 THEN 'A' WHEN delta_e > 45e0 AND min_step > 2.5e0 THEN 'B' WHEN delta_e > 30e0 THEN 'C' ELSE 'F' END AS palette_grade FROM {_SCORES} v""")
_ELIGIBLE = f"""(SELECT l.layer, l.pool, s.*, CASE WHEN delta_e >= least_de AND min_step >= least_step THEN 1 ELSE 0 END AS eligible FROM {_SCORES} s CROSS JOIN layer_limits l)"""
shared("pair_eligible", f"SELECT layer, color_a, color_b, delta_e FROM {_ELIGIBLE} v WHERE eligible = 1")
shared("pair_pool_topk", f"""SELECT layer, color_a, color_b, delta_e, CAST(place AS INT) AS place FROM
  (SELECT v.*, row_number() OVER (PARTITION BY layer ORDER BY delta_e DESC, ord_a, ord_b) AS place FROM
    (SELECT e.*, max(eligible) OVER (PARTITION BY layer) AS any_eligible FROM {_ELIGIBLE} e) v WHERE eligible = 1 OR any_eligible = 0) w WHERE place <= pool""")
shared("pair_assignment", "SELECT band, layer, local_band, color_a, color_b FROM band_dim")
_SAMPLE = """(SELECT d.band, i AS s, a.r AS ar, a.g AS ag, a.b AS ab, b.r - a.r AS vr, b.g - a.g AS vg, b.b - a.b AS vb, least(255e0, a.r + (b.r - a.r) * (i / 7e0) + 3e0 * i) AS r, a.g + (b.g - a.g) * (i / 7e0) AS g, a.b + (b.b - a.b) * (i / 7e0) AS b
  FROM band_dim d JOIN palette a ON a.name = d.color_a JOIN palette b ON b.name = d.color_b CROSS JOIN RANGE(0, 8) t)"""
PROJECTED = """(SELECT p.*, CASE WHEN vv < 1e-6 THEN 1e0 ELSE greatest(0e0, 1e0 - sqrt(pow(r - ar - t * vr, 2e0) + pow(g - ag - t * vg, 2e0) + pow(b - ab - t * vb, 2e0)) / (sqrt(vv) + 1e-9)) END AS conf FROM
  (SELECT o.*, CASE WHEN vv < 1e-6 THEN 0e0 ELSE greatest(0e0, least(1e0, ((r - ar) * vr + (g - ag) * vg + (b - ab) * vb) / vv)) END AS t FROM
  (SELECT z.*, CAST(vr * vr + vg * vg + vb * vb AS DOUBLE) AS vv FROM {table} z) o) p)"""
shared("color_project", f"SELECT band, s, round(t, 6) AS t, round(conf, 6) AS conf FROM {PROJECTED.format(table=_SAMPLE)} v")
shared("terminal_color", "SELECT name, CAST(16 + 36 * (r * 5 // 255) + 6 * (g * 5 // 255) + b * 5 // 255 AS INT) AS code FROM palette")

"""Colour arithmetic as SQL expressions: sRGB, CIELAB (D65), CIEDE2000, ink."""

from __future__ import annotations

# fixed values: sRGB to XYZ and back, and the white point
TO_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
FROM_XYZ = ((3.2404542, -1.5371385, -0.4985314), (-0.9692660, 1.8760108, 0.0415560), (0.0556434, -0.2040259, 1.0572252))
WHITE = (0.95047, 1.0, 1.08883)


def num(x: float) -> str:
    return f"{x!r}e0" if "e" not in repr(x) else repr(x)


def linear(channel: str) -> str:
    v = f"({channel} / 255e0)"
    return f"(CASE WHEN {v} > 0.04045e0 THEN pow(({v} + 0.055e0) / 1.055e0, 2.4e0) ELSE {v} / 12.92e0 END)"


def gamma(v: str) -> str:
    return f"(CASE WHEN {v} > 0.0031308e0 THEN 1.055e0 * pow({v}, 1e0 / 2.4e0) - 0.055e0 ELSE 12.92e0 * {v} END)"


def _f(t: str) -> str:
    return f"(CASE WHEN {t} > pow(6e0 / 29e0, 3e0) THEN pow({t}, 1e0 / 3e0) ELSE {t} / (3e0 * pow(6e0 / 29e0, 2e0)) + 4e0 / 29e0 END)"


def _f_back(t: str) -> str:
    return f"(CASE WHEN {t} > 6e0 / 29e0 THEN pow({t}, 3e0) ELSE 3e0 * pow(6e0 / 29e0, 2e0) * ({t} - 4e0 / 29e0) END)"


def with_lab(table: str, r: str = "r", g: str = "g", b: str = "b", prefix: str = "lab") -> str:
    """A subquery: table's columns and {prefix}_l, _a, _b."""
    xyz = [f"(({num(m[0])} * {linear(r)} + {num(m[1])} * {linear(g)} + {num(m[2])} * {linear(b)}) / {num(w)})" for m, w in zip(TO_XYZ, WHITE)]
    p = prefix
    return f"""(SELECT q.*, 116e0 * {p}_fy - 16e0 AS {p}_l, 500e0 * ({p}_fx - {p}_fy) AS {p}_a, 200e0 * ({p}_fy - {p}_fz) AS {p}_b FROM
      (SELECT x0.*, {_f(f'{p}_x')} AS {p}_fx, {_f(f'{p}_y')} AS {p}_fy, {_f(f'{p}_z')} AS {p}_fz FROM
      (SELECT s.*, {xyz[0]} AS {p}_x, {xyz[1]} AS {p}_y, {xyz[2]} AS {p}_z FROM {table} s) x0) q)"""


def with_rgb(table: str, l: str, a: str, b: str) -> str:  # noqa: E741
    """A subquery: table's columns and red, green, blue, clipped and cut off to whole numbers."""
    lin = [f"greatest(0e0, least(1e0, {num(m[0])} * vx + {num(m[1])} * vy + {num(m[2])} * vz))" for m in FROM_XYZ]
    names = ("red", "green", "blue")
    cut = ", ".join(f"CAST(floor(least(255e0, greatest(0e0, {gamma('l' + n)} * 255e0))) AS INT) AS {n}" for n in names)
    return f"""(SELECT q.*, {cut} FROM
      (SELECT x1.*, {', '.join(f'{e} AS l{n}' for e, n in zip(lin, names))} FROM
      (SELECT x0.*, {num(WHITE[0])} * {_f_back('gx')} AS vx, {num(WHITE[1])} * {_f_back('gy')} AS vy, {num(WHITE[2])} * {_f_back('gz')} AS vz FROM
      (SELECT s.*, ({l} + 16e0) / 116e0 AS gy, {a} / 500e0 + ({l} + 16e0) / 116e0 AS gx, ({l} + 16e0) / 116e0 - {b} / 200e0 AS gz FROM {table} s) x0) x1) q)"""


def ciede2000(table: str) -> str:
    """A subquery: table's columns (with l1, a1, b1, l2, a2, b2) and de; the published formula, weights one."""
    hue = lambda n: f"(CASE WHEN ap{n} = 0e0 AND b{n} = 0e0 THEN 0e0 ELSE degrees(atan2(b{n}, ap{n})) + CASE WHEN atan2(b{n}, ap{n}) < 0e0 THEN 360e0 ELSE 0e0 END END)"
    return f"""(SELECT y.*, sqrt(pow(dl / sl, 2e0) + pow(dc / sc, 2e0) + pow(dh / sh, 2e0) + rt * (dc / sc) * (dh / sh)) AS de FROM
      (SELECT x.*, 1e0 + 0.015e0 * pow(lm - 50e0, 2e0) / sqrt(20e0 + pow(lm - 50e0, 2e0)) AS sl, 1e0 + 0.045e0 * cm AS sc,
         1e0 + 0.015e0 * cm * (1e0 - 0.17e0 * cos(radians(hm - 30e0)) + 0.24e0 * cos(radians(2e0 * hm)) + 0.32e0 * cos(radians(3e0 * hm + 6e0)) - 0.20e0 * cos(radians(4e0 * hm - 63e0))) AS sh,
         -sin(radians(60e0 * exp(-pow((hm - 275e0) / 25e0, 2e0)))) * 2e0 * sqrt(pow(cm, 7e0) / (pow(cm, 7e0) + pow(25e0, 7e0))) AS rt FROM
      (SELECT w.*, l2 - l1 AS dl, cp2 - cp1 AS dc, 2e0 * sqrt(cp1 * cp2) * sin(radians(dhue / 2e0)) AS dh, (l1 + l2) / 2e0 AS lm, (cp1 + cp2) / 2e0 AS cm,
         CASE WHEN cp1 * cp2 = 0e0 THEN h1 + h2 WHEN abs(h1 - h2) <= 180e0 THEN (h1 + h2) / 2e0 WHEN h1 + h2 < 360e0 THEN (h1 + h2 + 360e0) / 2e0 ELSE (h1 + h2 - 360e0) / 2e0 END AS hm FROM
      (SELECT v.*, CASE WHEN cp1 * cp2 = 0e0 THEN 0e0 WHEN abs(h2 - h1) <= 180e0 THEN h2 - h1 WHEN h2 - h1 > 180e0 THEN h2 - h1 - 360e0 ELSE h2 - h1 + 360e0 END AS dhue FROM
      (SELECT u.*, sqrt(ap1 * ap1 + b1 * b1) AS cp1, sqrt(ap2 * ap2 + b2 * b2) AS cp2, {hue(1)} AS h1, {hue(2)} AS h2 FROM
      (SELECT t.*, (1e0 + gg) * a1 AS ap1, (1e0 + gg) * a2 AS ap2 FROM
      (SELECT s.*, 0.5e0 * (1e0 - sqrt(pow((sqrt(a1 * a1 + b1 * b1) + sqrt(a2 * a2 + b2 * b2)) / 2e0, 7e0) / (pow((sqrt(a1 * a1 + b1 * b1) + sqrt(a2 * a2 + b2 * b2)) / 2e0, 7e0) + pow(25e0, 7e0)))) AS gg
       FROM {table} s) t) u) v) w) x) y)"""

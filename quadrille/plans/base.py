"""Named relations that queries build on.

``signal``, ``coeffs``, ``bands`` and ``frames`` come from the engine's operators; SQL for the same is given
beside each, for checking. The others are SQL on top of them, the same text for both."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from quadrille import catalog
from quadrille.functions import dims
from quadrille.functions.dims import BAND_SQL, LAYER_LIMITS, LAYER_PAIRS, PALETTE, code_table
from quadrille.operators import framing, levels
from quadrille.plans import dialect
from quadrille.sources import signals


@dataclass(frozen=True)
class Relation:
    sql: str  # for checking, and for Spark too where make is None
    make: Callable[[SparkSession, str], DataFrame] | None = None


def analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return framing.analysed(signals.event_signal(spark, sf_dir))


def fixed_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return levels.fixed(analysis(spark, sf_dir))


RELATIONS: dict[str, Relation] = {
    "signal": Relation("SELECT 'all' AS track, row_number() OVER (ORDER BY ts, event_id) - 1 AS n, least(1e0, (value - 50) / 500) AS x FROM events", signals.event_signal),
    "type_signal": Relation("SELECT event_type AS track, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS n, least(1e0, (value - 50) / 500) AS x FROM events", signals.event_type_signal),
    "counts": Relation("SELECT track, CAST((count(*) + 1024) // 1024 + 1 AS INT) AS n_frames FROM signal GROUP BY track", lambda s, d: framing.frame_counts(signals.event_last(s, d))),
    "grid": Relation("SELECT track, UNNEST_RANGE(0, n_frames) AS frame FROM counts"),
    "framed": Relation("""SELECT s.track, CAST((n + 1024) // 1024 - o.i AS INT) AS frame, CAST((n + 1024) % 1024 + 1024 * o.i AS INT) AS k, x
      FROM signal s CROSS JOIN RANGE(0, 2) o WHERE (n + 1024) // 1024 - o.i >= 0"""),
    "coeffs": Relation(
        """SELECT g.track, g.frame, m.i AS m, coalesce(v.c, 0e0) AS c FROM grid g CROSS JOIN RANGE(0, 1024) m
      LEFT JOIN (SELECT track, frame, m.i AS m, sum(x * sin(pi() / 2048e0 * (k + 0.5e0)) * cos(pi() / 1024e0 * (k + 512.5e0) * (m.i + 0.5e0))) * sqrt(2e0 / 1024e0) AS c
        FROM framed CROSS JOIN RANGE(0, 1024) m GROUP BY track, frame, m.i) v ON v.track = g.track AND v.frame = g.frame AND v.m = m.i""",
        lambda s, d: framing.long_coeffs(analysis(s, d)),
    ),
    "band_edges": Relation(BAND_SQL),
    "pair_dim": Relation("SELECT * FROM (VALUES " + ", ".join(f"({layer}, {len(p)}, {i}, '{a}', '{b}')" for layer, p in enumerate(LAYER_PAIRS) for i, (a, b) in enumerate(p)) + ") AS v(layer, size, ord, color_a, color_b)"),
    "palette": Relation("SELECT * FROM (VALUES " + ", ".join(f"('{n}', {i}, {r}, {g}, {b})" for i, (n, (r, g, b)) in enumerate(PALETTE.items())) + ") AS v(name, ord, r, g, b)"),
    "layer_limits": Relation("SELECT * FROM (VALUES " + ", ".join(f"({i}, {d!r}e0, {m!r}e0, {k})" for i, (d, m, k) in enumerate(LAYER_LIMITS)) + ") AS v(layer, least_de, least_step, pool)"),
    "code_dim": Relation("SELECT * FROM (VALUES " + ", ".join(f"({s}, {len(c)}, '{c}')" for s, c in sorted(code_table().items())) + ") AS v(symbol, len, bits)"),
    "band_dim": Relation(
        """SELECT e.band, e.layer, e.local_band, hz_lo, hz_hi, CAST(floor(round(hz_lo * 2048e0 / 44100e0, 9)) AS INT) AS bin_lo,
      CAST(least(1023, greatest(floor(round(hz_hi * 2048e0 / 44100e0, 9)), floor(round(hz_lo * 2048e0 / 44100e0, 9)) + 1)) AS INT) AS bin_hi, (hz_lo + hz_hi) / 2e0 AS fc,
      CASE WHEN (hz_lo + hz_hi) / 2e0 < 100e0 THEN 0.25e0 WHEN (hz_lo + hz_hi) / 2e0 < 300e0 THEN 0.55e0 WHEN (hz_lo + hz_hi) / 2e0 < 1000e0 THEN 0.80e0 WHEN (hz_lo + hz_hi) / 2e0 < 4000e0 THEN 1.00e0
        WHEN (hz_lo + hz_hi) / 2e0 < 8000e0 THEN 0.75e0 WHEN (hz_lo + hz_hi) / 2e0 < 12000e0 THEN 0.45e0 ELSE 0.20e0 END AS weight,
      3.64e0 * pow(greatest((hz_lo + hz_hi) / 2e0, 20e0) / 1000e0, -0.8e0) - 6.5e0 * exp(-0.6e0 * pow(greatest((hz_lo + hz_hi) / 2e0, 20e0) / 1000e0 - 3.3e0, 2e0)) + 0.001e0 * pow(greatest((hz_lo + hz_hi) / 2e0, 20e0) / 1000e0, 4e0) - 96e0 AS ath_dbfs,
      13e0 * atan(0.00076e0 * (hz_lo + hz_hi) / 2e0) + 3.5e0 * atan(pow((hz_lo + hz_hi) / 2e0 / 7500e0, 2e0)) AS bark, color_a, color_b
      FROM band_edges e JOIN pair_dim p ON p.layer = e.layer AND p.ord = e.local_band % p.size""",
        lambda s, d: F.broadcast(dims.band_table(s)),
    ),
    "bin_dim": Relation("SELECT m.i AS m, band, m.i - bin_lo AS coeff FROM band_dim JOIN RANGE(0, 1023) m ON m.i >= bin_lo AND m.i < bin_hi", lambda s, d: F.broadcast(dims.bin_table(s))),
    "bands": Relation(
        "SELECT track, frame, band, greatest(20e0 * log10(sqrt(avg(c * c)) + 1e-12), -80e0) AS db, sqrt(avg(c * c)) AS rms FROM coeffs JOIN bin_dim USING (m) GROUP BY track, frame, band",
        lambda s, d: framing.long_bands(analysis(s, d)),
    ),
    "frames": Relation(
        """SELECT track, frame, frame % 8 AS gop_pos, CASE WHEN frame % 8 = 0 THEN 'K' WHEN max(db) < -55e0 THEN 'S' ELSE 'B' END AS ftype, max(db) < -55e0 AS is_silence,
      sum((greatest(db, -80e0) + 80e0) / 80e0 * weight) AS energy FROM bands JOIN band_dim USING (band) GROUP BY track, frame""",
        lambda s, d: analysis(s, d).select("track", "frame", "gop_pos", "ftype", "is_silence", "energy"),
    ),
    "spread": Relation("SELECT x.band AS b, y.band AS m, CASE WHEN x.bark >= y.bark THEN -14e0 - 25e0 * (x.bark - y.bark) ELSE -14e0 + 40e0 * (x.bark - y.bark) END AS s FROM band_dim x CROSS JOIN band_dim y"),
    "masks": Relation("SELECT e.track, e.frame, s.b AS band, greatest(min(d.ath_dbfs), max(greatest(e.db, -80e0) + s.s)) AS thr FROM bands e JOIN spread s ON s.m = e.band JOIN band_dim d ON d.band = s.b GROUP BY e.track, e.frame, s.b", lambda s, d: levels.by_band(fixed_levels(s, d), "thr")),
    "steps": Relation("SELECT track, frame, band, greatest(pow(10e0, (thr - 3e0) / 20e0), 1e-7) AS step FROM masks", lambda s, d: levels.by_band(fixed_levels(s, d), "step")),
    "quant": Relation("SELECT c.track, c.frame, b.band, b.coeff, c.m, c.c, s.step, CAST(greatest(-2047e0, least(2047e0, RINT(c.c / s.step))) AS SMALLINT) AS q FROM coeffs c JOIN bin_dim b ON b.m = c.m JOIN steps s ON s.track = c.track AND s.frame = c.frame AND s.band = b.band", lambda s, d: levels.long_levels(fixed_levels(s, d))),
    "costs": Relation("SELECT track, frame, band, 2e0 + sum(CASE WHEN RINT(abs(c) / step) > 0e0 THEN log2(RINT(abs(c) / step) + 1e0) + 1e0 ELSE 0e0 END) AS bits FROM quant GROUP BY track, frame, band", lambda s, d: levels.by_band(fixed_levels(s, d), "bits")),
    "neighbours": Relation("""SELECT f.track, f.frame, f.ftype AS was, a.frame AS k0, b.frame AS k1,
      CASE WHEN f.ftype = 'B' AND (a.frame IS NULL OR b.frame IS NULL) THEN 'K' ELSE f.ftype END AS ftype,
      CASE WHEN f.ftype = 'B' AND (a.frame IS NULL OR b.frame IS NULL) THEN 0 ELSE f.gop_pos END AS gop_pos
      FROM frames f LEFT JOIN frames a ON a.track = f.track AND a.frame = f.frame - f.gop_pos AND a.ftype = 'K'
      LEFT JOIN frames b ON b.track = f.track AND b.frame = f.frame - f.gop_pos + 8 AND b.ftype = 'K'""", lambda s, d: levels.neighbours(analysis(s, d))),
    "key_steps": Relation("""SELECT g.track, g.frame, max(k.frame) AS key_frame FROM neighbours g JOIN neighbours k ON k.track = g.track AND k.ftype = 'K' AND k.frame <= g.frame GROUP BY g.track, g.frame""", lambda s, d: levels.key_frames(analysis(s, d))),
    "levels": Relation("""SELECT q.track, q.frame, q.band, q.coeff, d.layer, n.ftype, q.c, q.q,
      least(1e0, (CASE WHEN n.ftype = 'K' THEN least(1e0, abs(q.q) / 31e0) ELSE least(1e0, abs(q.c) / (ks.step * 31e0 + 1e-12)) END) * (CASE WHEN d.layer = 2 THEN 1.15e0 ELSE 1e0 END)) AS steepness,
      CASE WHEN n.ftype = 'K' THEN CAST(sign(q.q) AS INT) ELSE CAST(sign(q.c) AS INT) END AS direction
      FROM quant q JOIN neighbours n ON n.track = q.track AND n.frame = q.frame JOIN band_dim d ON d.band = q.band
      JOIN key_steps a ON a.track = q.track AND a.frame = q.frame JOIN steps ks ON ks.track = a.track AND ks.frame = a.key_frame AND ks.band = q.band WHERE n.ftype <> 'S'""", lambda s, d: levels.steepness(fixed_levels(s, d))),
    "cells": Relation("""SELECT g.track, g.frame, g.band, coalesce(v.steepness, 0e0) AS steepness, coalesce(v.direction, 0) AS direction FROM
      (SELECT track, frame, band FROM grid CROSS JOIN band_dim) g
      LEFT JOIN (SELECT track, frame, band, round(avg(steepness), 4) AS steepness, CAST(sign(sum(direction)) AS INT) AS direction FROM levels GROUP BY track, frame, band) v
      ON v.track = g.track AND v.frame = g.frame AND v.band = g.band""", lambda s, d: levels.cells(fixed_levels(s, d))),
    # lengths of the prefix code: level or escape with its literal, sign, and the end of a band after the last nonzero level
    "code_bits": Relation(
        """SELECT e.track, e.frame, e.band, sum(CASE WHEN e.coeff <= e.last_nz THEN c.len + CASE WHEN abs(e.q) > 31 THEN 12 ELSE 0 END + CASE WHEN e.q <> 0 THEN 1 ELSE 0 END ELSE 0 END)
      + max(CASE WHEN e.last_nz >= 0 AND e.last_nz < e.last THEN 4 ELSE 0 END) AS bits FROM (SELECT q.track, q.frame, q.band, q.coeff, CAST(q.q AS INT) AS q, max(CASE WHEN q.q <> 0 THEN q.coeff ELSE -1 END) OVER (PARTITION BY q.track, q.frame, q.band) AS last_nz,
      max(q.coeff) OVER (PARTITION BY q.track, q.frame, q.band) AS last FROM quant q) e JOIN code_dim c ON c.symbol = least(abs(e.q), 32) GROUP BY e.track, e.frame, e.band""",
        lambda s, d: levels.by_band(fixed_levels(s, d).withColumn("bits", levels.code_lengths("q")), "bits"),
    ),
    "peaks": Relation("SELECT q.track, q.band, max(abs(q.c)) AS peak FROM quant q JOIN neighbours n ON n.track = q.track AND n.frame = q.frame WHERE n.ftype <> 'S' GROUP BY q.track, q.band", lambda s, d: levels.band_peaks(fixed_levels(s, d))),
    "loud": Relation("SELECT q.track, q.frame, q.band, q.coeff, q.c FROM quant q JOIN neighbours n ON n.track = q.track AND n.frame = q.frame WHERE n.ftype <> 'S'", lambda s, d: levels.long_levels(levels.with_neighbours(fixed_levels(s, d)).where("ftype <> 'S'")).select("track", "frame", "band", "coeff", "c")),
    "tone": Relation("SELECT 'tones' AS track, i AS n, 0.5e0 * sin(i * 440e0 * (2e0 * 3.141592653589793e0 / 44100e0)) + 0.3e0 * sin(i * 2000e0 * (2e0 * 3.141592653589793e0 / 44100e0)) + 0.2e0 * sin(i * 9000e0 * (2e0 * 3.141592653589793e0 / 44100e0)) AS x FROM RANGE(0, 8192) t"),
}


def needed(sql: str) -> list[str]:
    """The relations that a text names, those they name included, in order of definition."""
    found: set[str] = set()
    todo = [sql]
    while todo:
        text = todo.pop()
        for name in RELATIONS:
            if name not in found and re.search(rf"\b{name}\b", text):
                found.add(name)
                todo.append(RELATIONS[name].sql)
    return [n for n in RELATIONS if n in found]


def oracle(sql: str) -> str:
    names = needed(sql)
    ctes = ", ".join(f"{n} AS ({dialect.duck(RELATIONS[n].sql)})" for n in names)
    return f"WITH RECURSIVE {ctes} {dialect.duck(sql)}" if names else dialect.duck(sql)


def run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The text over relations: those that an operator makes are views of its result, the rest are SQL."""
    made: dict[str, DataFrame] = {}
    ctes: list[str] = []
    done: set[str] = set()

    def add(name: str) -> None:
        if name in done:
            return
        done.add(name)
        relation = RELATIONS[name]
        if relation.make:
            made[f"q_{name}"] = relation.make(spark, sf_dir)
            ctes.append(f"{name} AS (SELECT * FROM {{q_{name}}})")
            return
        for other in RELATIONS:
            if other != name and re.search(rf"\b{other}\b", relation.sql):
                add(other)
        ctes.append(f"{name} AS ({dialect.spark(relation.sql)})")

    for name in RELATIONS:
        if re.search(rf"\b{name}\b", sql):
            add(name)
    text = ("WITH " + ", ".join(ctes) + " " if ctes else "") + dialect.spark(sql)
    return spark.sql(text, **made)


def shared(name: str, sql: str, make: Callable[[SparkSession, str], DataFrame] | None = None) -> None:
    """Registers a query: its SQL for checking, and for Spark the operator given or the same text."""
    catalog.QUERIES[name] = make or (lambda spark, sf_dir: run(spark, sf_dir, sql))
    catalog.ORACLES[name] = oracle(sql)

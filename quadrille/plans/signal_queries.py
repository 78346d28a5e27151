"""Queries of the codec: framing, masking, quantisation, keyframes, decoding, time, code lengths."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadrille.functions.dims import DECAY_PER_FRAME
from quadrille.operators import codec, framing, levels, resample
from quadrille.plans.base import analysis, fixed_levels, shared
from quadrille.sources import signals

shared("signal_scan", "SELECT track, n, round(x, 9) AS x FROM signal")
shared("signal_stats", "SELECT track, count(*) AS samples, round(sum(x), 6) AS total, round(avg(x), 9) AS mean, min(x) AS least, max(x) AS most, round(sqrt(avg(x * x)), 9) AS rms FROM type_signal GROUP BY track")
shared("frame_samples_count", "SELECT track, frame, count(*) AS samples, min(k) AS first_k, max(k) AS last_k FROM framed GROUP BY track, frame")
shared("frame_counts", "SELECT track, n_frames FROM counts")
shared("window_shape", "SELECT i AS k, round(sin(pi() / 2048e0 * (i + 0.5e0)), 12) AS w FROM RANGE(0, 2048) t")
shared("mdct_coeffs", "SELECT track, frame, m, round(c, 6) AS c FROM coeffs")
shared("band_dim", "SELECT band, layer, local_band, round(hz_lo, 6) AS hz_lo, round(hz_hi, 6) AS hz_hi, bin_lo, bin_hi, weight, color_a, color_b FROM band_dim")
shared("bin_band", "SELECT m, band, coeff FROM bin_dim")
shared("band_energy", "SELECT track, frame, band, round(db, 6) AS db, round(rms, 9) AS rms FROM bands")
shared("layer_energies", "SELECT track, frame, layer, round(max(db), 6) AS peak_db, round(avg(rms), 9) AS mean_rms FROM bands JOIN band_dim USING (band) GROUP BY track, frame, layer")
shared("frame_energy", "SELECT track, frame, round(energy, 6) AS energy FROM frames")
shared("frame_index", "SELECT track, frame, gop_pos, ftype, is_silence FROM frames")
shared("frame_type_counts", "SELECT track, ftype, count(*) AS frames FROM frames GROUP BY track, ftype")
shared("voiced_frames", "SELECT track, frame, round(energy, 6) AS energy FROM frames WHERE NOT is_silence AND frame >= 2 AND frame < 8")
shared("ath_bark", "SELECT band, round(fc, 6) AS fc, round(ath_dbfs, 6) AS ath_dbfs, round(bark, 9) AS bark FROM band_dim")
shared("spread_matrix", "SELECT b, m, round(s, 6) AS s FROM spread")
shared("masking_threshold", "SELECT track, frame, band, round(thr, 6) AS thr FROM masks")
shared("step_sizes", "SELECT track, frame, band, round(step, 9) AS step FROM steps")
shared("band_bits", "SELECT track, frame, band, round(bits, 6) AS bits FROM costs")
shared("frame_bits", "SELECT track, frame, round(sum(bits), 6) AS bits, sum(bits) <= 2e0 * 278 AS fits_12k FROM costs GROUP BY track, frame")
shared("layer_bits", "SELECT track, frame, layer, CAST(sum(floor(bits)) AS BIGINT) AS bits FROM costs JOIN band_dim USING (band) GROUP BY track, frame, layer")
shared("quantize_fixed_step", "SELECT track, frame, band, coeff, q FROM quant")
shared("nonzero_levels", "SELECT track, frame, band, count(*) AS nonzero, max(abs(CAST(q AS INT))) AS peak FROM quant WHERE q <> 0 GROUP BY track, frame, band")
shared("dequantize_snr", """SELECT track, frame, round(CASE WHEN sqrt(avg(pow(c - q * step, 2e0))) < 1e-12 THEN 200e0 ELSE 20e0 * log10(sqrt(avg(c * c)) / sqrt(avg(pow(c - q * step, 2e0))) + 1e-300) END, 6) AS snr_db
  FROM quant GROUP BY track, frame HAVING avg(c * c) > 1e-20""")
shared("corpus_summary", """SELECT f.track, count(*) AS frames, round(avg(e.bits), 6) AS mean_bits, round(min(e.bits), 6) AS least_bits, round(max(e.bits), 6) AS most_bits,
  round(sum(e.bits) / (count(*) * 1024e0 / 44100e0) / 1000e0, 6) AS kbps FROM frames f JOIN (SELECT track, frame, sum(bits) AS bits FROM costs GROUP BY track, frame) e ON e.track = f.track AND e.frame = f.frame
  WHERE NOT f.is_silence GROUP BY f.track""")
shared("k_neighbors", "SELECT track, frame, coalesce(k0, -1) AS k0, coalesce(k1, -1) AS k1 FROM neighbours")
shared("promote_boundary", "SELECT track, frame, was, ftype, gop_pos FROM neighbours")
shared("b_residual", """SELECT n.track, n.frame, c.m, round(c.c - ((1e0 - n.gop_pos / 8e0) * a.c + n.gop_pos / 8e0 * b.c), 6) AS residual FROM neighbours n
  JOIN coeffs c ON c.track = n.track AND c.frame = n.frame JOIN coeffs a ON a.track = n.track AND a.frame = n.k0 AND a.m = c.m JOIN coeffs b ON b.track = n.track AND b.frame = n.k1 AND b.m = c.m WHERE n.ftype = 'B'""",
  lambda s, d: levels.residuals(analysis(s, d)).select("track", "frame", F.posexplode("residual").alias("m", "residual")).withColumn("residual", F.round("residual", 6)))
shared("residual_bands", """SELECT r.track, r.frame, b.band, round(greatest(20e0 * log10(sqrt(avg(r.e * r.e)) + 1e-12), -80e0), 6) AS db FROM
  (SELECT n.track, n.frame, c.m, c.c - ((1e0 - n.gop_pos / 8e0) * a.c + n.gop_pos / 8e0 * b.c) AS e FROM neighbours n
  JOIN coeffs c ON c.track = n.track AND c.frame = n.frame JOIN coeffs a ON a.track = n.track AND a.frame = n.k0 AND a.m = c.m JOIN coeffs b ON b.track = n.track AND b.frame = n.k1 AND b.m = c.m WHERE n.ftype = 'B') r
  JOIN bin_dim b ON b.m = r.m GROUP BY r.track, r.frame, b.band""",
  lambda s, d: levels.residual_bands(analysis(s, d)).select("track", "frame", "band", F.round("db", 6).alias("db")))
shared("asof_steps", "SELECT a.track, a.frame, a.key_frame, s.band, round(s.step, 9) AS step FROM key_steps a JOIN steps s ON s.track = a.track AND s.frame = a.key_frame")
shared("missing_k_decay", f"""SELECT n.track, n.frame, CASE WHEN n.k1 IS NULL THEN l.last_k ELSE n.k1 END AS key_used, round(CASE WHEN n.k1 IS NULL THEN pow({DECAY_PER_FRAME!r}e0, greatest(n.frame - l.last_k, 0)) ELSE 1e0 END, 9) AS fade
  FROM neighbours n JOIN (SELECT track, max(frame) AS last_k FROM frames WHERE ftype = 'K' GROUP BY track) l ON l.track = n.track""")
shared("decode_alpha", "SELECT track, frame, band, coeff, round(q * CAST(CAST(step AS REAL) AS DOUBLE) * (1e0 - band / 96e0), 6) AS c FROM quant".replace("REAL", "FLOAT"))
shared("layer_select", "SELECT q.track, q.frame, q.band, round(sum(abs(CASE WHEN d.layer IN (0, 1) THEN q.q * q.step ELSE 0e0 END)), 6) AS kept FROM quant q JOIN band_dim d ON d.band = q.band GROUP BY q.track, q.frame, q.band")
shared("bframe_reconstruct", """SELECT n.track, n.frame, c.m, round((1e0 - n.gop_pos / 8e0) * a.q * a.step + n.gop_pos / 8e0 * b.q * b.step + RINT((c.c - ((1e0 - n.gop_pos / 8e0) * a.c + n.gop_pos / 8e0 * b.c)) / c.step) * c.step, 6) AS c
  FROM neighbours n JOIN quant c ON c.track = n.track AND c.frame = n.frame JOIN quant a ON a.track = n.track AND a.frame = n.k0 AND a.m = c.m JOIN quant b ON b.track = n.track AND b.frame = n.k1 AND b.m = c.m WHERE n.ftype = 'B'""",
  lambda s, d: levels.rebuilt(fixed_levels(s, d)).select("track", "frame", "m", F.round("c", 6).alias("c")))

_SAMPLES = """SELECT track, n, round(sum(y), 6) AS x FROM
  (SELECT c.track, (c.frame - 1) * CAST(1024 AS BIGINT) + k.i AS n, sum(c.c * cos(pi() / 1024e0 * (k.i + 512.5e0) * (c.m + 0.5e0))) * sin(pi() / 2048e0 * (k.i + 0.5e0)) * sqrt(2e0 / 1024e0) AS y
   FROM {source} c CROSS JOIN RANGE(0, 2048) k GROUP BY c.track, c.frame, k.i) v WHERE n >= 0 AND n < (SELECT max(frame) FROM {source}) * 1024 GROUP BY track, n"""
shared("overlap_add", _SAMPLES.format(source="coeffs"), lambda s, d: framing.overlap_add(analysis(s, d).select("track", "frame", "coeffs")).select("track", "n", F.round("x", 6).alias("x")))
shared(
    "reverse_frames",
    _SAMPLES.format(source="(SELECT c.track, l.last - c.frame AS frame, m, c FROM coeffs c JOIN (SELECT track, max(frame) AS last FROM coeffs GROUP BY track) l ON l.track = c.track)"),
    lambda s, d: framing.overlap_add(analysis(s, d).select("track", "frame", "coeffs"), reverse=True).select("track", "n", F.round("x", 6).alias("x")),
)


def _speed(name: str, speed: float) -> None:
    sql = f"""SELECT g.track, CAST(g.j AS BIGINT) AS n, round(a.x * (1e0 - (g.p - floor(g.p))) + coalesce(b.x, 0e0) * (g.p - floor(g.p)), 6) AS x FROM
      (SELECT track, j, j * (n_in - 1e0) / (n_out - 1e0) AS p FROM (SELECT track, n_in, n_out, UNNEST_RANGE(0, n_out) AS j FROM
        (SELECT track, CAST(count(*) AS BIGINT) AS n_in, CAST(RINT(count(*) / {speed}e0) AS BIGINT) AS n_out FROM type_signal GROUP BY track) c) u) g
      JOIN type_signal a ON a.track = g.track AND a.n = CAST(floor(g.p) AS BIGINT) LEFT JOIN type_signal b ON b.track = g.track AND b.n = CAST(floor(g.p) AS BIGINT) + 1"""
    shared(name, sql, lambda s, d: resample.at_speed(signals.event_type_signal(s, d), speed).select("track", "n", F.round("x", 6).alias("x")))


_speed("resample_double", 2.0)
_speed("resample_half", 0.5)
shared("stop_decay", "SELECT track, n, round(x * exp(-(n / 44100e0) / 0.060e0), 9) AS x FROM type_signal", lambda s, d: resample.at_speed(signals.event_type_signal(s, d), 0.0).select("track", "n", F.round("x", 9).alias("x")))
shared("duration_capacity", "SELECT track, n_frames, round(n_frames * 1024e0 / 44100e0, 9) AS seconds, CASE WHEN n_frames > 1298 THEN 'over' WHEN n_frames > 779 THEN 'large only' ELSE 'fits' END AS capacity FROM counts")

shared("huffman_code_dim", "SELECT symbol, len, bits FROM code_dim")
shared("huffman_band_bits", "SELECT track, frame, band, CAST(bits AS BIGINT) AS bits, CAST((bits + 7) // 8 AS BIGINT) AS bytes FROM code_bits v")
shared("layer_byte_size", "SELECT v.track, v.frame, d.layer, CAST(sum(6 + (bits + 7) // 8) AS BIGINT) AS bytes FROM code_bits v JOIN band_dim d ON d.band = v.band GROUP BY v.track, v.frame, d.layer")
shared("encoded_size", """SELECT track, CAST(sum(6 + (bits + 7) // 8) + 36 + count(DISTINCT frame) * 12 AS BIGINT) AS bytes, count(DISTINCT frame) AS frames,
  round((sum(6 + (bits + 7) // 8) + 36 + count(DISTINCT frame) * 12) * 8e0 / (count(DISTINCT frame) * 1024e0 / 44100e0) / 1000e0, 6) AS kbps FROM code_bits v GROUP BY track""")
shared("layer_rms", "SELECT c.track, b.layer, round(sqrt(avg(c.c * c.c)), 9) AS rms FROM coeffs c JOIN bin_dim m ON m.m = c.m JOIN band_dim b ON b.band = m.band GROUP BY c.track, b.layer")
shared("alpha_curve", """SELECT a.alpha, round(20e0 * log10(sqrt(avg(pow(c.c * a.alpha, 2e0))) / sqrt(avg(c.c * c.c))), 6) AS attenuation_db FROM coeffs c
  CROSS JOIN (SELECT CAST(v AS DOUBLE) AS alpha FROM (VALUES (1.0), (0.7), (0.5), (0.3), (0.1)) AS t(v)) a GROUP BY a.alpha""")
shared("loud_quiet_ratio", "SELECT track, round(sqrt(avg(CASE WHEN n < 4096 THEN x * x END)) / (sqrt(avg(CASE WHEN n >= 4096 THEN x * x END)) + 1e-12), 6) AS ratio FROM tone GROUP BY track")
shared("tone_signal", "SELECT track, CAST(n AS BIGINT) AS n, round(x, 9) AS x FROM tone", lambda s, d: signals.tones(s, 8192).select("track", "n", F.round("x", 9).alias("x")))
shared("signal_snr", """SELECT s.track, count(*) AS n, round(20e0 * log10(sqrt(avg(s.x * s.x)) / (sqrt(avg(pow(s.x - round(s.x, 3), 2e0))) + 1e-12)), 6) AS snr_db FROM signal s
  JOIN (SELECT track, max(n) AS m FROM signal GROUP BY track) e ON e.track = s.track WHERE s.n >= 2048 AND s.n < e.m + 1 - 2048 GROUP BY s.track""")


def _hops(spark, sf_dir):
    """Each hop resampled on its own, as live playback does."""
    hops = signals.event_type_signal(spark, sf_dir).select(F.concat_ws("#", "track", F.floor(F.col("n") / 1024).cast("string")).alias("track"), F.pmod("n", F.lit(1024)).alias("n"), "x")
    return resample.at_speed(hops, 1.6).select("track", "n", F.round("x", 6).alias("x"))


_HOP = "(SELECT track || '#' || CAST(n // 1024 AS VARCHAR) AS track, n % 1024 AS n, x FROM type_signal)"
shared(
    "hop_resample",
    f"""SELECT g.track, CAST(g.j AS BIGINT) AS n, round(a.x * (1e0 - (g.p - floor(g.p))) + coalesce(b.x, 0e0) * (g.p - floor(g.p)), 6) AS x FROM
      (SELECT track, j, CASE WHEN n_out > 1 THEN j * (n_in - 1e0) / (n_out - 1e0) ELSE 0e0 END AS p FROM (SELECT track, n_in, n_out, UNNEST_RANGE(0, n_out) AS j FROM
        (SELECT track, CAST(count(*) AS BIGINT) AS n_in, CAST(greatest(1e0, RINT(count(*) / 1.6e0)) AS BIGINT) AS n_out FROM {_HOP} h GROUP BY track) c) u) g
      JOIN {_HOP} a ON a.track = g.track AND a.n = CAST(floor(g.p) AS BIGINT) LEFT JOIN {_HOP} b ON b.track = g.track AND b.n = CAST(floor(g.p) AS BIGINT) + 1""",
    _hops,
)

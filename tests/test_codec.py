import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.functions.dims import band_bins, code_table
from quadrille.operators import codec, framing, resample
from quadrille.sources import container, signals, wav


def column(df):
    return np.array([r.x for r in df.orderBy("n").collect()])


def test_fixed_tables():
    starts = [0, 5, 9, 14, 19, 23, 28, 32, 37, 42, 47, 54, 61, 69, 79, 89, 101, 115, 130, 148, 168, 190, 216, 245]
    starts += [278, 294, 310, 327, 346, 365, 385, 407, 429, 453, 479, 505, 534, 563, 595, 628, 663, 700, 739, 780, 824, 870, 918, 969]
    assert [a for a, _ in band_bins()] == starts and band_bins()[-1][1] == 1023
    lengths = [len(code_table()[s]) for s in range(34)]
    assert lengths == [2, 2, 3, 3, 4, 5, 5, 6, 6, 7, 7, 8, 8, 9, 9, 10, 10, 11, 11, 12, 12, 13, 13, 14, 14, 15, 15, 16, 16, 17, 17, 17, 17, 4]
    assert code_table()[0] == "11" and code_table()[33] == "1000" and code_table()[32] == "10010000000000000"


def test_transform_inverts(spark):
    rng = np.random.default_rng(42)
    x = rng.standard_normal(12 * 1024)
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "track string, n long, x double")
    back = column(framing.overlap_add(framing.analysed(df).select("track", "frame", "coeffs")))
    n = min(len(x), len(back))
    assert len(back) >= len(x)
    assert 20 * math.log10(np.sqrt(np.mean(x[:n] ** 2)) / np.sqrt(np.mean((x[:n] - back[:n]) ** 2))) > 200


@pytest.mark.parametrize("length,frames", [(10000, 11), (1024, 3), (8 * 1024, 10), (1, 2)])
def test_frame_counts(spark, length, frames):
    df = framing.analysed(signals.tones(spark, length))
    assert df.count() == frames


@pytest.mark.parametrize("kbps,least", [(6, 5), (12, 8), (32, 12), (96, 18)])
def test_round_trip_floors(spark, kbps, least):
    s = signals.tones(spark, 32 * 1024)
    assert codec.snr(s, codec.decode(codec.encode(s, kbps))).first().snr_db >= least


@pytest.fixture(scope="module")
def coded(spark):
    return codec.encode(signals.tones(spark, 24 * 1024), 12.0).cache()


def test_alpha_scales_and_mutes(coded):
    full, half, none = (column(codec.decode(coded, alpha=[a] * 48)) for a in (1.0, 0.5, 0.0))
    assert 0.45 < np.sqrt(np.mean(half**2)) / np.sqrt(np.mean(full**2)) < 0.55 and np.abs(none).max() < 1e-9


def test_speeds(coded):
    full = column(codec.decode(coded))
    for speed in (2.0, 0.5):
        assert abs(len(column(codec.decode(coded, speed=speed))) - round(len(full) / speed)) <= 2
    stopped = column(codec.decode(coded, speed=0.0))
    quarter = len(stopped) // 4
    assert np.sqrt(np.mean(stopped[:quarter] ** 2)) > 2 * np.sqrt(np.mean(stopped[-quarter:] ** 2))


def test_resampling_equals_interpolation(spark):
    x = np.sin(np.arange(1000) / 7.0)
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "track string, n long, x double")
    for speed in (0.5, 1.7, 3.0):
        n = max(1, round(len(x) / speed))
        assert np.allclose(column(resample.at_speed(df, speed)), np.interp(np.linspace(0, len(x) - 1, n), np.arange(len(x)), x))


def test_reverse_puts_the_loud_half_last(spark):
    s = signals.ramp(spark, 32 * 1024)
    back = column(codec.decode(codec.encode(s, 12.0), reverse=True))
    half = len(back) // 2
    assert np.sqrt(np.mean(back[half:] ** 2)) > 3 * np.sqrt(np.mean(back[:half] ** 2))


def test_silence_and_short_tracks(spark):
    quiet = spark.range(20 * 1024).select(F.lit("q").alias("track"), F.col("id").alias("n"), F.lit(0.0).alias("x"))
    kinds = {r.frame: r.ftype for r in codec.encode(quiet).collect()}
    assert kinds[0] == "K" and kinds[1] == "S" and kinds[8] == "K"
    assert np.abs(column(codec.decode(codec.encode(quiet)))).max() == 0
    one = codec.encode(signals.tones(spark, 8 * 1024))
    assert {r.ftype for r in one.where("frame >= 8").collect()} <= {"K", "S"}


def test_missing_keyframe_fades(coded):
    cut = coded.where("frame <> 24")
    full, part = (codec.decoded_coeffs(x).where("frame = 23").first().coeffs for x in (coded, cut))
    assert len(part) == 1024 and part != full


def test_band_code():
    rng = np.random.default_rng(1)
    for q in (np.zeros(40), rng.integers(-4, 5, 64), np.array([127, -512, 2047, -2047, 0, 1]), np.array([0, 0, 3, 0, 0]), np.array([31, -31, 32])):
        q = q.astype(np.int16)
        assert (container.unpack_band(container.pack_band(q), len(q)) == q).all()
    assert container.pack_band(np.zeros(5, np.int16)) == b""


def test_containers(spark, coded, tmp_path):
    files = container.to_containers(coded).collect()
    data = bytes(files[0].payload)
    (tmp_path / "tones.bin").write_bytes(data)
    head = container.header(data)
    assert head["n_frames"] == coded.count() and container.crc_ok(data)
    container.register(spark)
    whole = spark.read.format("quadrille").load(str(tmp_path))
    assert whole.count() == coded.count()
    low = spark.read.format("quadrille").option("layers", "0").load(str(tmp_path)).where("ftype = 'K'").first()
    assert not any(low.q[37:]) and any(low.q[:37])
    broken = data[:-1] + bytes([data[-1] ^ 1])
    with pytest.raises(ValueError):
        list(container.unpack(broken))
    with pytest.raises(ValueError):
        container.header(b"nope" + data[4:])


def test_wav_files(spark, tmp_path):
    x = np.array([0.0, 0.5, -0.5, 1.5, -1.5])
    (tmp_path / "a.wav").write_bytes(wav.encoded(x))
    got = column(wav.read_wav(spark, str(tmp_path)))
    assert np.allclose(got, [0, 0.49997, -0.49997, 0.99997, -1.0], atol=1e-4)


def test_resampling_joins_no_table_of_outputs(spark):
    """A grid of outputs out of one row a track was taken for small and broadcast, however long the track."""
    df = spark.range(5000).selectExpr("CASE WHEN id % 5 = 0 THEN 'a' ELSE 'b' END AS track", "CASE WHEN id % 5 = 0 THEN id DIV 5 ELSE id - id DIV 5 - 1 END AS n", "sin(id) AS x")
    x = {t: df.where(f"track = '{t}'").orderBy("n").toPandas()["x"].to_numpy() for t in "ab"}
    out = resample.at_speed(df, 0.5)
    rows = out.toPandas()
    for t, want in x.items():
        got = rows[rows["track"] == t].sort_values("n")
        assert got["n"].tolist() == list(range(2 * len(want))) and np.allclose(got["x"], np.interp(np.linspace(0, len(want) - 1, 2 * len(want)), np.arange(len(want)), want))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(" not in plan
    one = spark.createDataFrame([("c", 0, 0.25)], "track string, n long, x double")
    assert sorted(map(tuple, resample.at_speed(one, 0.5).collect())) == [("c", 0, 0.25), ("c", 1, 0.25)]
    gap = spark.createDataFrame([("d", 0, 1.0), ("d", 1, 1.0), ("d", 2000, 1.0)], "track string, n long, x double")
    assert sorted(r.n for r in resample.at_speed(gap, 0.5).collect()) == [0, 1, 2, 3, 4, 3999, 4000, 4001]

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.operators import codec, framing, geometry
from quadrille.plans import api
from quadrille.sources import container, images, layout, raw_frames, signals, wav
from quadrille.streaming import live


@pytest.fixture(scope="module")
def coded(spark):
    return codec.encode(signals.tones(spark, 12 * 1024), 12.0).cache()


def column(df):
    return np.array([r.x for r in df.orderBy("n").collect()])


@pytest.mark.parametrize("packed", [False, True])
def test_frame_streams(spark, coded, packed):
    back = raw_frames.from_stream(raw_frames.to_stream(coded, packed), packed)
    both = coded.join(back.select("frame", F.col("q").alias("q2"), F.col("ftype").alias("f2")), "frame")
    assert both.count() == coded.count() and both.where((F.col("q") != F.col("q2")) | (F.col("ftype") != F.col("f2"))).count() == 0
    with pytest.raises(ValueError):
        list(raw_frames.unpack_frames(b"nonsense bytes"))


def test_files_there_and_back(spark, tmp_path):
    x = 0.5 * np.sin(2 * np.pi * 440 * np.arange(12 * 1024) / 44100)
    (tmp_path / "wav").mkdir()
    (tmp_path / "out").mkdir()
    (tmp_path / "wav" / "a.wav").write_bytes(wav.encoded(x))
    files = api.encode(spark, str(tmp_path / "wav"), 32.0)
    row = files.first()
    (tmp_path / "out" / "a.bin").write_bytes(bytes(row.payload))
    facts = api.info(files).first()
    assert facts.crc_ok and facts.n_frames == 14 and facts.mode == "discrete" and facts.sample_rate == 44100 and facts.bitrate_kbps == 32
    y = column(api.decode(spark, str(tmp_path / "out")))
    n = min(len(x), len(y)) - 2048
    assert 10 * np.log10(np.mean(x[2048:n] ** 2) / np.mean((x[2048:n] - y[2048:n]) ** 2)) > 12
    assert len(column(api.decode(spark, str(tmp_path / "out"), layers=(0,), speed=2.0))) == round(len(y) / 2)


@pytest.mark.parametrize("mode", [1, 2])
def test_layouts(coded, mode):
    doc = api.layout(coded, mode).first().document
    whole = json.loads(doc)
    assert whole["n_frames"] == coded.count() and all(len(f["bands"]) == 48 for f in whole["frames"])
    steep = [b["steepness"] for f in whole["frames"] for b in f["bands"]]
    assert 0 <= min(steep) and 0 < max(steep) <= 1
    assert layout.from_documents(api.layout(coded, mode)).count() == 48 * coded.count()


def test_bench_table(spark):
    row = api.bench(signals.tones(spark, 12 * 1024), (12.0, 96.0)).first()
    assert row["96.0"] > row["12.0"] > 8


def test_images_and_components(spark, tmp_path):
    picture = np.zeros((12, 20, 3), np.uint8)
    picture[1:4, 2:6] = (255, 0, 255)
    picture[6:9, 10:14] = (255, 0, 255)
    picture[9, 13:18] = (255, 0, 255)
    (tmp_path / "a.png").write_bytes(images.png(picture))
    pixels = images.read_images(spark, str(tmp_path)).cache()
    assert pixels.count() == 240
    mask = pixels.where("r > 200 and g < 50 and b > 200").select("img", "y", "x")
    found = sorted((r.area, round(r.cx, 3), round(r.cy, 3)) for r in geometry.blobs(geometry.components(mask)).collect())
    assert found == [(12, 3.5, 2.0), (17, round((11.5 * 12 + 15 * 5) / 17, 3), round((7 * 12 + 9 * 5) / 17, 3))]
    again = images.to_png(pixels).first()
    assert (again.width, again.height) == (20, 12) and bytes(again.payload) == images.png(picture)


def test_perspective(spark):
    square, quad = [(0, 0), (9, 0), (9, 9), (0, 9)], [(1, 1), (8, 2), (9, 9), (0, 7)]
    h = geometry.homography(square, quad)
    for (x, y), (u, v) in zip(square, quad):
        p = h @ [x, y, 1]
        assert np.allclose(p[:2] / p[2], (u, v))
    df = spark.createDataFrame([("a", y, x, 10 * x, 10 * y, 5) for x in range(11) for y in range(11)], "img string, y int, x int, r int, g int, b int")
    for r in geometry.warp(df, h, 10, 10).collect():
        p = h @ [r.x, r.y, 1]
        assert np.allclose((r.r, r.g), 10 * p[:2] / p[2]) and np.isclose(r.b, 5)


def test_calibration():
    rng = np.random.default_rng(2)
    canonical = rng.uniform(0, 60, (8, 3))
    turn, shift = np.eye(3) + rng.uniform(-0.1, 0.1, (3, 3)), np.array([3.0, -2.0, 1.0])
    observed = (canonical - shift) @ np.linalg.inv(turn).T
    a = geometry.calibration(observed, canonical)
    assert np.allclose(np.hstack((observed, np.ones((8, 1)))) @ a.T, canonical)
    assert (geometry.calibration(observed[:5], canonical[:5]) == np.eye(3, 4)).all()


def test_streamed_overlap_equals_batch(spark, tmp_path):
    coeffs = framing.analysed(signals.tones(spark, 6 * 1024)).select("track", F.col("frame").cast("long").alias("frame"), "coeffs")
    for part in (0, 1):  # two micro-batches
        coeffs.where(f"frame div 4 = {part}").write.mode("append").parquet(str(tmp_path / "in"))
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(coeffs.schema).option("maxFilesPerTrigger", 100).parquet(str(tmp_path / "in"))
        run = live.stream_overlap_add(stream).writeStream.format("memory").queryName("overlap").trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        spark.conf.unset(key)
    hops = {r.frame: r.x for r in spark.table("overlap").collect()}
    batch = column(framing.overlap_add(coeffs))
    for frame in range(1, max(hops)):
        assert np.allclose(hops[frame], batch[(frame - 1) * 1024 : frame * 1024])


def test_speed_estimates():
    assert live.speed_of([(0, 1.0)]) == 1.0 and live.speed_of([(0, 1.0), (50, 9.0)]) == 0.0
    assert abs(live.speed_of([(0, 0.0), (1_000_000, 43.06640625)]) - 1) < 1e-12


def test_command_line(spark, tmp_path, capsys):
    from quadrille.__main__ import main

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.wav").write_bytes(wav.encoded(0.5 * np.sin(np.arange(9 * 1024) / 9)))
    coded, out, doc = (str(tmp_path / x) for x in ("coded", "out", "doc"))
    main(["encode", str(tmp_path / "in"), coded, "-b", "32"], spark)
    main(["info", coded], spark)
    assert "discrete" in capsys.readouterr().out
    main(["decode", coded, out, "--layers", "0,1", "--speed", "2"], spark)
    assert len(wav.samples(bytes(spark.read.parquet(out).first().payload))) == 5 * 1024
    main(["layout", coded, doc, "--mode", "2"], spark)
    assert json.loads(spark.read.text(doc).first().value)["n_bands"] == 48


def test_results_as_json(spark, tmp_path):
    reads = spark.createDataFrame([("a", 0, 3, 0.25, 1), ("a", 1, 3, None, -1)], "track string, frame int, band int, steepness double, direction int")
    api.write_results(reads, str(tmp_path / "reads"))
    back = spark.read.schema(reads.schema).json(str(tmp_path / "reads"))
    assert sorted(map(tuple, back.collect()), key=lambda r: r[1]) == sorted(map(tuple, reads.collect()), key=lambda r: r[1])


def test_noise_is_white_and_repeatable(spark):
    one, two = (np.array([r.x for r in signals.noise(spark, 20000).repartition(k).orderBy("n").collect()]) for k in (1, 7))
    assert (one == two).all() and abs(one.std() - 0.1) < 0.005 and abs(one.mean()) < 0.005
    assert abs(np.corrcoef(one[1:], one[:-1])[0, 1]) < 0.05

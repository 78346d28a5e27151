"""The chain from a rendered strip to cells read in a photograph of it."""

from itertools import combinations

import numpy as np

from quadrille import catalog
from quadrille.functions.dims import LAYER_PAIRS, PALETTE
from quadrille.operators import camera, geometry
from quadrille.plans import base, camera_queries
from tests.conftest import SF


def test_cells_are_read_through_marks_and_perspective(spark):
    read = catalog.QUERIES["camera_read"](spark, SF).collect()
    assert len(read) == 1 and read[0].n_cells == 48 * 2
    assert read[0].direction_accuracy >= 0.9 and read[0].steepness_mae < 0.12 and read[0].alpha > 0.9


def test_noise_and_blur(spark):
    flat = spark.range(400).selectExpr("'a' AS img", "CAST(id DIV 20 AS INT) AS y", "CAST(id % 20 AS INT) AS x", "128 AS r", "128 AS g", "CASE WHEN id % 20 < 10 THEN 0 ELSE 200 END AS b")
    noise = camera.noisy(flat.repartition(3), 10.0).toPandas()
    again = camera.noisy(flat, 10.0).toPandas()
    key = ["y", "x"]
    assert noise.sort_values(key)["r"].tolist() == again.sort_values(key)["r"].tolist()
    assert abs(noise["r"].mean() - 128) < 2 and 8 < noise["r"].std() < 12 and abs(np.corrcoef(noise["r"], noise["g"])[0, 1]) < 0.2
    soft = camera.blurred(flat, 1.0).toPandas().sort_values(key)
    assert len(soft) == 400 and set(soft["r"]) == {128}
    row = soft[soft["y"] == 5]["b"].tolist()
    assert row == sorted(row) and row[0] == 0 and row[-1] == 200 and 0 < row[9] < row[10] < 200


def test_marks_and_colours_are_made_without_the_grid_of_the_photograph(spark, monkeypatch):
    frames = 1200  # 9648 pixels of the strip, where the photograph is sheared
    wide = frames * camera_queries.WIDTH + 2 * camera_queries.MARGIN
    monkeypatch.setitem(base.RELATIONS, "counts", base.Relation(base.RELATIONS["counts"].sql, lambda s, d: s.createDataFrame([("a", frames)], "track string, n_frames int")))
    rng = np.random.default_rng(5)
    found = {(int(y), int(x)) for y, x in zip(rng.integers(0, camera_queries.HEIGHT, 300), rng.integers(0, wide, 300))} | {(y, x) for y in (0, 243) for x in (0, 1, wide - 2, wide - 1)}
    x, y = np.meshgrid(np.arange(2 * wide, dtype=float), np.arange(2 * camera_queries.HEIGHT, dtype=float))
    den = 1 + 0.06 * x / (2.0 * wide) + 0.04 * y / (2 * camera_queries.HEIGHT)
    sx = np.floor((0.625 * x + 0.004 * y - 0.05 * wide) / den).astype(int)
    sy = np.floor((0.625 * y + 7.0 * (x / (2.0 * wide)) - 12.2) / den).astype(int)
    asked = np.isin(sy * 100000 + sx, [v * 100000 + u for v, u in found]) & (sx >= 0) & (sx < wide)
    want = {("a", int(v), int(u)) for v, u in np.argwhere(asked)}
    shown = camera_queries._shown(spark, SF, spark.createDataFrame([("a", *f) for f in sorted(found)], "img string, y int, x int"))
    got = list(map(tuple, shown.collect()))
    assert len(want) > 300 and len(got) == len(want) and set(got) == want


def test_places_get_the_colours_of_the_photograph(spark):
    photo = {(r.y, r.x): (r.r, r.g, r.b) for r in catalog.QUERIES["photo_pixels"](spark, SF).collect()}
    high, wide = max(y for y, _ in photo) + 1, max(x for _, x in photo) + 1
    places = [("all", y, x, float(x)) for y in range(-1, high + 1, 7) for x in range(-1, wide + 1)]
    got = camera_queries._looked_up(spark, SF)(spark.createDataFrame(places, "img string, y int, x int, w double")).collect()
    assert {(r.y, r.x): (r.r, r.g, r.b) for r in got} == {(y, x): photo[y, x] for _, y, x, _ in places if (y, x) in photo}
    assert all(r.w == r.x for r in got)
    want = {k for k, (r, g, b) in photo.items() if r > 200 and g < 50 and b > 200}
    assert want == {(r.y, r.x) for r in catalog.QUERIES["fiducial_mask"](spark, SF).collect()}


def test_marks_are_found_without_making_the_cells(spark, monkeypatch):
    want = {(r.y, r.x) for r in catalog.QUERIES["photo_pixels"](spark, SF).where("r > 200 AND g < 50 AND b > 200").collect()}

    def never(*_):
        raise AssertionError("cells are made")

    monkeypatch.setitem(base.RELATIONS, "cells", base.Relation(base.RELATIONS["cells"].sql, never))
    got = [(r.y, r.x) for r in catalog.QUERIES["fiducial_mask"](spark, SF).collect()]
    assert len(want) > 300 and len(got) == len(want) and set(got) == want


def test_blends_that_may_be_marks():
    way = np.linspace(0, 1, 2001)[:, None]
    rng = np.random.default_rng(3)
    pairs = [tuple(map(tuple, rng.choice([0, 20, 60, 190, 210, 255], (2, 3)).tolist())) for _ in range(300)] + [(PALETTE[a], PALETTE[b]) for p in LAYER_PAIRS for a, b in p]
    for a, b in pairs:
        r, g, v = np.floor(np.array(a) + (np.array(b) - np.array(a)) * way).T
        assert camera.may_blend_to_mark(a, b) == bool(((r > 200) & (g < 50) & (v > 200)).any())


def test_one_task_labels_as_rounds_do(spark):
    rng = np.random.default_rng(9)
    at = {(img, int(y), int(x)) for img, share in (("a", 0.55), ("b", 0.4)) for y, x in np.argwhere(rng.random((60, 50)) < share)}
    at -= {("a", 30, x) for x in range(50)}  # a row without any
    mask = spark.createDataFrame([*sorted(at), (None, 1, 1)], "img string, y int, x int")
    once, rounds = (sorted(map(tuple, geometry.components(mask, n).collect())) for n in (geometry.IN_TASK, 0))
    assert once == rounds and 20 < len({r[::4] for r in once}) < len(once)
    assert geometry.components(mask.limit(0)).count() == 0


def test_the_best_four_and_their_corners(spark):
    rng = np.random.default_rng(4)
    points = {img: [(n + 1, 100 + n, *map(float, xy)) for n, xy in enumerate(rng.uniform(0, 300, (count, 2)))] for img, count in (("a", 9), ("b", 4), ("c", 3))}
    wanted, want = {"a": 1.5, "b": 0.7, "c": 1.0}, {}
    for img, held in points.items():
        fours = []
        for four in combinations(held, 4):
            mx, my = np.mean([p[2] for p in four]), np.mean([p[3] for p in four])
            x, y = np.array(sorted(((p[2], p[3]) for p in four), key=lambda p: np.arctan2(p[1] - my, p[0] - mx))).T
            area = abs((x * np.roll(y, -1) - y * np.roll(x, -1)).sum()) / 2
            fours.append((area * np.exp(-abs(np.log(np.ptp(x) / np.ptp(y) / wanted[img]))), four))
        for score, four in sorted(fours)[-1:]:
            rows = sorted(four, key=lambda p: p[3])
            want |= {(img, name): (p[1], score) for half, side in ((rows[:2], "T"), (rows[2:], "B")) for name, p in zip((f"{side}L", f"{side}R"), sorted(half, key=lambda p: p[2]))}
    candidates = spark.createDataFrame([(img, wanted[img], *p) for img, held in points.items() for p in held], "img string, wanted double, place int, label long, cx double, cy double")
    best = camera.best_quadrilateral(camera.quadrilaterals(candidates)).cache()
    score = {r.img: r.score for r in best.collect()}
    got = {(r.img, r.corner): (r.label, score[r.img]) for r in camera.corners(best).collect()}
    assert len(want) == 8 and got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and np.isclose(got[k][1], want[k][1]) for k in want)


def test_corners_join_no_table_but_the_sizes(spark):
    plan = catalog.QUERIES["corner_order"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and plan.count("parquet") == 1


def test_the_map_is_solved_once(spark):
    plan = catalog.QUERIES["homography_points"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroupsInPandas") == 1 and plan.count("Join ") == 1 and plan.count("parquet") == 1

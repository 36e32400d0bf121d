import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.functions import camera, geodesy, geometry, robust
from pointloom.operators import aggregates as A
from pointloom.operators import filters, joins, shape


def cloud(spark, xyz):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(xyz)], "id long, x double, y double, z double")


CUBE = [*itertools.product((-0.1, 0.1), repeat=3), (0, 0, 0), (0.2, 0, 0), (0.2, 0.2, -0.2)]


def brute(a, b, radius):
    return sorted((i, j) for i, p in enumerate(a) for j, q in enumerate(b) if math.dist(p, q) <= radius)


@pytest.mark.parametrize("radius", [0.1, 0.2, 0.35])
def test_radius_pairs_match_all_pairs(spark, radius):
    p = cloud(spark, CUBE)
    got = sorted((r["l"]["id"], r["r"]["id"]) for r in joins.radius_pairs(p, p, ["x", "y", "z"], radius).collect())
    assert got == brute(CUBE, CUBE, radius)


def test_decimate_keeps_the_lowest_id(spark):
    p = cloud(spark, [(0.01 * i, 0.01, 0.01) for i in range(5)] + [(1.0, 1, 1)])
    assert sorted(r["id"] for r in A.decimate(p, ["x", "y", "z"], 0.1, "id").collect()) == [0, 5]
    assert sorted(r["id"] for r in A.decimate(p, ["x", "y", "z"], 0.1, "id", compat=True).collect()) == [5]
    assert A.voxel_moments(p, ["x", "y", "z"], 0.1, 5).count() == 1


def test_cells_toward_zero_and_down(spark):
    df = spark.createDataFrame([(-0.05,), (0.05,), (-0.15,), (3300.0,), (float("nan"),), (None,)], "x double")
    got = df.select(geometry.cell("x", 0.1).alias("t"), geometry.cell("x", 0.1, "floor").alias("f")).collect()
    assert [r["t"] for r in got] == [0, 0, -1, 33000, None, None]
    assert [r["f"] for r in got][:3] == [-1, 0, -2]


def test_plane_and_line_features(spark):
    plane = cloud(spark, [(0.1 * i, 0.1 * j, 0.0) for i in range(6) for j in range(6)])
    f = shape.neighbourhood_features(plane, 0.25, "id").collect()
    assert all(abs(r["nz"]) == pytest.approx(1) and r["horizontal"] for r in f)
    line = cloud(spark, [(0.0, 0.0, 0.05 * i) for i in range(20)])
    f = shape.neighbourhood_features(line, 0.2, "id")
    assert f.where("linearity > 0.99").count() == 20 and shape.poles(f).count() == 20


def test_box_and_annulus(spark):
    p = cloud(spark, CUBE)
    box = F.array(*[F.lit(float(v)) for v in np.eye(4).ravel()])
    assert p.where(filters.in_box(box, (0.3, 0.3, 0.3))).count() == 9
    assert filters.annulus(p, 0.0, 0.15).count() == 8


def test_projections(spark):
    r = spark.range(1).select(geodesy.utm(F.lit(52.2003), F.lit(20.9415)).alias("u"), geodesy.puwg92(F.lit(52.0), F.lit(19.0)).alias("p"), geodesy.enu(F.lit(52.0), F.lit(21.0), F.lit(110.0), 52.0, 21.0, 100.0).alias("e"), geodesy.web_mercator(F.lit(0.0), F.lit(180.0)).alias("w")).first()
    assert r["u"]["zone"] == 34 and r["u"]["east"] == pytest.approx(496_002, abs=20) and 5_780_000 < r["u"]["north"] < 5_786_000
    assert r["p"]["east"] == pytest.approx(500_000) and r["p"]["north"] == pytest.approx(460_000, abs=5_000)
    assert (r["e"]["e"], r["e"]["n"], r["e"]["u"]) == (pytest.approx(0, abs=1e-6), pytest.approx(0, abs=1e-6), pytest.approx(10))
    assert r["w"]["x"] == pytest.approx(20037508.342789244)


def test_camera(spark):
    cam = camera.Intrinsics(100.0, 100.0, 50.0, 50.0, width=100, height=100)
    r = spark.range(1).select(camera.project(F.lit(0.1), F.lit(0.2), F.lit(1.0), cam).alias("a"), camera.project(F.lit(0.0), F.lit(0.0), F.lit(-1.0), cam).alias("b")).first()
    assert (r["a"]["u"], r["a"]["v"]) == (pytest.approx(60), pytest.approx(70)) and r["b"] is None


@pytest.mark.parametrize("name", robust.ESTIMATORS)
def test_weights_are_influence_over_residual(spark, name):
    rho, up, w = robust.estimator(name, F.col("r"))
    rows = spark.createDataFrame([(0.3,), (-2.0,), (7.5,), (0.0,)], "r double").select("r", rho.alias("rho"), up.alias("up"), w.alias("w")).collect()
    for x in rows[:3]:
        assert x["w"] == pytest.approx(x["up"] / x["r"]) and x["rho"] >= 0
    h = 1e-5
    a, b = (spark.range(1).select(robust.estimator(name, F.lit(0.8 + d))[0].alias("v")).first()["v"] for d in (h, -h))
    assert (a - b) / (2 * h) == pytest.approx(spark.range(1).select(robust.estimator(name, F.lit(0.8))[1].alias("v")).first()["v"], rel=1e-3)


def test_bits(spark):
    r = spark.range(1).select(geometry.gray_to_binary(F.lit(7 ^ 3)).alias("g"), geometry.pack_flags([F.lit(True), F.lit(False), F.lit(True)]).alias("f")).first()
    assert r["g"] == 7 and r["f"] == 5


def test_pose_graph_closes_a_square():
    from pointloom.plans.solvers import exp_pose, pose_graph

    step = exp_pose(np.array([1.0, 0, 0, 0, 0, math.pi / 2]))
    true = [np.linalg.matrix_power(step, k) for k in range(4)]
    noisy = np.array([t @ exp_pose(0.05 * np.array([1, -1, 1, 0.2, -0.1, 0.3]) * (k > 0)) for k, t in enumerate(true)])
    out = pose_graph(noisy, [(k, (k + 1) % 4, step, 1.0) for k in range(4)], rounds=20)
    assert np.allclose(out, true, atol=1e-5)


def test_crowded_cell_is_split(spark, monkeypatch):
    """A cell with most of the points is dealt over parts and loses no pair."""
    rng = np.random.default_rng(7)
    xyz = np.concatenate([rng.uniform(0.41, 0.49, (1500, 3)), rng.uniform(0, 3, (200, 3))])
    left = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(xyz)], "id long, x double, y double, z double")
    right = left.where("id % 50 = 0")
    near = joins.radius_pairs(left, right, ["x", "y", "z"], 0.5)
    want = sum(int((np.linalg.norm(xyz - xyz[i], axis=1) <= 0.5).sum()) for i in range(0, len(xyz), 50))
    assert near.count() == want
    a, _ = joins.split_hot(left.selectExpr("id", "floor(x / 0.5) as k"), right.selectExpr("floor(x / 0.5) as k"), ["k"], F.xxhash64("id"))
    assert a.where("k = 0").select("__part").distinct().count() > 32 and a.where("k > 0 and __part > 0").count() == 0


@pytest.mark.parametrize("on", [[], ["k"]])
def test_nearest_over_many_blocks_matches_all_pairs(spark, monkeypatch, on):
    """Blocks of 20 rows: neighbours across their edges, copies (the smallest id counts), ties, rows without a place."""
    monkeypatch.setattr(joins, "BLOCK_ROWS", 20)
    monkeypatch.setattr(joins, "AT_ONCE", 50)
    rng = np.random.default_rng(4)
    own, other = (np.round(rng.normal(size=(n, 2)), 1) for n in (150, 300))
    rows = lambda at, shift: [(i + shift, int(i % 2), float(x), float(y)) for i, (x, y) in enumerate(at)] + [(9999, 0, None, 0.0), (9998, 1, float("nan"), 0.0)]
    left, right = (spark.createDataFrame(rows(at, s), "id long, k int, x double, y double") for at, s in ((own, 0), (other, 1000)))
    near = joins.nearest(left, right, ["x", "y"], 0.25, "id", "id", on)
    got = {r["id"]: (r["r"]["id"], r["d"], r["l"]["x"]) for r in near.collect()}
    want = {}
    for i, (x, y) in enumerate(own):
        hits = [(np.sqrt((x - u) * (x - u) + (y - v) * (y - v)), j + 1000) for j, (u, v) in enumerate(other) if not on or i % 2 == j % 2]
        d, j = min(hits)
        if d <= 0.25:
            want[i] = (j, d, x)
    assert got == want and 50 < len(got) < 150

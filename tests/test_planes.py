"""Registration by planes: planted poses come back, derivatives are right, awkward rows have defined results."""

import numpy as np
import pytest

from pointloom.plans import planes
from pointloom.plans.solvers import exp_pose


def room(rng, n=400, noise=0.002):
    """Points on a floor and four walls in three directions, none of them at a cell's border."""
    u, v = rng.uniform(0.05, 3.95, (2, 5, n))
    flat = lambda k: np.full(n, k) + noise * rng.normal(size=n)
    sides = [(u[0], v[0], flat(0.5)), (u[1], flat(0.5), v[1]), (flat(0.5), u[2], v[2]), (u[3], flat(3.5), v[3]), (flat(3.5), u[4], v[4])]
    return np.concatenate([np.stack(s, axis=1) for s in sides])


def scans(spark, rng, true):
    rows = []
    for k, t in enumerate(true):
        own = (room(rng) - t[:3, 3]) @ t[:3, :3]
        rows += [(k, *map(float, p)) for p in own]
    return spark.createDataFrame(rows, "scan_id long, x double, y double, z double")


def table(spark, poses):
    return spark.createDataFrame([(k, m.ravel().tolist()) for k, m in enumerate(poses)], "id long, pose array<double>")


@pytest.mark.parametrize("kind", planes.KINDS)
def test_derivatives(kind):
    rng = np.random.default_rng(4)
    ta, tb = (np.stack([exp_pose(rng.normal(size=6)) for _ in range(5)]) for _ in range(2))
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    args = rng.normal(size=(5, 3)), unit(rng.normal(size=(5, 3))), rng.normal(size=(5, 3)), unit(rng.normal(size=(5, 3)))
    r, ja, jb = planes.residuals(kind, ta, tb, *args)
    for k in range(6):
        m = exp_pose(1e-6 * np.eye(6)[k])
        assert np.allclose((planes.residuals(kind, ta @ m, tb, *args)[0] - r) / 1e-6, ja[:, :, k], atol=1e-4)
        assert np.allclose((planes.residuals(kind, ta, tb @ m, *args)[0] - r) / 1e-6, jb[:, :, k], atol=1e-4)


@pytest.mark.parametrize("kind", ["point_to_plane", "point_to_projection", "plane_to_plane"])
def test_planted_poses_come_back(spark, kind):
    rng = np.random.default_rng(8)
    true = [np.eye(4), exp_pose(np.array([0.4, -0.2, 0.1, 0.02, -0.01, 0.3])), exp_pose(np.array([-0.3, 0.3, 0.0, 0.0, 0.02, -0.2]))]
    start = [true[0], *(t @ exp_pose(d) for t, d in zip(true[1:], 0.03 * rng.normal(size=(2, 6))))]
    pairs = spark.createDataFrame([(0, 1), (1, 2), (0, 2)], "a long, b long")
    out = planes.register_planes(scans(spark, rng, true), table(spark, start), pairs, 1.0, 0.8, kind, rounds=12, tolerance=1e-5, covariances=kind == "plane_to_plane")
    got = {r["id"]: r for r in out.collect()}
    off = max(np.abs(np.reshape(got[k]["pose"], (4, 4)) - true[k]).max() for k in range(3))
    assert off < 0.005 < max(np.abs(s - t).max() for s, t in zip(start, true))
    if kind == "plane_to_plane":
        spread = {k: np.linalg.eigvalsh(np.reshape(got[k]["covariance"], (6, 6))) for k in got}
        assert all((v > 0).all() for v in spread.values()) and spread[0].max() < 1e-9 < spread[1].max() < 1e-3


def test_planes_of_awkward_points(spark):
    rng = np.random.default_rng(1)
    wall = [(1, float(x), float(y), 0.25) for x, y in rng.uniform(0, 1, (50, 2))]
    line = [(2, float(x), 0.5, 0.5) for x in rng.uniform(0, 1, 50)]
    odd = [(1, None, 0.0, 0.0), (1, float("nan"), 0.1, 0.1), (3, 0.1, 0.1, 0.1)] + [(4, 0.5, 0.5, 0.5)] * 20
    schema = "scan_id long, x double, y double, z double"
    got = planes.fitted_planes(spark.createDataFrame(wall + line + odd, schema), 1.0).collect()
    assert [(r["scan_id"], r["n"], abs(round(r["nz"], 6)), round(r["z"], 6), round(r["spread"], 9)) for r in got] == [(1, 50, 1.0, 0.25, 0.0)]
    assert planes.fitted_planes(spark.createDataFrame([], schema), 1.0).count() == 0


def test_matches_face_the_same_way_and_ties_go_to_the_smallest_name(spark):
    rows = [(0, "p", 10, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.1), (1, "s", 10, 0.0, 0.0, 0.2, 0.0, 0.0, -1.0, 0.1), (1, "r", 10, 0.0, 0.0, -0.2, 0.0, 0.0, 1.0, 0.1), (1, "q", 10, 0.0, 0.0, 0.1, 1.0, 0.0, 0.0, 0.1), (2, "p", 10, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.1)]
    own = spark.createDataFrame(rows, "scan_id long, plane string, n long, x double, y double, z double, nx double, ny double, nz double, spread double")
    still = table(spark, [np.eye(4)] * 3)
    pairs = spark.createDataFrame([(0, 1), (0, 1)], "a long, b long")
    got = planes.matched_planes(own, still, pairs, 0.5).collect()
    assert [(r["a"], r["b"], r["pb"], r["nb"]) for r in got] == [(0, 1, [0.0, 0.0, -0.2], [0.0, 0.0, 1.0])]
    assert got[0]["weight"] == pytest.approx(1 / (0.01 + 0.01 + 1e-4))
    assert planes.neighbours(still, 1.0).count() == 3
    with pytest.raises(ValueError):
        planes.plane_terms(still, planes.matched_planes(own, still, pairs, 0.5), "line_to_line")

"""Distributed block systems against dense ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.plans import sparse
from pointloom.plans.solvers import exp_pose, pose_graph


def chain(rng, n, noise=0.05):
    """A track of n poses, the same with drift, measured steps and a few loop edges."""
    true = [np.eye(4)]
    for _ in range(n - 1):
        true.append(true[-1] @ exp_pose(np.array([0.5, 0, 0.02, 0, 0.01, 0.15])))
    edges = [(i, i + 1, np.linalg.inv(true[i]) @ true[i + 1], 1.0) for i in range(n - 1)]
    edges += [(i, j, np.linalg.inv(true[i]) @ true[j], 5.0) for i, j in ((0, n - 1), (2, n // 2), (n // 3, n - 3))]
    drift = [true[0]]
    for i in range(n - 1):
        drift.append(drift[-1] @ np.linalg.inv(true[i]) @ true[i + 1] @ exp_pose(noise * rng.normal(size=6) * [1, 1, 1, 0.3, 0.3, 0.3]))
    return np.array(true), np.array(drift), edges


def frames(spark, poses, edges, ids=None):
    ids = range(len(poses)) if ids is None else ids
    p = spark.createDataFrame([(int(i), m.ravel().tolist()) for i, m in zip(ids, poses)], "id long, pose array<double>")
    e = spark.createDataFrame([(int(ids[a]), int(ids[b]), z.ravel().tolist(), w) for a, b, z, w in edges], "a long, b long, measured array<double>, weight double")
    return p, e


def test_system_matches_dense(spark):
    rng = np.random.default_rng(3)
    terms, a, b = [], np.zeros((60, 60)), np.zeros(60)
    for _ in range(200):
        nodes = sorted(rng.choice(30, 2, replace=False).tolist())
        jac, res, w = rng.normal(size=(2, 3, 2)), rng.normal(size=3), float(rng.uniform(0.5, 2))
        terms.append((nodes, jac.ravel().tolist(), res.tolist(), w))
        full = np.zeros((3, 60))
        for k, n in enumerate(nodes):
            full[:, 2 * n : 2 * n + 2] = jac[k]
        a, b = a + w * full.T @ full, b + w * full.T @ res
    df = spark.createDataFrame(terms, "nodes array<long>, jac array<double>, res array<double>, weight double")
    s = sparse.system(sparse.summed(sparse.term_blocks(df, 2), 2), 2, 8)
    x = rng.normal(size=(4, 16))
    v = spark.createDataFrame([(p, x[p].tolist()) for p in range(4)], "p long, v array<double>")
    y = np.array([r["y"] for r in sparse.product(s, v).orderBy("p").collect()]).ravel()[:60]
    assert np.allclose(y, a @ x.ravel()[:60])
    got = {r["id"]: r["x"] for r in sparse.solved(df, 2, 8).collect()}
    assert np.allclose([v for n in range(30) for v in got[n]], np.linalg.solve(a, b), atol=1e-7)


def test_consistent_trajectory_matches_the_driver_solver(spark):
    true, drift, edges = chain(np.random.default_rng(5), 14, 0.03)
    ids = [100 + 3 * i for i in range(14)]  # ids need not be dense
    got = {r["id"]: np.reshape(r["pose"], (4, 4)) for r in sparse.consistent(*frames(spark, drift, edges, ids), rounds=4, size=32, steps=30).collect()}
    want = pose_graph(drift, edges, rounds=12)
    assert np.allclose([got[i] for i in ids], true, atol=1e-4) and np.allclose(want, true, atol=1e-4)
    assert np.abs(drift - true).max() > 0.1


def test_places_draw_a_trajectory(spark):
    true, drift, edges = chain(np.random.default_rng(6), 12, 0.01)
    shift = exp_pose(np.array([2.0, -1, 0.5, 0, 0, 0.4]))
    p, e = frames(spark, drift, edges)
    places = spark.createDataFrame([(i, *(shift @ true[i])[:3, 3].tolist(), 100.0) for i in (0, 4, 7, 11)], "id long, x double, y double, z double, weight double")
    got = {r["id"]: np.reshape(r["pose"], (4, 4)) for r in sparse.consistent(p, e, places, rounds=8, size=16).collect()}
    assert np.allclose([got[i][:3, 3] for i in range(12)], [(shift @ t)[:3, 3] for t in true], atol=1e-3)


def test_voxels_pull_poses_back(spark):
    """Scans of a room against its map: poses off by little come back, with a step edge between them."""
    rng = np.random.default_rng(8)
    room = np.concatenate([np.insert(rng.uniform(-3, 3, (1500, 2)), axis, side * 3.0, axis=1) for axis in range(3) for side in (-1, 1)]) + rng.normal(scale=0.005, size=(9000, 3))
    true = [exp_pose(np.array([0.3 * k, 0.1, 0, 0, 0, 0.1 * k])) for k in range(3)]
    off = [t @ exp_pose(0.02 * rng.normal(size=6)) for t in true]
    rows = []
    for k, t in enumerate(true):
        own = np.c_[room[k::7], np.ones(len(room[k::7]))] @ np.linalg.inv(t).T
        rows += [(k, *p[:3].tolist()) for p in own]
    points = spark.createDataFrame(rows, "id long, x double, y double, z double")
    from pointloom.operators import maps

    map_points = spark.createDataFrame([tuple(map(float, p)) for p in room], "x double, y double, z double")
    gaussians = maps.voxel_gaussians(maps.voxel_sums(map_points, 1.0), 1.0).drop("n")
    p, e = frames(spark, off, [(0, 1, np.linalg.inv(true[0]) @ true[1], 1.0)])
    more = sparse.voxel_blocks(points, gaussians, 1.0)
    held = spark.createDataFrame([(99, np.eye(4).ravel().tolist())], p.schema)
    got = {r["id"]: np.reshape(r["pose"], (4, 4)) for r in sparse.consistent(p.union(held), e, fixed=[99], more=more, rounds=5, size=128).collect()}
    assert max(np.abs(got[k] - true[k]).max() for k in range(3)) < 0.01 < max(np.abs(off[k] - true[k]).max() for k in range(3))


def bent(n=400):
    t = np.arange(n) * 0.5
    true = np.stack([t, np.sin(t / 20) * 5, 0 * t], axis=1)
    return t, true, true + np.stack([0.02 * t, 1e-4 * t**2, 0.5 * np.sin(t / 60)], axis=1)


@pytest.mark.parametrize("size", [4, 64])
def test_bent_track_is_straightened(spark, size):
    t, true, off = bent()
    track = spark.createDataFrame([(float(a), *map(float, p)) for a, p in zip(t, off)], "t double, x double, y double, z double")
    rows = [(float(t[i]), *map(float, off[i]), *map(float, true[i]), 1.0) for i in range(0, len(t), 5)]
    matched = spark.createDataFrame(rows, "t double, x double, y double, z double, fx double, fy double, fz double, weight double")
    got = np.array([tuple(r) for r in sparse.bent_onto(track, matched, "t", 20.0, 0.01, size).select("x", "y", "z").orderBy("t").collect()])
    # the same as one dense system
    n = int(t[-1] // 20) + 2
    a, b = np.zeros((n, n)), np.zeros((n, 3))
    for row in rows:
        k, s = int(row[0] // 20), row[0] / 20 - row[0] // 20
        v = np.zeros(n)
        v[[k, k + 1]] = 1 - s, s
        a, b = a + np.outer(v, v), b + np.outer(v, np.subtract(row[4:7], row[1:4]))
    for k in range(n - 1):
        v = np.zeros(n)
        v[[k, k + 1]] = -1, 1
        a += 0.01 * np.outer(v, v)
    c = np.linalg.solve(a, b)
    k, s = (t // 20).astype(int), (t / 20 - t // 20)[:, None]
    assert np.allclose(got, off + (1 - s) * c[k] + s * c[k + 1], atol=1e-6)
    assert np.abs(got - true).max() < 0.2 < np.abs(off - true).max()
    still = sparse.bent_onto(track, matched.limit(0), "t", 20.0).agg(F.max(F.abs("cx"))).first()[0]
    assert abs(still) < 1e-9


def test_rays_bring_windows_and_poses_back(spark):
    """Two windows off as a whole and each pose a little by itself come back onto a room seen from its middle."""
    rng = np.random.default_rng(11)
    room = np.concatenate([np.insert(rng.uniform(-3, 3, (1500, 2)), axis, side * 3.0, axis=1) for axis in range(3) for side in (-1, 1)]) + rng.normal(scale=0.005, size=(9000, 3))
    true = [exp_pose(np.array([0.1 * k, 0.05 * k, 0, 0, 0, 0.05 * k])) for k in range(6)]
    whole = [exp_pose(np.array([0.03, -0.02, 0.02, 0.004, -0.003, 0.006])), exp_pose(np.array([-0.02, 0.03, 0.0, 0.0, 0.005, -0.004]))]
    off = [true[k] @ whole[k // 3] @ exp_pose(0.004 * rng.normal(size=6)) for k in range(6)]
    rows = []
    for k, t in enumerate(true):
        own = np.c_[room[k::9], np.ones(len(room[k::9]))] @ np.linalg.inv(t).T
        rows += [(k, *p[:3].tolist()) for p in own]
    points = spark.createDataFrame(rows, "id long, x double, y double, z double")
    reference = spark.createDataFrame([tuple(map(float, p)) for p in room], "x double, y double, z double")
    poses = spark.createDataFrame([(k, m.ravel().tolist()) for k, m in enumerate(off)], "id long, pose array<double>")
    rigid = sparse.refined_by_rays(points, poses, reference, (0.0, 0.0, 0.0), 0.6, 15.0, window=3, edge_weight=100.0, rounds=5, size=8)
    got = {r["id"]: np.reshape(r["pose"], (4, 4)) for r in rigid.collect()}
    before, after = (max(np.abs(m[k] - true[k]).max() for k in range(6)) for m in (dict(enumerate(off)), got))
    assert after < 0.01 and after < before / 3, (before, after)


def test_scattered_products_pass_on_only_what_they_hold(spark):
    """Nodes far apart, one entry a part: a row a node and no inverses, where each entry was 128 numbers and each
    part 16384 before."""
    rng = np.random.default_rng(5)
    pairs = {(int(a), int(b)) for a, b in rng.integers(0, 500, (300, 2)) * 64 + 7}
    blocks = {k: rng.normal(size=(2, 2)) for k in pairs | {(a, a) for k in pairs for a in k}}
    s = sparse.system(spark.createDataFrame([(a, b, v.ravel().tolist()) for (a, b), v in blocks.items()], sparse.BLOCK), 2, inverse=False)
    assert s.parts.selectExpr("max(size(inverse))").first()[0] == 0
    x = s.parts.selectExpr("p", "array_repeat(cast(p as double), 128) AS v")
    got = {r["p"] * 64 + r["i"]: r["y"] for r in sparse.product_rows(s, x).collect()}
    want = {}
    for (a, b), v in blocks.items():
        want[a] = want.get(a, 0) + v @ np.full(2, b // 64)
    assert got.keys() == want.keys() and all(np.allclose(got[a], want[a]) for a in got)

"""A recording in a room followed pose by pose, its maps rebuilt on the way, saved and loaded."""

import numpy as np
from pyspark.sql import functions as F

from pointloom.operators import scans
from pointloom.plans import odometry
from pointloom.plans.batches import Motion
from pointloom.plans.solvers import exp_pose


def recording(spark, n=24, per_pose=400):
    rng = np.random.default_rng(3)
    sides = [np.insert(rng.uniform(-3, 3, (4000, 2)), axis, side * 3.0, axis=1) for axis in range(3) for side in (-1, 1)]
    room = np.concatenate(sides) + rng.normal(scale=0.004, size=(24_000, 3))
    true, drift, at, off = [], [], np.eye(4), np.eye(4)
    for k in range(n):
        true.append(at.copy())
        drift.append(off.copy())
        step = exp_pose(np.array([0.03, 0.01, 0, 0, 0, 0.01]))
        at, off = at @ step, off @ step @ (exp_pose(np.array([0.003, -0.002, 0.001, 0, 0, 0.001])) if k > 6 else np.eye(4))
    rows = []
    for k, m in enumerate(true):
        inv = np.linalg.inv(m)
        for p in room[rng.choice(len(room), per_pose, replace=False)]:
            rows.append((len(rows), 1000 + 100 * k + 10, *map(float, inv[:3, :3] @ p + inv[:3, 3])))
    points = spark.createDataFrame(rows, "id long, ts_ns long, x double, y double, z double")
    track = spark.createDataFrame([(1000 + 100 * k, m.ravel().tolist()) for k, m in enumerate(drift)], "ts_ns long, pose array<double>")
    return points, track, true, drift


def test_numbers_by_ranges(spark):
    rows = spark.range(997).select((F.col("id") * 7 % 997).alias("v"))
    assert all(r["v"] == r["n"] for r in scans.numbered(rows, ["v"], partitions=6).collect())


def test_drift_is_taken_back_and_results_come_back(spark, tmp_path):
    points, track, true, drift = recording(spark)
    s = odometry.Settings(per_batch=8, fine=0.7, coarse=1.5, rounds=6, tolerance_ns=50, rebuild_metres=0.4, motion=Motion(0.01, 0.5, 0.05, 1.0))
    poses, report = odometry.followed(points, track, s)
    got = {r["scan_id"]: np.reshape(r["pose"], (4, 4)) for r in poses.collect()}
    # the first batch has no map and makes it; the drift begins after it
    error = lambda m: max(np.abs(true[k] - m[k])[:3, 3].max() for k in range(16, 24))
    assert len(got) == 24 and error(got) < 0.4 * error(drift), (error(got), error(drift))
    assert [r["poses"] for r in report] == [8, 8, 8] and any(r["rebuilt"] for r in report) and report[1]["matched"] > 1000
    where = str(tmp_path / "results")
    odometry.save(where, points, poses, report, s)
    cloud, again, settings, batches = odometry.load(spark, where)
    assert settings == s and batches == report
    assert all(np.allclose(np.reshape(r["pose"], (4, 4)), got[r["scan_id"]]) for r in again.collect())
    assert cloud.count() == points.count() and cloud.agg(F.max(F.abs("x"))).first()[0] < 3.5

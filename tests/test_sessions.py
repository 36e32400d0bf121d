import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.operators import aggregates, maps, windows
from pointloom.plans import sessions
from pointloom.plans.solvers import exp_pose, log_pose, log_poses, pose_graph
from pointloom.sources import config, sinks


def random_pose(rng, far=5.0, turn=1.0):
    return exp_pose(np.concatenate([rng.uniform(-far, far, 3), rng.uniform(-turn, turn, 3)]))


def plain_online_map(rows, size):
    """Voxels point after point: rows of (x, y, z, viewpoint)."""
    out = {}
    for x, y, z, view in rows:
        p = np.array([x, y, z])
        key = tuple(int(v) for v in np.trunc(p / size))
        if key not in out:
            out[key] = [p, 0.0009 * np.eye(3), 1, None]
            continue
        b = out[key]
        b[2] += 1
        n, d = b[2], p - b[0]
        if n <= 3 or b[3] is not None and b[3] @ (np.array(view) - b[0]) >= 0:
            b[1] = b[1] * (n - 1) / n + np.outer(d, d) * (n - 1) / n**2
        if n == 3:
            normal = np.linalg.eigh(b[1])[1][:, 0]
            b[3] = normal if normal @ (np.array(view) - b[0]) >= 0 else -normal
    return out


def test_online_map_with_moving_viewpoint(spark):
    rng = np.random.default_rng(1)
    rows = [(i, *map(float, rng.uniform(0.01, 0.99, 3) * (1.0, 1.0, 0.2)), *map(float, (0.5, 0.5, 3.0 if rng.random() < 0.6 else -3.0))) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, x double, y double, z double, vx double, vy double, vz double")
    got = {(r["ix"], r["iy"], r["iz"]): r for r in maps.first_point_moments(df, 0.3, ["id"], ("vx", "vy", "vz")).collect()}
    want = plain_online_map([(r[1], r[2], r[3], r[4:]) for r in rows], 0.3)
    assert set(got) == set(want)
    for k, (mean, cov, n, _) in want.items():
        assert got[k]["n"] == n and [got[k][f"mean_{a}"] for a in "xyz"] == pytest.approx(mean.tolist())
        assert [got[k][f"cov_{c}"] for c in ("xx", "xy", "xz", "yy", "yz", "zz")] == pytest.approx(cov[np.triu_indices(3)].tolist(), abs=1e-12)


def test_rigid_fusion_with_fixes(spark):
    rng = np.random.default_rng(2)
    true = random_pose(rng)
    scans, fixes = [], [(-1.0, 9e5, 9e5, 9e5)]  # a group's first fix never matches
    for i in range(60):
        m = random_pose(rng, 50.0)
        scans.append((i, float(i), m.ravel().tolist()))
        place = (true @ m)[:3, 3] + (100.0 if i % 20 == 7 else 0.0)  # a few fixes are far off
        fixes.append((float(i), *map(float, place)))
    s = spark.createDataFrame(scans, "scan_id int, ts double, pose array<double>")
    moved, pose = sessions.fused_with_fixes(s, spark.createDataFrame(fixes, "ts double, x double, y double, z double"), 0.5, rounds=30)
    assert np.allclose(pose, true, atol=2e-2)
    assert moved.count() == 60


def test_alignment_of_sessions(spark):
    rng = np.random.default_rng(3)
    track = [random_pose(rng) for _ in range(8)]
    shift = {0: np.eye(4), 1: random_pose(rng), 2: random_pose(rng)}
    rows = [(k, i, float(i + 10 * k), (shift[k] @ m).ravel().tolist()) for k in shift for i, m in enumerate(track)]
    df = spark.createDataFrame(rows, "session int, scan_id int, ts double, pose array<double>")
    for r in sessions.align_sessions(df, 2.5, 0).collect():
        assert np.allclose(np.array(r["pose"]).reshape(4, 4), track[r["scan_id"]], atol=1e-9)


def test_pose_graph_in_blocks():
    """A loop of 150 poses with drifted starts; edges are exact, so the graph must close."""
    rng = np.random.default_rng(4)
    true = [np.eye(4)]
    for _ in range(149):
        true.append(true[-1] @ exp_pose(np.array([1.0, 0, 0, 0, 0, 2 * np.pi / 150])))
    edges = [(i, i + 1, np.linalg.inv(true[i]) @ true[i + 1], 1.0) for i in range(149)] + [(149, 0, np.linalg.inv(true[149]) @ true[0], 1.0)]
    start = np.array([m @ exp_pose(0.05 * rng.normal(size=6)) if i else m for i, m in enumerate(true)])
    assert np.allclose(pose_graph(start, edges, rounds=20), true, atol=1e-4)
    away = np.array([exp_pose(np.array([3.0, -2, 1, 0, 0, 0])) @ m for m in true])
    places = [(i, true[i][:3, 3], 1.0) for i in range(0, 150, 10)]
    free = pose_graph(away, edges, rounds=30, fixed=[], places=places)
    assert np.abs(free[:, :3, 3] - np.array(true)[:, :3, 3]).max() < 1e-2
    many = np.array([random_pose(rng) for _ in range(20)])
    assert np.allclose(log_poses(many), [log_pose(m) for m in many])


def test_pair_blocks_solve_like_a_dense_system(spark):
    rng = np.random.default_rng(5)
    rows = [(int(a), int(b), *map(float, rng.normal(size=5))) for a, b in rng.integers(0, 4, (60, 2)) if a != b]
    df = spark.createDataFrame(rows, "a int, b int, f0 double, f1 double, s0 double, s1 double, res double")
    ata, atb = np.zeros((8, 8)), np.zeros(8)
    for r in aggregates.pair_normal_equations(df, ["f0", "f1"], ["s0", "s1"], "res", "a", "b").collect():
        if r["col"] is None:
            atb[2 * r["row"] + r["i"]] += r["value"]
        else:
            ata[2 * r["row"] + r["i"], 2 * r["col"] + r["j"]] += r["value"]
            if r["row"] < r["col"]:
                ata[2 * r["col"] + r["j"], 2 * r["row"] + r["i"]] += r["value"]
    jac = np.zeros((len(rows), 8))
    for k, (a, b, f0, f1, s0, s1, _) in enumerate(rows):
        jac[k, 2 * a : 2 * a + 2], jac[k, 2 * b : 2 * b + 2] = (f0, f1), (s0, s1)
    assert np.allclose(ata, jac.T @ jac) and np.allclose(atb, jac.T @ np.array([r[-1] for r in rows]))


def test_dead_reckoning_rules(spark):
    rows = [(1, 0.0, 1.0), (1, 0.1, 1.0), (1, 0.2, 900.0), (1, 0.3, float("nan")), (1, 0.3, 1.0), (1, 0.2, 1.0), (1, 5.0, 1.0)]
    df = spark.createDataFrame(rows, "k int, t double, ax double").withColumns({"ay": F.lit(0.0), "az": F.lit(0.0)})
    last = lambda out: out.agg(F.max("vx")).first()[0]
    assert last(windows.dead_reckoned(df.where("t <> 0.3"), ["k"], "t")) == pytest.approx(0.1 + 0.1 * 0 + 0.1, abs=0.11)
    smooth = spark.createDataFrame([(1, 0.05 * i, 2.0, 0.0, 0.0) for i in range(41)], "k int, t double, ax double, ay double, az double")
    out = windows.dead_reckoned(smooth, ["k"], "t", method="trapezoid").orderBy(F.desc("t")).first()
    assert (out["vx"], out["px"]) == pytest.approx((4.0, 4.0))
    kalman = windows.kalman_track(smooth, ["k"], "t", noise=0.01).orderBy(F.desc("t")).first()
    assert (kalman["vx"], kalman["px"]) == pytest.approx((4.0, 4.0), rel=0.1)


def test_params_and_results(spark, tmp_path):
    params = config.OdometryParams(size=0.5, rounds=7)
    config.write_params(params, str(tmp_path / "p.toml"))
    assert config.load_params(str(tmp_path / "p.toml")) == params
    batches = spark.createDataFrame([(0, 20, 3.5, 1.0), (1, 20, 4.5, 2.0)], "batch int, poses int, length double, seconds double")
    text = config.results_document(batches, params)
    assert '"poses": 40' in text and '"length_m": 8.0' in text and '"size": 0.5' in text


def test_geoid_between_grid_points(spark):
    from pointloom.functions.geodesy import with_geoid

    grid = spark.createDataFrame([(iy, ix, 30.0 + iy + 2 * ix) for iy in range(100, 103) for ix in range(40, 43)], "iy int, ix int, separation double")
    fixes = spark.createDataFrame([(50.25, 20.4, 100.0), (80.0, 20.0, 100.0)], "lat double, lon double, height double")
    got = {r["lat"]: r["orthometric"] for r in with_geoid(fixes, grid, 0.5).collect()}
    assert got[50.25] == pytest.approx(100.0 - (30 + 50.25 / 0.5 + 2 * 20.4 / 0.5)) and got[80.0] is None


def test_gnss_points(spark):
    fixes = spark.createDataFrame([(52.0, 21.0, 100.0, 1.0), (52.001, 21.0, 110.0, 2.0)], "lat double, lon double, height double, ts double")
    a, b = sinks.gnss_points(fixes, 52.0, 21.0, 100.0).orderBy("ts").collect()
    assert (a["x"], a["y"], a["z"]) == pytest.approx((0, 0, 0), abs=1e-6) and b["y"] == pytest.approx(111.27, abs=0.05) and b["z"] == pytest.approx(10, abs=0.01)


def room(n):
    """Points on three walls that meet in a corner."""
    rng = np.random.default_rng(6)
    xyz = rng.uniform(0, 3, (n, 3))
    xyz[np.arange(n), np.arange(n) % 3] = 0
    return xyz


def test_sessions_joined_by_loop_edges(spark):
    """Two sessions of the same room, the second one shifted: edges between them bring it back."""
    xyz = room(240)
    shift = exp_pose(np.array([0.03, -0.02, 0.02, 0.0, 0.0, 0.004]))
    true = {10 * s + k: exp_pose(np.array([0.4 * k, 0.2 * s, 0, 0, 0, 0.1 * k])) for s in (0, 1) for k in range(3)}
    rows, scans = [], []
    for key, m in true.items():
        inv = np.linalg.inv(m)
        rows += [(key, len(rows) + i, *map(float, inv[:3, :3] @ p + inv[:3, 3])) for i, p in enumerate(xyz)]
        scans.append((key // 10, key, float(key), (shift @ m if key >= 10 else m).ravel().tolist()))
    points = spark.createDataFrame(rows, "scan_id long, id long, x double, y double, z double")
    table = spark.createDataFrame(scans, "session int, scan_id long, ts double, pose array<double>")
    got = {r["scan_id"]: np.array(r["pose"]).reshape(4, 4) for r in sessions.sessions_joined(points, table, 0.35, 0.15).collect()}
    assert all(np.abs(got[k] - m).max() < 5e-3 for k, m in true.items())


def test_sensors_and_experiments(spark):
    xyz = room(150)
    move = exp_pose(np.array([0.02, -0.01, 0.015, 0.003, -0.002, 0.002]))
    back = np.linalg.inv(move)
    rows = [(i, 0, *map(float, p)) for i, p in enumerate(xyz)] + [(1000 + i, 1 + i % 2, *map(float, back[:3, :3] @ p + back[:3, 3])) for i, p in enumerate(xyz)]
    points = spark.createDataFrame(rows, "id long, lidar_id int, x double, y double, z double")
    pose = sessions.calibrated_sensors(points, 0.001, 0.12)
    assert np.allclose(pose, move, atol=1e-4)

    class Result:
        rms = 0.25

    r = sessions.experiments(spark, {"a": Result, "b": Result}).orderBy("method").collect()
    assert [(x["method"], x["rms"]) for x in r] == [("a", 0.25), ("b", 0.25)] and r[0]["ms"] >= 0


def test_kml(spark, tmp_path):
    fixes = spark.createDataFrame([(2.0, 52.5, 21.25, 110.0), (1.0, 52.0, 21.0, 100.0)], "ts double, lat double, lon double, alt double")
    sinks.write_kml(fixes, str(tmp_path / "k"))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "k")).collect()]
    assert sum("21.25000000,52.50000000,110.000" in x for x in lines) == 1 and sum("</kml>" in x for x in lines) == 1 and len(lines) == 4


def test_loops_without_a_match_and_sessions_with_places(spark):
    """A pair that meets nothing has no motion; known places of scans outweigh the first one's pose."""
    from pointloom.plans import registration

    poses = {0: np.eye(4), 1: exp_pose(np.array([0.2, 0, 0, 0, 0, 0]))}
    pairs = spark.createDataFrame([(0, 1), (0, 1)], "a long, b long")
    far = spark.createDataFrame([(0, 0, 0.0, 0.0, 0.0), (1, 1, 9.0, 9.0, 9.0)], "scan_id long, id long, x double, y double, z double")
    got = registration.register_loops(far, registration.pose_table(spark, poses), pairs, 0.1).collect()
    assert [(r["a"], r["b"], r["matched"]) for r in got] == [(0, 1, 0)] and np.allclose(np.reshape(got[0]["fix"], (4, 4)), np.eye(4))

    scans = spark.createDataFrame([(0, k, float(k), m.ravel().tolist()) for k, m in poses.items()], "session int, scan_id long, ts double, pose array<double>")
    places = spark.createDataFrame([(0, 1.0, 0.0, 0.0, 100.0), (1, 1.2, 0.0, 0.0, 100.0), (7, 5.0, 5.0, 5.0, 1.0)], "scan_id long, x double, y double, z double, weight double")
    out = {r["scan_id"]: r["pose"] for r in sessions.sessions_joined(far, scans, 0.01, 0.1, places=places).collect()}
    assert abs(out[0][3] - 1.0) < 1e-3 and abs(out[1][3] - 1.2) < 1e-3


def test_scans_are_not_dealt_by_session(spark):
    """However large the tables look, four sessions are not four tasks' work."""
    from pointloom.functions import pose as P
    from pointloom.plans import sessions

    k = F.col("id").cast("double")
    scans = spark.range(40).select((F.col("id") % 4).alias("session"), F.col("id").alias("scan_id"), k.alias("ts"), P.from_tait_bryan(k, -k, k * 0, k * 0, k * 0, k / 10).alias("pose"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = sessions.align_sessions(scans, 8.0, 0)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") >= 2

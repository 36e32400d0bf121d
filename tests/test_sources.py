import functools
import json
import operator

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.functions import nmea as N
from pointloom.sources import points, sinks, text


def sentence(body):
    """A sentence with its checksum, the exclusive or of the body's characters."""
    return f"${body}*{functools.reduce(operator.xor, body.encode()):02X}"


GGA = sentence("GNGGA,071530.25,3345.5,S,15112.75,E,2,07,1.31,58.4,M,22.6,M,3.5,0127")
RMC = sentence("GNRMC,220105.00,A,0130.6,N,00415.3,W,0.25,12.5,010203,,,D,V")


def test_sentences(spark):
    wrong = GGA.replace("58.4", "58.5")
    rows = spark.createDataFrame([(GGA,), (RMC,), (wrong,), ("no sentence",), (None,)], "s string")
    got = rows.select(N.valid("s").alias("ok"), N.gga("s").alias("g"), N.rmc("s").alias("r")).collect()
    assert [r["ok"] for r in got] == [True, True, False, False, False]
    g = got[0]["g"]
    assert (g["lat"], g["lon"]) == pytest.approx((-(33 + 45.5 / 60), 151 + 12.75 / 60)) and (g["fix"], g["sats"], g["alt"], g["undulation"], g["age"]) == (2, 7, 58.4, 22.6, 3.5)
    r = got[1]["r"]
    assert (r["lat"], r["lon"]) == pytest.approx((1 + 30.6 / 60, -(4 + 15.3 / 60))) and r["active"] and r["knots"] == 0.25
    assert got[1]["g"] is None and got[3]["r"] is None


def test_stamped_file(spark, tmp_path):
    (tmp_path / "drive.nmea").write_text(f"501 9001 {GGA}\r\n502 9002 {GGA[:-2]}zz\n503 9003 {RMC}\nhello\n")
    got = text.nmea(spark, str(tmp_path)).collect()
    assert [(r["lidar_ns"], r["unix_ns"]) for r in got] == [(501, 9001)]


def test_imu_with_and_without_header(spark, tmp_path):
    head = "timestamp gyroX gyroY gyroZ accX accY accZ imuId timestampUnix\n"
    (tmp_path / "h.csv").write_text(head + "1000000000 1 2 3 4 5 6 0 5000000000\n2000000000 1 2 3 4 5 6 1 5\n3000000000 1 2 3 4 5 6 -1 5\n")
    (tmp_path / "l.csv").write_text("1000000000,1,2,3,4,5,6\n0,1,2,3,4,5,6\n2000000000,1,2,3,4,5,6,1\nbad\n")
    got = text.imu(spark, str(tmp_path)).collect()
    assert sorted((r["path"][-5], r["ts"]) for r in got) == [("h", 1.0), ("h", 3.0), ("l", 1.0)]
    assert next(r for r in got if r["path"].endswith("h.csv") and r["ts"] == 1.0)["ts_unix"] == 5.0


def test_sensor_ids_and_calibration(spark, tmp_path):
    (tmp_path / "rig.sn").write_text("3 left\n\nx7 odd\n8 right\n")
    ids = text.sensor_ids(spark, str(tmp_path / "rig.sn"))
    assert sorted(map(tuple, ids.collect())) == [(3, "left"), (8, "right")]
    rng = np.random.default_rng(3)
    mount = np.eye(4)
    mount[:3, :3], mount[:3, 3] = np.linalg.qr(rng.normal(size=(3, 3)))[0], rng.uniform(-2, 2, 3)
    flat = lambda m: m.ravel().tolist()
    entries = {
        "left": {"data": flat(mount)},
        "right": {"order": "COLUMN", "data": flat(mount.T)},
        "none": {"identity": "true"},
        "back": {"inverted": "TRUE", "data": flat(mount)},
        "off": {"data": flat(mount)},
    }
    (tmp_path / "rig.json").write_text(json.dumps({"calibration": entries, "imuToUse": "right", "blacklist": ["off"]}))
    (tmp_path / "bad.json").write_text("[1,")
    c = {r["serial"]: np.array(r["pose"]).reshape(4, 4) for r in text.calibration(spark, str(tmp_path / "rig.json")).collect()}
    want = {"left": mount, "right": mount, "none": np.eye(4), "back": np.linalg.inv(mount)}
    assert set(c) == set(want) and all(np.allclose(c[k], want[k]) for k in want)
    assert text.calibration(spark, str(tmp_path / "bad.json")).count() == 0
    assert text.imu_to_use(spark, str(tmp_path / "rig.json")) == "right" and text.imu_to_use(spark, str(tmp_path / "bad.json")) == ""
    both = text.combined_calibration(ids, text.calibration(spark, str(tmp_path / "rig.json")))
    assert sorted(r["lidar_id"] for r in both.collect()) == [3, 8]
    assert text.combined_calibration(ids, text.calibration(spark, str(tmp_path / "bad.json"))).count() == 0
    with pytest.raises(Exception, match="no row for serial"):
        text.combined_calibration(spark.createDataFrame([(4, "rear")], "lidar_id int, serial string"), text.calibration(spark, str(tmp_path / "rig.json"))).collect()


def test_trajectories(spark, tmp_path):
    pose = "1 0 0 4 0 1 0 5 0 0 1 6"
    (tmp_path / "t.csv").write_text(f"timestamp m00\n1711111111111111111 {pose}\r\n2 {pose} 99\n3 {pose} 98 0.1 0.2 0.3\n4 {pose} 1 2\n")
    got = {r["ts_ns"]: r for r in text.trajectory(spark, str(tmp_path / "t.csv")).collect()}
    assert set(got) == {1711111111111111111, 2, 3} and got[2]["ts_unix_ns"] == 99 and got[3]["fi"] == 0.2 and got[2]["pose"][7] == 5
    (tmp_path / "u.txt").write_text("# c\n2 1 0 0 0 0 0 1\n1 5 0 0 0 0 0 1\nnan 1 1 1 0 0 0 1\n")
    moved = {r["ts"]: r["tx"] for r in text.tum(spark, str(tmp_path / "u.txt"), from_first=True).collect()}
    assert moved == {1.0: pytest.approx(0), 2.0: pytest.approx(-4)}


def test_pose_list_session_and_gnss(spark, tmp_path):
    (tmp_path / "p.mrp").write_text("1\nscan_0.laz\n1 0 0 7\n0 1 0 8\n0 0 1 9\n0 0 0 1\n")
    r = text.pose_list(spark, str(tmp_path / "p.mrp")).first()
    assert r["name"] == "scan_0.laz" and r["pose"][3] == 7 and len(r["pose"]) == 16
    (tmp_path / "s.json").write_text(json.dumps({"Session Settings": {"offset_x": 2.5}, "laz_file_names": [{"file_name": "a.laz"}]}))
    r = text.session(spark, str(tmp_path / "s.json")).first()
    assert r["offset_x"] == 2.5 and r["offset_y"] == 0.0 and r["files"] == ["a.laz"]
    (tmp_path / "g.txt").write_text("1 52 21 100 1 9 30 0 0 4\n2 0 21 100 1 9 30 0 0 4\nshort 1\n3 nan 21 100 1 9 30 0 0 4\n")
    assert [r["height"] for r in text.gnss(spark, str(tmp_path / "g.txt")).collect()] == [130.0]


def test_las_round_trip_and_scan(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = [(float(a), float(b), float(c), 200 - i, 30.0 + i * 0.002, i % 2, i // 50) for i, (a, b, c) in enumerate(rng.uniform(-40, 60, (100, 3)))]
    df = spark.createDataFrame(rows, "x double, y double, z double, intensity int, ts double, lidar_id int, scan_id int")
    paths = sinks.write_las(df, str(tmp_path / "las"), "scan_id")
    assert len(paths) == 2
    back = points.read_points(spark, str(tmp_path / "las"), "las", "*.las").orderBy("ts").collect()
    assert len(back) == 100 and all(abs(r["x"] - s[0]) < 1e-4 and r["intensity"] == s[3] and r["user_data"] == s[5] for r, s in zip(back, rows))
    cal = spark.createDataFrame([(0, [float(v) for v in (1, 0, 0, 10, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1)])], "lidar_id int, pose array<double>")
    got = points.scan(spark, str(tmp_path / "las"), "las", inner=1.0, outer=40.0, calibration=cal).collect()
    want = [r for r in rows if r[5] == 0 and 1 < np.hypot(r[0], r[1]) < 40]
    assert sorted(r["x"] for r in got) == pytest.approx(sorted(r[0] + 10 for r in want), abs=1e-4)


def test_ply_pcd_and_packed(spark, tmp_path):
    (tmp_path / "a.ply").write_bytes(b"ply\nformat ascii 1.0\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nproperty float intensity\nend_header\n1 2 3 0.5\n4 5 6 1\n")
    xyz = np.array([(1, 2, 3, 7.0)], [("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("intensity", "<f4")])
    (tmp_path / "a.pcd").write_bytes(b"VERSION .7\nFIELDS x y z intensity\nSIZE 4 4 4 4\nTYPE F F F F\nCOUNT 1 1 1 1\nWIDTH 1\nHEIGHT 1\nPOINTS 1\nDATA binary\n" + xyz.tobytes())
    (tmp_path / "a.bin").write_bytes(np.zeros(3, points.PACKED).tobytes())
    assert [r["intensity"] for r in points.read_points(spark, str(tmp_path / "a.ply"), "ply").orderBy("point_id").collect()] == [32767, 65535]
    assert points.read_points(spark, str(tmp_path / "a.pcd"), "pcd").first()["z"] == 3.0
    assert points.read_points(spark, str(tmp_path / "a.bin"), "packed").count() == 3
    (tmp_path / "b.bin").write_bytes(b"123")
    with pytest.raises(Exception, match="whole number"):
        points.read_points(spark, str(tmp_path / "b.bin"), "packed").collect()


def test_message_layouts(spark):
    p = spark.createDataFrame([(0.5, -7.0, 2.25, 31.0, 11, 2, 77.000004)], "x double, y double, z double, intensity double, ring int, laser_id int, timestamp double")
    assert "laser_id" not in sinks.message_layout(p, "velodyne", 77.0).columns
    assert sinks.message_layout(p, "ouster", 77.0).first()["t"] == 4000
    assert sinks.message_layout(p, "hesai").first()["timestamp"] == 77.000004


def test_result_chunks(spark):
    rows = spark.range(62).select(F.col("id").alias("batch"))
    assert sinks.result_chunks(rows).groupBy("chunk").count().orderBy("chunk").collect()[-1]["count"] == 11
    assert sinks.result_chunks(spark.range(61).select(F.col("id").alias("batch"))).count() == 51


def test_sources_by_name(spark, tmp_path):
    from pointloom.sources.register import register

    (tmp_path / "a.ply").write_bytes(b"ply\nformat ascii 1.0\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nend_header\n1 2 3\n4 5 6\n")
    (tmp_path / "skip.txt").write_text("x")
    register(spark)
    assert sorted(r["z"] for r in spark.read.format("ply").load(str(tmp_path)).collect()) == [3.0, 6.0]
    assert spark.sql("SELECT voxel_cell(-0.05, 0.1) c").first()["c"] == -1
    assert spark.sql("SELECT count(DISTINCT jx, jy, jz) n FROM neighbour_cells(1, 2, 3)").first()["n"] == 27


def test_pose_blocks_and_exports(spark, tmp_path):
    (tmp_path / "r.txt").write_text("a/scan_1.ply\n1 0 0 7\n0 1 0 8\n0 0 1 9\n0 0 0 1\n\n")
    blocks = text.pose_blocks(spark, str(tmp_path / "r.txt"))
    assert blocks.first()["stem"] == "scan_1" and text.pose_blocks(spark, str(tmp_path / "r.txt"), inverse=True).first()["pose"][3] == -7
    eye = [1.0 if k % 5 == 0 else 0.0 for k in range(16)]
    scans = spark.createDataFrame([(1, "x/scan_1.laz", eye), (2, "scan_2.laz", eye)], "scan_id int, file_name string, pose array<double>")
    assert {r["scan_id"]: r["pose"][3] for r in text.updated_poses(scans, blocks).collect()} == {1: 7.0, 2: 0.0}
    (tmp_path / "s.3d").write_text("2\n1 2 3 9\n4 5 6\n")
    assert text.xyz_text(spark, str(tmp_path / "s.3d")).count() == 2
    sinks.colmap_images(spark.createDataFrame([(1, "a.jpg", [*eye[:3], 2.0, *eye[4:]])], "image_id int, name string, pose array<double>"), str(tmp_path / "images"))
    line = next(x for f in (tmp_path / "images").glob("part-*") for x in f.read_text().split("\n") if x)
    assert [float(v) for v in line.split()[1:8]] == [1, 0, 0, 0, -2, 0, 0] and line.split()[-1] == "a.jpg"
    track = spark.createDataFrame([(2, 1.0, 0.0, 0.0), (1, 0.0, 0.0, 0.0)], "ts_ns long, x double, y double, z double")
    assert sinks.dxf_polyline(track).count("VERTEX") == 2
    assert sinks.scale_board(2, 3, 0.5, spark).count() == 6

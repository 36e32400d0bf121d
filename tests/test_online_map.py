"""The map that lives on, as a stream and as tables, against a plain recursion."""

import random

import numpy as np
import pytest

from pointloom.operators import maps
from pointloom.streaming import online_map

SIZE = 0.5
SCHEMA = "session long, id long, ts double, x double, y double, z double, vx double, vy double, vz double, rebuild long, keep_from double"


def recording(seed, n=900):
    """Two sessions' points seen from a moving place, with rebuilds on the way."""
    rng = random.Random(seed)
    rows = []
    for s in (1, 2):
        for i in range(n):
            at = i / 60
            rebuild = int(at // 5)
            keep = float("-inf") if rebuild == 0 else rebuild * 5 - 2.5
            p = [at * 0.2 + rng.uniform(-1, 1), rng.uniform(-1, 1), rng.choice([0.02, 0.03, -0.4]) + rng.gauss(0, 0.02)]
            rows.append((s, i, at, *p, at * 0.2, rng.choice([-3.0, 3.0]), rng.choice([-2.0, 2.0]), rebuild, keep))
    return rows


def plain(rows):
    """The map by one loop over all points, with its list of points rebuilt as a whole."""
    voxels, points, last = {}, {}, {}

    def take(session, p, view):
        key = (session, *(int(v / SIZE) for v in p))
        if key not in voxels:
            voxels[key] = [1, p, np.eye(3) * 0.03**2, None]
            return
        v = voxels[key]
        v[0] += 1
        k, d = v[0], v[1] - p
        update = v[2] * (k - 1) / k + np.outer(d, d) * (k - 1) / k**2
        if k <= 3 or v[3] @ (view - v[1]) >= 0:
            v[2] = update
        if k == 3:
            normal = np.linalg.svd(v[2])[0][:, 2]
            v[3] = normal if normal @ (view - v[1]) >= 0 else -normal

    for s, _, ts, x, y, z, vx, vy, vz, rebuild, keep in rows:
        if rebuild > last.get(s, 0):
            last[s] = rebuild
            points[s] = [q for q in points[s] if q[0] >= keep]
            for key in [k for k in voxels if k[0] == s]:
                del voxels[key]
            for q in points[s]:
                take(s, *q[1:])
        points.setdefault(s, []).append((ts, np.array([x, y, z]), np.array([vx, vy, vz])))
        take(s, *points[s][-1][1:])
    return voxels


def same(got, want, marks=None):
    """``got`` rows against plain voxels; a voxel not met since a rebuild may still show what it was."""
    seen = 0
    for r in got:
        v = want.get((r["session"], r["ix"], r["iy"], r["iz"]))
        if v is None or marks and r["rebuild"] < marks[r["session"]]:
            continue
        seen += 1
        assert r["n"] == v[0] and np.allclose([r[f"mean_{a}"] for a in "xyz"], v[1])
        assert np.allclose([r[f"cov_{c}"] for c in online_map.PAIRS], v[2][np.triu_indices(3)])
    return seen


def test_stream_of_batches_matches_the_recursion(spark, tmp_path):
    rows = sorted(recording(1), key=lambda r: (r[2], r[1]))
    where = str(tmp_path / "in")
    for b in range(10):
        spark.createDataFrame(rows[b * 180 : (b + 1) * 180], SCHEMA).coalesce(1).write.mode("append").parquet(where)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(where)
        q = online_map.online_map(stream, SIZE).writeStream.format("memory").queryName("voxels").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(300)
        q.stop()
    finally:
        if before:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
        else:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    latest = {}
    for r in spark.table("voxels").collect():
        key = (r["session"], r["ix"], r["iy"], r["iz"])
        if key not in latest or (r["rebuild"], r["n"]) > (latest[key]["rebuild"], latest[key]["n"]):
            latest[key] = r
    want = plain(rows)
    assert same(latest.values(), want, {1: 2, 2: 2}) > 20
    assert set(want) <= set(latest)


@pytest.mark.parametrize("batches", [1, 10])
def test_continued_table_matches_the_recursion(spark, batches):
    rows = sorted(recording(2, 450), key=lambda r: (r[2], r[1]))
    known, step = None, len(rows) // batches
    for b in range(batches):
        known = online_map.continued(known, spark.createDataFrame(rows[b * step : (b + 1) * step], SCHEMA), SIZE)
        known = spark.createDataFrame(known.collect(), online_map.SCHEMA)
    want = plain(rows)
    marks = {1: 1, 2: 1}
    assert same(known.collect(), want, marks) > 20
    held = online_map.current(known, spark.createDataFrame([(s, 1, 2.5) for s in (1, 2)], "session long, rebuild long, keep_from double"))
    assert {(r["session"], r["ix"], r["iy"], r["iz"]) for r in held.collect()} == set(want)


def test_without_rebuilds_it_is_the_table_form(spark):
    rows = [(*r[:9], 0, float("-inf")) for r in recording(3, 300) if r[0] == 1]
    df = spark.createDataFrame(rows, SCHEMA)
    one = {(r["ix"], r["iy"], r["iz"]): r for r in maps.first_point_moments(df, SIZE, ["ts", "id"], ("vx", "vy", "vz")).collect()}
    for r in online_map.continued(None, df, SIZE).collect():
        o = one[r["ix"], r["iy"], r["iz"]]
        assert r["n"] == o["n"] and np.allclose([r[f"cov_{c}"] for c in online_map.PAIRS], [o[f"cov_{c}"] for c in online_map.PAIRS])


def test_rebuilds_of_a_track(spark):
    track = spark.createDataFrame([(s, float(i), i * 1.0 * s, 0.0, 0.0) for s in (1, 2) for i in range(24)], "session long, ts double, x double, y double, z double")
    got = {(r["session"], r["ts"]): (r["rebuild"], r["keep_from"]) for r in online_map.rebuilds(track, 6.0).collect()}
    for s in (1, 2):
        gone, rebuild, keep, start = 0.0, 0, float("-inf"), 0.0
        for i in range(24):
            gone += s if i else 0
            if gone > 6:
                half = start + gone / 2
                keep = next(float(j) for j in range(24) if j * s >= half)
                start, gone, rebuild = start + gone, 0.0, rebuild + 1
            assert got[s, float(i)] == (rebuild, keep)
    points = spark.createDataFrame([(1, 7.5), (1, 0.2), (2, 30.0)], "session long, ts double")
    marked = {(r["session"], r["ts"]): r["rebuild"] for r in online_map.with_marks(points, online_map.rebuilds(track, 6.0)).collect()}
    assert marked == {(1, 7.5): 1, (1, 0.2): 0, (2, 30.0): got[2, 23.0][0]}

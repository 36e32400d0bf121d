import bisect
import random

import pytest
from pyspark.sql import functions as F

from pointloom.functions import pose as P
from pointloom.operators import joins, windows


def plain_interpolation(track, t, clamp=False, compat=False):
    """Linear between the neighbours of ``t`` in a sorted list of (time, value); null outside."""
    track = sorted(track)
    if not track or compat and (len(track) < 2 or t < track[1][0]):
        return None
    if t < track[0][0] or t > track[-1][0]:
        return (track[0] if t < track[0][0] else track[-1])[1] if clamp else None
    times = [x for x, _ in track]
    i = bisect.bisect_left(times, t)
    if times[i] == t:
        return track[i][1]
    (ta, va), (tb, vb) = track[i - 1], track[i]
    return va + (vb - va) * (t - ta) / (tb - ta)


@pytest.mark.parametrize("settings", [{}, {"clamp": True}, {"compat": True}])
def test_interpolation_matches_a_plain_one(spark, settings):
    """Random tracks of 0 to 9 rows; times on rows, between them and outside."""
    rng = random.Random(11)
    tracks = {k: [(t / 8, rng.uniform(-50, 50)) for t in rng.sample(range(-200, 200), k % 10)] for k in range(40)}
    asked = {k: sorted({t for t, _ in tr[:3]} | {rng.uniform(-30, 30) for _ in range(6)}) for k, tr in tracks.items()}
    series = spark.createDataFrame([(k, *r) for k, tr in tracks.items() for r in tr], "track int, at double, level double")
    q = spark.createDataFrame([(k, t) for k, ts in asked.items() for t in ts], "track int, t double")
    got = {(r["track"], r["t"]): r["level"] for r in joins.interpolated(q, series, "t", "at", "level", ["track"], **settings).collect()}
    assert len(got) == sum(map(len, asked.values()))
    for (k, t), v in got.items():
        want = plain_interpolation(tracks[k], t, **settings)
        assert v is None if want is None else v == pytest.approx(want, abs=1e-9)


def test_rotation_between_poses(spark):
    lit = lambda *v: [F.lit(float(x)) for x in v]
    a, b = P.from_tait_bryan(*lit(1, 4, 0, 0, 0, 0.2)), P.from_tait_bryan(*lit(5, 4, -8, 0, 0, 1.4))
    for part in (0.0, 0.3, 1.0):  # about one axis the angle moves evenly
        r = spark.range(1).select(P.to_tait_bryan(P.interpolate(a, b, F.lit(part))).alias("p")).first()["p"]
        assert r["ka"] == pytest.approx(0.2 + 1.2 * part, abs=1e-9) and (r["px"], r["pz"]) == pytest.approx((1 + 4 * part, -8 * part))


def test_pose_encodings_agree(spark):
    v = (1.0, -2.0, 3.0, 0.3, -0.7, 2.1)
    m = P.from_tait_bryan(*[F.lit(x) for x in v])
    q, s = P.to_quaternion("m"), P.to_rodrigues("m")
    df = spark.range(1).select(m.alias("m")).select("m", P.to_tait_bryan("m").alias("t"), q.alias("q"), s.alias("s"))
    back = P.from_quaternion(F.lit(1.0), F.lit(-2.0), F.lit(3.0), *[F.col(f"q.{n}") for n in ("qw", "qx", "qy", "qz")])
    r = df.select("*", back.alias("b"), P.from_rodrigues(*[F.col(f"s.{n}") for n in ("px", "py", "pz", "sx", "sy", "sz")]).alias("c"), P.product("m", P.inverse("m")).alias("i")).first()
    assert list(r["t"]) == pytest.approx(v)
    assert r["b"] == pytest.approx(r["m"]) and r["c"] == pytest.approx(r["m"])
    assert r["i"] == pytest.approx([1.0 if k % 5 == 0 else 0.0 for k in range(16)], abs=1e-12)


@pytest.mark.parametrize("bucket", [None, 2.0])
def test_asof_ties(spark, bucket):
    left = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 2.5), (4, None)], "id long, t double")
    right = spark.createDataFrame([(10, 1.0), (11, 2.0), (12, 2.0), (13, 7.0)], "k long, t double")
    run = lambda **o: {r["id"]: r["r_k"] for r in joins.asof_join(left, right, "t", "t", tie="k", bucket=bucket, **o).collect()}
    assert run() == {1: 10, 2: 12, 3: 12, 4: None}
    assert run(strict=True) == {1: None, 2: 10, 3: 12, 4: None}
    assert run(direction="forward") == {1: 10, 2: 11, 3: 13, 4: None}
    assert run(direction="forward", strict=True) == {1: 11, 2: 13, 3: 13, 4: None}
    assert run(tolerance=0.25) == {1: 10, 2: 12, 3: None, 4: None}
    assert run(direction="nearest") == {1: 10, 2: 12, 3: 12, 4: None}


def test_required_join_fails_on_a_miss(spark):
    left = spark.createDataFrame([("SN1",), ("SN3",)], "serial string")
    right = spark.createDataFrame([("SN1", 1)], "serial string, v int")
    with pytest.raises(Exception, match="no row for serial"):
        joins.required_join(left, right, "serial").collect()


def test_greedy_segments(spark):
    rows = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate([0, 3, 6, 9, 12, 13])], "k int, i int, v double")
    got = [r["segment"] for r in windows.greedy_segments(rows, ["k"], ["i"], ["v"], 5.0).orderBy("i").collect()]
    assert got == [0, 0, 1, 1, 2, 2]


def test_integration_of_constant_rate(spark):
    rows = spark.createDataFrame([(1, 0.005 * i, 2.0) for i in range(201)], "k int, t double, a double")
    for method in ("euler", "trapezoid"):
        last = windows.integrated(rows, ["k"], "t", "a", method).agg(F.max("integral")).first()[0]
        assert last == pytest.approx(2.0)


def test_spaced_and_thinned_rows(spark):
    rows = spark.createDataFrame([(1, i, float(i), None if i % 2 else 1.0, i > 5) for i in range(12)], "k int, i int, v double, m double, in_curve boolean")
    got = [r["i"] for r in windows.spaced_matches(rows, ["k"], ["i"], ["v"], "m", 3.0).orderBy("i").collect()]
    assert got == [4, 8]
    got = [r["i"] for r in windows.thinned(rows, ["k"], ["i"], ["v"], 4.0, 2.0).orderBy("i").collect()]
    assert got == [0, 4, 6, 8, 10]


def test_paths_equal_to_their_reach(spark):
    """Values with two decimals whose path, added in binary, misses or passes 0.3 by chance: 0.3 is not over 0.3, but reaches it."""
    values = [10.0, 10.1, 10.2, 10.3, 10.4, 10.5, 10.6, None, 10.6, 10.7]
    rows = spark.createDataFrame([(1, i, v, 1.0) for i, v in enumerate(values)], "k int, i int, v double, m double")
    for parts in (None, 3):
        got = [r["segment"] for r in windows.greedy_segments(rows, ["k"], ["i"], ["v"], 0.3, parts).orderBy("i").collect()]
        assert got == [0, 0, 0, 0, 1, 1, 1, 1, 1, 1]
        got = [r["i"] for r in windows.spaced_matches(rows, ["k"], ["i"], ["v"], "m", 0.3, parts).orderBy("i").collect()]
        assert got == [3, 6]


@pytest.mark.parametrize("direction, strict", [("backward", False), ("backward", True), ("forward", False)])
def test_asof_without_groups_is_cut_into_ranges(spark, direction, strict):
    """No window orders all rows in one task, and hits reach over the cuts."""
    left = spark.createDataFrame([(i, 3 * i) for i in range(200)] + [(999, None)], "id long, t long")
    right = spark.createDataFrame([(k, t) for k, t in enumerate((6, 6, 7, 300, 301, 590, 700))], "r long, t long")
    out = joins.asof_join(left, right, "t", "t", direction=direction, strict=strict, tie="r")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert all("__bucket" in line for line in plan.splitlines() if "Window [" in line and "__own" in line) and "__own" in plan
    rows = [(r["r"], r["t"]) for r in right.collect()]
    for r in out.collect():
        ok = [(t, k) for k, t in rows if r["t"] is not None and (t < r["t"] if strict else t <= r["t"] if direction == "backward" else t >= r["t"])]
        want = (max if direction == "backward" else min)(ok)[1] if ok else None
        assert r["r_r"] == want, r


def test_rotation_gaps_work_nothing_out_twice(spark):
    """The gap of two turns about z, and a plan that calls no function over arrays (they were nested many times)."""
    turn = lambda c: P.from_tait_bryan(*[F.lit(0.0)] * 5, F.col(c))
    rows = spark.createDataFrame([(0, 0.1, 0.0), (1, 0.5, 0.1), (2, 3.0, 0.2)], "i int, a double, b double").withColumn("k", F.lit(1))
    rows = spark.createDataFrame(rows.withColumn("pose", turn("a")).withColumn("imu_pose", turn("b")).collect(), "i int, a double, b double, k int, pose array<double>, imu_pose array<double>")
    out = windows.rotation_gaps(rows, ["k"], ["i"])
    assert "lambda" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = [r["gap"] for r in out.orderBy("i").collect()]
    assert got[0] is None and got[1:] == pytest.approx([0.3, 2.4])

"""Blocked scans against plain loops, with keys that run over many partitions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.functions import pose
from pointloom.operators import scans
from pointloom.plans.solvers import exp_pose


def track(seed, n=160):
    """A long key, short ones, standing still, jumps, ties of time, null values and a null key."""
    rng = random.Random(seed)
    rows = []
    for key, length in (("long", n), ("b", 9), ("c", 1), (None, 12)):
        x = 0.0
        for i in range(length):
            x += rng.choice([0, 0, 0.25, 0.5, 1, -0.75, 7]) if i else 0
            rows.append((key, i // 2, i % 2, None if rng.random() < 0.03 and i else x, rng.random() < 0.4, None if rng.random() < 0.5 else 1))
    rng.shuffle(rows)
    return rows, "k string, t int, tie int, x double, curve boolean, m int"


def by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        out.setdefault(r[0], []).append(r)
    return out


def lengths(rows):
    last, out = None, []
    for r in rows:
        out.append(0.0 if last is None or r[3] is None or last[3] is None else abs(r[3] - last[3]))
        last = r
    return out


@pytest.mark.parametrize("partitions,reach", [(1, 2.0), (7, 2.0), (23, 2.0), (23, 40.0)])
def test_greedy_rules(spark, partitions, reach):
    rows, schema = track(partitions)
    df = spark.createDataFrame(rows, schema)
    segments, matches, thin = [], [], []
    for own in by_key(rows).values():
        gone, seg, far, since = 0.0, 0, 0.0, float("inf")
        for r, d in zip(own, lengths(own)):
            gone, far, since = gone + d, far + d, since + d
            if gone > reach:
                seg, gone = seg + 1, 0.0
            segments.append((*r, seg))
            if far >= reach and r[5] is not None:
                far = 0.0
                matches.append(r)
            if since >= (reach / 2 if r[4] else reach):
                since = 0.0
                thin.append(r)
    args = (["k"], ["t", "tie"], ["x"])
    got = scans.greedy_segments(df, *args, reach, partitions)
    assert got.columns == [*df.columns, "segment"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, segments))
    assert sorted(map(str, map(tuple, scans.spaced_matches(df, *args, "m", reach, partitions).collect()))) == sorted(map(str, matches))
    assert sorted(map(str, map(tuple, scans.thinned(df, *args, reach, reach / 2, "curve", partitions).collect()))) == sorted(map(str, thin))


def test_chained_poses(spark):
    rng = np.random.default_rng(4)
    rows = [(k, i, None if i % 11 == 3 else exp_pose(rng.normal(size=6)).ravel().tolist()) for k, n in (("a", 300), ("b", 5), (None, 40)) for i in range(n)]
    want = {}
    for k in ("a", "b", None):
        at = np.eye(4)
        for _, i, m in (r for r in rows if r[0] == k):
            at = at if m is None else at @ np.reshape(m, (4, 4))
            want[k, i] = at
    df = spark.createDataFrame(rows, "k string, i int, relative array<double>")
    for partitions in (1, 9):
        got = {(r["k"], r["i"]): np.reshape(r["pose"], (4, 4)) for r in scans.chained_poses(df, ["k"], ["i"], partitions=partitions).collect()}
        assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)


def test_empty(spark):
    df = spark.createDataFrame([], track(1)[1])
    assert scans.greedy_segments(df, ["k"], ["t"], ["x"], 1.0).count() == 0


def test_chained_poses_of_a_column(spark):
    """The steps as a column worked out behind the exchange, and each key's first row told however it is cut."""
    df = spark.createDataFrame([(k, i, 0.01 * i) for k, n in (("a", 300), ("b", 5), (None, 40)) for i in range(n)], "k string, i int, s double")
    zero = F.lit(0.0)
    step = pose.from_tait_bryan(F.col("s"), zero, zero, zero, zero, F.col("s"))
    want = {(r["k"], r["i"]): r["pose"] for r in scans.chained_poses(df.withColumn("relative", step), ["k"], ["i"], partitions=1).collect()}
    for partitions in (1, 9):
        out = scans.chained_poses(df, ["k"], ["i"], step, partitions, begins="first")
        got = out.collect()
        assert out.columns == ["k", "i", "s", "pose", "first"] and {(r["k"], r["i"]) for r in got} == want.keys()
        assert all(r["first"] == (r["i"] == 0) and np.allclose(r["pose"], want[r["k"], r["i"]]) for r in got)

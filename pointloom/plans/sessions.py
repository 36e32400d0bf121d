"""Sessions as tables: scans with poses, their points, stored results, and how sessions are brought together.

A scan is a row (session, scan_id, ts, pose array<double>16); its points are rows with scan_id and
scan coordinates.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.functions import pose as P
from pointloom.functions.geometry import transform
from pointloom.operators import joins
from pointloom.sources.store import stored


def session_points(points: DataFrame, scans: DataFrame, keep: Column | None = None, on: str = "scan_id") -> DataFrame:
    """Points of a session in the common frame; ``keep`` is a condition on scan coordinates."""
    p = points if keep is None else points.where(keep)
    moved = p.join(scans.select(on, F.col("pose").alias("__pose")), on).withColumn("__p", transform("__pose", "x", "y", "z"))
    return moved.withColumns({a: F.col(f"__p.{a}") for a in "xyz"}).drop("__pose", "__p")


def to_first_vector(points: DataFrame, scans: DataFrame, least: float, on: str = "scan_id") -> DataFrame:
    """Points further than ``least`` from their scanner, in the frame of the session's first scan."""
    from pointloom.functions.geometry import norm
    from pointloom.operators.windows import to_first_frame

    first = to_first_frame(scans.withColumn("__all", F.lit(0)), ["__all"], ["ts", on]).drop("__all")
    return session_points(points, first, norm("x", "y", "z") > least, on)


def align_sessions(scans: DataFrame, offset: float, first: object) -> DataFrame:
    """All sessions brought to the session ``first``: each one's pose ``offset`` after its start (its
    first scan later than that) falls on that of ``first``.  A row a session decides; none is collected."""
    start = scans.groupBy("session").agg(F.min("ts").alias("__start"))
    # sessions are few against their scans, which stay where they lie: a session may hold any share of them
    late = scans.join(F.broadcast(start), "session").where(F.col("ts") > F.col("__start") + F.lit(offset))
    at = late.groupBy("session").agg(F.min_by("pose", F.struct("ts", "scan_id")).alias("__at"))
    target = at.where(F.col("session") == F.lit(first)).select(F.col("__at").alias("__to"))
    move = at.crossJoin(F.broadcast(target)).select("session", P.product("__to", P.inverse("__at")).alias("__move"))  # a single row
    return scans.join(F.broadcast(move), "session").withColumn("pose", P.product("__move", "pose")).drop("__move")


def reloaded(points: DataFrame, trajectory: DataFrame, index: DataFrame) -> DataFrame:
    """Stored results read back: points (file, row, x, y, z), the trajectory (file, i, pose) of each file and
    the list (file, i, value) that says for every point which pose it hangs on.  Adds pose_id and the
    point's place in scan coordinates; points whose entry or pose is missing stay, with nulls."""
    named = index.select("file", F.col("i").alias("row"), F.col("value").alias("pose_id"))
    out = points.join(named, ["file", "row"], "left").join(trajectory.select("file", F.col("i").alias("pose_id"), "pose"), ["file", "pose_id"], "left")
    own = F.when(F.col("pose").isNotNull(), transform(P.inverse("pose"), "x", "y", "z"))
    return out.withColumn("__l", own).withColumns({f"local_{a}": F.col(f"__l.{a}") for a in "xyz"}).drop("__l", "pose")


def rigid_sums(pairs: DataFrame, source: tuple[str, str, str], target: tuple[str, str, str], weight: str | None = None) -> DataFrame:
    """The one row of sums that a rigid fit needs: counts, means and cross products of paired places."""
    w = F.col(weight) if weight else F.lit(1.0)
    sums = [F.sum(w).alias("w"), *[F.sum(w * F.col(s)).alias(f"s{i}") for i, s in enumerate(source)], *[F.sum(w * F.col(t)).alias(f"t{i}") for i, t in enumerate(target)]]
    return pairs.agg(*sums, *[F.sum(w * F.col(s) * F.col(t)).alias(f"c{i}{j}") for i, s in enumerate(source) for j, t in enumerate(target)])


def rigid_fit(sums: DataFrame) -> np.ndarray | None:
    """The pose that brings the sources onto the targets best (Kabsch), from ``rigid_sums``; one row comes
    to the driver.  None without pairs."""
    r = sums.first()
    if not r["w"]:
        return None
    s, t = (np.array([r[f"{k}{i}"] for i in range(3)]) / r["w"] for k in "st")
    c = np.array([[r[f"c{i}{j}"] for j in range(3)] for i in range(3)]) / r["w"] - np.outer(s, t)
    u, _, vt = np.linalg.svd(c)
    turn = vt.T @ np.diag([1, 1, np.sign(np.linalg.det(vt.T @ u.T))]) @ u.T
    out = np.eye(4)
    out[:3, :3], out[:3, 3] = turn, t - turn @ s
    return out


def fused_with_fixes(scans: DataFrame, fixes: DataFrame, tolerance: float, rounds: int = 5, scale: float = 1.0) -> tuple[DataFrame, np.ndarray]:
    """A trajectory laid onto satellite fixes (ts, x, y, z) or another trajectory's places: every scan and
    the fix before it, Cauchy weights by their distance, a rigid fit each round.  Gives the moved scans
    and the pose."""
    from pointloom.plans.registration import checked_pose

    pairs = joins.asof_after_first(scans, fixes.select("ts", "x", "y", "z"), "ts", "ts", tolerance, prefix="g_").where("g_x is not null")
    pairs = stored(pairs.select(*[F.col("pose")[i].alias(f"p{a}") for a, i in zip("xyz", (3, 7, 11))], "g_x", "g_y", "g_z"), "pairs")  # read in every round
    pose = np.eye(4)
    for k in range(rounds):
        at = pairs.withColumn("__p", transform(F.array(*[F.lit(float(v)) for v in pose.ravel()]), "px", "py", "pz"))
        square = sum((F.col(f"__p.{a}") - F.col(f"g_{a}")) * (F.col(f"__p.{a}") - F.col(f"g_{a}")) for a in "xyz")
        new = rigid_fit(rigid_sums(at.withColumn("__w", 1 / (1 + square / (scale * scale)) if k else F.lit(1.0)), ("px", "py", "pz"), ("g_x", "g_y", "g_z"), "__w"))
        if new is None or np.allclose(new, pose, atol=1e-12):
            break
        pose = checked_pose(new)
    m = F.array(*[F.lit(float(v)) for v in pose.ravel()])
    return scans.withColumn("pose", P.product(m, "pose")), pose


def sessions_joined(points: DataFrame, scans: DataFrame, reach: float, radius: float, apart: int = 10, places: DataFrame | None = None, rounds: int = 20, solve=None) -> DataFrame:
    """Scans of all sessions in one graph: motions between consecutive scans of a session, and loop edges
    between scans nearer than ``reach`` (of different sessions, or ``apart`` places within one), measured
    by registering their points.  ``scan_id`` is unique over the sessions.

    ``places`` (scan_id, x, y, z, weight) are known points of scans, as satellite fixes or ground control;
    with them no scan is held, without them the first one is.  Scans, edges and the system they make are
    tables; ``solve`` is that of ``sparse.consistent``.
    """
    from pointloom.operators.scans import numbered
    from pointloom.plans import registration, sparse

    t = stored(numbered(scans.select("session", "scan_id", "ts", "pose"), ["session", "ts", "scan_id"]), "scans")
    ahead = t.select((F.col("n") - 1).alias("a"), F.col("n").alias("b"), F.col("session").alias("__s"), F.col("pose").alias("__next"))
    ways = ahead.join(t.select(F.col("n").alias("a"), "session", "pose"), "a").where("session = __s").select("a", "b", P.product(P.inverse("pose"), "__next").alias("measured"))
    loops = registration.register_loops(points, t, registration.loop_pairs(t, reach, apart), radius).where("matched > 0")
    side = lambda c: t.select(F.col("scan_id").alias(c), F.col("n").alias(f"__{c}"), F.col("pose").alias(f"__pose_{c}"))
    loops = loops.join(side("a"), "a").join(side("b"), "b")
    loops = loops.select(F.col("__a").alias("a"), F.col("__b").alias("b"), P.product(P.inverse("__pose_a"), P.product("fix", "__pose_b")).alias("measured"))
    edges = stored(ways.unionByName(loops).withColumn("weight", F.lit(1.0)), "edges")
    known = None
    if places is not None:
        known = stored(places.join(t.select("scan_id", F.col("n").alias("id")), "scan_id").select("id", "x", "y", "z", "weight"), "places")
        known = None if known.isEmpty() else known
    out = sparse.consistent(t.select(F.col("n").alias("id"), "pose"), edges, known, rounds=rounds, solve=solve)
    new = t.select("scan_id", F.col("n").alias("id")).join(out.withColumnRenamed("pose", "__new"), "id").drop("id")
    return scans.join(new, "scan_id").withColumn("pose", F.col("__new")).drop("__new")


def calibrated_sensors(points: DataFrame, size: float, radius: float, rounds: int = 20) -> np.ndarray:
    """The pose that brings all other sensors' points (lidar_id not 0) onto those of sensor 0: both sides
    are thinned to a point a cell, then registered."""
    from pointloom.operators.aggregates import decimate
    from pointloom.plans.solvers import register

    thin = lambda p: decimate(p.select("id", "x", "y", "z"), ["x", "y", "z"], size, "id").select("id", "x", "y", "z")
    return register(thin(points.where("lidar_id <> 0")), thin(points.where("lidar_id = 0")), radius, rounds).pose


def experiments(spark, methods: dict) -> DataFrame:
    """(method, rms, ms) of named registrations (functions without arguments that give a result with rms)."""
    import time

    rows = []
    for name, run in methods.items():
        began = time.perf_counter()
        rows.append((name, float(run().rms), 1000 * (time.perf_counter() - began)))
    return spark.createDataFrame(rows, "method string, rms double, ms double")

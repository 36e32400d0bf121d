"""Registration of many scans and of sessions: sums on the cluster, small systems on the driver.

Scans are rows (scan_id, pose array<double>16), their points (scan_id, id, x, y, z) in scan
coordinates.  A round joins points with what they are matched to and brings back one row of 27 sums
for each scan (or pair of scans), so the driver sees scans and never points.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.functions import pose as P
from pointloom.functions.geometry import cell, transform
from pointloom.operators import filters, joins
from pointloom.operators.aggregates import normal_equations
from pointloom.operators.maps import PAIRS, voxel_gaussians, voxel_sums
from pointloom.sources.store import dropped, stored
from pointloom.plans.solvers import exp_pose, log_pose, pose_graph, solve


def checked_pose(pose: np.ndarray) -> np.ndarray:
    """The pose itself; an error if a solve went wrong and left something that isn't finite."""
    if not np.isfinite(pose).all():
        raise FloatingPointError("a solve gave a pose that isn't finite")
    return pose


def posed(points: DataFrame, poses: dict[int, np.ndarray]) -> DataFrame:
    """Points in the common frame; the poses of all scans are a few numbers each."""
    spark = points.sparkSession
    table = spark.createDataFrame([(int(k), [float(v) for v in m.ravel()]) for k, m in poses.items()], "scan_id long, __pose array<double>")
    p = points.join(table, "scan_id").withColumn("__p", transform("__pose", "x", "y", "z"))
    return p.select("scan_id", "id", *[F.col(f"__p.{a}").alias(a) for a in "xyz"])


def _turn(p: dict[str, Column]) -> dict[str, tuple]:
    zero = F.lit(0.0)
    return {"x": (zero, p["z"], -p["y"]), "y": (-p["z"], zero, p["x"]), "z": (p["y"], -p["x"], zero)}


def _equations(p: dict[str, Column], diff: dict[str, Column], root: dict[str, Column] | None = None) -> Column:
    """Rows of (j0..j5, res) of a point and what it misses its target by; ``root`` holds the upper
    factor of the information matrix (uxx, uxy, ...), the unit matrix if not given."""
    turn = _turn(p)
    jac = {a: [F.lit(1.0 if a == b else 0.0) for b in "xyz"] + list(turn[a]) for a in "xyz"}
    rows = []
    for i, a in enumerate("xyz"):
        if root is None:
            own, res = jac[a], diff[a]
        else:
            own = [sum((root[a + b] * jac[b][k] for b in "xyz"[i + 1 :]), root[a + a] * jac[a][k]) for k in range(6)]
            res = sum((root[a + b] * diff[b] for b in "xyz"[i + 1 :]), root[a + a] * diff[a])
        rows.append(F.struct(*[j.alias(f"j{k}") for k, j in enumerate(own)], res.alias("res")))
    return F.explode(F.array(*rows))


def with_information_root(voxels: DataFrame, floor: float) -> DataFrame:
    """Adds uxx..uzz, U with U'U the inverse of covariance + floor^2 I."""
    c = {x: F.col(f"cov_{x}") + (floor * floor if x[0] == x[1] else 0.0) for x in ("xx", "xy", "xz", "yy", "yz", "zz")}
    cof = {"xx": c["yy"] * c["zz"] - c["yz"] * c["yz"], "xy": c["xz"] * c["yz"] - c["xy"] * c["zz"], "xz": c["xy"] * c["yz"] - c["xz"] * c["yy"], "yy": c["xx"] * c["zz"] - c["xz"] * c["xz"], "yz": c["xy"] * c["xz"] - c["xx"] * c["yz"], "zz": c["xx"] * c["yy"] - c["xy"] * c["xy"]}
    det = c["xx"] * cof["xx"] + c["xy"] * cof["xy"] + c["xz"] * cof["xz"]
    v = voxels.withColumn("__det", det).where(F.col("__det") > 0).withColumns({f"__i{k}": x / F.col("__det") for k, x in cof.items()})
    i = {k: F.col(f"__i{k}") for k in cof}
    v = v.withColumn("uxx", F.sqrt(i["xx"])).withColumn("uxy", i["xy"] / F.col("uxx")).withColumn("uxz", i["xz"] / F.col("uxx"))
    v = v.withColumn("uyy", F.sqrt(F.greatest(i["yy"] - F.col("uxy") * F.col("uxy"), F.lit(0.0))))
    v = v.withColumn("uyz", F.coalesce(F.try_divide(i["yz"] - F.col("uxy") * F.col("uxz"), F.col("uyy")), F.lit(0.0)))
    v = v.withColumn("uzz", F.sqrt(F.greatest(i["zz"] - F.col("uxz") * F.col("uxz") - F.col("uyz") * F.col("uyz"), F.lit(0.0))))
    return v.drop("__det", *[f"__i{k}" for k in cof])


def _step(rows: DataFrame, poses: dict[int, np.ndarray], fixed: set[int], damping: float) -> float:
    """One Gauss-Newton step of every free scan from its own sums; returns the sum of |step|."""
    moved = 0.0
    for r in normal_equations(rows, [f"j{i}" for i in range(6)], "res", ["scan_id"]).collect():  # a row a scan
        if r["scan_id"] in fixed:
            continue
        d = solve(r, 6, damping)
        if np.linalg.norm(d[:3]) < 1.0:  # a jump over 1 m is no correction
            poses[r["scan_id"]] = exp_pose(d) @ poses[r["scan_id"]]
            moved += float(np.abs(d).sum())
    return moved


def register_to_voxels(points: DataFrame, poses: dict[int, np.ndarray], size: float, rounds: int = 10, least: int = 5, fixed: set[int] | None = None, damping: float = 1e-3, gaussians: DataFrame | None = None) -> dict[int, np.ndarray]:
    """Scans against the voxel Gaussians of all of them (or of a given map): each point is drawn to
    its voxel's mean in the voxel's own metric, so along a wall it may slide."""
    poses = {k: v.copy() for k, v in poses.items()}
    for _ in range(rounds):
        world = posed(points, poses)
        v = gaussians if gaussians is not None else voxel_gaussians(voxel_sums(world, size), size, least)
        v = with_information_root(v.where(filters.sane_matrix(F.array(*[F.col(f"cov_{x}") for x in PAIRS]), 1e5)), 0.05 * size)
        j = world.withColumns({f"i{a}": cell(a, size, "floor") for a in "xyz"}).join(v, ["ix", "iy", "iz"])
        p = {a: F.col(a) for a in "xyz"}
        root = {a + b: F.col(f"u{a}{b}") for a, b in PAIRS}
        rows = j.select("scan_id", _equations(p, {a: F.col(f"mean_{a}") - F.col(a) for a in "xyz"}, root).alias("e")).select("scan_id", "e.*")
        if _step(rows, poses, fixed or set(), damping) < 1e-9:
            break
    return poses


def register_pairs(points: DataFrame, poses: dict[int, np.ndarray], radius: float, rounds: int = 10, fixed: set[int] | None = None, pairs: DataFrame | None = None) -> dict[int, np.ndarray]:
    """Scans against each other: every point and its nearest in each other scan within ``radius``.
    ``pairs`` (scan_from, scan_to) limits which meet."""
    poses = {k: v.copy() for k, v in poses.items()}
    for _ in range(rounds):
        world = posed(points, poses)
        near = joins.radius_pairs(world, world, ["x", "y", "z"], radius).where("l.scan_id <> r.scan_id")
        if pairs is not None:
            near = near.join(pairs, (F.col("l.scan_id") == pairs["scan_from"]) & (F.col("r.scan_id") == pairs["scan_to"]), "left_semi")
        best = near.groupBy("l.scan_id", "l.id", F.col("r.scan_id").alias("other")).agg(F.min_by(F.struct("l", "r"), F.struct("d", "r.id")).alias("b"))
        p = {a: F.col(f"b.l.{a}") for a in "xyz"}
        rows = best.select("scan_id", _equations(p, {a: F.col(f"b.r.{a}") - p[a] for a in "xyz"}).alias("e")).select("scan_id", "e.*")
        if _step(rows, poses, fixed or set(), 1e-9) < 1e-9:
            break
    return poses


def loop_pairs(scans: DataFrame, reach: float, apart: int = 1) -> DataFrame:
    """(a, b) of scans (scan_id, session, pose) nearer than ``reach``: of different sessions, the earlier one
    first, or ``apart`` places within one."""
    p = scans.select(F.col("scan_id").alias("id"), "session", *[F.col("pose")[i].alias(x) for x, i in zip("xyz", (3, 7, 11))])
    near = joins.radius_pairs(p, p, ["x", "y", "z"], reach, strict=True)
    other = (F.col("l.session") < F.col("r.session")) | ((F.col("l.session") == F.col("r.session")) & (F.col("l.id") + apart < F.col("r.id")))
    return near.where(other).select(F.col("l.id").alias("a"), F.col("r.id").alias("b"))


def pose_table(spark: SparkSession, poses: dict[int, np.ndarray]) -> DataFrame:
    return spark.createDataFrame([(int(k), [float(v) for v in m.ravel()]) for k, m in poses.items()], "scan_id long, pose array<double>")


def loop_edges(poses: dict[int, np.ndarray], spark: SparkSession, reach: float, sessions: dict[int, int] | None = None, apart: int = 1) -> list[tuple[int, int]]:
    """``loop_pairs`` of a few scans, as a list."""
    names = spark.createDataFrame([(int(k), int((sessions or {}).get(k, 0))) for k in poses], "scan_id long, session long")
    return sorted((r["a"], r["b"]) for r in loop_pairs(pose_table(spark, poses).join(names, "scan_id"), reach, apart).collect())


def _fixed_by_sums(rows: DataFrame) -> DataFrame:
    """(a, b, fix, matched, moved): ``fix`` one Gauss-Newton step further by its pair's sums (where it has any)."""
    names = [f"ata_{i}{j}" for i in range(6) for j in range(i, 6)] + [f"atb_{i}" for i in range(6)]

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                fix, d = np.reshape(r["fix"], (4, 4)), np.zeros(6)
                if r["n"]:
                    d = solve(r, 6)
                    fix = checked_pose(exp_pose(d) @ fix)
                out.append({"a": r["a"], "b": r["b"], "fix": fix.ravel().tolist(), "matched": r["n"] or 0, "moved": float(np.abs(d).sum())})
            yield pa.RecordBatch.from_pylist(out, schema)

    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("fix", pa.list_(pa.float64())), ("matched", pa.int64()), ("moved", pa.float64())])
    return rows.select("a", "b", "fix", "n", *names).mapInArrow(run, "a long, b long, fix array<double>, matched long, moved double")


def register_loops(points: DataFrame, scans: DataFrame, edges: DataFrame, radius: float, rounds: int = 10) -> DataFrame:
    """(a, b, fix, matched) for every pair of scans (a, b): the motion, in the common frame, that brings b onto
    a, and the equations it was measured with (none: no motion).

    All pairs are one join a round, kept apart by their names.  Sums and steps are rows by pair, so there may
    be as many pairs as there are; the driver sees one number a round.
    """
    own = scans.select("scan_id", "pose")
    still = F.array(*[F.lit(1.0 if i % 5 == 0 else 0.0) for i in range(16)])
    state = stored(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).distinct().select("a", "b", still.alias("fix"), F.lit(0).cast("long").alias("matched")), "loops")

    def placed(pairs: DataFrame, scan: str) -> DataFrame:
        at = points.join(pairs.withColumnRenamed(scan, "scan_id").join(own, "scan_id"), "scan_id")
        if "fix" in pairs.columns:
            at = at.withColumn("pose", P.product("fix", "pose"))
        at = at.withColumn("__p", transform("pose", "x", "y", "z")).withColumnRenamed("scan_id", scan)
        return at.select("a", "b", "id", *[F.col(f"__p.{x}").alias(x) for x in "xyz"])

    target = stored(placed(state.select("a", "b"), "a"), "targets")
    for _ in range(rounds):
        best = joins.nearest(placed(state.select("a", "b", "fix"), "b"), target, ["x", "y", "z"], radius, "id", "id", ["a", "b"])
        p = {x: F.col(f"l.{x}") for x in "xyz"}
        rows = best.select("a", "b", _equations(p, {x: F.col(f"r.{x}") - p[x] for x in "xyz"}).alias("e")).select("a", "b", "e.*")
        sums = normal_equations(rows, [f"j{i}" for i in range(6)], "res", ["a", "b"])
        after = stored(_fixed_by_sums(state.select("a", "b", "fix").join(sums, ["a", "b"], "left")), "loops")
        dropped(state)
        state = after
        if (after.agg(F.sum("moved")).first()[0] or 0.0) < 1e-9:
            break
    dropped(target)
    return state


def register_edges(points: DataFrame, poses: dict[int, np.ndarray], edges: list[tuple[int, int]], radius: float, rounds: int = 10) -> dict[tuple[int, int], tuple[np.ndarray, int]]:
    """``register_loops`` of a few pairs, by pair."""
    spark = points.sparkSession
    pairs = spark.createDataFrame([(int(a), int(b)) for a, b in edges], "a long, b long")
    found = register_loops(points, pose_table(spark, poses), pairs, radius, rounds).collect()
    return {(r["a"], r["b"]): (np.reshape(r["fix"], (4, 4)), r["matched"]) for r in found}


def closed(points: DataFrame, poses: dict[int, np.ndarray], edges: list[tuple[int, int]], radius: float, fixed: int | None = None) -> dict[int, np.ndarray]:
    """Pose graph over the given motions between consecutive scans and loop edges measured by
    registering their two scans."""
    keys = sorted(poses)
    at = {k: i for i, k in enumerate(keys)}
    graph = [(at[a], at[b], np.linalg.inv(poses[a]) @ poses[b], 1.0) for a, b in zip(keys, keys[1:])]
    if edges:
        for (a, b), (fix, n) in register_edges(points, poses, edges, radius).items():
            if n:
                graph.append((at[a], at[b], np.linalg.inv(poses[a]) @ fix @ poses[b], 1.0))
    out = pose_graph(np.array([poses[k] for k in keys]), graph, fixed=at[fixed] if fixed is not None else 0)
    return {k: out[at[k]] for k in keys}


STEPS: dict[str, Callable] = {"voxels": register_to_voxels, "pairs": register_pairs}


def run_multi_view(points: DataFrame, poses: dict[int, np.ndarray], steps: list[tuple[str, dict]]) -> dict[int, np.ndarray]:
    """Named steps in the order given, each from the poses of the one before."""
    for name, settings in steps:
        poses = STEPS[name](points, poses, **settings)
    return poses


def aligned(estimated: np.ndarray, truth: np.ndarray, rounds: int = 20) -> np.ndarray:
    """The rigid pose that brings a trajectory's positions (n, 3) onto the true ones, in closed form."""
    a, b = estimated - estimated.mean(axis=0), truth - truth.mean(axis=0)
    u, _, vt = np.linalg.svd(a.T @ b)
    d = np.diag([1, 1, np.sign(np.linalg.det(vt.T @ u.T))])
    out = np.eye(4)
    out[:3, :3] = vt.T @ d @ u.T
    out[:3, 3] = truth.mean(axis=0) - out[:3, :3] @ estimated.mean(axis=0)
    return out


def alignment(pairs: DataFrame) -> np.ndarray:
    """``aligned`` for a table of pose and true_pose of any size: 16 sums come to the driver."""
    p, t = F.col("pose"), F.col("true_pose")
    at = (3, 7, 11)
    sums = [F.count("*").alias("n"), *[F.avg(p[i]).alias(f"p{i}") for i in at], *[F.avg(t[i]).alias(f"t{i}") for i in at], *[F.covar_pop(p[i], t[j]).alias(f"c{i}_{j}") for i in at for j in at]]
    r = pairs.agg(*sums).first()
    if not r["n"]:
        return np.eye(4)
    c = np.array([[r[f"c{i}_{j}"] for j in at] for i in at])
    u, _, vt = np.linalg.svd(c)
    d = np.diag([1, 1, np.sign(np.linalg.det(vt.T @ u.T)) or 1])
    out = np.eye(4)
    out[:3, :3] = vt.T @ d @ u.T
    out[:3, 3] = np.array([r[f"t{i}"] for i in at]) - out[:3, :3] @ np.array([r[f"p{i}"] for i in at])
    return out


def run_odometry(points: DataFrame, trajectory: DataFrame, size: float = 0.3, per_batch: int = 20, rounds: int = 5, least: int = 5, tolerance_ns: int = 10_000_000, piece_ns: int = 10_000_000_000) -> dict[int, np.ndarray]:
    """Poses of batches of a recording (``odometry.followed`` solves for every pose of a batch).

    Points (id, ts_ns, x, y, z) are matched to the pose before them in ``trajectory`` (ts_ns, pose)
    within a tolerance and put into their batch's first frame; the first batch seeds the map, and
    every further one is registered to it from a constant-velocity guess, then added to it.
    Batches depend on each other, so they are a loop; the points of each are not.
    """
    from pointloom.operators import maps, windows

    t = windows.batches(trajectory.withColumn("__k", F.lit(0)), ["__k"], ["ts_ns"], per_batch).select("ts_ns", "pose", "batch")
    first = t.groupBy("batch").agg(F.min_by("pose", "ts_ns").alias("first_pose"))
    hit = joins.asof_join(points, t, "ts_ns", "ts_ns", strict=True, tolerance=tolerance_ns, bucket=piece_ns, prefix="__t_").where("__t_batch is not null")
    hit = hit.withColumnRenamed("__t_batch", "batch").join(first, "batch")
    local = hit.withColumn("__m", P.product(P.inverse("first_pose"), "__t_pose")).withColumn("__p", transform("__m", "x", "y", "z"))
    local = local.select(F.col("batch").alias("scan_id"), "id", *[F.col(f"__p.{a}").alias(a) for a in "xyz"]).persist()
    guess = {r["batch"]: np.array(r["first_pose"]).reshape(4, 4) for r in first.collect()}  # a row a batch
    out: dict[int, np.ndarray] = {}
    world = None
    for b in sorted(guess):
        own = local.where(F.col("scan_id") == b)
        before = sorted(out)
        pose = guess[b]
        if before:
            pose = out[before[-1]] @ np.linalg.inv(guess[before[-1]]) @ guess[b]
            pose = register_to_voxels(own, {b: pose}, size, rounds, gaussians=maps.voxel_gaussians(world, size, least))[b]
        out[b] = pose
        sums = maps.voxel_sums(posed(own, {b: pose}), size)
        world = stored(sums if world is None else maps.merged(world, sums), "world")
    local.unpersist()
    return out


def motion(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Six numbers of the motion from pose a to pose b."""
    return log_pose(np.linalg.inv(a) @ b)

"""A batch of poses against two voxel maps: fine cells nearby, coarse ones further out.

The cluster joins points with both maps at once and sums normal equations by pose; the driver adds the
motion model and solves a system of six unknowns a pose.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.functions.geometry import cell, norm, transform
from pointloom.operators import filters
from pointloom.operators.aggregates import normal_equations
from pointloom.operators.maps import PAIRS
from pointloom.plans.registration import _equations, checked_pose, with_information_root
from pointloom.plans.solvers import exp_pose, log_poses, solve_blocks


@dataclass(frozen=True)
class Motion:
    """Standard deviations of the motion model between consecutive poses and of the first pose's prior:
    metres, then degrees."""

    metres: float = 0.0005
    degrees: float = 0.01
    first_metres: float = 0.000001
    first_degrees: float = 0.000001

    def weights(self, first: bool = False) -> np.ndarray:
        m, d = (self.first_metres, self.first_degrees) if first else (self.metres, self.degrees)
        return 1 / np.array([m, m, m, *[np.radians(d)] * 3]) ** 2


@dataclass
class Batch:
    poses: dict[int, np.ndarray]
    rounds: int = 0
    moved: float = 0.0
    matched: int = 0
    damping: float = 0.0
    refused: list[int] = field(default_factory=list)


def two_level_map(levels: dict[str, tuple[DataFrame, float]], more_than: int = 5, planarity: float | None = None) -> DataFrame:
    """One table of voxel Gaussians with level and information roots from maps (table, cell size) by name;
    voxels whose matrix is not sane, or that aren't flat enough if ``planarity`` is given, go, each level
    by itself."""
    out = None
    for name, (gaussians, size) in levels.items():
        v = gaussians.where((F.col("n") > more_than) & filters.sane_matrix(F.array(*[F.col(f"cov_{x}") for x in PAIRS]), 1e5))
        if planarity is not None:
            v = filters.planar_buckets(v, more_than, planarity).drop("planarity")
        v = with_information_root(v, 0.05 * size).withColumn("level", F.lit(name))
        out = v if out is None else out.unionByName(v)
    return out


def probed(points: DataFrame, poses: dict[int, np.ndarray], maps: DataFrame, sizes: dict[str, float], least: float = 0.1, most: float = 70.0, far: float = 5.0) -> DataFrame:
    """(scan_id, j0..j5, res): equations of points with the voxel they fall into, of the first level, and
    of the other levels too for those from ``far`` on.  Points go to all their cells in one explode, so
    both maps cost one join."""
    rows = [(int(k), [float(v) for v in m.ravel()]) for k, m in poses.items()]
    table = points.sparkSession.createDataFrame(rows, "scan_id long, __pose array<double>")  # a row a pose
    p = points.withColumn("__r", norm("x", "y", "z")).where(F.col("__r").between(least, most))
    p = p.join(table, "scan_id").withColumn("__p", transform("__pose", "x", "y", "z")).select("scan_id", "__r", "__p.*")
    names = list(sizes)
    cells = [F.struct(F.lit(n).alias("level"), *[cell(a, sizes[n], "floor").alias(f"i{a}") for a in "xyz"]) for n in names]
    near = F.array(cells[0])
    p = p.withColumn("__c", F.explode(F.when(F.col("__r") >= far, F.array(*cells)).otherwise(near))).select("scan_id", "x", "y", "z", "__c.*")
    j = p.join(maps, ["level", "ix", "iy", "iz"])
    at = {a: F.col(a) for a in "xyz"}
    root = {a + b: F.col(f"u{a}{b}") for a, b in PAIRS}
    return j.select("scan_id", _equations(at, {a: F.col(f"mean_{a}") - F.col(a) for a in "xyz"}, root).alias("e")).select("scan_id", "e.*")


def motion_blocks(poses: np.ndarray, model: np.ndarray, first: np.ndarray, motion: Motion) -> tuple[np.ndarray, np.ndarray]:
    """Dense (6n, 6n) and (6n) of the motion model's terms, for steps applied from the left: each pose
    should follow the one before as in ``model``, and the first stay where it was."""
    n = len(poses)
    a, b = np.zeros((6 * n, 6 * n)), np.zeros(6 * n)
    moves = [exp_pose(1e-6 * np.eye(6)[k]) for k in range(6)]

    def add(slots: list[int], residual, weight: np.ndarray, at: np.ndarray) -> None:
        r = residual(at[None])[0]
        parts = []
        for s in range(len(slots)):
            stepped = np.stack([np.stack([m @ at[s] if t == s else at[t] for t in range(len(slots))]) for m in moves])
            parts.append((residual(stepped) - r).T / 1e-6)
        for s, x in zip(slots, parts):
            b[6 * s : 6 * s + 6] -= x.T @ (weight * r)
            for t, y in zip(slots, parts):
                a[6 * s : 6 * s + 6, 6 * t : 6 * t + 6] += x.T @ (weight[:, None] * y)

    for k in range(n - 1):
        back = np.linalg.inv(np.linalg.inv(model[k]) @ model[k + 1])
        add([k, k + 1], lambda p, back=back: log_poses(back @ np.linalg.inv(p[:, 0]) @ p[:, 1]), motion.weights(), poses[k : k + 2])
    add([0], lambda p: log_poses(np.linalg.inv(first) @ p[:, 0]), motion.weights(True), poses[:1])
    return a, b


def register_batch(points: DataFrame, poses: dict[int, np.ndarray], maps: DataFrame, sizes: dict[str, float], motion: Motion = Motion(), model: dict[int, np.ndarray] | None = None, rounds: int = 20, tolerance: float = 1e-8, damping: float = 1e-9, most_jump: float = 1.0, **ranges: float) -> Batch:
    """Poses of a batch (scan_id in time order) on both maps, by damped Gauss-Newton.

    ``model`` are the poses whose motion is kept (those given, if missing).  A step of over ``most_jump``
    metres is refused for its pose; the damping grows tenfold every ten rounds; it ends when the steps
    add up to less than ``tolerance`` or after ``rounds`` (a bound on rounds, not on time, so that a rerun
    agrees).  A solve that isn't finite is an error.
    """
    keys = sorted(poses)
    out = Batch({k: poses[k].copy() for k in keys}, damping=damping)
    then = np.array([(model or poses)[k] for k in keys])
    first = poses[keys[0]].copy()
    own = points.persist()
    for out.rounds in range(1, rounds + 1):
        at = np.array([out.poses[k] for k in keys])
        a, b = motion_blocks(at, then, first, motion)
        out.matched = 0
        for r in normal_equations(probed(own, out.poses, maps, sizes, **ranges), [f"j{i}" for i in range(6)], "res", ["scan_id"]).collect():  # a row a pose
            s = 6 * keys.index(r["scan_id"])
            out.matched += r["n"]
            block, right = solve_blocks(r, 6)
            a[s : s + 6, s : s + 6] += block
            b[s : s + 6] += right
        step = np.linalg.solve(a + out.damping * np.eye(len(a)), b).reshape(-1, 6)
        out.refused = [k for k, d in zip(keys, step) if not np.linalg.norm(d[:3]) <= most_jump]
        for k, d in zip(keys, step):
            if k not in out.refused:
                out.poses[k] = checked_pose(exp_pose(d) @ out.poses[k])
        out.moved = float(np.abs(step).sum())
        if not np.isfinite(out.moved):
            raise FloatingPointError("a solve gave steps that aren't finite")
        if out.moved < tolerance:
            break
        if out.rounds % 10 == 0:
            out.damping *= 10
    own.unpersist()
    return out

"""Ground, poles and camera extrinsics: small solvers over aggregates of the cluster."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.functions.camera import Intrinsics
from pointloom.operators import aggregates as A
from pointloom.operators import filters, shape
from pointloom.plans.solvers import exp_pose


def ground_surface(points: DataFrame, size: float, smooth: float = 1.0, rounds: int = 300) -> DataFrame:
    """(ix, iy, ground_z): a smooth surface under the points.

    The lowest point of every cell comes from the cluster; the surface minimises its distance to
    them plus ``smooth`` times the squared steps between neighbouring cells, by conjugate gradients
    over the cells (one number a cell, on the driver: for areas whose grid a driver holds).
    """
    low = A.lowest_per_cell(points, size, "id").select("ix", "iy", "z").collect()
    spark = points.sparkSession
    schema = "ix int, iy int, ground_z double"
    if not low:
        return spark.createDataFrame([], schema)
    x, y, z = (np.array(v) for v in zip(*low))
    x0, y0 = x.min(), y.min()
    shape_ = (x.max() - x0 + 1, y.max() - y0 + 1)
    known, target = np.zeros(shape_), np.zeros(shape_)
    known[x - x0, y - y0], target[x - x0, y - y0] = 1.0, z

    def apply(s: np.ndarray) -> np.ndarray:
        out = known * s
        for axis in (0, 1):
            step = smooth * np.diff(s, axis=axis)
            pad = [(0, 0), (0, 0)]
            pad[axis] = (1, 0)
            out += np.pad(step, pad)
            pad[axis] = (0, 1)
            out -= np.pad(step, pad)
        return out

    s = np.full(shape_, float(np.mean(z)))
    r = known * target - apply(s)
    d, rr = r.copy(), float((r * r).sum())
    for _ in range(rounds):
        if rr < 1e-18:
            break
        q = apply(d)
        a = rr / float((d * q).sum())
        s, r = s + a * d, r - a * q
        new = float((r * r).sum())
        d, rr = r + new / rr * d, new
    rows = [(int(x0 + i), int(y0 + j), float(s[i, j])) for i in range(shape_[0]) for j in range(shape_[1])]
    return spark.createDataFrame(rows, schema)


def vertex_heights(vertices: DataFrame, ground: DataFrame, radius: float = 1.0, key: str = "id") -> DataFrame:
    """(key, z, d): for every surface vertex (key, x, y) the height of the ground point nearest in the
    plane, within ``radius``; of equally near ones that with the smallest id."""
    from pointloom.operators.joins import nearest

    near = nearest(vertices.select(key, "x", "y"), ground.select("id", "x", "y", "z"), ["x", "y"], radius, key, "id")
    return near.select(key, F.col("r.z").alias("z"), "d")


def find_poles(points: DataFrame, size: float = 0.5, above: float = 0.5, below_top: float = 10.0, radius: float = 0.5, linearity: float = 0.8) -> DataFrame:
    """Standing lines above the ground: ground surface, band above it, local shape, threshold."""
    band = filters.ground_band(points, ground_surface(points, size), size, above, below_top)
    features = shape.neighbourhood_features(band, radius, "id")
    return shape.poles(features, linearity, 0.8)


def camera_extrinsics(picks: list[tuple[tuple[float, float, float], tuple[float, float]]], cam: Intrinsics, start: np.ndarray | None = None, rounds: int = 50) -> np.ndarray:
    """The pose that takes points of the platform into the camera frame, from picked pairs of a point
    and its pixel, by damped Gauss-Newton on the pinhole error.  Picks are a handful."""
    xyz, uv = np.array([p for p, _ in picks], float), np.array([q for _, q in picks], float)
    pose, damping = np.eye(4) if start is None else np.array(start, float), 1e-3

    def error(m: np.ndarray) -> np.ndarray:
        c = xyz @ m[:3, :3].T + m[:3, 3]
        depth = np.where(np.abs(c[:, 2]) < 1e-6, 1e-6, c[:, 2])
        return (np.column_stack([cam.fx * c[:, 0] / depth + cam.cx, cam.fy * c[:, 1] / depth + cam.cy]) - uv).ravel()

    e = error(pose)
    for _ in range(rounds):
        jac = np.column_stack([(error(exp_pose(1e-6 * np.eye(6)[k]) @ pose) - e) / 1e-6 for k in range(6)])
        h = jac.T @ jac
        step = np.linalg.solve(h + damping * np.diag(np.diag(h) + 1e-12), -jac.T @ e)
        moved = exp_pose(step) @ pose
        new = error(moved)
        if new @ new < e @ e:
            pose, e, damping = moved, new, damping / 3
        else:
            damping *= 4
        if np.abs(step).max() < 1e-12:
            break
    return pose


def uncertain_pairs(before: DataFrame, after: DataFrame, key: str = "scan_id") -> DataFrame:
    """Ratio of the mean covariance traces (a third of them) before and after an adjustment."""
    trace = lambda d: d.select(key, ((F.col("cov_xx") + F.col("cov_yy") + F.col("cov_zz")) / 3).alias("t"))
    j = trace(before).alias("b").join(trace(after).alias("a"), key)
    return j.agg(F.try_divide(F.avg("b.t"), F.avg("a.t")).alias("ratio"))

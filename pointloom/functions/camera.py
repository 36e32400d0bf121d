"""Pinhole and panoramic projections as columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from pointloom.functions.geometry import ColumnLike, c, norm


@dataclass(frozen=True)
class Intrinsics:
    fx: float
    fy: float
    cx: float
    cy: float
    k: tuple[float, float, float, float, float, float] = (0.0,) * 6
    p: tuple[float, float] = (0.0, 0.0)
    width: int = 0
    height: int = 0


def project(x: ColumnLike, y: ColumnLike, z: ColumnLike, cam: Intrinsics, min_depth: float = 1e-6) -> Column:
    """struct(u, v, depth) of a point in the camera frame with rational radial and tangential
    distortion; null nearer than ``min_depth`` and, where the image size is given, outside it."""
    depth = c(z)
    a, b = F.try_divide(c(x), depth), F.try_divide(c(y), depth)
    r2 = a * a + b * b
    k = cam.k
    radial = (1 + r2 * (k[0] + r2 * (k[1] + r2 * k[2]))) / (1 + r2 * (k[3] + r2 * (k[4] + r2 * k[5])))
    u = cam.fx * (a * radial + 2 * cam.p[0] * a * b + cam.p[1] * (r2 + 2 * a * a)) + cam.cx
    v = cam.fy * (b * radial + cam.p[0] * (r2 + 2 * b * b) + 2 * cam.p[1] * a * b) + cam.cy
    ok = depth > min_depth
    if cam.width and cam.height:
        ok = ok & (u >= 0) & (u < cam.width) & (v >= 0) & (v < cam.height)
    return F.when(ok, F.struct(u.alias("u"), v.alias("v"), depth.alias("depth")))


def equirectangular(x: ColumnLike, y: ColumnLike, z: ColumnLike, width: int, height: int) -> Column:
    """struct(u, v) on a full panorama: longitude across, polar angle down."""
    r = norm(x, y, z)
    u = (F.atan2(c(y), c(x)) / (2 * F.pi()) + 0.5) * width
    return F.when(r > 0, F.struct(u.alias("u"), (F.acos(c(z) / r) / F.pi() * height).alias("v")))


def fisheye(x: ColumnLike, y: ColumnLike, z: ColumnLike, cam: Intrinsics) -> Column:
    """struct(u, v) by the equidistant model with four coefficients (cam.k[:4])."""
    side = norm(x, y)
    t = F.atan2(side, c(z))
    t2 = t * t
    d = t * (1 + t2 * (cam.k[0] + t2 * (cam.k[1] + t2 * (cam.k[2] + t2 * cam.k[3]))))
    s = F.coalesce(F.try_divide(d, side), F.lit(0.0))
    return F.struct((cam.fx * s * c(x) + cam.cx).alias("u"), (cam.fy * s * c(y) + cam.cy).alias("v"))

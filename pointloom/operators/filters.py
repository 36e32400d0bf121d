"""Point filters as plain predicates, so that Catalyst can push them into the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.functions.geometry import c, cell, norm, transform
from pointloom.functions.pose import inverse


def annulus(points: DataFrame, inner: float, outer: float, x: str = "x", y: str = "y") -> DataFrame:
    """Strictly between two distances from the axis."""
    r = norm(x, y)
    return points.where((r > inner) & (r < outer))


def range_gate(points: DataFrame, most: float, least: float = 0.1, dims=("x", "y", "z")) -> DataFrame:
    square = sum((c(d) * c(d) for d in dims[1:]), c(dims[0]) * c(dims[0]))
    return points.where((square >= least * least) & (square <= most * most))


def slabs(points: DataFrame, widths: dict[str, float]) -> DataFrame:
    """Points in any slab: |axis| below its width."""
    cond = F.lit(False)
    for axis, w in widths.items():
        cond = cond | (F.abs(c(axis)) < w)
    return points.where(cond)


def in_box(box_pose: Column | str, size: tuple[float, float, float], x="x", y="y", z="z") -> Column:
    """Whether a point lies inside an oriented box (pose of its centre, full edge lengths)."""
    p = transform(inverse(box_pose), x, y, z)
    return (F.abs(p["x"]) < size[0] / 2) & (F.abs(p["y"]) < size[1] / 2) & (F.abs(p["z"]) < size[2] / 2)


def crop(points: DataFrame, other: DataFrame, dims: list[str]) -> DataFrame:
    """Points strictly inside the bounding box of another cloud (one row of bounds is joined)."""
    box = other.agg(*[f(d).alias(f"__{n}_{d}") for d in dims for n, f in (("lo", F.min), ("hi", F.max))])
    out = points.crossJoin(F.broadcast(box))  # a single row
    for d in dims:
        out = out.where((c(d) > c(f"__lo_{d}")) & (c(d) < c(f"__hi_{d}")))
    return out.select(*points.columns)


def sane_matrix(matrix: Column | str, most: float = 1e5) -> Column:
    """Whether no entry of a matrix is too large or not finite."""
    return ~F.exists(matrix, lambda v: F.isnan(v) | (F.abs(v) > most))


def facing(normal: tuple, mean: tuple, view: tuple) -> Column:
    """Whether a surface with this normal turns toward a viewpoint."""
    return sum((c(n) * (c(v) - c(m)) for n, m, v in zip(normal[1:], mean[1:], view[1:])), c(normal[0]) * (c(view[0]) - c(mean[0]))) > 0


def ground_band(points: DataFrame, ground: DataFrame, size: float, below: float, above: float, x: str = "x", y: str = "y", z: str = "z") -> DataFrame:
    """Points between ground + below and ground + above; where no ground is known, all stay.
    ``ground`` has ix, iy and ground_z."""
    p = points.withColumn("ix", cell(x, size)).withColumn("iy", cell(y, size))
    out = p.join(ground.select("ix", "iy", "ground_z"), ["ix", "iy"], "left")
    return out.where(F.col("ground_z").isNull() | c(z).between(F.col("ground_z") + below, F.col("ground_z") + above)).select(*points.columns)


def without(rows: DataFrame, banned: DataFrame, on: str) -> DataFrame:
    return rows.join(banned.select(on), on, "left_anti")


def recentred(points: DataFrame, dims: list[str], offset: dict[str, float] | None = None) -> DataFrame:
    """Less an offset, or less the mean."""
    if offset is not None:
        return points.withColumns({d: c(d) - F.lit(offset[d]) for d in dims})
    mean = points.agg(*[F.avg(d).alias(f"__m_{d}") for d in dims])
    return points.crossJoin(F.broadcast(mean)).withColumns({d: c(d) - c(f"__m_{d}") for d in dims}).select(*points.columns)


def unoccluded(voxels: DataFrame, most_hits: int = 20, hits: str = "hits") -> DataFrame:
    """Voxels that fewer than ``most_hits`` rays pass through (no count: none)."""
    return voxels.where(F.coalesce(c(hits), F.lit(0)) < most_hits)


def planar_buckets(voxels: DataFrame, more_than: int = 10, planarity: float = 0.7) -> DataFrame:
    """Voxels (n, cov_xx .. cov_zz; each level by itself) with enough points that lie flat: adds planarity."""
    # 3 e0 / s * 3 e1 / s * 3 e2 / s is 27 det / trace^3, so no eigenvalue is worked out
    det = c("cov_xx") * (c("cov_yy") * c("cov_zz") - c("cov_yz") * c("cov_yz")) - c("cov_xy") * (c("cov_xy") * c("cov_zz") - c("cov_yz") * c("cov_xz")) + c("cov_xz") * (c("cov_xy") * c("cov_yz") - c("cov_yy") * c("cov_xz"))
    trace = c("cov_xx") + c("cov_yy") + c("cov_zz")
    out = voxels.where(F.col("n") > more_than).withColumn("planarity", 1 - F.try_divide(27 * det, trace * trace * trace))
    return out.where(F.col("planarity") > planarity)


def around_point(rows: DataFrame, point: tuple[float, float, float], radius: float = 0.03) -> DataFrame:
    """Rows within ``radius`` of one point, with their distance d: its correspondences on every ray."""
    d = norm(*[c(a) - F.lit(float(v)) for a, v in zip("xyz", point)])
    return rows.withColumn("d", d).where(F.col("d") < radius)

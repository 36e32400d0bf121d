"""Scans registered by their planes.

Every scan's points are fitted with planes, a plane a cell, in the scan's own frame and once only, so a round
of registration moves planes and never points.  Planes of two scans meet in one distance join of their middles
and must point the same way.  A pair gives a residual of the kind asked for; each is weighed by what is known
of both planes.  The blocks are summed by scan and pair of scans and solved by ``sparse.consistent``'s means, so
scans are as many as there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.functions.geometry import cell, transform
from pointloom.operators.joins import radius_pairs
from pointloom.operators.shape import eigen3
from pointloom.plans import elimination, sparse
from pointloom.plans.sparse import matrix_of
from pointloom.sources.store import dropped, stored

#: Residuals of a pair: what its points are apart; their distance along the target's normal as a number or as
#: a vector (to the point's projection); what normals and offsets of the two planes differ by.
KINDS = ("point_to_point", "point_to_plane", "point_to_projection", "plane_to_plane")
PAIRS = ("xx", "xy", "xz", "yy", "yz", "zz")
TERMS = "nodes array<long>, jac array<double>, res array<double>, weight double"


def fitted_planes(points: DataFrame, size: float, least: int = 10, flat: float = 0.5) -> DataFrame:
    """(scan_id, plane, n, x, y, z, nx, ny, nz, spread) of cells of points (scan_id, x, y, z) that are flat: the
    middle, the normal, and the mean square distance of its points from the plane.

    Cells with fewer than ``least`` points, or whose planarity (e1 - e2) / e0 is below ``flat``, have none; so
    have points with a null or NaN coordinate.  Repeated points count as often as they come.
    """
    sound = points.where(" AND ".join(f"{a} IS NOT NULL AND NOT isnan({a})" for a in "xyz"))
    keys = [f"i{a}" for a in "xyz"]
    cells = sound.withColumns({k: cell(k[1], size, "floor") for k in keys})
    own = {a: F.col(a) - F.col(f"i{a}") * F.lit(size) for a in "xyz"}  # from the cell's corner, so that sums keep their digits
    sums = [F.avg(own[a]).alias(a) for a in "xyz"] + [F.covar_pop(own[a], own[b]).alias(f"c{a}{b}") for a, b in PAIRS]
    g = cells.groupBy("scan_id", *keys).agg(F.count("*").alias("n"), *sums).where(F.col("n") >= least)
    g = g.withColumn("e", eigen3(*[f"c{p}" for p in PAIRS])).where((F.col("e.e0") > 0) & (F.col("e.e1") - F.col("e.e2") >= flat * F.col("e.e0")))
    middle = [(F.col(a) + F.col(f"i{a}") * F.lit(size)).alias(a) for a in "xyz"]
    return g.select("scan_id", F.concat_ws("/", *keys).alias("plane"), "n", *middle, "e.nx", "e.ny", "e.nz", F.greatest("e.e2", F.lit(0.0)).alias("spread"))


def matched_planes(planes: DataFrame, poses: DataFrame, pairs: DataFrame, radius: float, degrees: float = 20.0, noise: float = 0.01) -> DataFrame:
    """(a, b, pa, na, pb, nb, weight): for each plane of scan ``a`` the plane of scan ``b`` whose middle is
    nearest, within ``radius`` and ``degrees`` between their normals, for the pairs of scans (a, b) given.

    Points and normals are in the scans' own frames, normals of ``b`` turned to agree with those of ``a``.  The
    weight is one over the variance of their distance: the spread of both over their points, and ``noise``
    squared, which keeps perfect planes finite.  Of equally near planes the one with the smallest name counts.
    """
    at = planes.join(poses.select(F.col("id").alias("scan_id"), "pose"), "scan_id").withColumn("__p", transform("pose", "x", "y", "z"))
    m, n = F.col("pose"), [F.col(f"n{a}") for a in "xyz"]
    turned = F.array(*[m[4 * k] * n[0] + m[4 * k + 1] * n[1] + m[4 * k + 2] * n[2] for k in range(3)])
    own = F.struct(F.array("x", "y", "z").alias("p"), F.array(*n).alias("n"), (F.col("spread") / F.col("n")).alias("v"))
    at = at.select("scan_id", "plane", own.alias("own"), turned.alias("turned"), *[F.col(f"__p.{a}").alias(a) for a in "xyz"])
    pairs = pairs.select("a", "b").distinct()
    side = lambda c: at.join(pairs.withColumn("scan_id", F.col(c)), "scan_id").drop("scan_id")
    near = radius_pairs(side("a"), side("b"), ["x", "y", "z"], radius, ["a", "b"])
    agree = F.aggregate(F.zip_with("l.turned", "r.turned", lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
    near = near.withColumn("agree", agree).where(F.abs("agree") >= float(np.cos(np.radians(degrees))))
    best = near.groupBy(F.col("l.a").alias("a"), F.col("l.b").alias("b"), F.col("l.plane").alias("plane")).agg(F.min_by(F.struct("l", "r", "agree"), F.struct("d", "r.plane")).alias("m"))
    facing = F.transform("m.r.own.n", lambda v: v * F.when(F.col("m.agree") < 0, -1.0).otherwise(1.0))
    weight = 1 / (F.col("m.l.own.v") + F.col("m.r.own.v") + noise * noise)
    return best.select("a", "b", F.col("m.l.own.p").alias("pa"), F.col("m.l.own.n").alias("na"), F.col("m.r.own.p").alias("pb"), facing.alias("nb"), weight.alias("weight"))


def _crossing(v: np.ndarray) -> np.ndarray:
    """For each vector the matrix that crosses with it."""
    o = np.zeros(len(v))
    return np.stack([o, -v[:, 2], v[:, 1], v[:, 2], o, -v[:, 0], -v[:, 1], v[:, 0], o], axis=1).reshape(-1, 3, 3)


def residuals(kind: str, ta: np.ndarray, tb: np.ndarray, pa_: np.ndarray, na: np.ndarray, pb: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Residuals (m, k) of matches, and how they change with small motions of each pose in its own axes
    (m, k, 6): translations, then rotations."""

    def moved(t: np.ndarray, v: np.ndarray, point: bool) -> tuple[np.ndarray, np.ndarray]:
        turn = t[:, :3, :3]
        out = np.einsum("mij,mj->mi", turn, v) + (t[:, :3, 3] if point else 0.0)
        return out, np.concatenate([turn if point else np.zeros_like(turn), -turn @ _crossing(v)], axis=2)

    (xa, dxa), (xb, dxb) = moved(ta, pa_, True), moved(tb, pb, True)
    (ua, dua), (ub, dub) = moved(ta, na, False), moved(tb, nb, False)
    apart = xa - xb
    if kind == "point_to_point":
        return apart, dxa, -dxb
    along = np.einsum("mi,mi->m", ub, apart)
    by_a, by_b = np.einsum("mi,mij->mj", ub, dxa), np.einsum("mi,mij->mj", apart, dub) - np.einsum("mi,mij->mj", ub, dxb)
    if kind == "point_to_plane":
        return along[:, None], by_a[:, None], by_b[:, None]
    if kind == "point_to_projection":
        return along[:, None] * ub, ub[:, :, None] * by_a[:, None], ub[:, :, None] * by_b[:, None] + along[:, None, None] * dub
    if kind == "plane_to_plane":
        # offsets are taken at the middle of the target, so that far from the origin a turn doesn't drown them
        return np.concatenate([ua - ub, along[:, None]], axis=1), np.concatenate([dua, by_a[:, None]], axis=1), np.concatenate([-dub, by_b[:, None]], axis=1)
    raise ValueError(f"no residual is named {kind!r}")


def plane_terms(poses: DataFrame, matches: DataFrame, kind: str = "plane_to_plane") -> DataFrame:
    """Terms (nodes, jac, res, weight) of matches (a, b, pa, na, pb, nb, weight) at the poses (id, pose), each
    with a Cauchy weight by its residual in units of its own deviation."""
    if kind not in KINDS:
        raise ValueError(f"no residual is named {kind!r}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ta, tb = (matrix_of(batch.column(i), 4, 4) for i in (2, 3))
            r, ja, jb = residuals(kind, ta, tb, *(matrix_of(batch.column(i), 3) for i in (4, 5, 6, 7)))
            w = np.asarray(batch.column(8), float)
            w = w / (1 + w * (r * r).sum(axis=1))
            nodes = np.stack([np.asarray(batch.column(0)), np.asarray(batch.column(1))], axis=1)
            lists = lambda v: pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * (v.size // len(v)), pa.int32()), pa.array(v.ravel()))
            yield pa.RecordBatch.from_arrays([lists(nodes), lists(np.stack([ja, jb], axis=1)), lists(-r), pa.array(w)], ["nodes", "jac", "res", "weight"])

    own = lambda c, name: poses.select(F.col("id").alias(c), F.col("pose").alias(name))
    rows = matches.join(own("a", "__a"), "a").join(own("b", "__b"), "b")
    return rows.select("a", "b", "__a", "__b", "pa", "na", "pb", "nb", F.col("weight").cast("double")).mapInArrow(run, TERMS)


def neighbours(poses: DataFrame, reach: float) -> DataFrame:
    """(a, b), a < b, of scans nearer to each other than ``reach``."""
    at = poses.select("id", *[F.col("pose")[i].alias(a) for a, i in zip("xyz", (3, 7, 11))])
    return radius_pairs(at, at, ["x", "y", "z"], reach).where("l.id < r.id").select(F.col("l.id").alias("a"), F.col("r.id").alias("b"))


def register_planes(points: DataFrame, poses: DataFrame, pairs: DataFrame, size: float, radius: float, kind: str = "plane_to_plane", degrees: float = 20.0, noise: float = 0.01, least: int = 10, flat: float = 0.5, fixed: list[int] | None = None, rounds: int = 20, tolerance: float = 1e-8, solve: Callable[[DataFrame, int], DataFrame] = elimination.solution, covariances: bool = False) -> DataFrame:
    """Poses (id, pose) of scans, moved so that the planes of their points (scan_id, x, y, z) fit, for the pairs
    of scans (a, b) given; with ``covariances`` also (covariance), 6 by 6, at the poses found.

    The poses ``fixed`` stay, or the first.  ``solve`` takes a round's summed blocks (conjugate gradients for
    graphs with loops all over).  A scan that no pair names stays where it is, and one that matches nothing too.
    """
    planes = stored(fitted_planes(points, size, least, flat), "planes")
    current = stored(poses.select(F.col("id").cast("long").alias("id"), "pose"), "poses")
    # a weak hold on every pose, so that what no plane decides (sliding along a wall) stays as it was.
    hold = current.select(F.col("id").alias("row"), F.col("id").alias("col"), F.array(*[F.lit(1e-6 if i % 7 == 0 else 0.0) for i in range(36)]).alias("value"))
    hold = stored(hold, "hold")

    def blocks() -> DataFrame:
        terms = plane_terms(current, matched_planes(planes, current, pairs, radius, degrees, noise), kind)
        return sparse.summed(sparse.term_blocks(terms, 6).unionByName(sparse.anchored(current, fixed)).unionByName(hold), 6)

    for _ in range(rounds):
        step = solve(blocks(), 6)
        before, current = current, stored(sparse.moved_poses(current, step), "poses")
        far = step.agg(F.max(F.aggregate("x", F.lit(0.0), lambda s, x: s + F.abs(x)))).first()[0] or 0.0
        for used in (before, step):
            dropped(used)
        if far < tolerance:
            break
    if covariances:
        found = elimination.solution(blocks(), 6, covariances=True).select("id", "covariance")
        current = stored(current.join(found, "id", "left"), "poses")
    for used in (planes, hold):
        dropped(used)
    return current

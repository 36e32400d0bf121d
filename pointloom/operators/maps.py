"""Voxel maps that grow, sampled points, and colouring from images."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.functions import pose as P
from pointloom.functions.camera import Intrinsics, project
from pointloom.functions.geometry import cell, transform
from pointloom.operators.joins import asof_join

PAIRS = ("xx", "xy", "xz", "yy", "yz", "zz")


def voxel_sums(points: DataFrame, size: float, mode: str = "floor") -> DataFrame:
    """A voxel map as sums that can be added: n, sums and sums of products about the voxel's corner
    (which keeps their digits far from the origin)."""
    p = points.withColumns({f"i{a}": cell(a, size, mode) for a in "xyz"})
    p = p.withColumns({f"u{a}": F.col(a) - F.col(f"i{a}") * size for a in "xyz"})
    sums = [F.sum(f"u{a}").alias(f"s{a}") for a in "xyz"] + [F.sum(F.col(f"u{a}") * F.col(f"u{b}")).alias(f"s{a}{b}") for a, b in PAIRS]
    return p.groupBy("ix", "iy", "iz").agg(F.count("*").alias("n"), *sums)


def merged(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two maps of one grid as one; any number of batches may be added in any order."""
    names = ["n", *[f"s{x}" for x in ("x", "y", "z", *PAIRS)]]
    return a.unionByName(b).groupBy("ix", "iy", "iz").agg(*[F.sum(c).alias(c) for c in names])


def voxel_gaussians(sums: DataFrame, size: float, least: int = 5) -> DataFrame:
    """Mean and covariance of each voxel with at least ``least`` points."""
    s = sums.where(F.col("n") >= least)
    n = F.col("n")
    means = [(F.col(f"i{a}") * size + F.col(f"s{a}") / n).alias(f"mean_{a}") for a in "xyz"]
    covs = [(F.col(f"s{a}{b}") / n - F.col(f"s{a}") / n * (F.col(f"s{b}") / n)).alias(f"cov_{a}{b}") for a, b in PAIRS]
    return s.select("ix", "iy", "iz", "n", *means, *covs)


def sampled(points: DataFrame, per_point: int, range_sigma: float, angle_sigma: float, key: str = "id", seed: int = 1) -> DataFrame:
    """Every point replaced by ``per_point`` draws of a scanner's error about it: along the ray from
    the origin and across it. Seeded by the point's key, so a rerun draws the same."""
    schema = points.schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            xyz = pdf[["x", "y", "z"]].to_numpy(float)
            r = np.linalg.norm(xyz, axis=1, keepdims=True)
            ray = xyz / np.where(r > 0, r, 1)
            draws = np.stack([np.random.default_rng([seed, int(k) & 0x7FFFFFFFFFFFFFFF]).normal(size=(per_point, 3)) for k in pdf[key]]) if len(pdf) else np.zeros((0, per_point, 3))
            along = (draws * ray[:, None]).sum(axis=2, keepdims=True) * ray[:, None]
            moved = xyz[:, None] + along * range_sigma + (draws - along) * (angle_sigma * r[:, None])
            out = pdf.loc[pdf.index.repeat(per_point)].copy()
            out[["x", "y", "z"]] = moved.reshape(-1, 3)
            yield out

    return points.mapInPandas(run, schema)


def fewest_cells(points: DataFrame, size: float, offsets: list[tuple[float, float, float]]) -> DataFrame:
    """(offset number, cells) of the grid offset that needs the fewest cells: all are counted in one pass."""
    tries = F.array(*[F.struct(F.lit(i).alias("offset"), *[cell(F.col(a) + o[k], size, "floor").alias(f"i{a}") for k, a in enumerate("xyz")]) for i, o in enumerate(offsets)])
    cells = points.select(F.explode(tries).alias("t")).select("t.*").distinct()
    return cells.groupBy("offset").agg(F.count("*").alias("cells")).orderBy("cells", "offset").limit(1)


def nearest_in_window(rows: DataFrame, series: DataFrame, ts: str, by: list[str], dims: list[str], reach: int = 100, key: str = "id", tie: str = "seq_id") -> DataFrame:
    """For each row the nearest series row, by ``dims``, among those within ``reach`` places of its
    as-of hit (from -reach to +reach - 1).  Places are dealt into runs of ``reach``, so it is an
    equi-join of three runs and no join of all."""
    w = Window.partitionBy(*by).orderBy(ts, tie)
    s = series.withColumn("__rn", F.row_number().over(w))
    hit = asof_join(rows, s.select(*by, ts, "__rn"), ts, ts, by, tie="__rn", prefix="__h_").where("__h___rn is not null")
    runs = lambda c: F.floor(F.col(c) / reach)
    a = hit.withColumn("__run", F.explode(F.array(runs("__h___rn") - 1, runs("__h___rn"), runs("__h___rn") + 1)))
    b = s.select(*by, F.col(tie).alias("__id"), *[F.col(d).alias(f"__{d}") for d in dims], "__rn", runs("__rn").alias("__run"))
    j = a.join(b, [*by, "__run"]).where((F.col("__rn") >= F.col("__h___rn") - reach) & (F.col("__rn") < F.col("__h___rn") + reach))
    d2 = sum(((F.col(d) - F.col(f"__{d}")) * (F.col(d) - F.col(f"__{d}")) for d in dims[1:]), (F.col(dims[0]) - F.col(f"__{dims[0]}")) * (F.col(dims[0]) - F.col(f"__{dims[0]}")))
    best = j.groupBy(key).agg(F.min(F.struct(F.sqrt(d2).alias("d"), F.col("__id").alias("id"))).alias("b"))
    return best.select(key, F.col("b.id").alias("nearest_id"), F.col("b.d").alias("d"))


def seen_by(points: DataFrame, images: DataFrame, camera: Intrinsics, extrinsic: Column, most_gap_ns: int, ts: str = "ts_ns", key: str = "id", nearest_time: bool = True) -> DataFrame:
    """(id, image, u, v, depth): the image that shows each point, among those within ``most_gap_ns``:
    the nearest in time, or the one it is least deep in.

    ``images`` has image, ts_ns and pose (of the platform); ``extrinsic`` is the camera's pose on it.
    Images go to time cells, so a point meets only those of its own moment.
    """
    at = lambda c: F.floor(F.col(c) / F.lit(most_gap_ns))
    i = images.withColumn("__inv", P.inverse(P.product("pose", extrinsic))).select("image", F.col("ts_ns").alias("__its"), "__inv", F.explode(F.array(at("ts_ns") - 1, at("ts_ns"), at("ts_ns") + 1)).alias("__cell"))
    j = points.withColumn("__cell", at(ts)).join(i, "__cell").withColumn("__gap", F.abs(F.col(ts) - F.col("__its"))).where(F.col("__gap") <= most_gap_ns)
    j = j.withColumn("__p", transform("__inv", "x", "y", "z")).withColumn("__uv", project("__p.x", "__p.y", "__p.z", camera)).where("__uv is not null")
    order = F.struct(*([F.col("__gap")] if nearest_time else []), F.col("__uv.depth").alias("depth"), F.col("image"))
    best = j.groupBy(key).agg(F.min_by(F.struct("image", "__uv.u", "__uv.v", "__uv.depth"), order).alias("b"))
    return best.select(key, "b.*")


def noisy_poses(scans: DataFrame, sigma_t: float, sigma_r: float, seed: int = 1) -> DataFrame:
    """Poses moved by a small random motion."""
    noise = P.from_rodrigues(*[F.randn(seed + i) * sigma_t for i in range(3)], *[F.randn(seed + 3 + i) * sigma_r for i in range(3)])
    return scans.withColumn("pose", P.product("pose", noise))


def first_point_moments(points: DataFrame, size: float, order: list[str], view: tuple[str, str, str] | tuple[float, float, float] = (0.0, 0.0, 0.0), start: float = 0.03) -> DataFrame:
    """(ix, iy, iz, n, mean_x.., cov_xx..): voxels as an online map builds them, point after point.

    The first point stays the mean, with covariance ``start``^2 I; point k turns cov into
    cov (k - 1) / k + d d' (k - 1) / k^2, d its offset from the first.  The third point gives the
    surface's normal, turned to the viewpoint; later ones count for cov only if their viewpoint
    (``view``: columns or numbers) is in front of it.  Unrolled, cov is a sum of d d' with weights that
    are running products, so it is windows and one aggregate and no loop over points.
    """
    from pointloom.operators.shape import eigen3

    keys = ["ix", "iy", "iz"]
    w = Window.partitionBy(*keys).orderBy(*order)
    see = [F.col(v) if isinstance(v, str) else F.lit(float(v)) for v in view]
    p = points.withColumns({f"i{a}": cell(a, size) for a in "xyz"} | {f"__v{a}": v for a, v in zip("xyz", see)})
    p = p.withColumn("__k", F.row_number().over(w)).withColumns({f"mean_{a}": F.first(a).over(w) for a in "xyz"})
    p = p.withColumns({f"__d{a}": F.col(a) - F.col(f"mean_{a}") for a in "xyz"}).select(*keys, "__k", *[f"{n}{a}" for n in ("mean_", "__d", "__v") for a in "xyz"])
    k = F.col("__k")
    three = p.where(k <= 3).groupBy(*keys).agg(F.count("*").alias("__n"), *[((start * start * (a == b) + F.sum(F.col(f"__d{a}") * F.col(f"__d{b}") * (k - 1) / k)) / 3).alias(f"c{a}{b}") for a, b in PAIRS], *[F.max_by(f"__v{a}", "__k").alias(f"s{a}") for a in "xyz"], *[F.first(f"mean_{a}").alias(f"m{a}") for a in "xyz"])
    side = F.signum(sum(F.col(f"e.n{a}") * (F.col(f"s{a}") - F.col(f"m{a}")) for a in "xyz"))
    normals = three.where("__n = 3").withColumn("e", eigen3(*[f"c{a}{b}" for a, b in PAIRS])).select(*keys, *[(F.col(f"e.n{a}") * F.when(side < 0, -1.0).otherwise(1.0)).alias(f"__n{a}") for a in "xyz"])
    p = p.join(normals, keys, "left")
    front = sum(F.col(f"__n{a}") * (F.col(f"__v{a}") - F.col(f"mean_{a}")) for a in "xyz") >= 0
    p = p.withColumn("__on", (k <= 3) | F.coalesce(front, F.lit(False)))
    # log of the running product of (k - 1) / k over the points that count
    run = F.sum(F.when(F.col("__on") & (k > 1), F.log((k - 1) / k)).otherwise(0.0)).over(Window.partitionBy(*keys).orderBy("__k").rowsBetween(Window.unboundedPreceding, 0))
    p = p.withColumn("__log", run)
    whole = F.min("__log")
    share = F.when(F.col("__on") & (k > 1), (k - 1) / (k * k) * F.exp(-F.col("__log")))
    sums = p.groupBy(*keys).agg(F.count("*").alias("n"), *[F.first(f"mean_{a}").alias(f"mean_{a}") for a in "xyz"], F.exp(whole).alias("__f"), *[F.coalesce(F.sum(share * F.col(f"__d{a}") * F.col(f"__d{b}")), F.lit(0.0)).alias(f"cov_{a}{b}") for a, b in PAIRS])
    return sums.withColumns({f"cov_{a}{b}": F.col("__f") * (F.lit(start * start * (a == b)) + F.col(f"cov_{a}{b}")) for a, b in PAIRS}).drop("__f")


def ray_hits(points: DataFrame, voxels: DataFrame, size: float, view: tuple[float, float, float] = (0.0, 0.0, 0.0), most: int = 30) -> DataFrame:
    """Adds hits to voxels: how many rays from points to the viewpoint step through them, ``most`` at most.
    Steps are as long as a cell's diagonal and leave out both ends."""
    reach = size * 3**0.5
    away = [F.lit(float(v)) - F.col(a) for a, v in zip("xyz", view)]
    far = F.sqrt(sum((a * a for a in away[1:]), away[0] * away[0]))
    p = points.select("x", "y", "z", far.alias("__far"), *[F.try_divide(a, far).alias(f"__u{n}") for n, a in zip("xyz", away)])
    steps = p.withColumn("__last", (F.ceil(F.col("__far") / reach) - 2).cast("int")).where("__last >= 1").withColumn("__j", F.explode(F.sequence(F.lit(1), F.col("__last"))))
    at = steps.select(*[cell(F.col(a) + F.col(f"__u{a}") * reach * (F.col("__j") + 1), size).alias(f"i{a}") for a in "xyz"])
    hits = at.groupBy("ix", "iy", "iz").agg(F.count("*").alias("hits"))
    return voxels.join(hits, ["ix", "iy", "iz"], "left").withColumn("hits", F.least(F.coalesce("hits", F.lit(0)), F.lit(most)))

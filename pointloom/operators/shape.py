"""Local shape from neighbourhoods: normals, eigenvalue features, ground and poles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointloom.operators.joins import radius_pairs

FEATURES = T.StructType([T.StructField(n, T.DoubleType()) for n in ("e0", "e1", "e2", "nx", "ny", "nz", "lx", "ly", "lz")])


@F.pandas_udf(FEATURES)
def eigen3(xx: pd.Series, xy: pd.Series, xz: pd.Series, yy: pd.Series, yz: pd.Series, zz: pd.Series) -> pd.DataFrame:
    """Of symmetric 3x3 matrices: eigenvalues e0 >= e1 >= e2, the vector of the smallest (normal)
    and of the largest (line), all in one stacked call."""
    m = np.empty((len(xx), 3, 3))
    for (i, j), v in zip(((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)), (xx, xy, xz, yy, yz, zz)):
        m[:, i, j] = m[:, j, i] = v.to_numpy(float)
    ok = np.isfinite(m).all(axis=(1, 2))
    m[~ok] = 0
    w, v = np.linalg.eigh(m)
    n, line = v[:, :, 0], v[:, :, 2]
    n = n * np.where(n[:, 2:] < 0, -1, 1)
    cols = np.column_stack([w[:, ::-1], n, line])
    cols[~ok] = np.nan
    return pd.DataFrame(cols, columns=["e0", "e1", "e2", "nx", "ny", "nz", "lx", "ly", "lz"])


def neighbourhood_features(points: DataFrame, radius: float, key: str, least: int = 3) -> DataFrame:
    """key, n, eigenvalues, normal, and planarity, linearity, sphericity, curvature, omnivariance,
    entropy, verticality of every point with at least ``least`` neighbours within ``radius``
    (itself included)."""
    p = radius_pairs(points.select(key, "x", "y", "z"), points.select(key, "x", "y", "z"), ["x", "y", "z"], radius)
    r = {d: F.col(f"r.{d}") - F.col(f"l.{d}") for d in "xyz"}  # shifted, so that sums keep their digits
    sums = [F.covar_pop(r[a], r[b]).alias(a + b) for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")]
    g = p.groupBy(F.col(f"l.{key}").alias(key)).agg(F.count("*").alias("n"), *sums).where(F.col("n") >= least)
    g = g.withColumn("f", eigen3("xx", "xy", "xz", "yy", "yz", "zz")).select(key, "n", "f.*")
    e = [F.greatest(F.col(f"e{i}"), F.lit(0.0)) for i in range(3)]
    total = e[0] + e[1] + e[2]
    share = [F.try_divide(v, total) for v in e]
    plogp = [F.when(s > 0, -s * F.log(s)).otherwise(0.0) for s in share]
    return g.withColumns(
        {
            "linearity": F.try_divide(e[0] - e[1], e[0]),
            "planarity": F.try_divide(e[1] - e[2], e[0]),
            "sphericity": F.try_divide(e[2], e[0]),
            "curvature": share[2],
            "omnivariance": F.pow(e[0] * e[1] * e[2], 1 / 3),
            "entropy": plogp[0] + plogp[1] + plogp[2],
            "verticality": 1 - F.abs(F.col("nz")),
            "horizontal": F.abs(F.col("nz")) > 0.8,
        }
    )


def poles(features: DataFrame, least_linearity: float = 0.8, least_line_z: float = 0.8) -> DataFrame:
    """Points whose neighbourhood is a line that stands up."""
    return features.where((F.col("linearity") >= least_linearity) & (F.abs(F.col("lz")) >= least_line_z))


def hit_voxels(rays: DataFrame, voxels: DataFrame, size: float, most: int = 30) -> DataFrame:
    """Existing voxels that rays pass on their way, with the number of passes (``most`` at most).

    ``rays`` has ox, oy, oz (origin) and x, y, z (end).  Steps of one voxel, without the end itself.
    """
    d = {a: F.col(a) - F.col(f"o{a}") for a in "xyz"}
    length = F.sqrt(d["x"] * d["x"] + d["y"] * d["y"] + d["z"] * d["z"])
    n = F.floor(length / size).cast("int")
    steps = rays.withColumn("__n", n).where("__n >= 2").withColumn("__j", F.explode(F.sequence(F.lit(1), F.col("__n") - 1)))
    at = {a: F.floor((F.col(f"o{a}") + d[a] * F.col("__j") / F.col("__n")) / size).cast("int").alias(f"i{a}") for a in "xyz"}
    passed = steps.select(*at.values()).groupBy("ix", "iy", "iz").agg(F.count("*").alias("__hits"))
    return voxels.join(passed, ["ix", "iy", "iz"]).withColumn("hits", F.least(F.col("__hits"), F.lit(most)).cast("int")).drop("__hits")


def terrain_grid(points: DataFrame, size: float, margin: float = 1.0) -> DataFrame:
    """(row, col, x, y) lattice over the bounding box and a margin; made from one row of bounds."""
    b = points.agg((F.min("x") - margin).alias("x0"), (F.max("x") + margin).alias("x1"), (F.min("y") - margin).alias("y0"), (F.max("y") + margin).alias("y1"))
    rows = b.withColumn("row", F.explode(F.sequence(F.lit(0), F.floor((F.col("y1") - F.col("y0")) / size).cast("int"))))
    cells = rows.withColumn("col", F.explode(F.sequence(F.lit(0), F.floor((F.col("x1") - F.col("x0")) / size).cast("int"))))
    return cells.select("row", "col", (F.col("x0") + F.col("col") * size).alias("x"), (F.col("y0") + F.col("row") * size).alias("y"))

"""Large collections of point files with a table of what each holds, so that a region is read from few.

The table (a zone map: bounds of place and time, and the number of points, a row a file) is made by one
pass over the files and stored; a region's files are chosen from it, and no other file is opened.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.sources.points import SCHEMA, read_points

BOUNDS = ("x", "y", "z", "ts")


def file_bounds(spark: SparkSession, paths: str | list[str], kind: str = "las", glob: str | None = None) -> DataFrame:
    """(path, n, min_x, max_x, ..., max_ts) of every file that holds points."""
    rows = read_points(spark, paths, kind, glob)
    ends = [f(c).alias(f"{n}_{c}") for c in BOUNDS for f, n in ((F.min, "min"), (F.max, "max"))]
    return rows.groupBy("path").agg(F.count("*").alias("n"), *ends)


def overlapping(bounds: DataFrame, box: dict[str, tuple[float, float]]) -> DataFrame:
    """Files that may hold points of a box: limits (from, to), both included, of any of x, y, z, ts."""
    for c, (low, high) in box.items():
        bounds = bounds.where((F.col(f"max_{c}") >= low) & (F.col(f"min_{c}") <= high))
    return bounds


def read_region(spark: SparkSession, bounds: DataFrame, box: dict[str, tuple[float, float]], kind: str = "las") -> DataFrame:
    """The points of a box, from the files that ``bounds`` says may hold some; the driver sees their names only."""
    files = [r["path"] for r in overlapping(bounds, box).select("path").orderBy("path").collect()]
    if not files:
        return spark.createDataFrame([], SCHEMA)
    rows = read_points(spark, files, kind)
    for c, (low, high) in box.items():
        rows = rows.where(F.col(c).between(low, high))
    return rows


def shifted(points: DataFrame, shift: tuple[float, float, float]) -> DataFrame:
    """Points moved, and colours from 0 to 1, as a sector of a map shows them."""
    moved = {a: F.col(a) + s for a, s in zip("xyz", shift)}
    return points.withColumns(moved | {c: F.col(c) / 65536.0 for c in "rgb"})

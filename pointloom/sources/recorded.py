"""A recorded session from its folder: a point file a scan, and beside it the scan's own trajectory."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.functions.geometry import cell
from pointloom.operators.scans import numbered
from pointloom.sources import text
from pointloom.sources.points import read_points
from pointloom.sources.store import stored


@dataclass
class Session:
    """``points`` (scan_id, path, point_id, x, y, z, ...) less ``offset``; ``nodes`` (scan_id, ts_ns, pose,
    ts_unix_ns, om, fi, ka), the poses of each scan's way; ``scans`` (scan_id, path, points, nodes)."""

    points: DataFrame
    nodes: DataFrame
    scans: DataFrame
    offset: tuple[float, float, float]


def scan_number(path: str | Column) -> Column:
    """The last part of a file's name, by underscores and without its ending, as a number; null if it isn't one."""
    return F.regexp_extract(path, r"(?:^|[/_])(\d+)\.[^./]*$", 1).try_cast("long")


def thinned(points: DataFrame, sizes: tuple[float, float, float]) -> DataFrame:
    """Of each scan's cells (of three lengths) the point with the lowest number."""
    keys = {f"__c{a}": cell(a, size, "floor") for a, size in zip("xyz", sizes)}
    best = points.withColumns(keys).groupBy("scan_id", *keys).agg(F.min_by(F.struct(*points.columns), "point_id").alias("row"))
    return best.select("row.*")


def middle(points: DataFrame, every: int) -> tuple[float, float, float]:
    """The mean of every ``every``-th point of each scan, from its first on; zeros without points."""
    n = numbered(points.select("scan_id", "point_id", "x", "y", "z"), ["scan_id", "point_id"])
    first = n.groupBy("scan_id").agg(F.min("n").alias("__first"))
    row = n.join(first, "scan_id").where((F.col("n") - F.col("__first")) % every == 0).agg(*[F.avg(a).alias(a) for a in "xyz"]).first()  # one row
    return tuple(float(row[a] or 0.0) for a in "xyz")


def load_session(spark: SparkSession, folder: str, kind: str = "las", sizes: tuple[float, float, float] | None = None, centre: bool = False, every: int = 1000, glob: str | None = None, trajectories: str = "trajectory_lio_*.csv") -> Session:
    """A session's scans: point files of ``folder`` (names ending in _number) and trajectories of the same
    numbers, lines of 13, 14 or 17 numbers below a header.

    ``sizes`` thins each scan by itself; ``centre`` takes the mean of every ``every``-th point of each scan as
    the offset that all points lose.  Files whose name has no number are not read into a scan and go; a scan
    without a trajectory has no nodes, and one without points is not in ``scans``.  Rows of a trajectory that
    have another number of parts go.
    """
    points = read_points(spark, folder, kind, glob or f"*.{kind}").withColumn("scan_id", scan_number("path")).where("scan_id is not null")
    if sizes is not None:
        points = thinned(points, sizes)
    points = stored(points, "session")
    offset = middle(points, every) if centre else (0.0, 0.0, 0.0)
    at = folder.rstrip("/")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/{trajectories}")
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    if there:
        nodes = text.trajectory(spark, f"{at}/{trajectories}").withColumn("scan_id", scan_number("path")).where("scan_id is not null")
    else:
        nodes = spark.createDataFrame([], "scan_id long, path string, ts_ns long, pose array<double>, ts_unix_ns long, om double, fi double, ka double")
    nodes = nodes.select("scan_id", "ts_ns", "pose", "ts_unix_ns", "om", "fi", "ka")
    counts = points.groupBy("scan_id").agg(F.min("path").alias("path"), F.count("*").alias("points"))
    scans = counts.join(nodes.groupBy("scan_id").agg(F.count("*").alias("nodes")), "scan_id", "left").fillna(0, ["nodes"])
    moved = points.withColumns({a: F.col(a) - F.lit(o) for a, o in zip("xyz", offset)})
    return Session(moved, nodes, scans, offset)

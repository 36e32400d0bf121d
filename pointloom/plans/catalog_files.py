"""Queries that write files in the formats of the library and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from pointloom.functions import pose
from pointloom.plans.catalog import P_SQL, XYZ, points, table
from pointloom.plans.registry import query
from pointloom.sources import catalogued, sinks, text
from pointloom.sources import points as readers
from pointloom.sources.register import register
from pointloom.sources.store import shared_folder


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


ROUND = ", ".join(f"round({a}, 4) AS {a}" for a in XYZ)


@query(f"{P_SQL} SELECT {ROUND}, id % 65536 AS intensity, label AS scan_id FROM p")
def las_round_trip(spark, sf_dir):
    """LAS files by scan, read back with their intensities."""
    p = points(spark, sf_dir).select(*XYZ, (F.col("id") % 65536).alias("intensity"), (F.col("id") * 0.5).alias("ts"), F.col("label").alias("lidar_id"))
    at = folder(spark, "las")
    sinks.write_las(p, at, "lidar_id")
    back = readers.read_points(spark, at, "las", "*.las")
    return back.select(*[F.round(a, 4).alias(a) for a in XYZ], F.col("intensity").cast("long").alias("intensity"), F.col("user_data").cast("long").alias("scan_id"))


@query(f"{P_SQL}, r AS (SELECT id, label, round(x, 4) AS x, round(y, 4) AS y FROM p) SELECT round(x * 100, 2) AS x, round(y * 100, 2) AS y, label AS lidar_id FROM r WHERE id % 5 > 0 AND sqrt(x * x + y * y) > 0.1 AND sqrt(x * x + y * y) < 0.25 AND label < 6")
def las_scan(spark, sf_dir):
    """A recording, in tenths of a millimetre as LAS files are: rows without a time go, then the annulus, then each
    sensor's calibration (here 100 times)."""
    p = points(spark, sf_dir).select(*XYZ, F.when(F.col("id") % 5 == 0, 0.0).otherwise(1.5).alias("ts"), F.col("label").alias("lidar_id"))
    at = folder(spark, "scan")
    sinks.write_las(p, at)
    big = F.array(*[F.lit(v) for v in (100.0, 0.0, 0.0, 0.0, 0.0, 100.0, 0.0, 0.0, 0.0, 0.0, 100.0, 0.0, 0.0, 0.0, 0.0, 1.0)])
    calibration = spark.range(6).select(F.col("id").alias("lidar_id"), big.alias("pose"))
    got = readers.scan(spark, at, "las", inner=0.1, outer=0.25, calibration=calibration)
    return got.select(F.round("x", 2).alias("x"), F.round("y", 2).alias("y"), F.col("lidar_id").cast("long").alias("lidar_id"))


def _clouds(spark, sf_dir, kind):
    at = folder(spark, kind)
    sinks.write_points(points(spark, sf_dir).select(*XYZ), at, kind)
    return readers.read_points(spark, at, kind, f"*.{kind}").select(*[F.round(a, 6).alias(a) for a in XYZ])


@query(f"{P_SQL} SELECT {', '.join(f'round({a}, 6) AS {a}' for a in XYZ)} FROM p")
def ply_round_trip(spark, sf_dir):
    return _clouds(spark, sf_dir, "ply")


@query(f"{P_SQL} SELECT {', '.join(f'round({a}, 6) AS {a}' for a in XYZ)} FROM p")
def pcd_round_trip(spark, sf_dir):
    return _clouds(spark, sf_dir, "pcd")


@query(f"{P_SQL} SELECT {', '.join(f'round({a}, 6) AS {a}' for a in XYZ)} FROM p")
def text_round_trip(spark, sf_dir):
    at = folder(spark, "xyz")
    sinks.write_points(points(spark, sf_dir).select(*XYZ), at, "txt")
    return text.xyz_text(spark, at).select(*[F.round(a, 6).alias(a) for a in XYZ])


def _track(spark, sf_dir):
    """Orders as a trajectory: a time, a place and a heading."""
    price = F.col("o_totalprice").cast("double") / 1000
    zero = F.lit(0.0)
    return table(spark, sf_dir, "orders").select((F.col("o_orderkey") * 1000).alias("ts_ns"), pose.from_tait_bryan(price, -price, zero, zero, zero, F.col("o_custkey") % 3 * 1.0).alias("pose"))


@query("SELECT o_orderkey * 1000 AS ts_ns, round(o_totalprice::DOUBLE / 1000, 5) AS x, round(-o_totalprice::DOUBLE / 1000, 5) AS y, round(cos(o_custkey % 3), 6) AS c FROM orders")
def trajectory_round_trip(spark, sf_dir):
    at = folder(spark, "trajectory")
    sinks.write_trajectory(_track(spark, sf_dir), at)
    m = F.col("pose")
    return text.trajectory(spark, at).select("ts_ns", F.round(m[3], 5).alias("x"), F.round(m[7], 5).alias("y"), F.round(m[0], 6).alias("c"))


@query("SELECT o_orderkey AS us, round(o_totalprice::DOUBLE / 1000, 5) AS tx, round(cos((o_custkey % 3) / 2.0), 6) AS qw FROM orders")
def tum_round_trip(spark, sf_dir):
    at = folder(spark, "tum")
    sinks.write_tum(_track(spark, sf_dir), at)
    return text.tum(spark, at).select(F.round(F.col("ts") * 1e6).cast("long").alias("us"), F.round("tx", 5).alias("tx"), F.round("qw", 6).alias("qw"))


@query("SELECT n_name AS name, n_nationkey::DOUBLE AS x, n_regionkey::DOUBLE AS z FROM nation")
def pose_list_round_trip(spark, sf_dir):
    zero = F.lit(0.0)
    scans = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("scan_id"), F.col("n_name").alias("name"), pose.from_tait_bryan(F.col("n_nationkey").cast("double"), zero, F.col("n_regionkey").cast("double"), zero, zero, zero).alias("pose"))
    at = folder(spark, "poses")
    one = spark.createDataFrame([(sinks.pose_list_text(scans).rstrip("\n"),)], "value string")  # a few lines a scan
    one.coalesce(1).write.text(at)
    return text.pose_list(spark, at).select("name", F.col("pose")[3].alias("x"), F.col("pose")[11].alias("z"))


@query("SELECT s_name AS name, s_acctbal::DOUBLE AS x, s_suppkey::DOUBLE AS y, 2.5::DOUBLE AS size FROM supplier")
def region_round_trip(spark, sf_dir):
    at = folder(spark, "regions")
    s = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").cast("double").alias("x"), F.col("s_suppkey").cast("double").alias("y"), F.lit(0.0).alias("z"), F.lit(2.5).alias("size"))
    sinks.roi_lines(s, at)
    return sinks.roi_constraints(spark, at).select("name", "x", "y", "size")


@query("SELECT event_id * 1000000 AS lidar_ns, epoch_us(ts) AS unix_ns, round(10 + event_id % 60 / 60.0, 6) AS lat, round(-(20 + event_id % 50 / 60.0), 6) AS lon, (event_id % 7 + 0.5)::DOUBLE AS alt FROM events")
def nmea_file(spark, sf_dir):
    """Stamped sentences written with their checksums, one in a file of its own with a wrong one."""
    from pointloom.functions.nmea import checksum

    k = F.col("event_id")
    body = F.format_string("$GPGGA,120000.00,10%02d.000,N,020%02d.000,W,4,10,0.9,%d.5,M,0.0,M,,", k % 60, k % 50, k % 7)
    e = table(spark, sf_dir, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), body.alias("body"))
    line = lambda off: F.format_string("%d %d %s*%02X", k * 1000000, F.col("us"), F.col("body"), F.pmod(checksum(F.concat("body", F.lit("*00"))) + off, F.lit(256)))
    at = folder(spark, "nmea")
    e.select(line(0)).union(e.where("event_id % 100 = 0").select(line(1))).write.text(at)
    got = text.nmea(spark, at)
    return got.select("lidar_ns", "unix_ns", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "alt")


@query(f"{P_SQL} SELECT round(x, 3) AS x, round(y, 3) AS y, count(*) AS n FROM (SELECT round(x, 4) AS x, round(y, 4) AS y FROM p) WHERE x BETWEEN -0.1 AND 0.25 AND y BETWEEN 0.0 AND 0.3 GROUP BY ALL")
def region_read(spark, sf_dir):
    """Tiles of 0.2 written through the data source, and a region read from those its bounds name."""
    register(spark)
    at = folder(spark, "tiles")
    p = points(spark, sf_dir).select(*[F.round(a, 4).alias(a) for a in XYZ])
    p.repartitionByRange(F.floor(F.col("x") / 0.2), F.floor(F.col("y") / 0.2)).write.format("las").mode("append").save(at)
    bounds = catalogued.file_bounds(spark, at, "las", "*.las")
    got = catalogued.read_region(spark, bounds, {"x": (-0.1, 0.25), "y": (0.0, 0.3)})
    return got.groupBy(F.round(F.round("x", 4), 3).alias("x"), F.round(F.round("y", 4), 3).alias("y")).agg(F.count("*").alias("n"))

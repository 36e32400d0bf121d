"""Regions read from few files, conditions pushed to the reader, and writers that leave nothing half done."""

import os
import random
import struct

import pytest
from pyspark.sql import functions as F

from pointloom.sources import catalogued, points, sinks
from pointloom.sources.register import files_in, register


@pytest.fixture
def tiles(spark, tmp_path):
    """Sixteen tiles of points, a LAS file each."""
    rng = random.Random(1)
    rows = [(t, t % 4 * 10 + rng.randrange(9000) / 1000, t // 4 * 10 + rng.randrange(9000) / 1000, rng.uniform(0, 2), t * 100 + i * 1.0) for t in range(16) for i in range(40)]
    df = spark.createDataFrame(rows, "tile int, x double, y double, z double, ts double")
    where = str(tmp_path / "tiles")
    sinks.write_las(df, where, "tile")
    return where, rows


def test_a_region_opens_only_its_files(spark, tiles):
    where, rows = tiles
    bounds = catalogued.file_bounds(spark, where, "las", "*.las").cache()
    assert bounds.count() == 16 and bounds.agg(F.sum("n")).first()[0] == len(rows)
    box = {"x": (12.0, 24.0), "y": (0.0, 8.0)}
    inside = {r["path"] for r in catalogued.overlapping(bounds, box).collect()}
    assert len(inside) == 2
    for name in os.listdir(where):  # whatever else is opened would fail
        path = os.path.join(where, name)
        if not any(p.endswith(name) for p in inside) and not name.startswith("."):
            os.chmod(path, 0o600)
            open(path, "wb").write(b"broken")
    got = sorted((round(r["x"], 3), round(r["y"], 3)) for r in catalogued.read_region(spark, bounds, box).collect())
    assert got == sorted((round(x, 3), round(y, 3)) for _, x, y, _, _ in rows if 12 <= x <= 24 and y <= 8)
    assert catalogued.read_region(spark, bounds, {"ts": (-5.0, -1.0)}).count() == 0


def test_conditions_reach_the_reader(spark, tiles):
    where, rows = tiles
    register(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = spark.read.format("las").option("pushdown", "true").load(where).where("x > 30 and y < 9.5")
        assert df.rdd.getNumPartitions() == 1
        assert df.count() == sum(x > 30 and y < 9.5 for _, x, y, _, _ in rows)
        assert spark.read.format("las").option("pushdown", "true").load(where).where("x > 1000").count() == 0
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_layout_of_a_las_file_by_hand():
    """Offsets and values of a file as the format's tables state them."""
    data = points.las_bytes(*[points.np.array(v) for v in ([1.5, -2.25], [0.0, 10.0], [3.0, 3.5])], intensity=points.np.array([7, 65535]), ts=points.np.array([0.25, 9.0]), user_data=points.np.array([3, 4]))
    assert data[:4] == b"LASF" and data[24:26] == bytes([1, 2]) and data[104] == 1
    head, size, n = struct.unpack_from("<H", data, 94)[0], struct.unpack_from("<H", data, 105)[0], struct.unpack_from("<I", data, 107)[0]
    start = struct.unpack_from("<I", data, 96)[0]
    assert (head, size, n) == (227, 28, 2) and len(data) == start + 2 * 28
    assert struct.unpack_from("<6d", data, 179) == (1.5, -2.25, 10.0, 0.0, 3.5, 3.0)
    scale, offset = struct.unpack_from("<3d", data, 131), struct.unpack_from("<3d", data, 155)
    x, y, z, intensity = struct.unpack_from("<3iH", data, start + 28)
    assert [round(v * s + o, 6) for v, s, o in zip((x, y, z), scale, offset)] == [-2.25, 10.0, 3.5] and intensity == 65535
    assert data[start + 28 + 17] == 4 and struct.unpack_from("<d", data, start + 28 + 20)[0] == 9.0
    assert points.las_bounds(data[:227])["min_x"] == -2.25 and points.las_bounds(b"x" * 300) is None


@pytest.mark.parametrize("kind", ["las", "ply", "pcd"])
def test_written_points_are_read_again(spark, tmp_path, kind):
    register(spark)
    df = spark.range(1000).select((F.col("id") % 10 / 4).alias("x"), (F.col("id") / 8).alias("y"), F.lit(1.5).alias("z"))
    where = str(tmp_path / "out")
    df.repartition(3).write.format(kind).option("most", 150).mode("append").save(where)
    df.limit(10).write.format(kind).mode("append").save(where)
    assert all(len(points.DECODERS[kind](open(f, "rb").read())["x"]) <= 150 for f in files_in(where, f"*.{kind}"))
    got = spark.read.format(kind).load(where)
    assert got.count() == 1010 and got.where("y < 1.25").count() == 20


def test_a_task_that_fails_leaves_nothing_that_is_read(spark, tmp_path):
    register(spark)
    where = str(tmp_path / "out")
    good = spark.range(100).select(F.col("id").cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    good.write.format("las").mode("append").save(where)
    bad = good.withColumn("z", F.when(F.col("x") == 99, F.raise_error(F.lit("killed")).cast("double")).otherwise(0.0)).repartition(4)
    with pytest.raises(Exception, match="killed"):
        bad.write.format("las").option("most", 5).mode("append").save(where)
    open(f"{where}/points-dead-0.las", "wb").write(b"half a file")
    assert spark.read.format("las").load(where).count() == 100


def test_places_read_as_they_were_written():
    """A file's offset leaves no trace in its coordinates (0.3 at an offset of -1 was 0.30000000000000004, beyond
    a box that ends at 0.3), and halves go away from zero at any offset."""
    v = points.np.array([-0.35, 0.3, -0.1, 0.0001, 12.3456])
    got = points.las_points(points.las_bytes(v, v, v))
    assert got["x"].tolist() == v.tolist() and ((got["y"] >= -0.1) & (got["y"] <= 0.3)).sum() == 3
    half = points.np.array([0.03125, -0.03125])
    assert points.las_points(points.las_bytes(half, half, half))["z"].tolist() == [0.0313, -0.0313]
    odd = points.las_points(points.las_bytes(v, v, v, scale=0.00025))["x"]  # no power of ten: as near as the scale allows
    assert points.np.abs(odd - v).max() <= 0.000125 + 1e-12


def test_a_scan_is_cut_where_its_file_puts_the_points(spark, tmp_path):
    """Points that the file's tenths of a millimetre move onto the annulus' border, or off it."""
    import duckdb

    from pointloom.plans import catalog

    xs = [0.10004, 0.10006, 0.24996, 0.24994, -0.10004, 0.15]
    spark.createDataFrame([(5 * i + 1, [x, 0.0, 0.0], i % 6) for i, x in enumerate(xs)], "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = sorted((r["x"], r["lidar_id"]) for r in catalog.QUERIES["las_scan"](spark, str(tmp_path)).collect())
    assert got == [(10.01, 1), (15.0, 5), (24.99, 3)]
    assert sorted((x, k) for x, _, k in db.execute(catalog.ORACLES["las_scan"]).fetchall()) == got

"""All queries of the library's own operators, over the driver's tables.

Points are the first three components of ``embeddings``; the time series are ``events``.  SQL sits
beside each query that SQL can express.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.functions import camera, geodesy, geometry, nmea, pose, robust
from pointloom.operators import aggregates as A
from pointloom.operators import filters, joins, maps, shape, windows
from pointloom.plans.registry import ORACLES, QUERIES, query
from pointloom.sources import sinks
from pointloom.streaming import messages

__all__ = ["ORACLES", "QUERIES", "flagship"]

XYZ = ["x", "y", "z"]
SIZE = 0.1
P_SQL = "WITH p AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, label FROM embeddings)"
CELLS_SQL = "trunc(x / 0.1)::INT AS ix, trunc(y / 0.1)::INT AS iy, trunc(z / 0.1)::INT AS iz"
E_SQL = "WITH e AS (SELECT event_id, epoch_us(ts) AS us, user_id, event_type, value FROM events)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), *[e[i].cast("double").alias(a) for i, a in enumerate(XYZ)], "label")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select("event_id", us.alias("us"), "user_id", "event_type", "value")


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voxels with count, centroid, covariance, planarity and their lowest point."""
    p = points(spark, sf_dir)
    keys = ["ix", "iy", "iz"]
    m = A.with_cells(p, XYZ, SIZE).groupBy(*keys).agg(*A.moments(XYZ), F.min("id").alias("first_id"))
    e = shape.eigen3(*[f"cov_{a}" for a in ("xx", "xy", "xz", "yy", "yz", "zz")])
    return m.withColumn("e", e).withColumn("planarity", geometry.planarity("e.e0", "e.e1", "e.e2")).drop("e")


# ---- grids -------------------------------------------------------------------------------------


@query(f"{P_SQL} SELECT id, {CELLS_SQL} FROM p")
def voxel_key(spark, sf_dir):
    return A.with_cells(points(spark, sf_dir), XYZ, SIZE).select("id", "ix", "iy", "iz")


@query(f"{P_SQL}, k AS (SELECT id, {CELLS_SQL} FROM p) SELECT id, ((ix & 65535)::BIGINT << 32) | ((iy & 65535)::BIGINT << 16) | (iz & 65535)::BIGINT AS key FROM k")
def voxel_packed_key(spark, sf_dir):
    k = A.with_cells(points(spark, sf_dir), XYZ, SIZE)
    return k.select("id", geometry.packed_key("ix", "iy", "iz").alias("key"))


@query(f"{P_SQL}, k AS (SELECT *, {CELLS_SQL} FROM p) SELECT ix, iy, iz, min(id) AS id FROM k GROUP BY ALL")
def voxel_decimate(spark, sf_dir):
    return A.decimate(points(spark, sf_dir), XYZ, SIZE, "id").select("ix", "iy", "iz", "id")


MOMENTS_SQL = "count(*) AS n, " + ", ".join(f"round(avg({a}), 6) AS mean_{a}" for a in XYZ) + ", " + ", ".join(f"round(covar_pop({a}, {b}), 6) AS cov_{a}{b}" for a, b in ("xx", "xy", "xz", "yy", "yz", "zz"))
MOMENT_NAMES = [f"mean_{a}" for a in XYZ] + [f"cov_{a}" for a in ("xx", "xy", "xz", "yy", "yz", "zz")]


@query(f"{P_SQL}, k AS (SELECT *, {CELLS_SQL} FROM p) SELECT ix, iy, iz, {MOMENTS_SQL} FROM k GROUP BY ix, iy, iz HAVING count(*) >= 5")
def voxel_moments(spark, sf_dir):
    return rounded(A.voxel_moments(points(spark, sf_dir), XYZ, SIZE, 5), *MOMENT_NAMES)


@query(f"{P_SQL} SELECT count(*) AS n, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z FROM p")
def bbox_dims(spark, sf_dir):
    return A.bounds(points(spark, sf_dir), XYZ)


GRID = ", ".join(f"min({a}) - 1 AS min_{a}, max({a}) + 1 AS max_{a}" for a in XYZ)
GRID_N = ", ".join(f"(floor((max_{a} - min_{a}) / 0.1) + 1)::BIGINT AS n_{a}" for a in XYZ)


@query(f"{P_SQL}, b AS (SELECT {GRID} FROM p), n AS (SELECT *, {GRID_N} FROM b) SELECT *, n_x * n_y * n_z AS n_buckets FROM n")
def grid_params(spark, sf_dir):
    return A.grid_params(points(spark, sf_dir), XYZ, SIZE, 1.0)


def _level_sql(name: str, size: float) -> str:
    return f"SELECT '{name}' AS level, trunc(x / {size})::INT AS ix, trunc(y / {size})::INT AS iy, trunc(z / {size})::INT AS iz, count(*) AS n, round(avg(x), 6) AS mean_x, round(avg(y), 6) AS mean_y, round(avg(z), 6) AS mean_z FROM p GROUP BY 1, 2, 3, 4"


@query(f"{P_SQL} {_level_sql('indoor', 0.1)} UNION ALL {_level_sql('outdoor', 0.3)}")
def two_level_grid(spark, sf_dir):
    return rounded(A.levels(points(spark, sf_dir), XYZ, {"indoor": 0.1, "outdoor": 0.3}), "mean_x", "mean_y", "mean_z")


@query(
    f"""{P_SQL}, k AS (SELECT trunc(x / 0.3)::INT AS cx, trunc(y / 0.3)::INT AS cy, trunc(z / 0.3)::INT AS cz, {CELLS_SQL} FROM p),
    f AS (SELECT cx, cy, cz, ix, iy, iz, count(*) AS n FROM k GROUP BY ALL)
    SELECT * FROM (SELECT *, (sum(n) OVER (PARTITION BY cx, cy, cz))::BIGINT AS n_coarse FROM f) WHERE n_coarse > 20"""
)
def coarse_to_fine(spark, sf_dir):
    return A.coarse_to_fine(points(spark, sf_dir), XYZ, 0.3, 0.1, 20)


@query(f"{P_SQL} SELECT trunc(x / 0.1)::INT AS ix, trunc(y / 0.1)::INT AS iy, arg_min(id, z) AS id, min(z) AS z FROM p GROUP BY 1, 2")
def lowest_per_cell(spark, sf_dir):
    return A.lowest_per_cell(points(spark, sf_dir), SIZE, "id")


@query(f"{P_SQL} SELECT trunc(x / 0.02)::INT AS bin, count(*) AS n FROM p GROUP BY 1")
def histogram_bins(spark, sf_dir):
    return A.histogram(points(spark, sf_dir), "x", 0.02)


@query(f"{P_SQL}, h AS (SELECT trunc(x / 0.02)::INT AS bin, count(*) AS n FROM p GROUP BY 1) SELECT round(sum(bin * 0.02 * n) / sum(n), 6) AS mean, round(sqrt(sum(bin * 0.02 * bin * 0.02 * n) / sum(n) - (sum(bin * 0.02 * n) / sum(n)) ** 2), 6) AS std FROM h")
def histogram_stats(spark, sf_dir):
    return rounded(A.histogram_stats(A.histogram(points(spark, sf_dir), "x", 0.02), 0.02), "mean", "std")


@query(f"{P_SQL}, k AS (SELECT trunc(x / 0.1)::INT AS ix, trunc(y / 0.1)::INT AS iy, z FROM p) SELECT ix, iy, count(*) AS n, round(avg(z), 6) AS mean_z, round(stddev_pop(z), 6) AS sigma_z FROM k GROUP BY ix, iy HAVING count(*) >= 10 AND stddev_pop(z) < 0.2")
def consistent_ground(spark, sf_dir):
    k = A.with_cells(points(spark, sf_dir), ["x", "y"], SIZE)
    return rounded(A.consistent_ground(k, ["ix", "iy"], "z", 10, 0.2), "mean_z", "sigma_z")


JAC = {"j0": "1.0", "j1": "x", "j2": "y"}
NORMAL_SQL = ", ".join(f"round(sum(j{i} * j{j}), 6) AS ata_{i}{j}" for i in range(3) for j in range(i, 3)) + ", " + ", ".join(f"round(sum(j{i} * z), 6) AS atb_{i}" for i in range(3)) + ", round(sum(z * z), 6) AS rtr"


@query(f"{P_SQL}, j AS (SELECT label, 1.0::DOUBLE AS j0, x AS j1, y AS j2, z FROM p) SELECT label, count(*) AS n, {NORMAL_SQL} FROM j GROUP BY label")
def normal_eq_sums(spark, sf_dir):
    rows = points(spark, sf_dir).withColumns({"j0": F.lit(1.0), "j1": F.col("x"), "j2": F.col("y")})
    out = A.normal_equations(rows, ["j0", "j1", "j2"], "z", ["label"])
    return rounded(out, *[c for c in out.columns if c.startswith(("at", "rt"))])


@query(f"{P_SQL} SELECT label, round(coalesce(sqrt(avg(x * x + y * y)), -1), 6) AS rms, count(*) AS n FROM p GROUP BY label")
def obs_rms(spark, sf_dir):
    return rounded(A.rms(points(spark, sf_dir), ["x", "y"], ["label"]), "rms")


@query(f"{P_SQL} SELECT DISTINCT {CELLS_SQL} FROM p")
def distinct_cells(spark, sf_dir):
    return A.with_cells(points(spark, sf_dir), XYZ, SIZE).select("ix", "iy", "iz").distinct()


@query(f"{P_SQL}, k AS (SELECT id, trunc(x / 0.1)::INT AS ix FROM p) SELECT id, (dense_rank() OVER (ORDER BY ix) - 1)::INT AS nth FROM k")
def dense_index(spark, sf_dir):
    k = A.with_cells(points(spark, sf_dir), ["x"], SIZE)
    return A.dense_index(k, "ix", "nth").select("id", F.col("nth").cast("int").alias("nth"))


# ---- filters and geometry ----------------------------------------------------------------------


@query(f"{P_SQL} SELECT id FROM p WHERE sqrt(x * x + y * y) > 0.1 AND sqrt(x * x + y * y) < 0.25")
def annulus_filter(spark, sf_dir):
    return filters.annulus(points(spark, sf_dir), 0.1, 0.25).select("id")


@query(f"{P_SQL} SELECT id FROM p WHERE x * x + y * y + z * z BETWEEN 0.01 AND 0.0625")
def range_gate(spark, sf_dir):
    return filters.range_gate(points(spark, sf_dir), 0.25, 0.1).select("id")


@query(f"{P_SQL} SELECT id, round(sqrt(x * x + y * y + z * z), 6) AS r, round(atan2(y, x), 6) AS polar, round(acos(z / sqrt(x * x + y * y + z * z)), 6) AS azimuth FROM p WHERE x * x + y * y + z * z > 0")
def spherical(spark, sf_dir):
    s = points(spark, sf_dir).select("id", geometry.spherical("x", "y", "z").alias("s")).where("s is not null").select("id", "s.*")
    return rounded(s, "r", "polar", "azimuth")


@query(f"{P_SQL} SELECT id FROM p WHERE abs(x) < 0.05 OR abs(z) < 0.02")
def axis_slabs(spark, sf_dir):
    return filters.slabs(points(spark, sf_dir), {"x": 0.05, "z": 0.02}).select("id")


@query(f"{P_SQL} SELECT id FROM p WHERE abs((x - 0.02) * cos(0.3) + (y - 0.01) * sin(0.3)) < 0.1 AND abs(-(x - 0.02) * sin(0.3) + (y - 0.01) * cos(0.3)) < 0.15 AND abs(z) < 0.2")
def oriented_box(spark, sf_dir):
    box = pose.from_tait_bryan(F.lit(0.02), F.lit(0.01), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.3))
    return points(spark, sf_dir).where(filters.in_box(box, (0.2, 0.3, 0.4))).select("id")


@query(f"{P_SQL}, b AS (SELECT min(x) ax, max(x) bx, min(y) ay, max(y) by_, min(z) az, max(z) bz FROM p WHERE label = 0) SELECT id FROM p, b WHERE label <> 0 AND x > ax AND x < bx AND y > ay AND y < by_ AND z > az AND z < bz")
def bbox_crop(spark, sf_dir):
    p = points(spark, sf_dir)
    return filters.crop(p.where("label <> 0"), p.where("label = 0"), XYZ).select("id")


@query(f"{P_SQL}, g AS (SELECT trunc(x / 0.1)::INT ix, trunc(y / 0.1)::INT iy, min(z) gz FROM p WHERE label < 5 GROUP BY 1, 2) SELECT id FROM p LEFT JOIN g ON trunc(x / 0.1)::INT = ix AND trunc(y / 0.1)::INT = iy WHERE gz IS NULL OR z BETWEEN gz + 0.05 AND gz + 0.2")
def ground_band(spark, sf_dir):
    p = points(spark, sf_dir)
    ground = A.lowest_per_cell(p.where("label < 5"), SIZE, "id").withColumnRenamed("z", "ground_z")
    return filters.ground_band(p, ground, SIZE, 0.05, 0.2).select("id")


@query(f"{P_SQL}, m AS (SELECT avg(x) mx, avg(y) my, avg(z) mz FROM p) SELECT id, round(x - mx, 6) AS x, round(y - my, 6) AS y, round(z - mz, 6) AS z FROM p, m")
def recentre(spark, sf_dir):
    return rounded(filters.recentred(points(spark, sf_dir), XYZ).select("id", *XYZ), *XYZ)


@query(f"{P_SQL} SELECT id, round(x * cos(0.3) - y * sin(0.3) + 1, 6) AS x, round(x * sin(0.3) + y * cos(0.3) + 2, 6) AS y, round(z + 3, 6) AS z FROM p")
def rigid_transform(spark, sf_dir):
    m = pose.from_tait_bryan(F.lit(1.0), F.lit(2.0), F.lit(3.0), F.lit(0.0), F.lit(0.0), F.lit(0.3))
    out = points(spark, sf_dir).select("id", geometry.transform(m, "x", "y", "z").alias("t")).select("id", "t.*")
    return rounded(out, *XYZ)


@query("SELECT n_nationkey, n_name FROM nation WHERE n_name NOT IN (SELECT n_name FROM nation WHERE n_regionkey = 1)")
def blacklist_anti(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return filters.without(n, n.where("n_regionkey = 1"), "n_name").select("n_nationkey", "n_name")


# ---- distance joins ----------------------------------------------------------------------------

D_SQL = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))"


@query(f"{P_SQL}, d AS (SELECT a.id, b.id AS nn_id, {D_SQL} AS d FROM p a JOIN p b ON a.label % 2 = 0 AND b.label % 2 = 1 AND {D_SQL} <= 0.08) SELECT id, nn_id, round(d, 6) AS d FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY d.d, nn_id) = 1")
def radius_nn(spark, sf_dir):
    p = points(spark, sf_dir)
    return rounded(joins.nearest_within(p.where("label % 2 = 0"), p.where("label % 2 = 1"), XYZ, 0.08, "id", "id"), "d")


@query(f"{P_SQL} SELECT a.id AS a, b.id AS b, round({D_SQL}, 6) AS d FROM p a JOIN p b ON a.label = 0 AND b.label = 1 AND {D_SQL} <= 0.1")
def radius_pairs(spark, sf_dir):
    p = points(spark, sf_dir)
    out = joins.radius_pairs(p.where("label = 0"), p.where("label = 1"), XYZ, 0.1)
    return rounded(out.select(F.col("l.id").alias("a"), F.col("r.id").alias("b"), "d"), "d")


@query(f"{P_SQL} SELECT a.id AS a, b.id AS b, round({D_SQL}, 6) AS d FROM p a JOIN p b ON a.label < b.label AND {D_SQL} < 0.03")
def closure_candidates(spark, sf_dir):
    return rounded(joins.self_pairs(points(spark, sf_dir), XYZ, 0.03, "id", "label"), "d")


@query(f"{P_SQL} SELECT a.id, count(*) AS n, round(covar_pop(b.x, b.x), 6) AS xx, round(covar_pop(b.y, b.y), 6) AS yy, round(covar_pop(b.z, b.z), 6) AS zz FROM p a JOIN p b ON {D_SQL} <= 0.06 GROUP BY a.id HAVING count(*) >= 3")
def neighbour_spread(spark, sf_dir):
    p = points(spark, sf_dir)
    near = joins.radius_pairs(p, p, XYZ, 0.06)
    spread = [F.round(F.covar_pop(F.col(f"r.{a}"), F.col(f"r.{a}")), 6).alias(a + a) for a in XYZ]
    return near.groupBy(F.col("l.id").alias("id")).agg(F.count("*").alias("n"), *spread).where("n >= 3")


@query()
def shape_features(spark, sf_dir):
    return shape.neighbourhood_features(points(spark, sf_dir), 0.06, "id")


@query("SELECT l_orderkey, l_linenumber, s_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey")
def calibration_join(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    return joins.required_join(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey"), s, "l_suppkey").select("l_orderkey", "l_linenumber", "s_name")


# ---- time joins --------------------------------------------------------------------------------


def _clicks(spark, sf_dir):
    e = events(spark, sf_dir)
    return e.where("event_id % 2 = 0").select("event_id", "us", "user_id"), e.where("event_id % 2 = 1").select("event_id", "us", "user_id", "value")


LR_SQL = f"{E_SQL}, l AS (SELECT event_id, us, user_id FROM e WHERE event_id % 2 = 0), r AS (SELECT us, user_id, max(event_id) AS hi, min(event_id) AS lo FROM e WHERE event_id % 2 = 1 GROUP BY us, user_id)"


@query(f"{LR_SQL} SELECT l.event_id, r.hi AS r_event_id, r.us AS r_us FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.us >= r.us")
def asof_backward(spark, sf_dir):
    left, r = _clicks(spark, sf_dir)
    return joins.asof_join(left, r, "us", "us", ["user_id"], tie="event_id").select("event_id", "r_event_id", "r_us")


@query(f"{LR_SQL} SELECT l.event_id, r.hi AS r_event_id FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.us > r.us")
def asof_backward_strict(spark, sf_dir):
    left, r = _clicks(spark, sf_dir)
    return joins.asof_join(left, r, "us", "us", ["user_id"], strict=True, tie="event_id").select("event_id", "r_event_id")


@query(f"{LR_SQL} SELECT l.event_id, r.hi AS r_event_id FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.us >= r.us")
def asof_bucketed(spark, sf_dir):
    left, r = _clicks(spark, sf_dir)
    return joins.asof_join(left, r, "us", "us", ["user_id"], tie="event_id", bucket=3 * 86_400e6).select("event_id", "r_event_id")


@query(f"{LR_SQL} SELECT l.event_id, r.lo AS r_event_id FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.us <= r.us")
def asof_forward(spark, sf_dir):
    left, r = _clicks(spark, sf_dir)
    return joins.asof_join(left, r, "us", "us", ["user_id"], "forward", tie="event_id").select("event_id", "r_event_id")


@query(
    f"""{LR_SQL}, b AS (SELECT l.event_id, l.us, r.us AS bus FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.us >= r.us),
    f AS (SELECT l.event_id, r.us AS fus FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.us <= r.us)
    SELECT event_id, CASE WHEN bus IS NULL OR us - bus > 7200000000 THEN CASE WHEN fus - us <= 7200000000 THEN fus END
      WHEN fus IS NULL OR fus - us > 7200000000 OR us - bus <= fus - us THEN bus ELSE fus END AS r_us FROM b JOIN f USING (event_id)"""
)
def asof_nearest_tol(spark, sf_dir):
    left, r = _clicks(spark, sf_dir)
    return joins.asof_join(left, r, "us", "us", ["user_id"], "nearest", tolerance=7_200_000_000, tie="event_id").select("event_id", "r_us")


@query(
    f"""{E_SQL}, o AS (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) - 1) // 20 AS batch FROM e),
    s AS (SELECT user_id, batch, min(us) AS start_us, max(us) AS end_us FROM o GROUP BY 1, 2 HAVING count(*) >= 20)
    SELECT e.event_id, s.batch FROM e JOIN s ON e.user_id = s.user_id AND e.us >= s.start_us AND e.us < s.end_us"""
)
def interval_slice(spark, sf_dir):
    e = events(spark, sf_dir)
    b = windows.batches(e, ["user_id"], ["us", "event_id"], 20).groupBy("user_id", "batch").agg(F.min("us").alias("start_us"), F.max("us").alias("end_us"))
    return joins.interval_join(e, b, "us", "start_us", "end_us", ["user_id"]).select("event_id", "batch")


@query(f"{E_SQL}, h AS (SELECT user_id, us AS a, us + 3600000000 AS b, event_id AS span FROM e WHERE event_type = (SELECT min(event_type) FROM e)) SELECT e.event_id, h.span FROM e JOIN h ON e.user_id = h.user_id AND e.us >= h.a AND e.us < h.b")
def range_join(spark, sf_dir):
    e = events(spark, sf_dir)
    first = e.agg(F.min("event_type").alias("event_type"))
    h = e.join(F.broadcast(first), "event_type").select("user_id", F.col("us").alias("a"), (F.col("us") + 3_600_000_000).alias("b"), F.col("event_id").alias("span"))
    return joins.range_join(e.select("event_id", "us", "user_id"), h, "us", "a", "b", 3.6e9, ["user_id"]).select("event_id", "span")


@query(
    f"""{E_SQL}, s AS (SELECT user_id, us, avg(value) AS value FROM e WHERE event_id % 2 = 1 GROUP BY 1, 2), q AS (SELECT event_id, us, user_id FROM e WHERE event_id % 2 = 0),
    b AS (SELECT q.*, s.us AS a, s.value AS va FROM q ASOF LEFT JOIN s ON q.user_id = s.user_id AND q.us >= s.us),
    f AS (SELECT b.*, s.us AS z, s.value AS vz FROM b ASOF LEFT JOIN s ON b.user_id = s.user_id AND b.us <= s.us)
    SELECT event_id, round(CASE WHEN a = z THEN va ELSE va + (vz - va) * ((us - a)::DOUBLE / nullif(z - a, 0)::DOUBLE) END, 6) AS value FROM f"""
)
def interp_value(spark, sf_dir):
    q, s = _clicks(spark, sf_dir)
    s = s.groupBy("user_id", "us").agg(F.avg("value").alias("value"))
    return rounded(joins.interpolated(q, s, "us", "us", "value", ["user_id"]).select("event_id", "value"), "value")


@query(
    f"""{E_SQL}, s AS (SELECT user_id, us, avg(value) AS value FROM e WHERE event_id % 2 = 1 GROUP BY 1, 2), q AS (SELECT event_id, us, user_id, value AS own FROM e WHERE event_id % 2 = 0),
    b AS (SELECT q.*, s.us AS a, s.value AS va FROM q ASOF JOIN s ON q.user_id = s.user_id AND q.us >= s.us),
    f AS (SELECT b.*, s.us AS z, s.value AS vz FROM b ASOF JOIN s ON b.user_id = s.user_id AND b.us <= s.us),
    d AS (SELECT user_id, abs(own - CASE WHEN a = z THEN va ELSE va + (vz - va) * ((us - a)::DOUBLE / nullif(z - a, 0)::DOUBLE) END) AS err FROM f)
    SELECT user_id, count(*) AS n, round(avg(err), 6) AS ate_avg, round(min(err), 6) AS ate_min, round(max(err), 6) AS ate_max FROM d GROUP BY user_id"""
)
def ate_metrics(spark, sf_dir):
    e = events(spark, sf_dir)
    s = e.where("event_id % 2 = 1").groupBy("user_id", "us").agg(F.avg("value").alias("truth"))
    q = e.where("event_id % 2 = 0").select("event_id", "us", "user_id", "value")
    err = joins.interpolated(q, s, "us", "us", "truth", ["user_id"]).where("truth is not null").select("user_id", F.abs(F.col("value") - F.col("truth")).alias("err"))
    out = err.groupBy("user_id").agg(F.count("*").alias("n"), F.avg("err").alias("ate_avg"), F.min("err").alias("ate_min"), F.max("err").alias("ate_max"))
    return rounded(out, "ate_avg", "ate_min", "ate_max")


# ---- windows -----------------------------------------------------------------------------------


@query(f"{E_SQL}, o AS (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) - 1) // 20 AS batch FROM e) SELECT user_id, event_id, batch FROM o QUALIFY count(*) OVER (PARTITION BY user_id, batch) >= 20")
def batch20(spark, sf_dir):
    return windows.batches(events(spark, sf_dir), ["user_id"], ["us", "event_id"], 20).select("user_id", "event_id", "batch")


@query(f"{E_SQL} SELECT user_id, event_id, us - lag(us) OVER w AS d_us, round(value - lag(value) OVER w, 6) AS d_value FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id) QUALIFY row_number() OVER w > 1")
def motion_edges(spark, sf_dir):
    out = windows.motion_edges(events(spark, sf_dir), ["user_id"], ["us", "event_id"], ["us", "value"])
    return rounded(out.select("user_id", "event_id", "d_us", "d_value"), "d_value")


@query(
    f"""WITH RECURSIVE e AS (SELECT event_id, epoch_us(ts) AS us, user_id, value FROM events),
    s AS (SELECT *, floor(coalesce(abs(value - lag(value) OVER w), 0) / 1e-9 + 0.5)::BIGINT AS step, row_number() OVER w AS rn FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
    walk AS (
      SELECT *, 0::BIGINT AS segment, 0::BIGINT AS gone FROM s WHERE rn = 1
      UNION ALL
      SELECT s.*, walk.segment + (walk.gone + s.step > 500000000000)::BIGINT, CASE WHEN walk.gone + s.step > 500000000000 THEN 0 ELSE walk.gone + s.step END
      FROM walk JOIN s ON s.user_id = walk.user_id AND s.rn = walk.rn + 1)
    SELECT user_id, us, event_id, value, segment FROM walk"""
)
def segment_by_distance(spark, sf_dir):
    """A user's events cut where over 500 of value are travelled; paths are whole billionths, so both sides add them exactly."""
    return windows.greedy_segments(events(spark, sf_dir).select("user_id", "us", "event_id", "value"), ["user_id"], ["us", "event_id"], ["value"], 500.0)


@query("SELECT o_custkey, o_orderkey, round(coalesce(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 2) AS before FROM orders")
def cum_offset(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    out = windows.cumulative_offset(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice", "before")
    return out.select("o_custkey", "o_orderkey", F.round("before", 2).alias("before"))


@query(f"{E_SQL}, s AS (SELECT user_id, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY us, event_id)) AS d FROM e) SELECT user_id, count(*) AS n, round(coalesce(sum(d), 0), 6) AS length FROM s GROUP BY user_id")
def traj_length(spark, sf_dir):
    return rounded(windows.path_length(events(spark, sf_dir), ["user_id"], ["us", "event_id"], ["value"]), "length")


@query(f"{E_SQL}, s AS (SELECT *, us / 1e6 AS sec FROM e), d AS (SELECT user_id, event_id, value, sec - lag(sec) OVER w AS gap FROM s WINDOW w AS (PARTITION BY user_id ORDER BY sec, event_id)) SELECT user_id, round(sum(value * CASE WHEN gap > 0 THEN least(gap, 60) ELSE 0 END), 4) AS total FROM d GROUP BY user_id")
def integrate_euler(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("sec", F.col("us") / 1e6)
    out = windows.integrated(e, ["user_id"], "sec", "value", "euler", 60.0)
    return out.groupBy("user_id").agg(F.round(F.sum(F.col("value") * F.col("dt")), 4).alias("total"))


@query(f"{E_SQL}, f AS (SELECT value FROM e ORDER BY us, event_id LIMIT 1000) SELECT list_sort(list(value))[len(list(value)) // 2 + 1] AS median, count(*) AS n FROM f")
def median_first_n(spark, sf_dir):
    return A.upper_median_of_first(events(spark, sf_dir), "value", ["us", "event_id"], 1000)


@query(f"{E_SQL} SELECT user_id, round(coalesce((max(us) - min(us))::DOUBLE / nullif(count(us) - 1, 0), 0.005), 3) AS period FROM e GROUP BY user_id")
def sample_period(spark, sf_dir):
    return A.sample_period(events(spark, sf_dir), "us", ["user_id"]).select("user_id", F.round("period", 3).alias("period"))


@query(f"{E_SQL}, w AS (SELECT *, value > 50 AS ins, lag(value > 50) OVER (PARTITION BY user_id ORDER BY us, event_id) AS was FROM e) SELECT user_id, event_id FROM w WHERE coalesce(ins, false) AND NOT coalesce(was, false)")
def roi_entries(spark, sf_dir):
    return windows.entries(events(spark, sf_dir), ["user_id"], ["us", "event_id"], F.col("value") > 50).select("user_id", "event_id")


@query(f"{E_SQL} SELECT user_id, event_id FROM e QUALIFY (row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) - 1) % 7 = 0")
def modulo_decimate(spark, sf_dir):
    return windows.every_nth(events(spark, sf_dir), ["user_id"], ["us", "event_id"], 7).select("user_id", "event_id")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_windows(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    out = messages.tumbling(e, "ts", "1 day", ["event_type"])
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


# ---- functions ---------------------------------------------------------------------------------

R_SQL = "((l_extendedprice - 30000) / 10000)"


@query(
    f"""SELECT l_orderkey, l_linenumber, round(CASE WHEN abs(r) <= 1.345 THEN 1 ELSE 1.345 / abs(r) END, 6) AS huber,
    round(1 / (1 + r * r / (2.3849 * 2.3849)), 6) AS cauchy, round(exp(-r * r / (2.9846 * 2.9846)), 6) AS welsch,
    round(CASE WHEN abs(r) <= 4.6851 THEN (1 - r * r / (4.6851 * 4.6851)) ** 2 ELSE 0 END, 6) AS tukey,
    round(1 / (1 + abs(r) / 1.3998), 6) AS fair, round(1 / ((1 + r * r) * (1 + r * r)), 6) AS geman, round(1 / sqrt(1 + r * r / 2), 6) AS l1l2
    FROM (SELECT l_orderkey, l_linenumber, {R_SQL} AS r FROM lineitem)"""
)
def robust_weights(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", ((F.col("l_extendedprice") - 30000) / 10000).alias("r"))
    return rows.select("l_orderkey", "l_linenumber", *[F.round(robust.estimator(n, "r")[2], 6).alias(n) for n in ("huber", "cauchy", "welsch", "tukey", "fair", "geman", "l1l2")])


@query(
    """WITH f AS (SELECT c_custkey, string_split('$GPGGA,' || lpad((c_custkey % 24)::VARCHAR, 2, '0') || '0000,' || printf('%02d%02d.%03d', (c_custkey * 7) % 90, c_custkey % 60, (c_custkey * 13) % 1000) || CASE WHEN c_nationkey % 2 = 0 THEN ',N,' ELSE ',S,' END
      || printf('%03d%02d.%03d', (c_custkey * 11) % 180, (c_custkey * 3) % 60, (c_custkey * 17) % 1000) || CASE WHEN c_nationkey % 3 = 0 THEN ',E,' ELSE ',W,' END || '1,09,1.1,' || c_acctbal::VARCHAR || ',M,0,M,,', ',') AS p FROM customer),
    n AS (SELECT c_custkey, p[3]::DOUBLE AS a, p[5]::DOUBLE AS o, p[4] AS ns, p[6] AS ew, p[10]::DOUBLE AS alt FROM f)
    SELECT c_custkey, round(CASE ns WHEN 'S' THEN -1 ELSE 1 END * (floor(a / 100) + (a % 100) / 60), 6) AS lat, round(CASE ew WHEN 'W' THEN -1 ELSE 1 END * (floor(o / 100) + (o % 100) / 60), 6) AS lon, alt, -1.0::DOUBLE AS age FROM n"""
)
def nmea_parse(spark, sf_dir):
    """Sentences made of every customer's numbers, taken apart again."""
    k = F.col("c_custkey")
    lat = F.format_string("%02d%02d.%03d", (k * 7) % 90, k % 60, (k * 13) % 1000)
    lon = F.format_string("%03d%02d.%03d", (k * 11) % 180, (k * 3) % 60, (k * 17) % 1000)
    side = lambda by, a, b: F.when(F.col("c_nationkey") % by == 0, a).otherwise(b)
    time = F.concat(F.lpad((k % 24).cast("string"), 2, "0"), F.lit("0000"))
    body = F.concat_ws(",", F.lit("$GPGGA"), time, lat, side(2, "N", "S"), lon, side(3, "E", "W"), F.lit("1,09,1.1"), F.col("c_acctbal").cast("string"), F.lit("M,0,M,,*"))
    g = table(spark, sf_dir, "customer").select("c_custkey", nmea.gga(body).alias("g"))
    return rounded(g.select("c_custkey", "g.lat", "g.lon", "g.alt", "g.age"), "lat", "lon")


@query("SELECT c_custkey, round(6378137 * radians((c_custkey % 360) - 180), 3) AS x, round(6378137 * atanh(sin(radians((c_custkey % 160) - 80))), 3) AS y FROM customer")
def web_mercator(spark, sf_dir):
    k = F.col("c_custkey")
    m = table(spark, sf_dir, "customer").select("c_custkey", geodesy.web_mercator(k % 160 - 80, k % 360 - 180).alias("m"))
    return m.select("c_custkey", F.round("m.x", 3).alias("x"), F.round("m.y", 3).alias("y"))


@query(f"{P_SQL} SELECT id, round(a - 2 * pi() * ceil((a - pi()) / (2 * pi())), 6) AS a FROM (SELECT id, x * 100 AS a FROM p)")
def angle_normalise(spark, sf_dir):
    return rounded(points(spark, sf_dir).select("id", geometry.normalised_angle(F.col("x") * 100).alias("a")), "a")


@query("SELECT year(l_shipdate) AS y, month(l_shipdate) AS m, count(*) AS n, min(l_extendedprice) AS min_l_extendedprice, max(l_extendedprice) AS max_l_extendedprice FROM lineitem GROUP BY 1, 2")
def zone_map(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumns({"y": F.year("l_shipdate"), "m": F.month("l_shipdate")})
    return A.zone_map(rows, ["y", "m"], ["l_extendedprice"])


@query("WITH z AS (SELECT year(l_shipdate) AS y, max(l_extendedprice) AS hi, min(l_extendedprice) AS lo FROM lineitem GROUP BY 1) SELECT y FROM z WHERE hi >= 90000 AND lo <= 95000")
def zone_map_prune(spark, sf_dir):
    z = A.zone_map(table(spark, sf_dir, "lineitem").withColumn("y", F.year("l_shipdate")), ["y"], ["l_extendedprice"])
    return z.where("max_l_extendedprice >= 90000 and min_l_extendedprice <= 95000").select("y")


@query("SELECT 'order' AS kind, o_orderkey AS id FROM orders UNION ALL SELECT 'event', event_id FROM events")
def session_union(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"))
    return o.unionByName(table(spark, sf_dir, "events").select(F.lit("event").alias("kind"), F.col("event_id").alias("id")))


@query("SELECT user_id, session_start AS start, count(*) AS n FROM (SELECT user_id, ts, max(CASE WHEN gap THEN ts END) OVER (PARTITION BY user_id ORDER BY ts) AS session_start FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE AS gap FROM events)) GROUP BY 1, 2")
def gap_sessions(spark, sf_dir):
    out = messages.sessions(table(spark, sf_dir, "events"), "ts", "30 minutes", ["user_id"])
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query()
def register_clouds(spark, sf_dir):
    """Points against a moved copy of themselves: the pose that brings them back, as one row."""
    from pointloom.plans.solvers import register

    p = points(spark, sf_dir).select("id", *XYZ)
    m = pose.from_tait_bryan(F.lit(0.004), F.lit(-0.003), F.lit(0.002), F.lit(0.01), F.lit(-0.005), F.lit(0.008))
    moved = p.select("id", geometry.transform(m, "x", "y", "z").alias("t")).select("id", "t.*")
    r = register(p, moved, 0.05, rounds=8)
    return spark.createDataFrame([(r.matched, round(r.rms, 9), [round(float(v), 6) for v in r.pose.ravel()])], "matched long, rms double, pose array<double>")


DET_SQL = "(cov_xx * (cov_yy * cov_zz - cov_yz * cov_yz) - cov_xy * (cov_xy * cov_zz - cov_yz * cov_xz) + cov_xz * (cov_xy * cov_yz - cov_yy * cov_xz))"
RAW_SQL = "count(*) AS n, " + ", ".join(f"avg({a}) AS mean_{a}" for a in XYZ) + ", " + ", ".join(f"covar_pop({a}, {b}) AS cov_{a}{b}" for a, b in ("xx", "xy", "xz", "yy", "yz", "zz"))


@query(f"{P_SQL}, k AS (SELECT *, {CELLS_SQL} FROM p), m AS (SELECT ix, iy, iz, {RAW_SQL}, min(id) AS first_id FROM k GROUP BY ix, iy, iz) SELECT ix, iy, iz, n, first_id, {', '.join(f'round({c}, 6) AS {c}' for c in MOMENT_NAMES)}, round(1 - 27 * {DET_SQL} / nullif(power(cov_xx + cov_yy + cov_zz, 3), 0), 6) AS planarity FROM m WHERE n >= 4")
def voxel_shape(spark, sf_dir):
    return rounded(flagship(spark, sf_dir).where("n >= 4"), *MOMENT_NAMES, "planarity")


# ---- maps and further windows ------------------------------------------------------------------

FLOOR_SQL = "floor(x / 0.1)::INT AS ix, floor(y / 0.1)::INT AS iy, floor(z / 0.1)::INT AS iz"
GAUSS_SQL = ", ".join(f"round(avg({a}), 6) AS mean_{a}" for a in XYZ) + ", " + ", ".join(f"round(covar_pop({a}, {b}), 6) AS cov_{a}{b}" for a, b in ("xx", "xy", "xz", "yy", "yz", "zz"))


@query(f"{P_SQL}, k AS (SELECT *, {FLOOR_SQL} FROM p) SELECT ix, iy, iz, count(*) AS n, {GAUSS_SQL} FROM k GROUP BY ix, iy, iz HAVING count(*) >= 5")
def merged_maps(spark, sf_dir):
    """A map made of two batches equals the map of all points."""
    p = points(spark, sf_dir)
    both = maps.merged(maps.voxel_sums(p.where("id % 2 = 0"), SIZE), maps.voxel_sums(p.where("id % 2 = 1"), SIZE))
    return rounded(maps.voxel_gaussians(both, SIZE, 5), *MOMENT_NAMES)


@query(f"{P_SQL}, s AS (SELECT *, sqrt(x * x + y * y + z * z) AS r FROM p), k AS (SELECT trunc(r / 0.1)::INT AS ir, trunc(atan2(y, x) / 0.5)::INT AS ip, trunc(acos(z / r) / 0.5)::INT AS ia, x, y, z FROM s WHERE r > 0.05) SELECT ir, ip, ia, count(*) AS n, round(avg(x), 6) AS mean_x, round(avg(y), 6) AS mean_y, round(avg(z), 6) AS mean_z FROM k GROUP BY 1, 2, 3 HAVING count(*) >= 3")
def spherical_voxels(spark, sf_dir):
    p = points(spark, sf_dir).withColumn("s", geometry.spherical("x", "y", "z")).where("s.r > 0.05")
    keys = [geometry.cell("s.r", 0.1).alias("ir"), geometry.cell("s.polar", 0.5).alias("ip"), geometry.cell("s.azimuth", 0.5).alias("ia")]
    out = p.groupBy(*keys).agg(F.count("*").alias("n"), *[F.avg(a).alias(f"mean_{a}") for a in XYZ]).where("n >= 3")
    return rounded(out, "mean_x", "mean_y", "mean_z")


@query(f"{P_SQL}, o AS (SELECT unnest(range(4)) AS \"offset\"), c AS (SELECT DISTINCT \"offset\", floor((x + \"offset\" * 0.025) / 0.1)::INT AS a, floor(y / 0.1)::INT AS b, floor(z / 0.1)::INT AS c FROM p, o) SELECT \"offset\"::INT AS \"offset\", count(*) AS cells FROM c GROUP BY 1 ORDER BY 2, 1 LIMIT 1")
def fewest_cells(spark, sf_dir):
    return maps.fewest_cells(points(spark, sf_dir), SIZE, [(0.025 * i, 0.0, 0.0) for i in range(4)])


@query(
    f"""{E_SQL}, s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS rn FROM e WHERE event_id % 2 = 1),
    q AS (SELECT event_id AS id, us, user_id, value FROM e WHERE event_id % 2 = 0),
    h AS (SELECT q.*, (SELECT max(rn) FROM s WHERE s.user_id = q.user_id AND s.us <= q.us) AS at FROM q)
    SELECT h.id, arg_min(s.event_id, (abs(s.value - h.value), s.event_id)) AS nearest_id, round(min(abs(s.value - h.value)), 6) AS d
    FROM h JOIN s ON s.user_id = h.user_id AND s.rn >= h.at - 10 AND s.rn < h.at + 10 GROUP BY h.id"""
)
def nearest_in_window(spark, sf_dir):
    e = events(spark, sf_dir)
    q = e.where("event_id % 2 = 0").select(F.col("event_id").alias("id"), "us", "user_id", "value")
    s = e.where("event_id % 2 = 1").select("event_id", "us", "user_id", "value")
    return rounded(maps.nearest_in_window(q, s, "us", ["user_id"], ["value"], reach=10, tie="event_id"), "d")


@query(f"{E_SQL} SELECT event_id, CASE WHEN abs(a) > 20 THEN 0 ELSE round(a, 6) END AS step_value FROM (SELECT event_id, lag(value, 1) OVER w - lag(value, 2) OVER w AS a FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id))")
def predicted_motion(spark, sf_dir):
    out = windows.predicted(events(spark, sf_dir), ["user_id"], ["us", "event_id"], ["value"], 20.0)
    return rounded(out.select("event_id", "step_value"), "step_value")


@query(
    f"""{E_SQL}, d AS (SELECT event_id, (us - lag(us, 5) OVER w) / 1e9 AS ax, value - lag(value, 5) OVER w AS ay, (lead(us, 5) OVER w - us) / 1e9 AS bx, lead(value, 5) OVER w - value AS by_
      FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id))
    SELECT event_id, coalesce(abs(atan2(ax * by_ - ay * bx, ax * bx + ay * by_)) > radians(10), false) AS in_curve FROM d"""
)
def curve_detection(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("sec", F.col("us") / 1e9)
    return windows.curves(e, ["user_id"], ["us", "event_id"], "sec", "value", 5, 10.0).select("event_id", "in_curve")


@query(f"{E_SQL} SELECT event_id, first_value(us) OVER w + (row_number() OVER w - 1) * 5000 AS ts FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)")
def uniform_times(spark, sf_dir):
    return windows.uniform_times(events(spark, sf_dir), ["user_id"], ["us", "event_id"], "us", 5000).select("event_id", "ts")


@query("WITH b AS (SELECT o_orderkey, o_orderkey % 215 AS batch FROM orders), c AS (SELECT *, batch // 51 AS chunk FROM b) SELECT o_orderkey, batch, chunk FROM c WHERE chunk IN (SELECT chunk FROM c GROUP BY chunk HAVING count(DISTINCT batch) > 10)")
def result_chunks(spark, sf_dir):
    b = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 215).alias("batch"))
    return sinks.result_chunks(b).select("o_orderkey", "batch", "chunk")


@query("WITH e AS (SELECT n_nationkey AS scan_from, n_regionkey AS scan_to FROM nation) SELECT DISTINCT scan_from, scan_to, s_suppkey AS scan_id FROM e JOIN supplier ON s_suppkey BETWEEN scan_from - 2 AND scan_from + 2 OR s_suppkey BETWEEN scan_to - 2 AND scan_to + 2")
def edge_neighbours(spark, sf_dir):
    e = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("scan_from"), F.col("n_regionkey").alias("scan_to"))
    return joins.edge_neighbours(e, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("scan_id")), 2)


@query("SELECT a.l_orderkey, a.l_linenumber AS scan_a, b.l_linenumber AS scan_b FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber <> b.l_linenumber")
def observation_pairs(spark, sf_dir):
    """Views of the same thing (an order) from different scans (its lines)."""
    o = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    a, b = o.withColumnRenamed("l_linenumber", "scan_a"), o.withColumnRenamed("l_linenumber", "scan_b")
    return a.join(b, "l_orderkey").where("scan_a <> scan_b")


@query("SELECT l_returnflag, round(avg(l_tax) / nullif(avg(l_discount), 0), 6) AS impact FROM lineitem GROUP BY l_returnflag")
def uncertainty_impact(spark, sf_dir):
    out = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.try_divide(F.avg("l_tax"), F.avg("l_discount")).alias("impact"))
    return rounded(out, "impact")


@query(f"{P_SQL}, c AS (SELECT id, x / (z + 1) AS a, y / (z + 1) AS b, z + 1 AS d FROM p), r AS (SELECT *, a * a + b * b AS r2 FROM c) SELECT id, round(500 * (a * (1 + r2 * (0.1 - 0.05 * r2)) + 2 * 0.001 * a * b + 0.002 * (r2 + 2 * a * a)) + 320, 5) AS u, round(500 * (b * (1 + r2 * (0.1 - 0.05 * r2)) + 0.001 * (r2 + 2 * b * b) + 2 * 0.002 * a * b) + 240, 5) AS v FROM r WHERE d > 1e-6")
def camera_projection(spark, sf_dir):
    cam = camera.Intrinsics(500.0, 500.0, 320.0, 240.0, (0.1, -0.05, 0.0, 0.0, 0.0, 0.0), (0.001, 0.002))
    q = points(spark, sf_dir).select("id", camera.project("x", "y", F.col("z") + 1, cam).alias("q")).where("q is not null")
    return q.select("id", F.round("q.u", 5).alias("u"), F.round("q.v", 5).alias("v"))


@query("SELECT p_partkey, string_split(p_name || '/' || p_brand || '.las', '/')[-1] AS base, right(regexp_replace(p_name || '/' || p_brand || '.las', '^.*/|\\.[^.]*$', '', 'g'), 4) AS chunk FROM part")
def path_names(spark, sf_dir):
    path = F.concat("p_name", F.lit("/"), "p_brand", F.lit(".las"))
    return table(spark, sf_dir, "part").select("p_partkey", geometry.base_name(path).alias("base"), geometry.chunk_index(path).alias("chunk"))


@query(f"{P_SQL} SELECT id, round(sqrt((y * 3 - z * 2) ** 2 + (z * 1 - x * 3) ** 2 + (x * 2 - y * 1) ** 2) / sqrt(14), 6) AS d FROM p")
def point_line_distance(spark, sf_dir):
    d = geometry.point_line_distance(("x", "y", "z"), (0.0, 0.0, 0.0), (1.0, 2.0, 3.0))
    return rounded(points(spark, sf_dir).select("id", d.alias("d")), "d")


@query("SELECT c_custkey, xor(c_custkey, c_custkey >> 1) AS gray, c_custkey AS back FROM customer")
def gray_code(spark, sf_dir):
    g = F.col("c_custkey").bitwiseXOR(F.shiftright("c_custkey", 1))
    return table(spark, sf_dir, "customer").select("c_custkey", g.alias("gray"), geometry.gray_to_binary(g, 64).alias("back"))


from pointloom.plans import catalog_maps, catalog_files, catalog_solvers  # noqa: E402, F401, I001  # further queries, registered when read

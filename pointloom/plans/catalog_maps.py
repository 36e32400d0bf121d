"""Queries of online maps, sessions, time windows and joins with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pointloom.functions import geodesy, geometry, imu, pose, robust
from pointloom.operators import aggregates as A
from pointloom.operators import evaluate, filters, joins, maps, shape, windows
from pointloom.plans import sessions, terrain
from pointloom.plans.catalog import CELLS_SQL, D_SQL, DET_SQL, E_SQL, FLOOR_SQL, P_SQL, RAW_SQL, SIZE, XYZ, events, points, rounded, table
from pointloom.plans.registry import query
from pointloom.sources import store
from pointloom.streaming import online_map

COVS = ("xx", "xy", "xz", "yy", "yz", "zz")
DIFF_SQL = ", ".join(f"{a} - first_value({a}) OVER w AS d{a}, first_value({a}) OVER w AS mean_{a}" for a in XYZ)
FIRST_SQL = ", ".join(f"round((CASE WHEN '{a}' = '{b}' THEN 0.0009 ELSE 0 END + sum(d{a} * d{b} * (k - 1) / k)) / count(*), 6) AS cov_{a}{b}" for a, b in COVS)


@query(f"{P_SQL}, c AS (SELECT *, {CELLS_SQL} FROM p), f AS (SELECT ix, iy, iz, row_number() OVER w AS k, {DIFF_SQL} FROM c WINDOW w AS (PARTITION BY ix, iy, iz ORDER BY id)) SELECT ix, iy, iz, count(*) AS n, {', '.join(f'round(any_value(mean_{a}), 6) AS mean_{a}' for a in XYZ)}, {FIRST_SQL} FROM f GROUP BY ix, iy, iz")
def first_point_map(spark, sf_dir):
    """One batch seen from one place: every point counts, so the recursion is a plain weighted sum."""
    out = maps.first_point_moments(points(spark, sf_dir), SIZE, ["id"], (0.0, 0.0, 5.0))
    return rounded(out, *[f"mean_{a}" for a in XYZ], *[f"cov_{c}" for c in COVS])


STEP = "(0.1 * sqrt(3))"


@query(
    f"""{P_SQL}, v AS (SELECT DISTINCT {CELLS_SQL} FROM p), r AS (SELECT x, y, z, sqrt((2 - x) ** 2 + (1 - y) ** 2 + (3 - z) ** 2) AS far FROM p),
    s AS (SELECT *, unnest(range(1, ceil(far / {STEP})::BIGINT - 1)) AS j FROM r),
    h AS (SELECT trunc((x + (2 - x) / far * {STEP} * (j + 1)) / 0.1)::INT AS ix, trunc((y + (1 - y) / far * {STEP} * (j + 1)) / 0.1)::INT AS iy, trunc((z + (3 - z) / far * {STEP} * (j + 1)) / 0.1)::INT AS iz FROM s),
    n AS (SELECT ix, iy, iz, count(*) AS hits FROM h GROUP BY ALL)
    SELECT ix, iy, iz, least(coalesce(hits, 0), 30)::BIGINT AS hits FROM v LEFT JOIN n USING (ix, iy, iz) WHERE coalesce(hits, 0) < 20"""
)
def unoccluded_voxels(spark, sf_dir):
    p = points(spark, sf_dir)
    voxels = A.with_cells(p, XYZ, SIZE).select("ix", "iy", "iz").distinct()
    return filters.unoccluded(maps.ray_hits(p, voxels, SIZE, (2.0, 1.0, 3.0)), 20).select("ix", "iy", "iz", F.col("hits").cast("long").alias("hits"))


@query(f"{P_SQL}, k AS (SELECT *, {CELLS_SQL} FROM p), m AS (SELECT ix, iy, iz, {RAW_SQL} FROM k GROUP BY ix, iy, iz) SELECT ix, iy, iz, n, round(1 - 27 * {DET_SQL} / nullif(power(cov_xx + cov_yy + cov_zz, 3), 0), 6) AS planarity FROM m WHERE n > 10 AND 1 - 27 * {DET_SQL} / nullif(power(cov_xx + cov_yy + cov_zz, 3), 0) > 0.2")
def planar_voxels(spark, sf_dir):
    v = A.voxel_moments(points(spark, sf_dir), XYZ, SIZE, 1)
    return rounded(filters.planar_buckets(v, 10, 0.2).select("ix", "iy", "iz", "n", "planarity"), "planarity")


EIGEN_SQL = """
 q AS (SELECT *, (cov_xx + cov_yy + cov_zz) / 3 AS q FROM m),
 s AS (SELECT *, sqrt(((cov_xx - q) ** 2 + (cov_yy - q) ** 2 + (cov_zz - q) ** 2 + 2 * (cov_xy ** 2 + cov_xz ** 2 + cov_yz ** 2)) / 6) AS s FROM q),
 r AS (SELECT *, CASE WHEN s > 0 THEN ((cov_xx - q) * ((cov_yy - q) * (cov_zz - q) - cov_yz ** 2) - cov_xy * (cov_xy * (cov_zz - q) - cov_yz * cov_xz) + cov_xz * (cov_xy * cov_yz - (cov_yy - q) * cov_xz)) / (2 * s ** 3) ELSE 0 END AS r FROM s),
 a AS (SELECT *, acos(greatest(-1, least(1, r))) / 3 AS a FROM r),
 e AS (SELECT *, q + 2 * s * cos(a) AS e0, q + 2 * s * cos(a + 2 * pi() / 3) AS e2 FROM a),
 f AS (SELECT *, 3 * q - e0 - e2 AS e1 FROM e)"""


@query(
    f"""{P_SQL}, m AS (SELECT a.id, count(*) AS n, {', '.join(f'covar_pop(b.{a} - a.{a}, b.{b} - a.{b}) AS cov_{a}{b}' for a, b in COVS)} FROM p a JOIN p b ON {D_SQL} <= 0.06 GROUP BY a.id HAVING count(*) >= 5), {EIGEN_SQL}
    SELECT id, n, round((e0 - e1) / e0, 5) AS linearity, round((e1 - e2) / e0, 5) AS planarity, round(e2 / e0, 5) AS sphericity, round(e2 / (e0 + e1 + e2), 5) AS curvature FROM f"""
)
def shape_eigenvalues(spark, sf_dir):
    f = shape.neighbourhood_features(points(spark, sf_dir), 0.06, "id", 5)
    return f.select("id", "n", *[F.round(c, 5).alias(c) for c in ("linearity", "planarity", "sphericity", "curvature")])


@query(f"{P_SQL}, g AS (SELECT *, {FLOOR_SQL} FROM p), m AS (SELECT ix, iy, iz, {RAW_SQL} FROM g GROUP BY ix, iy, iz HAVING count(*) >= 5), j AS (SELECT x - mean_x AS x, y - mean_y AS y, z - mean_z AS z, cov_xx + 0.0001 AS a, cov_xy AS b, cov_xz AS c, cov_yy + 0.0001 AS d, cov_yz AS e, cov_zz + 0.0001 AS f FROM g JOIN m USING (ix, iy, iz)), s AS (SELECT (x * x * (d * f - e * e) + y * y * (a * f - c * c) + z * z * (a * d - b * b) + 2 * (x * y * (c * e - b * f) + x * z * (b * e - c * d) + y * z * (b * c - a * e))) / (a * (d * f - e * e) + b * (c * e - b * f) + c * (b * e - c * d)) AS m FROM j) SELECT count(*) AS n, round(avg(m), 6) AS mean_square FROM s")
def mahalanobis_mean(spark, sf_dir):
    p = points(spark, sf_dir)
    g = maps.voxel_gaussians(maps.voxel_sums(p, SIZE), SIZE, 5)
    return rounded(A.mahalanobis(p, g, SIZE, floor=0.01), "mean_square")


@query(f"{P_SQL}, c AS (SELECT {CELLS_SQL}, count(*) AS n FROM p GROUP BY ALL) SELECT ix, iy, iz, n, (sum(n) OVER (ORDER BY ix, iy, iz) - n)::BIGINT AS begin, (sum(n) OVER (ORDER BY ix, iy, iz))::BIGINT AS \"end\" FROM c")
def bucket_index(spark, sf_dir):
    return A.bucket_index(points(spark, sf_dir), XYZ, SIZE)


@query(f"{P_SQL} SELECT {CELLS_SQL}, count(*) AS n FROM p GROUP BY ALL HAVING count(*) > 6")
def largest_buckets(spark, sf_dir):
    return A.largest_buckets(points(spark, sf_dir), XYZ, SIZE, 6)


@query(f"{P_SQL}, o AS (SELECT a.label AS p, b.label AS q, b.x - a.x AS r, -1.0 AS u0, a.y AS u1, 1.0 AS v0, -b.y AS v1 FROM p a JOIN p b ON a.label < b.label AND {D_SQL} < 0.05), b AS (SELECT p AS \"row\", p AS col, i, j, sum(CASE i WHEN 0 THEN u0 ELSE u1 END * CASE j WHEN 0 THEN u0 ELSE u1 END) AS value FROM o, range(2) x(i), range(2) y(j) GROUP BY ALL UNION ALL SELECT q, q, i, j, sum(CASE i WHEN 0 THEN v0 ELSE v1 END * CASE j WHEN 0 THEN v0 ELSE v1 END) FROM o, range(2) x(i), range(2) y(j) GROUP BY ALL UNION ALL SELECT p, q, i, j, sum(CASE i WHEN 0 THEN u0 ELSE u1 END * CASE j WHEN 0 THEN v0 ELSE v1 END) FROM o, range(2) x(i), range(2) y(j) GROUP BY ALL UNION ALL SELECT p, NULL, i, NULL, sum(CASE i WHEN 0 THEN u0 ELSE u1 END * r) FROM o, range(2) x(i) GROUP BY ALL UNION ALL SELECT q, NULL, i, NULL, sum(CASE i WHEN 0 THEN v0 ELSE v1 END * r) FROM o, range(2) x(i) GROUP BY ALL) SELECT \"row\"::BIGINT AS \"row\", col::BIGINT AS col, i::INT AS i, j::INT AS j, round(sum(value), 6) AS value FROM b GROUP BY ALL")
def pair_blocks(spark, sf_dir):
    """Sparse normal equations of observations between labels (as poses), two unknowns each."""
    p = points(spark, sf_dir)
    near = joins.radius_pairs(p, p, XYZ, 0.05, strict=True).where("l.label < r.label")
    rows = near.select(F.col("r.label").alias("a"), F.col("l.label").alias("b"), (F.col("r.x") - F.col("l.x")).alias("res"), F.lit(1.0).alias("f0"), (-F.col("r.y")).alias("f1"), F.lit(-1.0).alias("s0"), F.col("l.y").alias("s1"))
    return rounded(A.pair_normal_equations(rows, ["f0", "f1"], ["s0", "s1"], "res", "a", "b"), "value")


@query(f"{E_SQL} SELECT user_id, count(*) AS total, count(*) FILTER (us % 1000 = 0) AS without_time, count(*) FILTER (NOT coalesce(value > 20, false)) AS filtered FROM e GROUP BY user_id")
def load_counters(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("t", F.col("us") % 1000)
    return A.load_counters(e, F.col("value") > 20, "t", ["user_id"])


@query(f"{E_SQL} SELECT user_id, min(us) FILTER (value <= 5 OR value IS NULL) AS ts_failure, count(*) FILTER (value <= 5 OR value IS NULL) AS failures FROM e GROUP BY user_id")
def first_failure(spark, sf_dir):
    bad = F.when(F.col("value") > 5, F.col("value")).when(F.col("value").isNotNull(), F.lit(float("nan")))
    return A.first_failure(events(spark, sf_dir).withColumn("v", bad), "v", "us", ["user_id"])


@query(f"{P_SQL}, b AS (SELECT floor(x / 0.01)::INT AS bin, count(*) FILTER (label % 2 = 0) AS na, count(*) FILTER (label % 2 = 1) AS nb FROM p GROUP BY 1), c AS (SELECT bin, abs(sum(na) OVER (ORDER BY bin) / sum(na) OVER () - sum(nb) OVER (ORDER BY bin) / sum(nb) OVER ()) * coalesce(lead(bin) OVER (ORDER BY bin) - bin, 0) * 0.01 AS part FROM b) SELECT round(sum(part), 6) AS emd FROM c")
def earth_movers(spark, sf_dir):
    p = points(spark, sf_dir)
    return rounded(A.wasserstein(p.where("label % 2 = 0"), p.where("label % 2 = 1"), "x", 0.01), "emd")


@query(f"{P_SQL} SELECT id, round(sqrt((x - 0.05) ** 2 + (y - 0.02) ** 2 + (z + 0.03) ** 2), 6) AS d FROM p WHERE sqrt((x - 0.05) ** 2 + (y - 0.02) ** 2 + (z + 0.03) ** 2) < 0.15")
def around_point(spark, sf_dir):
    return rounded(filters.around_point(points(spark, sf_dir), (0.05, 0.02, -0.03), 0.15).select("id", "d"), "d")


@query(f"{P_SQL}, d AS (SELECT label, id, sqrt((y * 3 - z * 2) ** 2 + (z - x * 3) ** 2 + (x * 2 - y) ** 2) / sqrt(14) AS d FROM p) SELECT label, arg_min(id, d) AS id, round(min(d), 6) AS d FROM d GROUP BY label")
def nearest_to_ray(spark, sf_dir):
    return rounded(joins.nearest_to_ray(points(spark, sf_dir), (0.0, 0.0, 0.0), (1.0, 2.0, 3.0), by=["label"]), "d")


@query(f"{P_SQL} SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.id <> b.id AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 0.02 AND abs(a.z - b.z) < 0.05")
def band_neighbours(spark, sf_dir):
    return joins.band_neighbours(points(spark, sf_dir), 0.02, 0.05)


@query(f"{P_SQL}, v AS (SELECT id, x, y FROM p WHERE label = 3), g AS (SELECT * FROM p WHERE label <> 3), j AS (SELECT v.id, g.z, sqrt((v.x - g.x) ** 2 + (v.y - g.y) ** 2) AS d, g.id AS gid FROM v JOIN g ON sqrt((v.x - g.x) ** 2 + (v.y - g.y) ** 2) <= 0.1) SELECT id, round(arg_min(z, (d, gid)), 6) AS z, round(min(d), 6) AS d FROM j GROUP BY id")
def vertex_heights(spark, sf_dir):
    p = points(spark, sf_dir)
    return rounded(terrain.vertex_heights(p.where("label = 3").select("id", "x", "y"), p.where("label <> 3"), 0.1), "z", "d")


# ---- time and sessions -------------------------------------------------------------------------


@query(f"{E_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS rn FROM e WHERE event_id % 2 = 1), g AS (SELECT user_id, us, max(event_id) AS event_id FROM r WHERE rn > 1 GROUP BY 1, 2), l AS (SELECT event_id, us, user_id FROM e WHERE event_id % 2 = 0) SELECT l.event_id, CASE WHEN l.us - g.us <= 7200000000 THEN g.event_id END AS r_event_id FROM l ASOF LEFT JOIN g ON l.user_id = g.user_id AND l.us >= g.us")
def asof_after_first(spark, sf_dir):
    e = events(spark, sf_dir)
    left, r = e.where("event_id % 2 = 0").select("event_id", "us", "user_id"), e.where("event_id % 2 = 1").select("event_id", "us", "user_id")
    return joins.asof_after_first(left, r, "us", "us", 7_200_000_000, ["user_id"], tie="event_id").select("event_id", "r_event_id")


@query(f"{E_SQL}, f AS (SELECT us FROM e ORDER BY us, event_id LIMIT 501) SELECT count(*) AS n, max(us) AS last FROM f")
def seed_rows(spark, sf_dir):
    return windows.seed_rows(events(spark, sf_dir), ["us", "event_id"], "us", 501)[1]


@query(f"{E_SQL}, o AS (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) - 1) // 11 AS batch FROM e) SELECT user_id, event_id, batch FROM o QUALIFY count(*) OVER (PARTITION BY user_id, batch) >= 11")
def point_batches(spark, sf_dir):
    return windows.point_batches(events(spark, sf_dir), ["user_id"], ["us", "event_id"], 10).select("user_id", "event_id", "batch")


def lines(spark, sf_dir):
    """Order lines as scans: a place and a heading each."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *[F.col(c).cast("double").alias(c) for c in ("l_quantity", "l_discount", "l_tax", "l_extendedprice")])
    yaw, zero = F.col("l_tax") * 10, F.lit(0.0)
    return rows.withColumn("pose", pose.from_tait_bryan(F.col("l_quantity"), F.col("l_discount"), zero, zero, zero, yaw))


L_SQL = "WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity::DOUBLE AS x, l_discount::DOUBLE AS y, l_tax::DOUBLE * 10 AS a, l_extendedprice::DOUBLE AS p FROM lineitem)"


@query(f"{L_SQL}, f AS (SELECT *, first_value(x) OVER w AS x0, first_value(y) OVER w AS y0, first_value(a) OVER w AS a0 FROM l WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, p)) SELECT l_orderkey, l_linenumber, round(cos(a0) * (x - x0) + sin(a0) * (y - y0), 6) AS x, round(-sin(a0) * (x - x0) + cos(a0) * (y - y0), 6) AS y, round(cos(a - a0), 6) AS c FROM f")
def to_first_frame(spark, sf_dir):
    out = windows.to_first_frame(lines(spark, sf_dir), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_extendedprice"])
    m = F.col("pose")
    return rounded(out.select("l_orderkey", "l_linenumber", m[3].alias("x"), m[7].alias("y"), m[0].alias("c")), "x", "y", "c")


@query(f"{L_SQL}, g AS (SELECT *, a - lag(a) OVER w - (y * 3 - lag(y * 3) OVER w) AS g FROM l WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, p)) SELECT l_orderkey, l_linenumber, CASE WHEN g IS NOT NULL THEN round(acos(greatest(-1, least(1, cos(g)))), 5) END AS gap FROM g WHERE g IS NULL OR abs(sin(g)) > 0.01")
def rotation_gaps(spark, sf_dir):
    zero = F.lit(0.0)
    nodes = lines(spark, sf_dir).withColumn("imu_pose", pose.from_tait_bryan(zero, zero, zero, zero, zero, F.col("l_discount") * 3))
    out = windows.rotation_gaps(nodes, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_extendedprice"])
    return out.where("gap is null or abs(sin(gap)) > 0.01").select("l_orderkey", "l_linenumber", F.round("gap", 5).alias("gap"))


@query(f"{L_SQL}, s AS (SELECT l_orderkey % 4 AS session, l_orderkey * 10 + l_linenumber AS scan_id, p AS ts, x, y, a FROM l), t AS (SELECT session, min(ts) + 1000 AS t0 FROM s GROUP BY 1), r AS (SELECT session, arg_min(x, (ts, scan_id)) AS x1, arg_min(y, (ts, scan_id)) AS y1, arg_min(a, (ts, scan_id)) AS a1 FROM s JOIN t USING (session) WHERE ts > t0 GROUP BY 1), m AS (SELECT s.*, r.x1, r.y1, r.a1, z.x1 AS x2, z.y1 AS y2, z.a1 AS a2 FROM s JOIN r USING (session), r z WHERE z.session = 0) SELECT session, scan_id, round(x2 + cos(a2 - a1) * (x - x1) - sin(a2 - a1) * (y - y1), 5) AS x, round(y2 + sin(a2 - a1) * (x - x1) + cos(a2 - a1) * (y - y1), 5) AS y FROM m")
def align_sessions(spark, sf_dir):
    s = lines(spark, sf_dir).select((F.col("l_orderkey") % 4).alias("session"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("scan_id"), F.col("l_extendedprice").alias("ts"), "pose")
    m = F.col("pose")
    return sessions.align_sessions(s, 1000.0, 0).select("session", "scan_id", F.round(m[3], 5).alias("x"), F.round(m[7], 5).alias("y"))


@query(f"{P_SQL}, s AS (SELECT DISTINCT label, label * 0.3 AS a, label::DOUBLE AS t FROM p) SELECT id, round(cos(a) * x - sin(a) * y + t, 6) AS x, round(sin(a) * x + cos(a) * y - t, 6) AS y, round(z, 6) AS z FROM p JOIN s USING (label) WHERE sqrt(x * x + y * y + z * z) > 0.1")
def session_points(spark, sf_dir):
    p = points(spark, sf_dir).withColumnRenamed("label", "scan_id")
    zero, k = F.lit(0.0), F.col("scan_id")
    scans = p.select("scan_id").distinct().withColumn("pose", pose.from_tait_bryan(k.cast("double"), -k.cast("double"), zero, zero, zero, k * 0.3))
    return rounded(sessions.session_points(p, scans, geometry.norm("x", "y", "z") > 0.1).select("id", *XYZ), *XYZ)


@query(f"{P_SQL}, s AS (SELECT DISTINCT label, label * 0.3 AS a, label::DOUBLE AS t FROM p), w AS (SELECT *, min(a) OVER () AS a0, min(t) OVER () AS t0 FROM s), m AS (SELECT id, z, cos(a) * x - sin(a) * y + t - t0 AS u, sin(a) * x + cos(a) * y - t + t0 AS v, a0 FROM p JOIN w USING (label) WHERE sqrt(x * x + y * y + z * z) > 0.2) SELECT id, round(cos(a0) * u + sin(a0) * v, 6) AS x, round(-sin(a0) * u + cos(a0) * v, 6) AS y, round(z, 6) AS z FROM m")
def first_frame_cloud(spark, sf_dir):
    p = points(spark, sf_dir).withColumnRenamed("label", "scan_id")
    zero, k = F.lit(0.0), F.col("scan_id")
    scans = p.select("scan_id").distinct().withColumn("ts", k * 10).withColumn("pose", pose.from_tait_bryan(k.cast("double"), -k.cast("double"), zero, zero, zero, k * 0.3))
    return rounded(sessions.to_first_vector(p, scans, 0.2).select("id", *XYZ), *XYZ)


@query("WITH p AS (SELECT event_id // 8 % 8 AS file, event_id AS \"row\", value AS x, user_id::DOUBLE AS y FROM events), t AS (SELECT o_orderkey % 8 AS file, o_orderkey AS i, o_totalprice::DOUBLE / 1e5 AS t FROM orders WHERE o_orderkey % 3 > 0) SELECT p.file, p.\"row\", p.\"row\" // 8 AS pose_id, round(x - t, 8) AS local_x, round(CASE WHEN t IS NOT NULL THEN y END, 8) AS local_y FROM p LEFT JOIN t ON t.file = p.file AND t.i = p.\"row\" // 8")
def reloaded_results(spark, sf_dir):
    at = F.floor(F.col("event_id") / 8)
    p = events(spark, sf_dir).select((at % 8).alias("file"), F.col("event_id").alias("row"), F.col("value").alias("x"), F.col("user_id").cast("double").alias("y"), F.lit(0.0).alias("z"))
    index = p.select("file", F.col("row").alias("i"), F.floor(F.col("row") / 8).alias("value"))
    zero = F.lit(0.0)
    track = table(spark, sf_dir, "orders").where("o_orderkey % 3 > 0").select((F.col("o_orderkey") % 8).alias("file"), F.col("o_orderkey").alias("i"), pose.from_tait_bryan(F.col("o_totalprice").cast("double") / 1e5, zero, zero, zero, zero, zero).alias("pose"))
    return sessions.reloaded(p, track, index).select("file", "row", "pose_id", *[F.round(c, 8).alias(c) for c in ("local_x", "local_y")])


@query(f"{E_SQL}, s AS (SELECT user_id, event_id, us / 1e6 AS t, CASE WHEN value < 60 THEN value ELSE 0 END AS a FROM e), d AS (SELECT *, CASE WHEN t - lag(t) OVER w > 0 THEN least(t - lag(t) OVER w, 60) ELSE 0 END AS dt FROM s WINDOW w AS (PARTITION BY user_id ORDER BY t)), v AS (SELECT *, sum(a * dt) OVER w AS v FROM d WINDOW w AS (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING)) SELECT user_id, round(max(v), 3) AS v, round(sum(v * dt), 0) AS p FROM v GROUP BY user_id")
def dead_reckoning(spark, sf_dir):
    e = events(spark, sf_dir).select("user_id", (F.col("us") / 1e6).alias("t"), F.col("value").alias("ax"), F.lit(0.0).alias("ay"), F.lit(0.0).alias("az"))
    out = windows.dead_reckoned(e, ["user_id"], "t", most_dt=60.0, most_acc=60.0)
    return out.groupBy("user_id").agg(F.round(F.max("vx"), 3).alias("v"), F.round(F.max_by("px", "t"), 0).alias("p"))


@query("SELECT c_custkey, round(c_acctbal::DOUBLE * 9.80665, 4) AS a, round(radians(c_custkey % 720), 8) AS r, abs(c_acctbal::DOUBLE) < 5000 AS ok FROM customer")
def imu_units(spark, sf_dir):
    c, zero = table(spark, sf_dir, "customer"), F.lit(0.0)
    bal = F.col("c_acctbal").cast("double")
    return c.select("c_custkey", F.round(imu.metres(bal), 4).alias("a"), F.round(imu.radians(F.col("c_custkey") % 720), 8).alias("r"), imu.valid(bal, zero, zero, 5000.0).alias("ok"))


@query("SELECT c_custkey, round(degrees(2 * atan(exp(y / 6378137)) - pi() / 2), 7) AS lat, round(degrees(x / 6378137), 7) AS lon FROM (SELECT c_custkey, (c_custkey % 300) * 60000.0 - 9000000 AS x, (c_custkey % 170) * 70000.0 - 6000000 AS y FROM customer)")
def from_web_mercator(spark, sf_dir):
    k = F.col("c_custkey")
    g = table(spark, sf_dir, "customer").select("c_custkey", geodesy.from_web_mercator((k % 300) * 60000.0 - 9000000, (k % 170) * 70000.0 - 6000000).alias("g"))
    return g.select("c_custkey", F.round("g.lat", 7).alias("lat"), F.round("g.lon", 7).alias("lon"))


@query("SELECT c_custkey, round(48.0 + (c_custkey % 700) / 100, 7) AS lat, round(14.0 + (c_custkey % 900) / 90, 7) AS lon FROM customer")
def grid_round_trip(spark, sf_dir):
    """Places projected to a national grid and back are where they were."""
    k = F.col("c_custkey")
    p = table(spark, sf_dir, "customer").select("c_custkey", geodesy.puwg92(48.0 + (k % 700) / 100, 14.0 + (k % 900) / 90).alias("p"))
    g = p.select("c_custkey", geodesy.from_transverse_mercator("p.east", "p.north", 19.0, 0.9993, 500_000.0, -5_300_000.0).alias("g"))
    return g.select("c_custkey", F.round("g.lat", 7).alias("lat"), F.round("g.lon", 7).alias("lon"))


@query(
    """WITH r AS (SELECT l_orderkey, l_linenumber, (l_extendedprice::DOUBLE - 30000) / 10007.3 AS r FROM lineitem)
    SELECT l_orderkey, l_linenumber, round(abs(r), 6) AS l1, round(r * r / 2, 6) AS l2, round(abs(r) ** 1.2 / 1.2, 6) AS lp, round(2 * (sqrt(1 + r * r / 2) - 1), 6) AS l1l2,
    round(CASE WHEN abs(r) <= 1.345 THEN r * r / 2 ELSE 1.345 * (abs(r) - 0.6725) END, 6) AS huber, round(r * r / 2 / (1 + r * r), 6) AS geman, round(sqrt(r * r + 1) - 1, 6) AS barron,
    round(2.3849 ** 2 / 2 * ln(1 + (r / 2.3849) ** 2), 6) AS cauchy, round(2.9846 ** 2 / 2 * (1 - exp(-((r / 2.9846) ** 2))), 6) AS welsch FROM r"""
)
def robust_losses(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", ((F.col("l_extendedprice").cast("double") - 30000) / 10007.3).alias("r"))  # a divisor that leaves no exact halves to round
    return rows.select("l_orderkey", "l_linenumber", *[F.round(robust.estimator(n, "r")[0], 6).alias(n) for n in ("l1", "l2", "lp", "l1l2", "huber", "geman", "barron", "cauchy", "welsch")])


# ---- the map that lives on ---------------------------------------------------------------------

VIEW_SQL = "(id % 5 - 2) * 0.7 AS vx, (id % 3 - 1) * 0.9 AS vy, (id % 2) * 2.0 - 1 AS vz"
SEEN_SQL = f"""{P_SQL.replace('WITH p', 'WITH RECURSIVE p')}, c AS (SELECT *, {CELLS_SQL}, {VIEW_SQL} FROM p),
    d AS (SELECT ix, iy, iz, row_number() OVER w AS k, vx, vy, vz, {DIFF_SQL} FROM c WINDOW w AS (PARTITION BY ix, iy, iz ORDER BY id)),
    m AS (SELECT ix, iy, iz, {', '.join(f"(CASE WHEN '{c[0]}' = '{c[1]}' THEN 0.0009 ELSE 0 END + sum(d{c[0]} * d{c[1]} * (k - 1) / k)) / 3 AS cov_{c}" for c in COVS)} FROM d WHERE k <= 3 GROUP BY ix, iy, iz HAVING count(*) = 3), {EIGEN_SQL},
    g AS (SELECT ix, iy, iz, cov_xx - e2 AS g0, cov_yy - e2 AS g1, cov_zz - e2 AS g2, cov_xy AS h, cov_xz AS i, cov_yz AS j FROM f),
    x AS (SELECT ix, iy, iz, [h * j - i * g1, i * h - g0 * j, g0 * g1 - h * h] AS n0, [h * g2 - i * j, i * i - g0 * g2, g0 * j - h * i] AS n1, [g1 * g2 - j * j, j * i - h * g2, h * j - g1 * i] AS n2 FROM g),
    n AS (SELECT ix, iy, iz, list_extract(list_sort([struct_pack(q := list_inner_product(n0, n0), v := n0), struct_pack(q := list_inner_product(n1, n1), v := n1), struct_pack(q := list_inner_product(n2, n2), v := n2)], 'DESC'), 1).v AS nv FROM x),
    sd AS (SELECT d.*, list_inner_product(nv, [vx - mean_x, vy - mean_y, vz - mean_z]) AS front FROM d LEFT JOIN n USING (ix, iy, iz)),
    o AS (SELECT *, k <= 3 OR coalesce(front * first_value(front) OVER w >= 0, false) AS counts FROM sd WINDOW w AS (PARTITION BY ix, iy, iz ORDER BY CASE WHEN k = 3 THEN 0 ELSE k END)),
    step AS (SELECT ix, iy, iz, k, mean_x, mean_y, mean_z, {', '.join(f"CASE WHEN '{c[0]}' = '{c[1]}' THEN 0.0009 ELSE 0 END::DOUBLE AS cov_{c}" for c in COVS)} FROM o WHERE k = 1
      UNION ALL SELECT o.ix, o.iy, o.iz, o.k, o.mean_x, o.mean_y, o.mean_z, {', '.join(f'CASE WHEN o.counts THEN step.cov_{c} * (o.k - 1) / o.k + o.d{c[0]} * o.d{c[1]} * (o.k - 1) / (o.k * o.k) ELSE step.cov_{c} END' for c in COVS)}
      FROM step JOIN o ON step.ix = o.ix AND step.iy = o.iy AND step.iz = o.iz AND o.k = step.k + 1)
    SELECT ix, iy, iz, k AS n, {', '.join(f'round(mean_{a}, 6) AS mean_{a}' for a in XYZ)}, {', '.join(f'round(cov_{c}, 6) AS cov_{c}' for c in COVS)}
    FROM step QUALIFY k = max(k) OVER (PARTITION BY ix, iy, iz)"""


def viewed(spark, sf_dir):
    i = F.col("id")
    return points(spark, sf_dir).withColumns({"vx": (i % 5 - 2) * 0.7, "vy": (i % 3 - 1) * 0.9, "vz": (i % 2) * 2.0 - 1})


@query(SEEN_SQL)
def seen_point_map(spark, sf_dir):
    """The map of points seen from moving places: what is seen from behind doesn't count."""
    out = maps.first_point_moments(viewed(spark, sf_dir), SIZE, ["id"], ("vx", "vy", "vz"))
    return rounded(out, *[f"mean_{a}" for a in XYZ], *[f"cov_{c}" for c in COVS])


@query(SEEN_SQL)
def continued_map(spark, sf_dir):
    """The same map, taken on over four batches of points."""
    p = viewed(spark, sf_dir).select(F.lit(0).alias("session"), "id", F.col("id").alias("ts"), *XYZ, "vx", "vy", "vz", F.lit(0).alias("rebuild"), F.lit(float("-inf")).alias("keep_from"))
    ends = p.agg(F.min("id").alias("a"), (F.max("id") + 1).alias("b")).first()
    known, step = None, (ends["b"] - ends["a"]) / 4
    for k in range(4):
        known = store.stored(online_map.continued(known, p.where((F.col("id") >= ends["a"] + k * step) & (F.col("id") < ends["a"] + (k + 1) * step)), SIZE), "map")
    out = known.select("ix", "iy", "iz", "n", *online_map.MEAN, *online_map.COV)
    return rounded(out, *online_map.MEAN, *online_map.COV)


@query(f"{E_SQL}, s AS (SELECT user_id, us, avg(value) AS v FROM e WHERE event_id % 2 = 1 AND value IS NOT NULL GROUP BY 1, 2), q AS (SELECT * FROM e WHERE event_id % 2 = 0 AND value IS NOT NULL), b AS (SELECT q.*, s.us AS a, s.v AS va FROM q ASOF JOIN s ON q.user_id = s.user_id AND q.us >= s.us), f AS (SELECT b.*, s.us AS z, s.v AS vz FROM b ASOF JOIN s ON b.user_id = s.user_id AND b.us <= s.us), d AS (SELECT user_id, CASE WHEN a = z THEN va ELSE va + (vz - va) * ((us - a)::DOUBLE / (z - a)::DOUBLE) END - value AS err FROM f) SELECT user_id, count(*) AS n, round(sqrt(avg(err * err)), 5) AS ate_rmse, round(avg(abs(err)), 5) AS ate_mean, round(max(abs(err)), 5) AS ate_max FROM d GROUP BY user_id")
def trajectory_ate(spark, sf_dir):
    """Absolute errors of each user's even events as poses, against poses interpolated between the odd ones."""
    zero = F.lit(0.0)
    e = events(spark, sf_dir).where("value is not null")
    at = lambda v: pose.from_tait_bryan(v, zero, zero, zero, zero, zero)
    truth = e.where("event_id % 2 = 1").groupBy("user_id", F.col("us").alias("ts_ns")).agg(F.avg("value").alias("v")).select("user_id", "ts_ns", at(F.col("v")).alias("pose"))
    own = e.where("event_id % 2 = 0").select("user_id", F.col("us").alias("ts_ns"), at(F.col("value")).alias("pose"))
    out = evaluate.ate(evaluate.with_truth(own, truth, "ts_ns", ["user_id"]), ["user_id"])
    return out.select("user_id", "n", *[F.round(c, 5).alias(c) for c in ("ate_rmse", "ate_mean", "ate_max")])


@query("WITH b AS (SELECT l_partkey AS scan_id, avg(l_tax) + avg(l_discount) + avg(l_quantity) / 100 AS t FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1), a AS (SELECT l_partkey AS scan_id, avg(l_tax) + avg(l_discount) + avg(l_quantity) / 100 AS t FROM lineitem WHERE l_linenumber > 3 GROUP BY 1) SELECT round(avg(b.t) / avg(a.t), 6) AS ratio FROM b JOIN a USING (scan_id)")
def uncertainty_ratio(spark, sf_dir):
    """Covariance traces of scans (parts) before and after an adjustment (later lines)."""
    rows = table(spark, sf_dir, "lineitem").withColumnRenamed("l_partkey", "scan_id")
    cov = lambda d: d.groupBy("scan_id").agg(F.avg("l_tax").cast("double").alias("cov_xx"), F.avg("l_discount").cast("double").alias("cov_yy"), (F.avg("l_quantity") / 100).cast("double").alias("cov_zz"))
    return rounded(terrain.uncertain_pairs(cov(rows.where("l_linenumber <= 3")), cov(rows.where("l_linenumber > 3"))), "ratio")


# ---- directions --------------------------------------------------------------------------------

UNIT_SQL = f"{P_SQL}, u AS (SELECT id, x / sqrt(x * x + y * y + z * z) AS nx, y / sqrt(x * x + y * y + z * z) AS ny, z / sqrt(x * x + y * y + z * z) AS nz FROM p), h AS (SELECT {', '.join(f'least(floor((n{a} + 1) / 2 * 11), 10)::INT AS i{a}' for a in XYZ)}, count(*) AS n FROM u GROUP BY ALL)"


def directions(spark, sf_dir):
    r = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    return A.normal_histogram(points(spark, sf_dir).select(*[(F.col(a) / r).alias(f"n{a}") for a in XYZ]), 11)


@query(f"{UNIT_SQL} SELECT ix, iy, iz, n FROM h")
def normal_histogram(spark, sf_dir):
    return directions(spark, sf_dir)


@query(f"{UNIT_SQL} SELECT ix, iy, iz, n FROM h a WHERE n >= 3 AND NOT EXISTS (SELECT 1 FROM h b WHERE abs(a.ix - b.ix) <= 1 AND abs(a.iy - b.iy) <= 1 AND abs(a.iz - b.iz) <= 1 AND (b.n > a.n OR b.n = a.n AND (b.ix, b.iy, b.iz) < (a.ix, a.iy, a.iz)))")
def histogram_modes(spark, sf_dir):
    return A.histogram_modes(directions(spark, sf_dir), 3)


@query(
    f"""{P_SQL}, d AS (SELECT * FROM (VALUES (0, 1.0, 0.0, 0.0), (1, 0.6, 0.8, 0.0), (2, 0.0, 0.6, -0.8), (3, 0.48, 0.6, 0.64)) t(direction, a, b, c)),
    b AS (SELECT direction, floor((x * a + y * b + z * c) / 0.0101)::BIGINT AS bin, count(*) FILTER (label % 2 = 0) AS na, count(*) FILTER (label % 2 = 1) AS nb FROM p, d GROUP BY ALL),
    s AS (SELECT direction, abs(sum(na) OVER w / sum(na) OVER (PARTITION BY direction) - sum(nb) OVER w / sum(nb) OVER (PARTITION BY direction)) * (lead(bin) OVER w - bin) * 0.0101 AS part FROM b WINDOW w AS (PARTITION BY direction ORDER BY bin))
    SELECT direction, round(sum(part), 6) AS distance FROM s GROUP BY direction"""
)
def sliced_distance(spark, sf_dir):
    p = points(spark, sf_dir)
    ways = [(1.0, 0.0, 0.0), (0.6, 0.8, 0.0), (0.0, 0.6, -0.8), (0.48, 0.6, 0.64)]
    return rounded(A.sliced_distance(p.where("label % 2 = 0"), p.where("label % 2 = 1"), ways, 0.0101), "distance")

"""Queries of the sparse solvers: one product, the sums they start from, tracks solved by elimination with their
variances, and tracks bent or laid onto fixes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from pointloom.functions import geometry, pose
from pointloom.operators import maps, scans, windows
from pointloom.plans import batches, elimination, planes, sessions, sparse, trackwise
from pointloom.plans.catalog import E_SQL, P_SQL, events, points, rounded
from pointloom.plans.registry import query
from pointloom.sources.store import stored

STEP_SQL = f"{E_SQL}, s AS (SELECT lag(event_id) OVER w AS a, event_id AS b, value / 100.7 AS v FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)), t AS (SELECT a, b, v FROM s WHERE a IS NOT NULL)"


def steps(spark, sf_dir):
    """Terms of a user's consecutive events, two unknowns an event: (-1, -v) of the one, (1, v) of the other
    (v by a divisor that leaves no exact halves to round)."""
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    rows = events(spark, sf_dir).select(F.lag("event_id").over(w).alias("a"), F.col("event_id").alias("b"), (F.col("value") / 100.7).alias("v")).where("a is not null")
    return rows.select(F.array("a", "b").alias("nodes"), F.array(F.lit(-1.0), -F.col("v"), F.lit(1.0), F.col("v")).alias("jac"), F.array("v").alias("res"), F.lit(1.0).alias("weight"))


@query(f"{STEP_SQL}, u AS (SELECT *, (b % 7 - a % 7) / 7.0 + v * (b % 3 - a % 3) AS u FROM t), y AS (SELECT a AS id, -u AS y0, -v * u AS y1 FROM u UNION ALL SELECT b, u, v * u FROM u) SELECT id, round(sum(y0), 6) AS y0, round(sum(y1), 6) AS y1 FROM y GROUP BY id")
def consistency_product(spark, sf_dir):
    """The step of a trajectory's consistency that crosses the cluster: its matrix times a vector."""
    s = sparse.system(sparse.summed(sparse.term_blocks(steps(spark, sf_dir), 2), 2), 2, inverse=False)
    ids = s.parts.select("p", F.sequence(F.col("p") * s.size, (F.col("p") + 1) * s.size - 1).alias("ids"))
    x = ids.select("p", F.flatten(F.transform("ids", lambda i: F.array(i % 7 / 7.0, (i % 3).cast("double")))).alias("v"))
    return sparse.product_rows(s, x).select((F.col("p") * s.size + F.col("i")).alias("id"), *[F.round(F.col("y")[k], 6).alias(f"y{k}") for k in (0, 1)])


def fixes(spark, sf_dir):
    """Events as one track (t in hours; x the value, y the user), every fifth with a fix beside it."""
    e = events(spark, sf_dir).where("value is not null")
    track = e.select("event_id", (F.col("us") / 3.6e9).alias("t"), F.col("value").alias("x"), F.col("user_id").cast("double").alias("y"), F.lit(0.0).alias("z"))
    off = [("fx", F.col("x") + F.col("t") / 1000), ("fy", F.col("y") + F.sin("t")), ("fz", F.lit(1.0))]
    return track, track.where("event_id % 5 = 0").select("t", "x", "y", "z", *[v.alias(n) for n, v in off], F.lit(2.0).alias("weight"))


@query(
    f"""{E_SQL}, m AS (SELECT us / 3.6e9 AS t, value AS x FROM e WHERE value IS NOT NULL AND event_id % 5 = 0), k AS (SELECT floor(t / 24)::BIGINT AS knot, t / 24 - floor(t / 24) AS s, t FROM m),
    c AS (SELECT knot AS "row", knot AS col, 2 * (1 - s) * (1 - s) AS value, 0.0 AS bx, 0.0 AS by FROM k UNION ALL SELECT knot + 1, knot + 1, 2 * s * s, 0, 0 FROM k UNION ALL SELECT knot, knot + 1, 2 * s * (1 - s), 0, 0 FROM k UNION ALL SELECT knot + 1, knot, 2 * s * (1 - s), 0, 0 FROM k)
    SELECT "row", col, round(sum(value), 5) AS value FROM c GROUP BY ALL
    UNION ALL SELECT "row", NULL, round(sum(value), 5) FROM (SELECT knot AS "row", 2 * (1 - s) * (t / 1000) AS value FROM k UNION ALL SELECT knot + 1, 2 * s * (t / 1000) FROM k) GROUP BY ALL"""
)
def knot_sums(spark, sf_dir):
    """Normal equations of a semi-rigid fusion: blocks between neighbouring knots, and the right side along x."""
    blocks = sparse.summed(sparse.term_blocks(sparse.fix_terms(fixes(spark, sf_dir)[1], "t", 24.0), 3), 3)
    return blocks.select("row", "col", F.round(F.col("value")[0], 5).alias("value"))


@query()
def bent_track(spark, sf_dir):
    """All events' track bent onto its fixes, with knots a day apart; tests compare it with a dense system."""
    track, matched = fixes(spark, sf_dir)
    out = sparse.bent_onto(track, matched, "t", 24.0, 0.1)
    return out.select("event_id", *[F.round(c, 5).alias(c) for c in ("x", "y", "cx", "cy")])


@query(
    f"""{E_SQL}, v AS (SELECT *, coalesce(value, 0) / 50 AS yaw, coalesce(value, 0) / 100 AS tx, user_id / 1000 AS ty FROM e),
    h AS (SELECT *, sum(yaw) OVER w - yaw AS h FROM v WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING))
    SELECT user_id, event_id, round(sum(cos(h) * tx - sin(h) * ty) OVER w, 5) AS x, round(sum(sin(h) * tx + cos(h) * ty) OVER w, 5) AS y FROM h WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING)"""
)
def chained_poses(spark, sf_dir):
    """Steps and turns of each user chained to places; in the plane that is a sum of turned steps."""
    zero, v = F.lit(0.0), F.coalesce(F.col("value"), F.lit(0.0))
    e = events(spark, sf_dir).withColumn("relative", pose.from_tait_bryan(v / 100, F.col("user_id") / 1000, zero, zero, zero, v / 50))
    out = windows.chained_poses(e, ["user_id"], ["us", "event_id"])
    return out.select("user_id", "event_id", F.round(F.col("pose")[3], 5).alias("x"), F.round(F.col("pose")[7], 5).alias("y"))


@query(
    f"""{E_SQL.replace('WITH e', 'WITH RECURSIVE e')}, s AS (SELECT user_id, event_id, row_number() OVER w AS i, event_type, floor(coalesce(abs(value - lag(value) OVER w), 0) / 1e-9 + 0.5)::BIGINT AS d FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
    r AS (SELECT user_id, event_id, i, 0::BIGINT AS gone, false AS took FROM s WHERE i = 1
      UNION ALL SELECT s.user_id, s.event_id, s.i, CASE WHEN r.gone + s.d >= 250000000000 AND s.event_type = 'click' THEN 0 ELSE r.gone + s.d END, r.gone + s.d >= 250000000000 AND s.event_type = 'click' FROM r JOIN s ON s.user_id = r.user_id AND s.i = r.i + 1)
    SELECT user_id, event_id FROM r WHERE took"""
)
def spaced_matches(spark, sf_dir):
    """A user's clicks at least 250 of value travelled apart, in whole billionths as ``segment_by_distance``."""
    e = events(spark, sf_dir).withColumn("m", F.when(F.col("event_type") == "click", 1))
    return windows.spaced_matches(e, ["user_id"], ["us", "event_id"], ["value"], "m", 250.0).select("user_id", "event_id")


@query(
    f"""{P_SQL}, s AS (SELECT *, x - 0.05 AS dx, y + 0.02 AS dy, z - 0.01 AS dz FROM p), r AS (SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS r FROM s),
    k AS (SELECT *, floor(r / 0.1)::INT AS ir, floor(degrees(acos(greatest(-1, least(1, dz / r)))) / 30)::INT AS it, floor(degrees(atan2(dy, dx)) / 30)::INT AS ip FROM r)
    SELECT ir, it, ip, count(*) AS n, round(avg(x), 6) AS mean_x, round(avg(y), 6) AS mean_y, round(avg(z), 6) AS mean_z, round(covar_pop(x, x), 6) AS cov_xx, round(covar_pop(x, y), 6) AS cov_xy, round(covar_pop(x, z), 6) AS cov_xz, round(covar_pop(y, y), 6) AS cov_yy, round(covar_pop(y, z), 6) AS cov_yz, round(covar_pop(z, z), 6) AS cov_zz
    FROM k GROUP BY ir, it, ip HAVING count(*) >= 3"""
)
def ray_cells(spark, sf_dir):
    """Sums of points by ray and range about a place, on which the spherical refinement stands."""
    out = sparse.ray_gaussians(points(spark, sf_dir), (0.05, -0.02, 0.01), 0.1, 30.0, 3)
    return rounded(out, *[f"mean_{a}" for a in "xyz"], *[f"cov_{c}" for c in ("xx", "xy", "xz", "yy", "yz", "zz")])


def tracks(spark, sf_dir):
    """Events numbered user by user in time order: n, whether it begins a user, and the step from the one before."""
    own = Window.partitionBy("user_id").orderBy("us", "event_id")
    e = scans.numbered(events(spark, sf_dir), ["user_id", "us", "event_id"])
    return stored(e.withColumn("begins", F.row_number().over(own) == 1).withColumn("v", F.coalesce("value", F.lit(0.0)) / 100.7), "tracks")


@query(
    f"""{E_SQL}, v AS (SELECT event_id, user_id, row_number() OVER w = 1 AS begins, coalesce(value, 0) / 100.7 AS v, 1 + event_id % 3 AS weight, us FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id))
    SELECT event_id, round(sum(CASE WHEN begins THEN user_id / 10 ELSE v END) OVER w, 5) AS x, round(sum(CASE WHEN begins THEN 0.25 ELSE 1 / weight END) OVER w, 6) AS variance FROM v WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING)"""
)
def track_variances(spark, sf_dir):
    """Each user's events as a track with a known start, solved by elimination: where each event lies, and its
    variance, which along a track is the sum of those of its steps."""
    t = tracks(spark, sf_dir)
    one = F.array(F.lit(1.0))
    starts = t.where("begins").select(F.array("n", "n").alias("nodes"), F.array(F.lit(1.0), F.lit(0.0)).alias("jac"), F.array(F.col("user_id") / 10).alias("res"), F.lit(4.0).alias("weight"))
    ways = t.where("NOT begins").select(F.array(F.col("n") - 1, "n").alias("nodes"), F.concat(F.array(F.lit(-1.0)), one).alias("jac"), F.array("v").alias("res"), (1.0 + F.col("event_id") % 3).alias("weight"))
    out = elimination.solution(sparse.summed(sparse.term_blocks(starts.unionByName(ways), 1), 1), 1, covariances=True)
    return out.join(t.select(F.col("n").alias("id"), "event_id"), "id").select("event_id", F.round(F.col("x")[0], 5).alias("x"), F.round(F.col("covariance")[0], 6).alias("variance"))


@query(
    f"""{E_SQL}, v AS (SELECT *, coalesce(value, 0) / 50 AS yaw, coalesce(value, 0) / 100 AS tx, user_id / 1000 AS ty FROM e),
    h AS (SELECT *, sum(yaw) OVER w - yaw AS h FROM v WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING))
    SELECT event_id, round(sum(cos(h) * tx - sin(h) * ty) OVER w, 4) AS x, round(sum(sin(h) * tx + cos(h) * ty) OVER w, 4) AS y FROM h WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING)"""
)
def closed_tracks(spark, sf_dir):
    """A pose graph: each user's track has drifted, its steps and the loop from its first to its last event
    are known, its start is held; all tracks come back to where their steps put them."""
    zero, v = F.lit(0.0), F.coalesce(F.col("value"), F.lit(0.0))
    relative = pose.from_tait_bryan(v / 100, F.col("user_id") / 1000, zero, zero, zero, v / 50)
    e = scans.numbered(events(spark, sf_dir).drop("event_type"), ["user_id", "us", "event_id"])
    t = windows.chained_poses(e, ["user_id"], ["us", "event_id"], relative, begins="begins")
    off = pose.from_tait_bryan(F.sin("n") / 20, F.cos("n") / 20, zero, zero, zero, F.sin(F.col("n") * 2) / 50)
    drifted = t.select(F.col("user_id").alias("track"), F.col("n").alias("id"), F.when(F.col("begins"), F.col("pose")).otherwise(pose.product("pose", off)).alias("pose"), "event_id")
    ways = t.where("NOT begins").select(F.col("user_id").alias("track"), (F.col("n") - 1).alias("a"), F.col("n").alias("b"), relative.alias("measured"), F.lit(1.0).alias("weight"))
    at = lambda f: F.array(*[f(F.col("pose")[i], "n") for i in range(16)])  # noqa: E731  number by number: whole lists would have all rows sorted
    ends = t.groupBy(F.col("user_id").alias("track")).agg(F.min("n").alias("a"), F.max("n").alias("b"), at(F.min_by).alias("start"), at(F.max_by).alias("end"))
    loops = ends.where("b > a + 1").select("track", "a", "b", pose.product(pose.inverse("start"), "end").alias("measured"), F.lit(5.0).alias("weight"))
    out = trackwise.consistent(drifted, ways.unionByName(loops), hold=1e6, rounds=8, tolerance=1e-6)
    return out.select("event_id", F.round(F.col("pose")[3], 4).alias("x"), F.round(F.col("pose")[7], 4).alias("y"))


PLANE_SQL = "m AS (SELECT id % 7 AS a, 7 + id % 5 AS b, x, y, z, x - z AS dx, y - x AS dy, z - y AS dz FROM p), r AS (SELECT *, 0.6 * dy + 0.8 * dz AS r FROM m), j AS (SELECT *, 1 / (1 + 4 * r * r) * 4 AS w, [0, 0.6, 0.8, y * 0.8 - z * 0.6, -x * 0.8, x * 0.6] AS j FROM r)"


@query(
    f"""{P_SQL}, {PLANE_SQL}, k AS (SELECT unnest(range(1, 7)) AS i),
    t AS (SELECT a AS "row", a AS col, i - 1 AS i, w * j[i] * j[6] AS v FROM j, k UNION ALL SELECT b, b, i - 1, w * j[i] * j[6] FROM j, k UNION ALL SELECT a, b, i - 1, -w * j[i] * j[6] FROM j, k UNION ALL SELECT b, a, i - 1, -w * j[i] * j[6] FROM j, k
      UNION ALL SELECT a, NULL, i - 1, -w * r * j[i] FROM j, k UNION ALL SELECT b, NULL, i - 1, w * r * j[i] FROM j, k)
    SELECT "row", col, i, round(sum(v), 6) AS value FROM t GROUP BY ALL"""
)
def plane_sums(spark, sf_dir):
    """Normal equations of points against planes by scan and pair of scans: the last column of each block, and
    the right sides."""
    p = points(spark, sf_dir)
    slope, flat = (F.array(*[F.lit(v) for v in n]) for n in ((0.6, 0.8, 0.0), (0.0, 0.6, 0.8)))
    m = p.select((F.col("id") % 7).alias("a"), (7 + F.col("id") % 5).alias("b"), F.array("x", "y", "z").alias("pa"), slope.alias("na"), F.array("z", "x", "y").alias("pb"), flat.alias("nb"), F.lit(4.0).alias("weight"))
    still = m.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("pose", F.array(*[F.lit(1.0 if i % 5 == 0 else 0.0) for i in range(16)]))
    blocks = sparse.summed(sparse.term_blocks(planes.plane_terms(still, m, "point_to_plane"), 6), 6)
    last = F.when(F.col("col").isNull(), F.col("value")).otherwise(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.col("value")[i * 6 + 5]))
    return blocks.select("row", "col", F.posexplode(last).alias("i", "value")).withColumn("value", F.round("value", 6))


@query(
    f"""{P_SQL}, k AS (SELECT id % 10 AS scan_id, x, y, z, sqrt(x * x + y * y + z * z) AS r FROM p),
    l AS (SELECT 'fine' AS level, 0.15 AS size UNION ALL SELECT 'coarse', 0.3),
    c AS (SELECT level, size, scan_id, x, y, z, r, floor(x / size)::INT AS ix, floor(y / size)::INT AS iy, floor(z / size)::INT AS iz FROM k, l),
    g AS (SELECT level, ix, iy, iz, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, covar_pop(x, x) + (0.05 * any_value(size)) ** 2 AS xx, covar_pop(x, y) AS xy, covar_pop(x, z) AS xz, covar_pop(y, y) + (0.05 * any_value(size)) ** 2 AS yy, covar_pop(y, z) AS yz, covar_pop(z, z) + (0.05 * any_value(size)) ** 2 AS zz FROM c GROUP BY ALL HAVING count(*) > 5),
    h AS (SELECT c.scan_id, mx - x AS dx, my - y AS dy, mz - z AS dz, g.* FROM c JOIN g USING (level, ix, iy, iz) WHERE r BETWEEN 0.1 AND 70 AND (level = 'fine' OR r >= 0.2)),
    q AS (SELECT *, xx * (yy * zz - yz * yz) - xy * (xy * zz - yz * xz) + xz * (xy * yz - yy * xz) AS det FROM h)
    SELECT scan_id, 3 * count(*) AS n, round(sum((dx * dx * (yy * zz - yz * yz) + dy * dy * (xx * zz - xz * xz) + dz * dz * (xx * yy - xy * xy) + 2 * (dx * dy * (xz * yz - xy * zz) + dx * dz * (xy * yz - xz * yy) + dy * dz * (xy * xz - xx * yz))) / det), 5) AS misfit FROM q GROUP BY scan_id"""
)
def two_map_probe(spark, sf_dir):
    """Points of each scan against a fine and a coarse map in one join: how many equations they give, and their
    squared misfit in the voxels' own metric."""
    p = points(spark, sf_dir).select((F.col("id") % 10).alias("scan_id"), "id", "x", "y", "z")
    sizes = {"fine": 0.15, "coarse": 0.3}
    levels = {n: (maps.voxel_gaussians(maps.voxel_sums(p, size), size, 5), size) for n, size in sizes.items()}
    rows = batches.probed(p, {k: np.eye(4) for k in range(10)}, batches.two_level_map(levels, 5), sizes, far=0.2)
    return rows.groupBy("scan_id").agg(F.count("*").alias("n"), F.round(F.sum(F.col("res") * F.col("res")), 5).alias("misfit"))


@query(
    """WITH e AS (SELECT epoch_us(ts) AS us, min(event_id) AS event_id, min_by(coalesce(value, 0) / 100, event_id) AS x, min_by(user_id / 100, event_id) AS y FROM events GROUP BY ts)
    SELECT event_id, round(cos(0.3) * x - sin(0.3) * y + 2, 5) AS x, round(sin(0.3) * x + cos(0.3) * y - 1, 5) AS y, round(sin(us / 1e9) + 0.5, 5) AS z FROM e"""
)
def rigid_fusion(spark, sf_dir):
    """A trajectory laid onto satellite fixes that show it turned and moved."""
    e = events(spark, sf_dir).groupBy("us").agg(F.min("event_id").alias("event_id"), F.min_by(F.coalesce("value", F.lit(0.0)) / 100, "event_id").alias("x"), F.min_by(F.col("user_id") / 100, "event_id").alias("y"))
    z = F.sin(F.col("us") / 1e9)
    zero, one = F.lit(0.0), F.lit(1.0)
    track = e.select(F.col("us").alias("ts"), "event_id", F.array(one, zero, zero, F.col("x"), zero, one, zero, F.col("y"), zero, zero, one, z, zero, zero, zero, one).alias("pose"))
    c, s = float(np.cos(0.3)), float(np.sin(0.3))
    fixes = e.select(F.col("us").alias("ts"), (c * F.col("x") - s * F.col("y") + 2).alias("x"), (s * F.col("x") + c * F.col("y") - 1).alias("y"), (z + 0.5).alias("z"))
    out, _ = sessions.fused_with_fixes(stored(track, "track"), stored(fixes, "fixes"), 1)
    return out.select("event_id", *[F.round(F.col("pose")[i], 5).alias(a) for a, i in zip("xyz", (3, 7, 11))])


def seen_from(p, key, poses):
    """Points as scanners at known poses see them: (key, id, x, y, z) in each one's own frame."""
    at = p.crossJoin(F.broadcast(poses)).withColumn("__p", geometry.transform(pose.inverse("true_pose"), "x", "y", "z"))  # poses: a handful of stated rows
    return at.select(key, "id", *[F.col(f"__p.{a}").alias(a) for a in "xyz"])


@query(f"{P_SQL} SELECT k AS scan_id, id, round(x, 4) AS x, round(y, 4) AS y, round(z, 4) AS z FROM p, range(4) r(k)")
def joined_sessions(spark, sf_dir):
    """Two sessions of two scans each of the same points, the second one displaced as a whole: edges between them
    bring every point back to where it is."""
    k, zero = F.col("id").cast("double"), F.lit(0.0)
    true = spark.range(4).select(F.col("id").alias("scan_id"), F.when(F.col("id") < 2, 0).otherwise(1).alias("session"), k.alias("ts"), pose.from_tait_bryan(k / 5, -k / 10, zero, zero, zero, k / 10).alias("true_pose"))
    off = pose.from_tait_bryan(F.lit(0.004), F.lit(-0.003), F.lit(0.002), F.lit(0.004), F.lit(-0.003), F.lit(0.005))
    given = true.withColumn("pose", F.when(F.col("session") == 1, pose.product(off, "true_pose")).otherwise(F.col("true_pose")))
    own = stored(seen_from(points(spark, sf_dir).select("id", "x", "y", "z"), "scan_id", true), "scans")
    joined = sessions.sessions_joined(own, given.select("session", "scan_id", "ts", "pose"), 1.0, 0.05)
    out = sessions.session_points(own, joined)
    return out.select("scan_id", "id", *[F.round(a, 4).alias(a) for a in "xyz"])


@query(f"{P_SQL} SELECT k::INT AS lidar_id, id, round(x, 4) AS x, round(y, 4) AS y, round(z, 4) AS z FROM p, range(2) r(k)")
def two_sensors(spark, sf_dir):
    """Two sensors that see the same points, the second one mounted a little off: calibrated, both agree."""
    zero = F.lit(0.0)
    mount = F.when(F.col("id") == 1, pose.from_tait_bryan(F.lit(0.003), F.lit(-0.002), F.lit(0.004), F.lit(-0.005), F.lit(0.003), F.lit(0.002))).otherwise(pose.from_tait_bryan(*[zero] * 6))
    sensors = spark.range(2).select(F.col("id").cast("int").alias("lidar_id"), mount.alias("true_pose"))
    own = stored(seen_from(points(spark, sf_dir).select("id", "x", "y", "z"), "lidar_id", sensors), "sensors")
    found = sessions.calibrated_sensors(own, 1e-6, 0.05)
    m = F.array(*[F.lit(float(v)) for v in found.ravel()])
    moved = own.withColumn("__p", F.when(F.col("lidar_id") == 0, F.struct("x", "y", "z")).otherwise(geometry.transform(m, "x", "y", "z")))
    return moved.select("lidar_id", "id", *[F.round(f"__p.{a}", 4).alias(a) for a in "xyz"])

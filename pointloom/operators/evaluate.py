"""How far a trajectory is from the true one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointloom.functions import pose as P
from pointloom.operators.joins import asof_join


def with_truth(estimated: DataFrame, truth: DataFrame, ts: str = "ts_ns", by: list[str] | None = None) -> DataFrame:
    """Estimated poses with the true pose interpolated at their times (true_pose); those outside it go."""
    by = by or []
    t = truth.select(*by, ts, "pose")
    q = asof_join(asof_join(estimated, t, ts, ts, by, prefix="__a_"), t, ts, ts, by, "forward", prefix="__b_")
    q = q.where(F.col(f"__a_{ts}").isNotNull() & F.col(f"__b_{ts}").isNotNull())
    part = F.coalesce(F.try_divide((F.col(ts) - F.col(f"__a_{ts}")).cast("double"), (F.col(f"__b_{ts}") - F.col(f"__a_{ts}")).cast("double")), F.lit(0.0))
    q = q.withColumn("__part", part).withColumn("true_pose", P.interpolate("__a_pose", "__b_pose", "__part"))
    return q.select(*estimated.columns, "true_pose")


def _angle(m) -> F.Column:
    return P.held(lambda v: F.sqrt(v["sx"] * v["sx"] + v["sy"] * v["sy"] + v["sz"] * v["sz"]), P.to_rodrigues(m))


def ate(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Absolute errors of poses with true_pose: of the translation (root mean square, mean, most), of
    the rotation, and the Frobenius norm of the whole difference."""
    p, t = F.col("pose"), F.col("true_pose")
    move = F.sqrt((p[3] - t[3]) * (p[3] - t[3]) + (p[7] - t[7]) * (p[7] - t[7]) + (p[11] - t[11]) * (p[11] - t[11]))
    whole = F.sqrt(F.aggregate(F.zip_with("pose", "true_pose", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
    rows = pairs.select(*(by or []), move.alias("t"), _angle(P.product(P.inverse("true_pose"), "pose")).alias("r"), whole.alias("w"))
    return rows.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.sqrt(F.avg(F.col("t") * F.col("t"))).alias("ate_rmse"), F.avg("t").alias("ate_mean"), F.max("t").alias("ate_max"), F.avg("r").alias("rotation_mean"), F.avg("w").alias("ate_frobenius"), F.min("w").alias("frobenius_min"), F.max("w").alias("frobenius_max"))


def rpe(pairs: DataFrame, delta: int = 1, ts: str = "ts_ns", by: list[str] | None = None) -> DataFrame:
    """Relative errors over ``delta`` rows: what the motion between two poses misses of the true one."""
    w = Window.partitionBy(*(by or [])).orderBy(ts)
    q = pairs.withColumn("__p", F.lag("pose", delta).over(w)).withColumn("__t", F.lag("true_pose", delta).over(w)).where("__p is not null")
    q = q.withColumn("__e", P.product(P.inverse(P.product(P.inverse("__t"), "true_pose")), P.product(P.inverse("__p"), "pose")))
    e = F.col("__e")
    rows = q.select(*(by or []), F.sqrt(e[3] * e[3] + e[7] * e[7] + e[11] * e[11]).alias("t"), _angle("__e").alias("r"))
    return rows.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.sqrt(F.avg(F.col("t") * F.col("t"))).alias("rpe_rmse"), F.max("t").alias("rpe_max"), F.avg("r").alias("rotation_mean"))

"""Window operators over ordered rows of a key, and the few that are inherently sequential."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointloom.functions import pose as P
from pointloom.operators.scans import chained_poses, greedy_segments, spaced_matches, thinned  # noqa: F401


def batches(rows: DataFrame, keys: list[str], order: list[str], size: int = 20, least: int | None = None) -> DataFrame:
    """Adds batch: consecutive runs of ``size`` rows; an incomplete last one is left out, as are
    batches with at most ``least`` rows."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = rows.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size).cast("long"))
    n = F.count("*").over(Window.partitionBy(*keys, "batch"))
    return out.withColumn("__n", n).where(F.col("__n") >= size if least is None else F.col("__n") > least).drop("__n")


def motion_edges(rows: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """Every row after the first of its key with the differences to the row before."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = rows.withColumns({f"d_{v}": F.col(v) - F.lag(v).over(w) for v in values}).withColumn("__n", F.row_number().over(w))
    return out.where("__n > 1").drop("__n")


def relative_poses(rows: DataFrame, keys: list[str], order: list[str], pose: str = "pose") -> DataFrame:
    """Adds relative = inverse(previous) * current; null for the first row of a key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    before = F.lag(pose).over(w)
    return rows.withColumn("__before", before).withColumn("relative", F.when(F.col("__before").isNotNull(), P.product(P.inverse("__before"), pose))).drop("__before")


def cumulative_offset(rows: DataFrame, keys: list[str], order: list[str], n: str, name: str = "offset") -> DataFrame:
    """Adds the sum of ``n`` over the rows before."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, F.coalesce(F.sum(n).over(w), F.lit(0)))


def path_length(rows: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """Sum of the distances between consecutive rows of a key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    steps = rows.select(*keys, *[(F.col(v) - F.lag(v).over(w)).alias(f"__{i}") for i, v in enumerate(values)])
    square = sum((F.col(f"__{i}") * F.col(f"__{i}") for i in range(1, len(values))), F.col("__0") * F.col("__0"))
    return steps.groupBy(*keys).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.sqrt(square)), F.lit(0.0)).alias("length"))


def predicted(rows: DataFrame, keys: list[str], order: list[str], values: list[str], most: float = 1.0) -> DataFrame:
    """Adds step_v: the motion between the two rows before (zero if longer than ``most``)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    d = {v: F.lag(v, 1).over(w) - F.lag(v, 2).over(w) for v in values}
    out = rows.withColumns({f"step_{v}": d[v] for v in values})
    square = sum((F.col(f"step_{v}") * F.col(f"step_{v}") for v in values[1:]), F.col(f"step_{values[0]}") * F.col(f"step_{values[0]}"))
    far = square > most * most
    return out.withColumn("__far", far).withColumns({f"step_{v}": F.when(F.col("__far"), 0.0).otherwise(F.col(f"step_{v}")) for v in values}).drop("__far")


def curves(rows: DataFrame, keys: list[str], order: list[str], x: str, y: str, reach: int = 100, degrees: float = 10.0) -> DataFrame:
    """Adds in_curve: the headings to and from the rows ``reach`` away differ by more than ``degrees``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    ax, ay = F.col(x) - F.lag(x, reach).over(w), F.col(y) - F.lag(y, reach).over(w)
    bx, by = F.lead(x, reach).over(w) - F.col(x), F.lead(y, reach).over(w) - F.col(y)
    turn = F.abs(F.atan2(ax * by - ay * bx, ax * bx + ay * by))
    return rows.withColumn("in_curve", F.coalesce(turn > F.radians(F.lit(degrees)), F.lit(False)))


def entries(rows: DataFrame, keys: list[str], order: list[str], inside) -> DataFrame:
    """Rows at which ``inside`` (a condition) turns true."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = rows.withColumn("__in", F.coalesce(inside, F.lit(False))).withColumn("__was", F.coalesce(F.lag("__in").over(w), F.lit(False)))
    return out.where("__in and not __was").drop("__in", "__was")


def integrated(rows: DataFrame, keys: list[str], order: str, rate: str, method: str = "euler", most_dt: float = 0.1) -> DataFrame:
    """Adds dt and integral: the running integral of ``rate`` over ``order`` (seconds).

    Steps of no positive length count nothing, longer ones than ``most_dt`` as that long.
    ``trapezoid`` takes the mean of both ends, ``euler`` the row's own rate.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    dt = F.col(order) - F.lag(order).over(w)
    out = rows.withColumn("dt", F.when(dt > 0, F.least(dt, F.lit(most_dt))).otherwise(0.0))
    own = F.col(rate) if method == "euler" else (F.col(rate) + F.coalesce(F.lag(rate).over(w), F.col(rate))) / 2
    return out.withColumn("__part", own * F.col("dt")).withColumn("integral", F.sum("__part").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__part")


def uniform_times(rows: DataFrame, keys: list[str], order: list[str], start: str, step: float, name: str = "ts") -> DataFrame:
    """Rewrites times to start + k * step inside a batch."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn(name, F.first(start).over(w) + (F.row_number().over(w) - 1) * F.lit(step))


def every_nth(rows: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w) - 1).where(F.col("__n") % n == 0).drop("__n")


def orientation(rows: DataFrame, keys: list[str], order: str = "ts", gain: float = 0.5) -> DataFrame:
    """Adds qw..qz: attitude from gyro (gx, gy, gz, rad/s) and accelerometer (ax, ay, az), by a
    gradient-corrected quaternion filter, sample by sample."""
    schema = T.StructType(list(rows.schema))  # a copy: add() changes its own
    for q in ("qw", "qx", "qy", "qz"):
        schema = schema.add(q, "double")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        q, out, last = np.array([1.0, 0, 0, 0]), [], None
        for t, gx, gy, gz, ax, ay, az in pdf[[order, "gx", "gy", "gz", "ax", "ay", "az"]].to_numpy(float):
            dt = 0.0 if last is None else min(max(t - last, 0.0), 0.1)
            last = t
            w, x, y, z = q
            rate = 0.5 * np.array([-x * gx - y * gy - z * gz, w * gx + y * gz - z * gy, w * gy - x * gz + z * gx, w * gz + x * gy - y * gx])
            n = np.sqrt(ax * ax + ay * ay + az * az)
            if n > 0:
                f = np.array([2 * (x * z - w * y) - ax / n, 2 * (w * x + y * z) - ay / n, 2 * (0.5 - x * x - y * y) - az / n])
                jac = np.array([[-2 * y, 2 * z, -2 * w, 2 * x], [2 * x, 2 * w, 2 * z, 2 * y], [0, -4 * x, -4 * y, 0]])
                g = jac.T @ f
                if (m := np.linalg.norm(g)) > 0:
                    rate = rate - gain * g / m
            q = q + rate * dt
            q = q / np.linalg.norm(q)
            out.append(q)
        return pdf.assign(**dict(zip(("qw", "qx", "qy", "qz"), np.array(out).reshape(-1, 4).T)))

    return rows.groupBy(*keys).applyInPandas(run, schema)


def to_first_frame(rows: DataFrame, keys: list[str], order: list[str], pose: str = "pose") -> DataFrame:
    """Poses of every key in the frame of its first one, which becomes the identity."""
    first = rows.groupBy(*keys).agg(F.min_by(pose, F.struct(*order)).alias("__first"))
    return rows.join(first, keys).withColumn(pose, P.product(P.inverse("__first"), pose)).drop("__first")


def seed_rows(rows: DataFrame, order: list[str], ts: str, n: int = 10_001) -> tuple[DataFrame, DataFrame]:
    """The first ``n`` rows of all, and one row with their number and last time: the cloud that a map starts from."""
    first = rows.orderBy(*order).limit(n)
    return first, first.agg(F.count("*").alias("n"), F.max(ts).alias("last"))


def point_batches(rows: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """Adds batch: consecutive runs of ``n`` + 1 rows of a key; a shorter last one is left out."""
    return batches(rows, keys, order, n + 1)


def rotation_gaps(nodes: DataFrame, keys: list[str], order: list[str], pose: str = "pose", measured: str = "imu_pose") -> DataFrame:
    """Adds gap: the angle between a node's rotation since the one before and the measured one; null
    for a key's first."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = nodes.withColumn("__a", F.lag(pose).over(w)).withColumn("__b", F.lag(measured).over(w))
    a, b, p, q = (F.col(c) for c in ("__a", "__b", pose, measured))
    turned = lambda m, n, i, j: m[i] * n[j] + m[4 + i] * n[4 + j] + m[8 + i] * n[8 + j]
    # the trace of both rotations' difference; columns of the window's rows, so nothing is worked out twice
    trace = sum((turned(a, p, i, j) * turned(b, q, i, j) for i in range(3) for j in range(3) if i or j), turned(a, p, 0, 0) * turned(b, q, 0, 0))
    gap = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (trace - 1) / 2)))
    return out.withColumn("gap", F.when(a.isNotNull(), gap)).drop("__a", "__b")


def dead_reckoned(rows: DataFrame, keys: list[str], order: str, acc: tuple[str, str, str] = ("ax", "ay", "az"), method: str = "euler", most_dt: float = 0.1, most_acc: float = 50.0) -> DataFrame:
    """Adds vx.. and px..: velocity and place from accelerations (m/s^2) in one frame.

    Steps of no positive length count nothing, longer ones than ``most_dt`` as that long.  An
    acceleration that isn't finite or has a norm from ``most_acc`` on is invalid: 0 for ``euler``, the
    last valid one for ``trapezoid``, which also takes the mean of both ends.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    dt = F.col(order) - F.lag(order).over(w)
    square = sum(F.col(a) * F.col(a) for a in acc)
    out = rows.withColumn("dt", F.when(dt > 0, F.least(dt, F.lit(most_dt))).otherwise(0.0)).withColumn("__ok", F.coalesce((square < most_acc * most_acc) & ~F.isnan(square), F.lit(False)))
    own = {}
    for a, name in zip(acc, "xyz"):
        valid = F.when(F.col("__ok"), F.col(a))
        own[name] = valid if method == "euler" else F.last(valid, ignorenulls=True).over(run)
    out = out.withColumns({f"__a{n}": F.coalesce(v, F.lit(0.0)) for n, v in own.items()})
    if method == "trapezoid":
        out = out.withColumns({f"__a{n}": (F.col(f"__a{n}") + F.coalesce(F.lag(f"__a{n}").over(w), F.col(f"__a{n}"))) / 2 for n in "xyz"})
    out = out.withColumns({f"v{n}": F.sum(F.col(f"__a{n}") * F.col("dt")).over(run) for n in "xyz"})
    step = lambda n: F.col(f"v{n}") if method == "euler" else (F.col(f"v{n}") + F.coalesce(F.lag(f"v{n}").over(w), F.lit(0.0))) / 2
    out = out.withColumns({f"__s{n}": step(n) * F.col("dt") for n in "xyz"})
    return out.withColumns({f"p{n}": F.sum(f"__s{n}").over(run) for n in "xyz"}).drop("__ok", *[f"__{k}{n}" for k in "as" for n in "xyz"])


def kalman_track(rows: DataFrame, keys: list[str], order: str, acc: tuple[str, str, str] = ("ax", "ay", "az"), noise: float = 0.5, drift: float = 1.0, most_dt: float = 0.1, most_acc: float = 50.0) -> DataFrame:
    """Adds px.., vx..: a filter over place, velocity and acceleration that measures accelerations.

    The three axes are alike and independent, so one 3x3 covariance serves all; invalid accelerations
    measure 0.  It is recursive in a key, hence one pass of numpy a key over fixed-size state.
    """
    schema = T.StructType(list(rows.schema))  # a copy: add() changes its own
    for n in ("px", "py", "pz", "vx", "vy", "vz"):
        schema = schema.add(n, "double")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        t, a = pdf[order].to_numpy(float), pdf[list(acc)].to_numpy(float)
        a = np.where((np.isfinite(a).all(axis=1) & (np.linalg.norm(a, axis=1) < most_acc))[:, None], a, 0.0)
        step = np.clip(np.diff(t, prepend=t[:1]), 0, most_dt)
        state, cov, out = np.zeros((3, 3)), np.eye(3), np.zeros((len(t), 6))
        for k in range(len(t)):
            d = step[k]
            f = np.array([[1, d, d * d / 2], [0, 1, d], [0, 0, 1]])
            state, cov = f @ state, f @ cov @ f.T + drift * d * np.diag([0, 0, 1.0])
            gain = cov[:, 2] / (cov[2, 2] + noise * noise)
            state, cov = state + gain[:, None] * (a[k] - state[2]), cov - np.outer(gain, cov[2])
            out[k] = state[:2].ravel()
        return pdf.assign(**dict(zip(("px", "py", "pz", "vx", "vy", "vz"), out.T)))

    return rows.groupBy(*keys).applyInPandas(run, schema)

"""Odometry of a recording: every pose of a batch is solved for on a fine and a coarse map that grow.

Points meet the pose before them by an as-of join in pieces of time; poses are numbered by ranges; each
batch of poses is then registered (``batches.register_batch``: points against both maps, the motion between
poses kept) from where the last one ended, and its points are added to the maps.  Batches depend on each
other, so they are a loop; of a batch only its poses and six sums each come to the driver.

Once the way since the last rebuild exceeds ``rebuild_metres``, the maps are made anew from the newer half of
the batches since then, so they hold what is near and not the whole recording.  All results go to one folder
and come back from it.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.functions.geometry import transform
from pointloom.operators import maps, scans
from pointloom.operators.joins import asof_join
from pointloom.plans.batches import Batch, Motion, register_batch, two_level_map
from pointloom.plans.registration import posed
from pointloom.sources.register import register
from pointloom.sources.store import dropped, stored


@dataclass(frozen=True)
class Settings:
    per_batch: int = 20
    fine: float = 0.3
    coarse: float = 0.8
    more_than: int = 5
    rounds: int = 20
    #: A batch with at most so many points is not registered: its poses follow the trajectory.
    least_points: int = 1000
    #: Points further in time from the pose before them take no part; pieces in which the join orders time.
    tolerance_ns: int = 10_000_000
    piece_ns: int = 10_000_000_000
    rebuild_metres: float = 20.0
    motion: Motion = field(default_factory=Motion)


def matched(points: DataFrame, trajectory: DataFrame, s: Settings) -> DataFrame:
    """Points (id, ts_ns, x, y, z) with scan_id, the number of the pose strictly before them, and its batch, stored
    by batch."""
    t = trajectory.select("ts_ns", F.col("n").alias("scan_id"))
    hit = asof_join(points, t, "ts_ns", "ts_ns", strict=True, tolerance=s.tolerance_ns, bucket=s.piece_ns, prefix="__t_").where("__t_scan_id is not null")
    rows = hit.select(F.col("__t_scan_id").alias("scan_id"), "id", "x", "y", "z", F.floor(F.col("__t_scan_id") / s.per_batch).alias("batch"))
    return stored(rows.repartitionByRange("batch").sortWithinPartitions("batch"), "matched")  # row groups know their batches


def followed(points: DataFrame, trajectory: DataFrame, settings: Settings = Settings()) -> tuple[DataFrame, list[dict]]:
    """(ts_ns, scan_id, pose) of every pose of ``trajectory`` (ts_ns, pose), and a report a batch."""
    s, spark = settings, points.sparkSession
    track = stored(scans.numbered(trajectory.select("ts_ns", "pose"), ["ts_ns"]), "track")
    own = matched(points, track, s)
    counts = {r["batch"]: r["count"] for r in own.groupBy("batch").count().collect()}  # a row a batch
    n = track.count()
    sizes = {"fine": s.fine, "coarse": s.coarse}
    world: dict[str, DataFrame] = {}
    kept: list[tuple[int, dict[int, np.ndarray], float]] = []  # batches in the maps, with the way at their end
    out, report, last, way, since = [], [], None, 0.0, 0.0

    def add(rows: DataFrame, poses: dict[int, np.ndarray]) -> None:
        for name, size in sizes.items():
            sums = maps.voxel_sums(posed(rows, poses), size)
            before = world.get(name)
            world[name] = stored(sums if before is None else maps.merged(before, sums), f"map-{name}")
            if before is not None:
                dropped(before)

    for b in range(-(-n // s.per_batch)):
        given = {r["n"]: np.reshape(r["pose"], (4, 4)) for r in track.where(F.floor(F.col("n") / s.per_batch) == b).collect()}  # a batch of poses
        keys = sorted(given)
        model = given
        if last is not None:  # the trajectory's motion from where the last batch ended
            move = last[1] @ np.linalg.inv(last[0])
            given = {k: move @ m for k, m in given.items()}
        rows = own.where(F.col("batch") == b).select("scan_id", "id", "x", "y", "z")
        done = Batch(given)
        if world and counts.get(b, 0) > s.least_points:
            levels = {name: (maps.voxel_gaussians(world[name], size, s.more_than), size) for name, size in sizes.items()}
            done = register_batch(rows, given, two_level_map(levels, s.more_than), sizes, s.motion, model, s.rounds)
        for k in keys:
            at = done.poses[k]
            step = float(np.linalg.norm(at[:3, 3] - (out[-1][2][:3, 3] if out else at[:3, 3])))
            way, since = way + step, since + step
            out.append((None, k, at))
        last = (model[keys[-1]], done.poses[keys[-1]])
        rebuilt = since > s.rebuild_metres
        if rebuilt:
            kept = [x for x in kept if x[2] >= way - since / 2]
            for name in list(world):
                dropped(world.pop(name))
            for other, poses, _ in kept:
                add(own.where(F.col("batch") == other).select("scan_id", "id", "x", "y", "z"), poses)
            since = 0.0
        if counts.get(b, 0):
            add(rows, done.poses)
            kept.append((b, done.poses, way))
        report.append({"batch": b, "poses": len(keys), "points": counts.get(b, 0), "matched": done.matched, "rounds": done.rounds, "moved": done.moved, "refused": len(done.refused), "rebuilt": rebuilt, "length": way})
    table = spark.createDataFrame([(int(k), m.ravel().tolist()) for _, k, m in out], "scan_id long, pose array<double>")
    poses = track.select("ts_ns", F.col("n").alias("scan_id")).join(table, "scan_id").select("ts_ns", "scan_id", "pose")
    return stored(poses, "poses"), report


def save(folder: str, points: DataFrame, poses: DataFrame, report: list[dict], settings: Settings = Settings(), kind: str = "las", per_chunk: int = 51) -> None:
    """The whole result set in one folder: points in the common frame by chunks of batches as point files, each
    pose (CSV: scan_id, ts_ns, the matrix by rows), the index of the points' poses, and a document of settings and
    figures.  Each part is committed as a whole."""
    spark = points.sparkSession
    register(spark)
    track = poses.select("ts_ns", F.col("scan_id").alias("n"))
    own = matched(points, track, settings).join(poses.select("scan_id", "pose"), "scan_id").withColumn("__p", transform("pose", "x", "y", "z"))
    own = own.select("scan_id", "id", "batch", F.floor(F.col("batch") / per_chunk).alias("chunk"), *[F.col(f"__p.{a}").alias(a) for a in "xyz"])
    dealt = own.repartitionByRange("chunk", "batch").sortWithinPartitions("chunk", "scan_id", "id")
    dealt.select("x", "y", "z", F.least("scan_id", F.lit(65535)).alias("scan_id")).write.format(kind).mode("append").save(f"{folder}/points")
    dealt.select("id", "scan_id", "chunk").write.parquet(f"{folder}/index")
    poses.orderBy("scan_id").select("scan_id", "ts_ns", *[F.col("pose")[i].alias(f"m{i // 4}{i % 4}") for i in range(12)]).write.csv(f"{folder}/trajectory", header=True)
    text = json.dumps({"settings": asdict(settings), "batches": report})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{folder}/report")


def load(spark: SparkSession, folder: str, kind: str = "las") -> tuple[DataFrame, DataFrame, Settings, list[dict]]:
    """Points, poses, settings and report of a folder that ``save`` wrote."""
    register(spark)
    fields = "scan_id long, ts_ns long, " + ", ".join(f"m{i // 4}{i % 4} double" for i in range(12))
    rows = spark.read.csv(f"{folder}/trajectory", schema=fields, header=True)
    pose = F.array(*[F.col(f"m{i // 4}{i % 4}") for i in range(12)], *[F.lit(v) for v in (0.0, 0.0, 0.0, 1.0)])
    document = json.loads(spark.read.text(f"{folder}/report", wholetext=True).first()[0])
    known = dict(document["settings"])
    known["motion"] = Motion(**known["motion"])
    return spark.read.format(kind).load(f"{folder}/points"), rows.select("ts_ns", "scan_id", pose.alias("pose")), Settings(**known), document["batches"]

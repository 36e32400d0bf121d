"""A voxel map that lives on: each voxel is a keyed state that takes points one after another.

The first point of a voxel stays its mean, with covariance ``start``^2 I; point k turns the covariance
into cov (k - 1) / k + d d' (k - 1) / k^2, d its offset from the first.  The third point gives the surface's
normal, turned to the viewpoint; later points count for the covariance only if their viewpoint lies in
front of it.

A map is rebuilt when its session has travelled far enough (``rebuilds``): the older half of the way
since then is forgotten and the rest taken anew.  Each point carries the number of rebuilds before it and
the time from which points are still held, so a voxel rebuilds itself when it is next met, and nothing
but its own points is needed for that.  A voxel not met since holds the state before; ``current`` leaves out
those that hold nothing any more.

Two forms of one rule: ``online_map`` for streams (transformWithState, one state a voxel) and ``continued``
for tables (a map and a batch of points give the next map).  State is never more than a voxel's points
since the last rebuild but one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from pointloom.functions.geometry import cell
from pointloom.operators.joins import asof_join
from pointloom.operators.scans import fired, paths

KEYS = ["session", "ix", "iy", "iz"]
PAIRS = ("xx", "xy", "xz", "yy", "yz", "zz")
POINT = ["ts", "id", "x", "y", "z", "vx", "vy", "vz", "rebuild", "keep_from"]
MEAN, COV, NORMAL = [f"mean_{a}" for a in "xyz"], [f"cov_{c}" for c in PAIRS], [f"n{a}" for a in "xyz"]
VOXEL = "n long, rebuild long, " + ", ".join(f"{c} double" for c in (*MEAN, *COV, *NORMAL)) + ", held array<double>"
SCHEMA = "session long, ix int, iy int, iz int, " + VOXEL
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


@dataclass
class Voxel:
    """What a voxel knows; ``held`` are its points (ts, x, y, z, vx, vy, vz) that a rebuild may take again."""

    start: float = 0.03
    n: int = 0
    rebuild: int = 0
    mean: np.ndarray | None = None
    cov: np.ndarray = field(default_factory=lambda: np.zeros((3, 3)))
    normal: np.ndarray | None = None
    held: list = field(default_factory=list)

    @classmethod
    def of(cls, row: tuple, start: float) -> Voxel:
        """From the values of VOXEL."""
        n, rebuild, rest, held = int(row[0]), int(row[1]), [float(v) for v in row[2:14]], row[14]
        cov = np.array(rest[3:9])[[0, 1, 2, 1, 3, 4, 2, 4, 5]].reshape(3, 3)
        normal = None if np.isnan(rest[9]) else np.array(rest[9:12])
        return cls(start, n, rebuild, np.array(rest[:3]) if n else None, cov, normal, np.reshape(held, (-1, 7)).tolist())

    def values(self) -> tuple:
        normal = [float("nan")] * 3 if self.normal is None else self.normal.tolist()
        return (self.n, self.rebuild, *self.mean.tolist(), *self.cov[np.triu_indices(3)].tolist(), *normal, [float(v) for p in self.held for v in p])

    def take(self, p: np.ndarray, view: np.ndarray) -> None:
        self.n += 1
        if self.n == 1:
            self.mean, self.cov, self.normal = p, np.eye(3) * self.start**2, None
            return
        k, d = self.n, self.mean - p
        if k <= 3 or (self.normal is not None and self.normal @ (view - self.mean) >= 0):
            self.cov = self.cov * (k - 1) / k + np.outer(d, d) * (k - 1) / k**2
        if k == 3:
            normal = np.linalg.eigh(self.cov)[1][:, 0]
            self.normal = -normal if normal @ (view - self.mean) < 0 else normal

    def meet(self, ts: float, p: list[float], view: list[float], rebuild: int, keep_from: float) -> None:
        """Takes a point; first, if its session's map was rebuilt since, what is still held anew."""
        if rebuild > self.rebuild:
            self.rebuild, self.n = rebuild, 0
            self.held = [h for h in self.held if h[0] >= keep_from]
            for h in self.held:
                self.take(np.array(h[1:4]), np.array(h[4:7]))
        self.take(np.array(p), np.array(view))
        self.held.append([ts, *p, *view])


def taken(voxel: Voxel, pdf: pd.DataFrame) -> Voxel:
    for ts, _, x, y, z, vx, vy, vz, rebuild, keep_from in pdf[POINT].sort_values(["ts", "id"]).itertuples(index=False):
        voxel.meet(float(ts), [x, y, z], [vx, vy, vz], int(rebuild), float(keep_from))
    return voxel


class VoxelProcessor(StatefulProcessor):
    """One voxel's state; each batch that meets it gives a row."""

    def __init__(self, start: float):
        self.start = start

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("voxel", VOXEL)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        own = Voxel.of(self.state.get(), self.start) if self.state.exists() else Voxel(self.start)
        values = taken(own, pd.concat(list(rows))).values()
        self.state.update(values)
        yield pd.DataFrame([(*key, *values)], columns=NAMES)

    def close(self) -> None:
        pass


def in_cells(points: DataFrame, size: float) -> DataFrame:
    names = [F.col(c).cast("double").alias(c) for c in ("ts", "x", "y", "z", "vx", "vy", "vz", "keep_from")]
    own = points.select(F.col("session").cast("long").alias("session"), F.col("id").cast("long").alias("id"), F.col("rebuild").cast("long").alias("rebuild"), *names)
    return own.withColumns({f"i{a}": cell(a, size).cast("int") for a in "xyz"}).select(*KEYS, *POINT)


def online_map(points: DataFrame, size: float, start: float = 0.03) -> DataFrame:
    """A stream of points (session, id, ts, x, y, z, the viewpoint vx, vy, vz, rebuild, keep_from) as a stream of
    voxels after each batch that met them.  Needs the RocksDB state store; points of a voxel must come in the
    order of their batches, inside a batch they are sorted."""
    keyed = in_cells(points, size).groupBy(*KEYS)
    return keyed.transformWithStateInPandas(statefulProcessor=VoxelProcessor(start), outputStructType=SCHEMA, outputMode="Append", timeMode="None")


def continued(known: DataFrame | None, points: DataFrame, size: float, start: float = 0.03) -> DataFrame:
    """The map (SCHEMA) after a batch of points: that of ``known``, or a new one.

    Known voxels and new points meet in one exchange, sorted, and stream through the tasks voxel by voxel.
    """
    own = in_cells(points, size).withColumn("__kind", F.lit(1))
    both = own if known is None else known.withColumn("__kind", F.lit(0)).withColumnRenamed("rebuild", "__rebuild").unionByName(own, allowMissingColumns=True)
    both = both.repartition(*KEYS).sortWithinPartitions(*KEYS, "__kind", "ts", "id")
    known_columns = ["n", "__rebuild", *MEAN, *COV, *NORMAL, "held"]
    has_known = known is not None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, voxel = None, None
        for pdf in batches:
            out = []
            rows = pdf[KEYS + POINT + ["__kind"]].itertuples(index=False)
            states = pdf[known_columns].itertuples(index=False) if has_known else iter([None] * len(pdf))
            for r, s in zip(rows, states):
                key = tuple(r[:4])
                if key != at:
                    if voxel is not None:
                        out.append((*at, *voxel.values()))
                    at, voxel = key, Voxel(start)
                if r[-1] == 0:
                    voxel = Voxel.of(tuple(s), start)
                else:
                    ts, _, x, y, z, vx, vy, vz, rebuild, keep_from = r[4:14]
                    voxel.meet(float(ts), [x, y, z], [vx, vy, vz], int(rebuild), float(keep_from))
            yield pd.DataFrame(out, columns=NAMES)
        if voxel is not None:
            yield pd.DataFrame([(*at, *voxel.values())], columns=NAMES)

    return both.mapInPandas(run, SCHEMA)


def current(voxels: DataFrame, marks: DataFrame) -> DataFrame:
    """Voxels of a map that hold a point their session has not forgotten; ``marks`` has each session's last
    rebuild and keep_from.  Voxels not met since the last rebuild show what they were before it."""
    last = marks.groupBy("session").agg(F.max_by("keep_from", "rebuild").alias("__keep"))
    newest = F.element_at("held", F.size("held") - 6)  # the time of the last point held
    return voxels.join(last, "session").where(newest >= F.col("__keep")).drop("__keep")


def rebuilds(track: DataFrame, reach: float, session: str = "session", ts: str = "ts", values: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """(session, ts, rebuild, keep_from) of a track's rows: the map is rebuilt at the first row whose path since
    the last rebuild exceeds ``reach``, and keeps what was seen on the newer half of that way."""
    way = fired(paths(track, [session], [ts], list(values)).withColumn("__rule", F.lit("all")), {"all": reach}, True, False)
    run = Window.partitionBy(session).orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    marks = way.where("__fires").select(session, ts, F.col("__d").alias("__at"), "__pid")
    marks = marks.withColumn("rebuild", F.row_number().over(Window.partitionBy(session).orderBy(ts)).cast("long"))
    before = F.coalesce(F.lag("__at").over(Window.partitionBy(session).orderBy(ts)), F.lit(0))
    marks = marks.withColumn("__half", (F.col("__at") + before) / 2)
    # the first row at or after the half of the way
    own = way.select(session, F.col(ts).alias("__t"), "__d")
    halves = asof_join(marks, own, "__half", "__d", [session], "forward", tie=None, prefix="__h_").select(session, ts, "rebuild", F.col("__h___t").alias("keep_from"))
    out = track.select(session, ts).join(halves, [session, ts], "left")
    return out.select(session, ts, F.coalesce(F.max("rebuild").over(run), F.lit(0)).alias("rebuild"), F.coalesce(F.max("keep_from").over(run), F.lit(float("-inf"))).alias("keep_from"))


def with_marks(points: DataFrame, marks: DataFrame, ts: str = "ts") -> DataFrame:
    """Points with rebuild and keep_from of their session's last track row at or before them."""
    out = asof_join(points, marks.withColumnRenamed(ts, "__t"), ts, "__t", ["session"], "backward", prefix="__m_")
    zero: Column = F.coalesce("__m_rebuild", F.lit(0))
    return out.select(*points.columns, zero.alias("rebuild"), F.coalesce("__m_keep_from", F.lit(float("-inf"))).alias("keep_from"))

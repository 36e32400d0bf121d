"""Pose graphs of many separate tracks, each made consistent where it lies.

``sparse.consistent`` writes a system each round, several times the size of the poses.  Where the edges of a
track join its own poses only, as with one graph for each user, session or drive, nothing has to cross the
cluster between rounds: tracks are dealt into groups of about ``GROUP`` poses, one exchange of poses and edges
brings a group into one task, and that does all rounds and hands on the poses.  A group's system is a list of
blocks that is eliminated by levels (``direct``), so a long track costs no more a pose than a short one.

A track of over ``most`` poses is not gathered; such go through ``sparse.consistent`` with
``elimination.solution``, level by level over the cluster, to the same poses.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.plans import elimination, sparse
from pointloom.plans.solvers import exp_poses
from pointloom.sources.store import dropped, stored

#: Poses of a group, about, and of a partition of the exchange.
GROUP, ROWS = 4096, 250_000
#: Blocks a node that a system may come to while it is eliminated.
FILL = 32


def merged(row: np.ndarray, col: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of one place added up, by row and col."""
    code = row * n + col
    order = np.argsort(code, kind="stable")
    code, value = code[order], value[order]
    first = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else order
    value = np.add.reduceat(value, first) if len(first) < len(code) else value
    return code[first] // n, code[first] % n, value


def direct(row: np.ndarray, col: np.ndarray, value: np.ndarray, right: np.ndarray) -> np.ndarray:
    """x (n, d) of a symmetric system from its blocks (row <= col; blocks of one place add up; every node has one
    on the diagonal) and its right side.

    A level eliminates nodes of which no two are neighbours, those with the fewest neighbours first, and of a
    chain every second one; what is left is half as large, and blocks of a level are one batch.
    """
    n, d = right.shape
    b, x, gone = right.copy(), np.zeros((n, d)), []
    row, col, value = merged(row, col, value, n)
    while len(row):
        if len(row) > FILL * n + FILL * FILL:
            raise ValueError(f"a system of {n} nodes comes to {len(row)} blocks: this graph is no track, use conjugate gradients")
        on = row == col
        left, own, i, j, link = row[on], value[on], row[~on], col[~on], value[~on]
        place = np.zeros(n, np.int64)
        place[left] = np.arange(len(left))
        degree = np.bincount(i, minlength=n) + np.bincount(j, minlength=n)
        key = (2 * degree + place % 2) * n + place
        best = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(best, i, key[j])
        np.minimum.at(best, j, key[i])
        out = key < best
        at_i, at_j = out[i], out[j]
        node, near = np.concatenate([i[at_i], j[at_j]]), np.concatenate([j[at_i], i[at_j]])
        arm = np.concatenate([link[at_i], link[at_j].transpose(0, 2, 1)])
        order = np.lexsort((near, node))
        node, near = node[order], near[order]
        keep = ~(at_i | at_j)
        stay = ~out[left]
        rows, cols, values = [left[stay], i[keep]], [left[stay], j[keep]], [own[stay], link[keep]]
        now = left[~stay]
        for k in np.unique(degree[now]):
            these = now[degree[now] == k]
            at = np.searchsorted(node, these)[:, None] + np.arange(k)
            to, m = near[at], len(these)
            arms = arm[order[at]].transpose(0, 2, 1, 3).reshape(m, d, k * d)
            both = np.linalg.solve(own[place[these]], np.concatenate([arms, b[these][:, :, None]], axis=2))
            gone.append((these, to, both))
            if not k:
                continue
            change = (arms.transpose(0, 2, 1) @ both).reshape(m, k, d, -1)
            for p in range(k):
                for q in range(p, k):
                    rows.append(to[:, p])
                    cols.append(to[:, q])
                    values.append(-change[:, p, :, q * d : q * d + d])
            for c in range(d):
                b[:, c] -= np.bincount(to.ravel(), change[:, :, c, -1].ravel(), n)
        row, col, value = merged(np.concatenate(rows), np.concatenate(cols), np.concatenate(values), n)
    for these, to, both in reversed(gone):
        x[these] = both[:, :, -1] - (both[:, :, :-1] @ x[to].reshape(len(these), -1, 1))[:, :, 0]
    return x


def settled(pose: np.ndarray, a: np.ndarray, b: np.ndarray, measured: np.ndarray, weight: np.ndarray, hold: np.ndarray, rounds: int, tolerance: float) -> np.ndarray:
    """Poses (n, 4, 4) after Gauss-Newton rounds over edges between places a and b, each pose held by its ``hold``."""
    n = len(pose)
    low, high = np.minimum(a, b), np.maximum(a, b)
    free = (np.bincount(a, minlength=n) + np.bincount(b, minlength=n) == 0) & (hold == 0)  # without any term: it stays
    still = np.where(free, 1.0, hold)[:, None, None] * np.eye(6)
    for _ in range(rounds):
        ja, jb, r, w = sparse.edge_system(pose[a], pose[b], measured, weight)
        jb = np.where((a == b)[:, None, None], ja + jb, jb)
        ja = np.where((a == b)[:, None, None], 0.0, ja)
        wa, wb = (ja * w[:, :, None]).transpose(0, 2, 1), (jb * w[:, :, None]).transpose(0, 2, 1)
        cross = wa @ jb
        cross = np.where((a > b)[:, None, None], cross.transpose(0, 2, 1), cross)
        right = np.zeros((n, 6))
        for at, g in ((a, wa), (b, wb)):
            g = (g @ r[:, :, None])[:, :, 0]
            for c in range(6):
                right[:, c] -= np.bincount(at, g[:, c], n)
        nodes = np.arange(n)
        step = direct(np.concatenate([nodes, a, b, low]), np.concatenate([nodes, a, b, high]), np.concatenate([still, wa @ ja, wb @ jb, cross]), right)
        pose = pose @ exp_poses(step)
        far = np.abs(step).sum(axis=1)
        if far[np.isfinite(far)].max(initial=0.0) < tolerance:
            break
    return pose


def _group(names: list[str], hold: float, rounds: int, tolerance: float) -> Callable:
    """What a group's poses come to with its edges."""

    def run(rows: pa.Table, links: pa.Table) -> pa.Table:
        rows = rows.select(names)
        if not rows.num_rows or not links.num_rows:
            return rows
        code = pa.chunked_array([*rows["track"].chunks, *links["track"].chunks]).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        order = np.argsort(rows["id"].to_numpy(), kind="stable")
        ids, track, of = rows["id"].to_numpy()[order], code[: rows.num_rows][order], code[rows.num_rows :]
        ends = [links[c].to_numpy() for c in "ab"]
        a, b = (np.minimum(np.searchsorted(ids, e), len(ids) - 1) for e in ends)
        here = (ids[a] == ends[0]) & (track[a] == of) & (ids[b] == ends[1]) & (track[b] == of)
        held = np.zeros(len(ids))
        held[np.unique(track, return_index=True)[1]] = hold
        measured, weight = sparse.matrix_of(links["measured"].combine_chunks(), 4, 4), links["weight"].to_numpy().astype(float)
        at = sparse.matrix_of(rows["pose"].combine_chunks(), 4, 4)[order]
        sizes = np.bincount(track, minlength=code.max() + 1)
        batch = (np.cumsum(sizes) - sizes) // GROUP  # of whole tracks: long ones that meet in a group go one after another
        for k in np.unique(batch[track]):
            own, e = np.flatnonzero(batch[track] == k), np.flatnonzero(here & (batch[of] == k))
            at[own] = settled(at[own], np.searchsorted(own, a[e]), np.searchsorted(own, b[e]), measured[e], weight[e], held[own], rounds, tolerance)
        pose = np.empty_like(at)
        pose[order] = at
        return rows.set_column(names.index("pose"), "pose", sparse.list_column(pose))

    return run


def _spread(poses: DataFrame, edges: DataFrame, firsts: DataFrame, hold: float, rounds: int, tolerance: float) -> DataFrame:
    """Tracks too long for a task, over the cluster."""
    own = poses.select("id", F.col("track").alias("__of"))
    for c in "ab":
        edges = edges.join(own.withColumnRenamed("id", c), c).where(F.col("track").eqNullSafe(F.col("__of"))).drop("__of")
    edges = stored(edges.select("a", "b", "measured", "weight"), "edges")
    held = firsts.select(F.col("__first").alias("row"), F.col("__first").alias("col"), F.array(*[F.lit(float(hold) if i % 7 == 0 else 0.0) for i in range(36)]).alias("value"))
    none = poses.sparkSession.createDataFrame([], "id long, x double, y double, z double, weight double")
    out = sparse.consistent(poses, edges, places=none, more=lambda _: held, rounds=rounds, tolerance=tolerance, solve=elimination.solution)
    dropped(edges)
    return poses.drop("pose").join(out, "id").select(poses.columns)


def consistent(poses: DataFrame, edges: DataFrame, hold: float = 1e12, rounds: int = 10, tolerance: float = 1e-8, most: int = 50_000) -> DataFrame:
    """Poses (track, id, pose and any other columns) made consistent with the edges (track, a, b, measured, weight)
    of their track, as ``sparse.consistent`` does: Gauss-Newton with Cauchy weights, the first pose of each track
    kept where it is by ``hold``.  ids are unique longs, best consecutive; an edge to a pose that its track
    doesn't have is left out."""
    poses = poses.withColumn("id", F.col("id").cast("long"))
    edges = edges.where("a IS NOT NULL AND b IS NOT NULL").select("track", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), "measured", F.col("weight").cast("double").alias("weight"))
    sizes = stored(poses.groupBy("track").agg(F.count("*").alias("__n"), F.min("id").alias("__first")), "sizes")
    total, longest = (v or 0 for v in sizes.agg(F.sum("__n"), F.max("__n")).first())
    far = None
    if longest > most:
        large = sizes.where(F.col("__n") > most).withColumnRenamed("track", "__track")  # one for every ``most`` poses, at most
        of = lambda df, how: df.join(F.broadcast(large), df["track"].eqNullSafe(large["__track"]), how)
        far = _spread(of(poses, "left_semi"), of(edges, "left_semi"), large, hold, rounds, tolerance)
        poses, edges = of(poses, "left_anti"), of(edges, "left_anti")
    groups = max(1, -(-total // GROUP))
    partitions = max(int(poses.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // ROWS))
    dealt = lambda df: df.withColumn("__group", F.pmod(F.xxhash64("track"), F.lit(groups))).repartition(partitions, "__group").groupBy("__group")
    near = dealt(poses).cogroup(dealt(edges)).applyInArrow(_group(poses.columns, hold, rounds, tolerance), poses.schema)
    return near if far is None else near.unionByName(far)

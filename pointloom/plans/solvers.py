"""Iterative solvers: the cluster sums normal equations, the driver solves what is of fixed size.

A round of registration is one nearest-neighbour join and one aggregate of 27 sums; what comes to
the driver is one row, whatever the number of points.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.functions.geometry import transform
from pointloom.operators.aggregates import normal_equations
from pointloom.operators.joins import nearest


def skew(v: np.ndarray) -> np.ndarray:
    return np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0]])


def crosses(v: np.ndarray) -> np.ndarray:
    """``skew`` of many."""
    x, y, z = v.T
    o = np.zeros(len(v))
    return np.stack([o, -z, y, z, o, -x, -y, x, o], axis=1).reshape(-1, 3, 3)


def exp_pose(d: np.ndarray) -> np.ndarray:
    """The pose of a small motion (translation, rotation vector)."""
    angle = float(np.linalg.norm(d[3:]))
    k = skew(d[3:] / angle) if angle > 1e-12 else np.zeros((3, 3))
    out = np.eye(4)
    out[:3, :3] += np.sin(angle) * k + (1 - np.cos(angle)) * k @ k
    out[:3, 3] = d[:3]
    return out


def exp_poses(d: np.ndarray) -> np.ndarray:
    """``exp_pose`` of many."""
    angle = np.linalg.norm(d[:, 3:], axis=1)
    x, y, z = np.where(angle > 1e-12, d[:, 3:].T / np.where(angle > 1e-12, angle, 1), 0.0)
    k = crosses(np.stack([x, y, z], axis=1))
    out = np.tile(np.eye(4), (len(d), 1, 1))
    out[:, :3, :3] += np.sin(angle)[:, None, None] * k + (1 - np.cos(angle))[:, None, None] * (k @ k)
    out[:, :3, 3] = d[:, :3]
    return out


@dataclass
class Registration:
    pose: np.ndarray
    rms: float
    rounds: int
    matched: int


def solve_blocks(row, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The matrix and right side of a row of ``normal_equations``."""
    a, b = np.zeros((n, n)), np.zeros(n)
    for i in range(n):
        b[i] = row[f"atb_{i}"] or 0.0
        for j in range(i, n):
            a[i, j] = a[j, i] = row[f"ata_{i}{j}"] or 0.0
    return a, b


def solve(row, n: int, damping: float = 0.0) -> np.ndarray:
    a, b = solve_blocks(row, n)
    return np.linalg.lstsq(a + damping * np.eye(n), b, rcond=None)[0]


def register(source: DataFrame, target: DataFrame, radius: float, rounds: int = 20, tolerance: float = 1e-9, start: np.ndarray | None = None, plane: bool = False) -> Registration:
    """Rigid pose that brings ``source`` (id, x, y, z) onto ``target`` (id, x, y, z; nx, ny, nz for
    point to plane): nearest neighbours within ``radius``, Gauss-Newton."""
    pose = np.eye(4) if start is None else np.array(start, float)
    rms, n = float("nan"), 0
    step = 0
    for step in range(1, rounds + 1):
        m = F.array(*[F.lit(float(v)) for v in pose.ravel()])
        moved = source.withColumn("__p", transform(m, "x", "y", "z")).select("id", *[F.col(f"__p.{a}").alias(a) for a in "xyz"])
        near = nearest(moved, target, ["x", "y", "z"], radius, "id", "id").select("l", "r")
        p = {a: F.col(f"l.{a}") for a in "xyz"}
        diff = {a: F.col(f"r.{a}") - p[a] for a in "xyz"}
        zero = F.lit(0.0)
        # rows of the jacobian of (p + t + r x p) by (t, r)
        turn = {"x": (zero, p["z"], -p["y"]), "y": (-p["z"], zero, p["x"]), "z": (p["y"], -p["x"], zero)}
        if plane:
            nrm = {a: F.col(f"r.n{a}") for a in "xyz"}
            jac = [nrm[a] for a in "xyz"] + [sum((nrm[a] * turn[a][k] for a in "yz"), nrm["x"] * turn["x"][k]) for k in range(3)]
            eqs = [F.struct(*[j.alias(f"j{i}") for i, j in enumerate(jac)], sum((nrm[a] * diff[a] for a in "yz"), nrm["x"] * diff["x"]).alias("res"))]
        else:
            eqs = [F.struct(*[F.lit(1.0 if a == b else 0.0).alias(f"j{i}") for i, b in enumerate("xyz")], *[turn[a][k].alias(f"j{3 + k}") for k in range(3)], diff[a].alias("res")) for a in "xyz"]
        rows = near.select(F.explode(F.array(*eqs)).alias("e")).select("e.*")
        sums = normal_equations(rows, [f"j{i}" for i in range(6)], "res").first()  # one row of sums
        n = sums["n"]
        if not n:
            break
        rms = float(np.sqrt(sums["rtr"] / n))
        d = solve(sums, 6)
        pose = exp_pose(d) @ pose
        if np.abs(d).sum() < tolerance:
            break
    return Registration(pose, rms, step, n)


def pose_graph(poses: np.ndarray, edges: list[tuple[int, int, np.ndarray, float]], rounds: int = 10, fixed: int | list[int] = 0, places: list[tuple[int, np.ndarray, float]] | None = None, steps: int = 200) -> np.ndarray:
    """Poses (n, 4, 4) that fit relative poses (from, to, measured, weight), with Cauchy weights; pose
    ``fixed`` stays.  ``places`` (pose, xyz, weight) draw poses to known points, as satellite fixes and
    ground control do.

    Each edge is four 6x6 blocks.  The system is never laid out: conjugate gradients with the blocks of
    the diagonal as preconditioner need one product of each block a step, so memory and time follow the
    number of edges.
    """
    poses = poses.copy()
    n = len(poses)
    at = np.array([[i, j] for i, j, *_ in edges], np.int64).reshape(-1, 2)
    measured = np.linalg.inv(np.array([z for *_, z, _ in edges]).reshape(-1, 4, 4))
    given = np.array([w for *_, w in edges], float)
    on = np.array([i for i, *_ in places or []], np.int64)
    to = np.array([x for _, x, _ in places or []], float).reshape(-1, 3)
    pull = np.array([w for *_, w in places or []], float)
    moves = [exp_pose(1e-6 * np.eye(6)[k]) for k in range(6)]
    for _ in range(rounds):
        a, b = poses[at[:, 0]], poses[at[:, 1]]
        error = lambda a, b: log_poses(measured @ np.linalg.inv(a) @ b)
        r = error(a, b)
        w = given / (1 + (r * r).sum(axis=1))
        ja = np.stack([(error(a @ m, b) - r) / 1e-6 for m in moves], axis=2)
        jb = np.stack([(error(a, b @ m) - r) / 1e-6 for m in moves], axis=2)
        right, diagonal = np.zeros((n, 6)), np.tile(1e-9 * np.eye(6), (n, 1, 1))
        blocks = {}
        for s, x in enumerate((ja, jb)):
            np.add.at(right, at[:, s], -np.einsum("eki,ek,e->ei", x, r, w))
            for t, y in enumerate((ja, jb)):
                blocks[s, t] = np.einsum("eki,ekj,e->eij", x, y, w)
            np.add.at(diagonal, at[:, s], blocks[s, s])
        if len(on):  # a place depends on its pose's translation, in the pose's own axes
            miss = poses[on, :3, 3] - to
            turn = poses[on, :3, :3]
            v = pull / (1 + (miss * miss).sum(axis=1))
            own = np.zeros((len(on), 6, 6))
            own[:, :3, :3] = np.einsum("eki,ekj,e->eij", turn, turn, v)
            np.add.at(diagonal, on, own)
            np.add.at(right[:, :3], on, -np.einsum("eki,ek,e->ei", turn, miss, v))
        diagonal[fixed] += 1e12 * np.eye(6)
        near = np.linalg.inv(diagonal)

        def product(x: np.ndarray) -> np.ndarray:
            out = np.einsum("nij,nj->ni", diagonal, x)
            np.add.at(out, at[:, 0], np.einsum("eij,ej->ei", blocks[0, 1], x[at[:, 1]]))
            np.add.at(out, at[:, 1], np.einsum("eij,ej->ei", blocks[1, 0], x[at[:, 0]]))
            return out

        step = conjugate_gradients(product, right, near, max(steps, 6 * n if n < 200 else steps))
        poses = poses @ np.stack([exp_pose(d) for d in step])
        if np.abs(step).sum() < 1e-10:
            break
    return poses


def conjugate_gradients(product, right: np.ndarray, near: np.ndarray, steps: int) -> np.ndarray:
    """x with product(x) = right, with block preconditioner ``near``."""
    x, r = np.zeros_like(right), right.copy()
    z = np.einsum("nij,nj->ni", near, r)
    p, rz = z.copy(), (r * z).sum()
    end = 1e-24 * max(rz, 1e-300)
    for _ in range(steps):
        if rz <= end:
            break
        q = product(p)
        alpha = rz / (p * q).sum()
        x, r = x + alpha * p, r - alpha * q
        z = np.einsum("nij,nj->ni", near, r)
        rz, old = (r * z).sum(), rz
        p = z + rz / old * p
    return x


def log_poses(m: np.ndarray) -> np.ndarray:
    """``log_pose`` of many."""
    angle = np.arccos(np.clip((np.trace(m[:, :3, :3], axis1=1, axis2=2) - 1) / 2, -1, 1))
    v = np.stack([m[:, 2, 1] - m[:, 1, 2], m[:, 0, 2] - m[:, 2, 0], m[:, 1, 0] - m[:, 0, 1]], axis=1) / 2
    s = np.sin(angle)
    return np.concatenate([m[:, :3, 3], v * np.where(s > 1e-9, angle / np.where(s > 1e-9, s, 1), 1.0)[:, None]], axis=1)


def log_pose(m: np.ndarray) -> np.ndarray:
    """Translation and rotation vector of a pose."""
    c = np.clip((np.trace(m[:3, :3]) - 1) / 2, -1, 1)
    angle = np.arccos(c)
    v = np.array([m[2, 1] - m[1, 2], m[0, 2] - m[2, 0], m[1, 0] - m[0, 1]]) / 2
    s = np.sin(angle)
    return np.concatenate([m[:3, 3], v * (angle / s if s > 1e-9 else 1.0)])


def best_alpha(residuals: DataFrame, residual: str, scale: float = 1.0, axis: str | None = None) -> DataFrame:
    """The shape alpha from -10 to 2 in steps of 0.1 with the smallest mean adaptive loss, by axis:
    losses of all alphas are sums of one pass."""
    from pointloom.functions.robust import barron_partition, estimator

    alphas = [round(-10 + 0.1 * i, 1) for i in range(121)]
    loss = F.array(*[estimator("barron", F.col(residual), scale, a)[0] + F.log(barron_partition(a, scale)) for a in alphas])
    rows = residuals.select(*([axis] if axis else []), F.posexplode(loss).alias("i", "loss"))
    sums = rows.groupBy(*([axis] if axis else []), "i").agg(F.avg("loss").alias("loss"))
    best = sums.groupBy(*([axis] if axis else [])).agg(F.min(F.struct("loss", "i")).alias("b"))
    return best.select(*([axis] if axis else []), F.round(F.col("b.i") * 0.1 - 10, 1).alias("alpha"), F.col("b.loss").alias("loss"))

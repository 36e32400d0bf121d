"""Least squares over very many unknowns, as tables of blocks.

A term is a residual with a Jacobian block for each of the nodes (poses, knots) it depends on.  Sums
of their products are the blocks of a symmetric matrix, (row, col, value), which no machine holds
whole.  It is solved by conjugate gradients: nodes are dealt into parts of ``size`` consecutive ids, a
part's vectors are one row, a product is a join of matrix parts with vector parts and a sum, and the
blocks inside a part, inverted once, are the preconditioner (a chain of poses is almost solved by it).
The driver sees two numbers a step.

Each step's vectors are stored in the shared folder and the step before deleted.  A part with very many
neighbours is summed in each task before the exchange.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.functions import pose as P
from pointloom.functions.geometry import cell, transform
from pointloom.operators.maps import PAIRS
from pointloom.plans.solvers import crosses, exp_poses, log_poses
from pointloom.sources.store import dropped, stored

BLOCK = "row long, col long, value array<double>"


def matrix_of(column: pa.Array, *shape: int) -> np.ndarray:
    """A column of lists of one length as an array of that shape."""
    return np.asarray(column.flatten(), float).reshape(-1, *shape)


def list_column(values: np.ndarray) -> pa.Array:
    """A list for each of the array's first places."""
    flat = np.ascontiguousarray(values).reshape(len(values), -1)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * flat.shape[1], pa.int32()), pa.array(flat.ravel()))


def term_blocks(terms: DataFrame, d: int) -> DataFrame:
    """The blocks of terms (nodes, jac, res, weight): J'WJ as (row, col, value) and J'Wr with a null col.

    All terms have as many nodes and residuals; ``jac`` holds a node's rows after another's, ``d`` unknowns each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.num_rows
            nodes = np.asarray(batch.column(0).flatten()).reshape(n, -1)
            k = nodes.shape[1]
            res = matrix_of(batch.column(2), len(batch.column(2).flatten()) // n)
            jac = matrix_of(batch.column(1), k, res.shape[1], d)
            w = np.asarray(batch.column(3), float)
            square = np.einsum("tkmi,tlmj,t->tklij", jac, jac, w).reshape(-1, d * d)
            right = np.einsum("tkmi,tm,t->tki", jac, res, w).reshape(-1, d)
            rows, cols = np.repeat(nodes, k, axis=1).ravel(), np.tile(nodes, (1, k)).ravel()
            for row, col, value in ((rows, pa.array(cols), square), (nodes.ravel(), pa.nulls(nodes.size, pa.int64()), right)):
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(value) + 1) * value.shape[1], pa.int32()), pa.array(value.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(row), col, lists], ["row", "col", "value"])

    return terms.select("nodes", "jac", "res", F.col("weight").cast("double")).mapInArrow(run, BLOCK)


def summed(blocks: DataFrame, d: int) -> DataFrame:
    """Blocks of one place added up, with partial sums before the exchange; one pass over ``blocks``, right sides
    being the groups with a null col."""
    sums = blocks.groupBy("row", "col").agg(*[F.sum(F.get("value", F.lit(i))).alias(f"__{i}") for i in range(d * d)])
    at = lambda n: F.array(*[F.col(f"__{i}") for i in range(n)])
    return sums.select("row", "col", F.when(F.col("col").isNull(), at(d)).otherwise(at(d * d)).alias("value"))


@dataclass
class System:
    """A system in parts: matrix (p, q, e), parts (p, inverse, b, used)."""

    d: int
    size: int
    matrix: DataFrame
    parts: DataFrame


def system(blocks: DataFrame, d: int, size: int = 64, damping: float = 1e-9, inverse: bool = True) -> System:
    """The system of summed blocks; without ``inverse`` for products only.  Inverses have (size * d)^2 numbers
    a part, so a task makes and hands on one after another."""
    blocks = stored(blocks, "blocks")
    part = lambda c: F.floor(F.col(c) / size)
    local = lambda c: (F.col(c) - part(c) * size).cast("int")
    square = blocks.where("col is not null").select(part("row").alias("p"), part("col").alias("q"), F.struct(local("row").alias("i"), local("col").alias("j"), "value").alias("e"))
    matrix = stored(square.groupBy("p", "q").agg(F.collect_list("e").alias("e")), "matrix")  # size^2 entries at most
    right = blocks.where("col is null").select(part("row").alias("p"), F.struct(local("row").alias("i"), "value").alias("b")).groupBy("p").agg(F.collect_list("b").alias("b"))
    n = size * d

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, e, b in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                rhs, e = np.zeros((size, d)), e.values
                used = np.unique(np.asarray(e.field("i")))
                if b.is_valid:
                    rhs[np.asarray(b.values.field("i"))] = np.asarray(b.values.field("value").flatten(), float).reshape(-1, d)
                own = np.zeros(0)
                if inverse:
                    dense = np.zeros((size, d, size, d))
                    dense[np.asarray(e.field("i")), :, np.asarray(e.field("j")), :] = np.asarray(e.field("value").flatten(), float).reshape(-1, d, d)
                    free = np.ones(size, bool)
                    free[used] = False
                    own = np.linalg.inv(dense.reshape(n, n) + np.diag(np.where(np.repeat(free, d), 1.0, damping))).ravel()
                lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v, t)) for v, t in ((own, pa.float64()), (rhs.ravel(), pa.float64()), (used, pa.int32()))]
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int64()), *lists], ["p", "inverse", "b", "used"])

    own = matrix.where("p = q").select("p", "e").join(right, "p", "left")
    parts = own.mapInArrow(run, "p long, inverse array<double>, b array<double>, used array<int>")
    out = System(d, size, matrix, stored(parts, "parts"))
    dropped(blocks)
    return out


def product_rows(s: System, x: DataFrame) -> DataFrame:
    """(p, i, y): the matrix times the vector parts (p, v), ``d`` numbers a node.  A task adds up what it has of
    a node before the exchange, and nodes without entries aren't passed on, so it grows with the entries
    however they are scattered."""
    d, size = s.d, s.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            e, v = batch.column(1), batch.column(2)
            at = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(e.offsets)))
            e = e.flatten()
            value = np.asarray(e.field("value").flatten(), float).reshape(-1, d, d)
            x = np.asarray(v.flatten(), float).reshape(-1, size, d)[at, np.asarray(e.field("j"))]
            nodes, back = np.unique(np.asarray(batch.column(0))[at] * size + np.asarray(e.field("i")), return_inverse=True)
            y = np.zeros((len(nodes), d))
            np.add.at(y, back, np.einsum("eij,ej->ei", value, x))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * d, pa.int32()), pa.array(y.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(nodes // size), pa.array((nodes % size).astype(np.int32)), lists], ["p", "i", "y"])

    pieces = s.matrix.join(x.select(F.col("p").alias("q"), "v"), "q").select("p", "e", "v").mapInArrow(run, "p long, i int, y array<double>")
    return pieces.groupBy("p", "i").agg(F.array(*[F.sum(F.col("y")[k]) for k in range(d)]).alias("y"))


def product(s: System, x: DataFrame) -> DataFrame:
    """(p, y): ``product_rows`` as vector parts, zero where a node has no entries."""
    zero = F.array_repeat(F.lit(0.0), s.d)
    rows = product_rows(s, x).groupBy("p").agg(F.map_from_entries(F.collect_list(F.struct("i", "y"))).alias("y"))  # size entries at most
    return rows.select("p", F.flatten(F.transform(F.sequence(F.lit(0), F.lit(s.size - 1)), lambda i: F.coalesce(F.try_element_at("y", i), zero))).alias("y"))


def dot(a: str, b: str) -> Column:
    return F.sum(F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x))


def along(a: Column, b: Column, factor: float) -> Column:
    """a + factor * b."""
    return F.zip_with(a, b, lambda x, y: x + F.lit(factor) * y)


def preconditioned(state: DataFrame, n: int) -> DataFrame:
    """``state`` with z, the part's inverse times r."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            inverse, r = (batch.column(batch.schema.get_field_index(c)) for c in ("inverse", "r"))
            z = [(np.asarray(m.values, float).reshape(n, n) @ np.asarray(v.values, float)).tolist() for m, v in zip(inverse, r)]
            yield batch.append_column("z", pa.array(z, pa.list_(pa.float64())))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in state.schema) + ", z array<double>"
    return state.mapInArrow(run, schema)


def conjugate_gradients(s: System, steps: int = 200, tolerance: float = 1e-10) -> DataFrame:
    """(id, x) with the system's matrix times x = its right side; stops where the residual, as the
    preconditioner weighs it, has fallen by ``tolerance``."""
    n, d, size = s.size * s.d, s.d, s.size
    zero = F.array_repeat(F.lit(0.0), n)
    state = preconditioned(s.parts.select("p", zero.alias("x"), F.col("b").alias("r"), "inverse"), n).withColumn("v", F.col("z"))
    at = state = stored(state.select("p", "x", "r", "z", "v"), "cg")
    rz = first = state.agg(dot("r", "z")).first()[0] or 0.0
    for _ in range(steps):
        if rz <= tolerance * tolerance * first or first == 0:
            break
        moved = stored(state.join(product(s, state), "p", "left").withColumn("y", F.coalesce("y", zero)).select("p", "x", "r", "v", "y"), "cg")
        alpha = rz / moved.agg(dot("v", "y")).first()[0]
        ahead = moved.select("p", along(F.col("x"), F.col("v"), alpha).alias("x"), along(F.col("r"), F.col("y"), -alpha).alias("r"), "v").join(s.parts.select("p", "inverse"), "p")
        ahead = stored(preconditioned(ahead, n).drop("inverse"), "cg")
        rz, before = ahead.agg(dot("r", "z")).first()[0], rz
        for used in (moved, at):
            dropped(used)
        at, state = ahead, ahead.select("p", "x", "r", "z", along(F.col("z"), F.col("v"), rz / before).alias("v"))
    ids = state.join(s.parts.select("p", "used"), "p").select("p", "x", F.explode("used").alias("i"))
    return ids.select((F.col("p") * size + F.col("i")).alias("id"), F.slice("x", F.col("i") * d + 1, d).alias("x"))


def solved(terms: DataFrame, d: int, size: int = 64, steps: int = 200, tolerance: float = 1e-10, more: DataFrame | None = None) -> DataFrame:
    """(id, x): the least squares solution of the terms (and of further blocks)."""
    blocks = term_blocks(terms, d)
    s = system(summed(blocks if more is None else blocks.unionByName(more), d), d, size)
    out = stored(conjugate_gradients(s, steps, tolerance), "solution")
    dropped(s.matrix)
    dropped(s.parts)
    return out


# ---- poses ---------------------------------------------------------------------------------------


def edge_system(a: np.ndarray, b: np.ndarray, measured: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Jacobians (n, 6, 6) by either pose's own motion, the six residuals of relative poses, and their Cauchy weights."""
    back = np.linalg.inv(measured)
    d = np.linalg.inv(a) @ b
    e = back @ d
    r = log_poses(e)
    turn = r[:, 3:]
    square = (turn * turn).sum(axis=1)
    small = square < 1e-8
    t = np.sqrt(np.where(small, 1.0, square))
    c = np.where(small, 1 / 12 + square / 720, (1 - t * np.sin(t) / (2 - 2 * np.cos(t))) / (t * t))
    k = crosses(turn)
    right = np.eye(3) + k / 2 + c[:, None, None] * (k @ k)
    turned = back[:, :3, :3]
    ja, jb = np.zeros((2, len(r), 6, 6))
    jb[:, :3, :3], jb[:, 3:, 3:] = e[:, :3, :3], right
    ja[:, :3, :3], ja[:, :3, 3:], ja[:, 3:, 3:] = -turned, turned @ crosses(d[:, :3, 3]), -right.transpose(0, 2, 1) @ turned
    return ja, jb, r, weight[:, None] / (1 + r * r)


def edge_terms(poses: DataFrame, edges: DataFrame) -> DataFrame:
    """Terms of relative poses (a, b, measured, weight) at the poses (id, pose), with Cauchy weights:
    six residuals, in each pose's own axes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ja, jb, r, w = edge_system(*(matrix_of(batch.column(i), 4, 4) for i in (2, 3, 4)), np.asarray(batch.column(5), float))
            # each component has a weight of its own, which goes into its rows
            root = np.sqrt(w)
            jac = np.stack([ja, jb], axis=1) * root[:, None, :, None]
            nodes = np.stack([batch.column(0), batch.column(1)], axis=1)
            yield pa.RecordBatch.from_arrays([*map(list_column, (nodes, jac, -r * root)), pa.array(np.ones(len(r)))], ["nodes", "jac", "res", "weight"])

    own = lambda c, name: poses.select(F.col("id").alias(c), F.col("pose").alias(name))
    rows = edges.join(own("a", "__a"), "a").join(own("b", "__b"), "b").select("a", "b", "__a", "__b", "measured", F.col("weight").cast("double"))
    return rows.mapInArrow(run, "nodes array<long>, jac array<double>, res array<double>, weight double")


def place_terms(poses: DataFrame, places: DataFrame) -> DataFrame:
    """Terms that draw poses to known points (id, x, y, z, weight), with Cauchy weights."""
    m = F.col("pose")
    miss = [m[4 * k + 3] - F.col(a) for k, a in enumerate("xyz")]
    square = sum((v * v for v in miss[1:]), miss[0] * miss[0])
    turn = F.array(*[m[4 * k + j] if j < 3 else F.lit(0.0) for k in range(3) for j in range(6)])
    rows = poses.join(places, "id")
    return rows.select(F.array("id").alias("nodes"), turn.alias("jac"), F.array(*[-v for v in miss]).alias("res"), (F.col("weight") / (1 + square)).cast("double").alias("weight"))


def moved_poses(poses: DataFrame, steps: DataFrame) -> DataFrame:
    """Poses times the small motions (id, x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            pose, step = matrix_of(batch.column(1), 4, 4), np.zeros((batch.num_rows, 6))
            step[np.asarray(batch.column(2).is_valid())] = matrix_of(batch.column(2), 6)
            yield pa.RecordBatch.from_arrays([batch.column(0), list_column(pose @ exp_poses(step))], ["id", "pose"])

    return poses.join(steps, "id", "left").select("id", "pose", "x").mapInArrow(run, "id long, pose array<double>")


def anchored(poses: DataFrame, fixed: list[int] | None, d: int = 6, weight: float = 1e12) -> DataFrame:
    """Blocks that keep poses where they are: the given ones, or the first."""
    own = poses.where(F.col("id").isin(fixed)) if fixed else poses.agg(F.min("id").alias("id"))
    return own.select(F.col("id").alias("row"), F.col("id").alias("col"), F.array(*[F.lit(weight if i % (d + 1) == 0 else 0.0) for i in range(d * d)]).alias("value"))


def consistent(poses: DataFrame, edges: DataFrame, places: DataFrame | None = None, fixed: list[int] | None = None, rounds: int = 10, tolerance: float = 1e-8, more=None, size: int = 64, steps: int = 200, solve: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """A trajectory (id, pose) made consistent with relative poses between any of its poses, with known
    places, and with what ``more`` gives for the poses of a round (blocks of 6, such as sums of points
    against a map).  Gauss-Newton; all tables are distributed, ids may be any longs, best consecutive.

    Without places the poses ``fixed`` stay (the first, if none is named).  ``solve`` gives (id, x) of a round's
    summed blocks, as ``elimination.solution`` does for tracks; conjugate gradients, if none is named.
    """
    current = stored(poses.select(F.col("id").cast("long").alias("id"), "pose"), "poses")
    for _ in range(rounds):
        blocks = term_blocks(edge_terms(current, edges), 6)
        if places is not None:
            blocks = blocks.unionByName(term_blocks(place_terms(current, places), 6))
        if fixed or places is None:
            blocks = blocks.unionByName(anchored(current, fixed))
        if more is not None:
            blocks = blocks.unionByName(more(current))
        if solve is not None:
            s, step = None, solve(summed(blocks, 6), 6)
        else:
            s = system(summed(blocks, 6), 6, size)
            step = stored(conjugate_gradients(s, steps), "step")
        before, current = current, stored(moved_poses(current, step), "poses")
        far = step.agg(F.max(F.aggregate("x", F.lit(0.0), lambda s, x: s + F.abs(x)))).first()[0] or 0.0
        for used in (before, step) + ((s.matrix, s.parts) if s else ()):
            dropped(used)
        if far < tolerance:
            break
    return current


def map_blocks(points: DataFrame, gaussians: DataFrame, cells: Callable[[Column], dict[str, Column]], floor: float = 1e-2):
    """``more`` of ``consistent``: points (id of their pose, x, y, z in its frame) against a map's cells
    (mean_, cov_ and the key columns), each weighed by the cell's inverse covariance.  ``cells`` gives the key
    columns of a place (a struct of x, y, z)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            col = lambda *names: np.stack([np.asarray(batch.column(batch.schema.get_field_index(c)), float) for c in names], axis=1)  # noqa: B023, E731
            pose, own, mean, cov = matrix_of(batch.column(1), 4, 4), col("x", "y", "z"), col(*(f"mean_{a}" for a in "xyz")), col(*(f"cov_{c}" for c in PAIRS))
            c = cov[:, [0, 1, 2, 1, 3, 4, 2, 4, 5]].reshape(-1, 3, 3) + floor * floor * np.eye(3)
            turn = pose[:, :3, :3]
            r = mean - (np.einsum("nij,nj->ni", turn, own) + pose[:, :3, 3])
            x, y, z, o = own[:, 0], own[:, 1], own[:, 2], np.zeros(len(own))
            cross = np.stack([o, z, -y, -z, o, x, y, -x, o], axis=1).reshape(-1, 3, 3)
            jac = np.concatenate([turn, turn @ cross], axis=2)
            w = np.linalg.inv(c)
            ids = np.asarray(batch.column(0))
            square, right = np.einsum("nki,nkl,nlj->nij", jac, w, jac), np.einsum("nki,nkl,nl->ni", jac, w, r)
            own_ids, at = np.unique(ids, return_inverse=True)  # sums of the batch
            for cols, value, width in ((pa.array(own_ids), square.reshape(len(r), 36), 36), (pa.nulls(len(own_ids), pa.int64()), right, 6)):
                total = np.zeros((len(own_ids), width))
                np.add.at(total, at, value)
                yield pa.RecordBatch.from_arrays([pa.array(own_ids), cols, pa.array(total.tolist(), pa.list_(pa.float64()))], ["row", "col", "value"])

    def blocks(poses: DataFrame) -> DataFrame:
        p = points.join(poses, "id").withColumn("__g", transform("pose", "x", "y", "z"))
        keys = cells(F.col("__g"))
        rows = p.withColumns(keys).join(gaussians, list(keys)).select("id", "pose", "x", "y", "z", *[f"mean_{a}" for a in "xyz"], *[f"cov_{c}" for c in PAIRS])
        return rows.mapInArrow(run, BLOCK)

    return blocks


def voxel_blocks(points: DataFrame, gaussians: DataFrame, size: float, floor: float = 1e-2):
    """``map_blocks`` for voxels (ix, iy, iz)."""
    return map_blocks(points, gaussians, lambda g: {f"i{a}": cell(g[a], size, "floor") for a in "xyz"}, floor)


# ---- spherical refinement ------------------------------------------------------------------------


def ray_cells(place: Column, origin: tuple[float, float, float], step: float, degrees: float) -> dict[str, Column]:
    """Key columns ir, it, ip of a place seen from an origin: its range in steps, and the two angles of its ray.
    A cell is as deep as ``step`` everywhere and as wide as its angle makes it, as a scanner sees the world."""
    x, y, z = (place[a] - F.lit(float(o)) for a, o in zip("xyz", origin))
    r = F.sqrt(x * x + y * y + z * z)
    up = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(z, r)))))
    return {"ir": F.floor(r / step).cast("int"), "it": F.floor(F.coalesce(up, F.lit(0.0)) / degrees).cast("int"), "ip": F.floor(F.degrees(F.atan2(y, x)) / degrees).cast("int")}


def ray_gaussians(points: DataFrame, origin: tuple[float, float, float], step: float, degrees: float, least: int = 5) -> DataFrame:
    """(ir, it, ip, n, mean_x.., cov_xx..) of points (x, y, z) by ray cells: keys are spherical, sums are not."""
    p = points.withColumns(ray_cells(F.struct("x", "y", "z"), origin, step, degrees))
    covs = [F.covar_pop(a, b).alias(f"cov_{a}{b}") for a, b in PAIRS]
    return p.groupBy("ir", "it", "ip").agg(F.count("*").alias("n"), *[F.avg(a).alias(f"mean_{a}") for a in "xyz"], *covs).where(F.col("n") >= least)


def refined_by_rays(points: DataFrame, poses: DataFrame, reference: DataFrame, origin: tuple[float, float, float], step: float, degrees: float, window: int | None = 20, edge_weight: float = 1e4, rounds: int = 8, floor: float = 1e-2, least: int = 5, **solver) -> DataFrame:
    """Poses (id, pose) moved so that their points (id, x, y, z) fit the ray cells of a reference cloud.

    First rigidly: ``window`` consecutive poses move as one (none: this step is left out), so a window that is
    off as a whole comes back as a whole.  Then semi-rigidly: each pose by itself, with the motion between
    neighbours kept by ``edge_weight``.  Both are ``consistent`` with the cells' sums as blocks.
    """
    cells = lambda g: ray_cells(g, origin, step, degrees)
    gaussians = stored(ray_gaussians(reference, origin, step, degrees, least), "rays").drop("n")
    poses = poses.select(F.col("id").cast("long").alias("id"), "pose")
    none = poses.sparkSession.createDataFrame([], "a long, b long, measured array<double>, weight double")
    nothing = poses.sparkSession.createDataFrame([], "id long, x double, y double, z double, weight double")
    if window:
        own = poses.withColumn("w", F.floor(F.col("id") / window)).withColumn("first", F.lit(None).cast("array<double>"))
        first = own.groupBy("w").agg(F.min_by("pose", "id").alias("first"))
        own = own.drop("first").join(first, "w").withColumn("inside", P.product(P.inverse("first"), "pose"))
        whole = points.join(own.select("id", "w", "inside"), "id").withColumn("__p", transform("inside", "x", "y", "z")).select(F.col("w").alias("id"), "__p.x", "__p.y", "__p.z")
        moved = consistent(first.select(F.col("w").alias("id"), F.col("first").alias("pose")), none, places=nothing, rounds=rounds, more=map_blocks(whole, gaussians, cells, floor), **solver)
        poses = stored(own.join(moved.select(F.col("id").alias("w"), F.col("pose").alias("new")), "w").select("id", P.product("new", "inside").alias("pose")), "poses")
    at = Window.orderBy("id").partitionBy(F.floor(F.col("id") / 1024))  # pieces of neighbours; their seams have no edge
    edges = poses.select(F.lag("id").over(at).alias("a"), F.col("id").alias("b"), F.lag("pose").over(at).alias("__a"), F.col("pose").alias("__b")).where("a is not null")
    edges = stored(edges.select("a", "b", P.product(P.inverse("__a"), "__b").alias("measured"), F.lit(edge_weight).alias("weight")), "edges")
    return consistent(poses, edges, places=nothing, rounds=rounds, more=map_blocks(points, gaussians, cells, floor), **solver)


# ---- semi-rigid fusion ---------------------------------------------------------------------------


def knot_weights(track: DataFrame, ts: str, spacing: float) -> DataFrame:
    """Adds knot and share: a row lies between knot and knot + 1, at that share of the way."""
    at = F.col(ts).cast("double") / F.lit(float(spacing))
    return track.withColumn("knot", F.floor(at)).withColumn("share", at - F.floor(at))


def fix_terms(matched: DataFrame, ts: str, spacing: float) -> DataFrame:
    """Terms of rows with a place (x, y, z) and a fix (fx, fy, fz, weight): the corrections of the two knots
    around a row, by their shares, should make up what it is off."""
    rows = knot_weights(matched, ts, spacing)
    shares = [1 - F.col("share"), F.col("share")]
    jac = F.array(*[s if i == j else F.lit(0.0) for s in shares for i in range(3) for j in range(3)])
    miss = F.array(*[(F.col(f"f{a}") - F.col(a)).cast("double") for a in "xyz"])
    return rows.select(F.array("knot", F.col("knot") + 1).alias("nodes"), jac.alias("jac"), miss.alias("res"), F.col("weight").cast("double").alias("weight"))


def bend_terms(knots: DataFrame, stiffness: float) -> DataFrame:
    """Terms that hold neighbouring knots' corrections together."""
    jac = F.array(*[F.lit(float(s) if i == j else 0.0) for s in (-1, 1) for i in range(3) for j in range(3)])
    return knots.select(F.array("knot", F.col("knot") + 1).alias("nodes"), jac.alias("jac"), F.array(*[F.lit(0.0)] * 3).alias("res"), F.lit(float(stiffness)).alias("weight"))


def bent_onto(track: DataFrame, matched: DataFrame, ts: str, spacing: float, stiffness: float = 1.0, size: int = 64, steps: int = 200) -> DataFrame:
    """A track (ts, x, y, z) bent onto fixes: corrections at knots every ``spacing`` of time, linear between
    them, that make up what the ``matched`` rows (track rows with fx, fy, fz, weight) are off while
    neighbouring knots stay alike by ``stiffness``.  Adds cx, cy, cz and moves x, y, z.

    Knots a track passes without any fix are drawn along by their neighbours; a track without fixes stays.
    """
    rows = knot_weights(track, ts, spacing)
    bends = bend_terms(rows.select("knot").distinct(), stiffness)
    knots = solved(fix_terms(matched, ts, spacing).unionByName(bends), 3, size, steps)
    left, right = (knots.select((F.col("id") - k).alias("knot"), F.col("x").alias(f"__{k}")) for k in (0, 1))
    out = rows.join(left, "knot", "left").join(right, "knot", "left")
    c = {a: (1 - F.col("share")) * F.coalesce(F.col("__0")[i], F.lit(0.0)) + F.col("share") * F.coalesce(F.col("__1")[i], F.lit(0.0)) for i, a in enumerate("xyz")}
    out = out.withColumns({f"c{a}": v for a, v in c.items()}).withColumns({a: F.col(a) + F.col(f"c{a}") for a in "xyz"})
    return out.drop("knot", "share", "__0", "__1")

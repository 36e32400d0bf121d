"""Block systems solved by elimination, with the covariances of their unknowns.

Trajectories are long and narrow: most nodes have neighbours nearby only.  Ids are cut into parts of ``size``
consecutive ones.  A node whose neighbours all lie in its part is inner, and each part eliminates its inner
nodes by itself, which leaves a smaller system over the others.  That is cut into parts ``fan`` times as wide,
and so on until one part holds what a connected track has left: a level is an exchange of what is left, and a
million poses in a row need five.  On the way back each part fills in its inner nodes from the outer ones.

This is exact, so it also gives the blocks of the inverse on the diagonal, which conjugate gradients can't:
the covariance of a pose is known from that of the nodes its part keeps, level by level.  Nothing of a level
is held anywhere but in its parts.  A part that keeps over ``most`` nodes is refused (a graph with loops all
over is no track): solve such with ``sparse.conjugate_gradients``.

Null columns mean right sides, as in ``sparse``.  Nodes may have any ids; an empty table gives an empty
result; a node without a right side has a zero one; a system that is singular is an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.plans import sparse
from pointloom.plans.sparse import BLOCK
from pointloom.sources.store import dropped, stored


@dataclass
class Part:
    """The dense system of one part: its nodes, which of them are inner, matrix and right side."""

    nodes: np.ndarray
    inner: np.ndarray
    a: np.ndarray
    b: np.ndarray


def block_batch(rows: np.ndarray, cols: np.ndarray | None, values: np.ndarray) -> pa.RecordBatch:
    """Rows of BLOCK from values with a line each."""
    values = values.reshape(len(rows), -1)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * values.shape[1], pa.int32()), pa.array(values.ravel(), pa.float64()))
    return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.nulls(len(rows), pa.int64()) if cols is None else pa.array(cols, pa.int64()), lists], ["row", "col", "value"])


def entries_of(scalar: pa.Scalar, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, col and value (n, width) of a list of blocks; empty for a null."""
    if not scalar.is_valid or not len(scalar.values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, width))
    s = scalar.values
    return np.asarray(s.field("row")), np.asarray(s.field("col")), np.asarray(s.field("value").flatten(), float).reshape(-1, width)


def part_of(e: pa.Scalar, b: pa.Scalar, edge: pa.Scalar, d: int) -> Part:
    row, col, value = entries_of(e, d * d)
    nodes = np.unique(row)
    k = len(nodes)
    a, right = np.zeros((k, d, k, d)), np.zeros((k, d))
    a[np.searchsorted(nodes, row), :, np.searchsorted(nodes, col), :] = value.reshape(-1, d, d)
    if b.is_valid:
        at, _, value = entries_of(b, d)
        right[np.searchsorted(nodes, at)] = value
    outer = np.asarray(edge.values) if edge.is_valid else np.zeros(0, np.int64)
    return Part(nodes, ~np.isin(nodes, outer), a.reshape(k * d, k * d), right.ravel())


def split(part: Part, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of inner and outer unknowns, and the inner matrix's inverse times what links both and times the
    inner right side."""
    i = np.flatnonzero(np.repeat(part.inner, d))
    s = np.flatnonzero(np.repeat(~part.inner, d))
    both = np.linalg.solve(part.a[np.ix_(i, i)], np.column_stack([part.a[np.ix_(i, s)], part.b[i]]))
    return i, s, both[:, :-1], both[:, -1]


def _kept(d: int) -> Callable:
    """What a part leaves behind once its inner nodes are gone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for e, b, edge in zip(batch.column("e"), batch.column("b"), batch.column("edge")):
                part = part_of(e, b, edge, d)
                i, s, link, own = split(part, d)
                outer = part.nodes[~part.inner]
                n = len(outer)
                across = part.a[np.ix_(s, i)]
                left = (part.a[np.ix_(s, s)] - across @ link).reshape(n, d, n, d).transpose(0, 2, 1, 3)
                yield block_batch(np.repeat(outer, n), np.tile(outer, n), left.reshape(n * n, d * d))
                yield block_batch(outer, None, part.b[s] - across @ own)

    return run


def _filled(d: int, base: int, below: int | None, covariances: bool) -> Callable:
    """Solution and, if asked for, inverse of a part from those of its outer nodes.  Of the inverse come the
    blocks that the level below needs: of nodes in one of its parts (``below`` wide), or the diagonal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for e, b, edge, known, ends in zip(*(batch.column(c) for c in ("e", "b", "edge", "known", "ends"))):
                part = part_of(e, b, edge, d)
                i, s, link, own = split(part, d)
                n, outer = len(part.nodes), part.nodes[~part.inner]
                x = np.zeros(n * d)
                at, _, value = entries_of(ends, d)
                given = np.zeros((len(outer), d))
                given[np.searchsorted(outer, at)] = value
                x[s] = given.ravel()
                x[i] = own - link @ x[s]
                yield block_batch(part.nodes, None, x)
                if not covariances:
                    continue
                row, col, value = entries_of(known, d * d)
                m = len(outer)
                edge_cov = np.zeros((m, d, m, d))
                edge_cov[np.searchsorted(outer, row), :, np.searchsorted(outer, col), :] = value.reshape(-1, d, d)
                edge_cov = edge_cov.reshape(m * d, m * d)
                cov = np.zeros((n * d, n * d))
                cov[np.ix_(s, s)] = edge_cov
                cov[np.ix_(i, i)] = np.linalg.inv(part.a[np.ix_(i, i)]) + link @ edge_cov @ link.T
                cov[np.ix_(i, s)] = -link @ edge_cov
                cov[np.ix_(s, i)] = cov[np.ix_(i, s)].T
                if below is None:
                    r = c = np.arange(n)
                else:
                    place = (part.nodes - base) // below
                    r, c = np.nonzero(place[:, None] == place[None, :])
                yield block_batch(part.nodes[r], part.nodes[c], cov.reshape(n, d, n, d)[r, :, c, :])

    return run


def solution(blocks: DataFrame, d: int, size: int = 16, fan: int = 16, most: int = 500, covariances: bool = False) -> DataFrame:
    """(id, x) of summed blocks (row, col, value), or (id, x, covariance) with each node's block of the inverse.

    A part's work grows with the cube of its nodes, so ``size`` is small; a level is one exchange up and one down.
    """
    blocks = left = stored(blocks, "blocks")
    base = blocks.agg(F.min("row")).first()[0] or 0
    levels: list[DataFrame] = []
    width = size
    part = lambda c, w: F.expr(f"({c} - {base}L) div {w}L")
    entry = F.struct("row", "col", "value")
    while True:
        p, q = part("row", width), part("col", width)
        kinds = {"e": F.collect_list(F.when(p == q, entry)), "b": F.collect_list(F.when(F.col("col").isNull(), entry)), "edge": F.array_sort(F.collect_set(F.when(p != q, F.col("row"))))}
        rows = left.groupBy(p.alias("p")).agg(*[v.alias(k) for k, v in kinds.items()]).where("size(e) > 0")
        rows = rows.withColumn("edge", F.when(F.size("edge") > 0, F.col("edge"))).withColumn("nodes", F.size(F.filter("e", lambda x: x["row"] == x["col"])))
        levels.append(stored(rows, f"level-{len(levels)}"))
        seen = levels[-1].agg(F.max("nodes").alias("largest"), F.count("edge").alias("open")).first()
        if (seen["largest"] or 0) > most:
            raise ValueError(f"a part of {width} ids keeps {seen['largest']} nodes (at most {most}): this graph is no track, use conjugate gradients")
        if not seen["open"]:
            break
        beyond = left.where(p != q)
        upper = stored(levels[-1].where("edge is not null").select("e", "b", "edge").mapInArrow(_kept(d), BLOCK).unionByName(beyond), "left")
        if left is not blocks:
            dropped(left)
        left, width = upper, width * fan
    found = None
    for level in reversed(range(len(levels))):
        rows = levels[level]
        if found is None:
            none = F.lit(None).cast("array<struct<row: long, col: long, value: array<double>>>")
            rows = rows.withColumn("known", none).withColumn("ends", none)
        else:  # the nodes of the level above are this one's outer ones
            p, q = part("row", size * fan**level), part("col", size * fan**level)
            kinds = {"known": F.when(p == q, entry), "ends": F.when(F.col("col").isNull(), entry)}
            rows = rows.join(found.groupBy(p.alias("p")).agg(*[F.collect_list(v).alias(k) for k, v in kinds.items()]), "p", "left")
        below = size * fan ** (level - 1) if level else None
        run = _filled(d, base, below, covariances)
        filled = stored(rows.select("e", "b", "edge", "known", "ends").mapInArrow(run, BLOCK), "found")
        if found is not None:
            dropped(found)
        found = filled
    x = found.where("col is null").select(F.col("row").alias("id"), F.col("value").alias("x"))
    if covariances:
        x = x.join(found.where("row = col").select(F.col("row").alias("id"), F.col("value").alias("covariance")), "id")
    out = stored(x, "solution")
    for used in (blocks, found, *levels) + ((left,) if left is not blocks else ()):
        dropped(used)
    return out


def unit_variance(terms: DataFrame, unknowns: int) -> float:
    """Weighted squared residuals by degrees of freedom (residuals less unknowns; 1 if there are none): the
    variance of a residual of weight one, as the misfit shows it."""
    square = F.col("weight") * F.aggregate("res", F.lit(0.0), lambda s, r: s + r * r)
    r = terms.agg(F.sum(square).alias("s"), F.sum(F.size("res")).alias("n")).first()
    return float(r["s"] / (r["n"] - unknowns)) if (r["n"] or 0) > unknowns else 1.0


def scaled(covariance: str | Column, by: float) -> Column:
    return F.transform(covariance, lambda v: v * F.lit(float(by)))


def pose_covariances(poses: DataFrame, edges: DataFrame, places: DataFrame | None = None, fixed: list[int] | None = None, more: Callable | None = None, measured: bool = False, **parts: int) -> DataFrame:
    """(id, covariance) of each pose, 6 by 6 by rows (translation, rotation, in the pose's own axes), at poses
    that fit (as ``sparse.consistent`` leaves them), with the same edges, places, fixed poses and ``more``.

    Weights count as inverse variances; with ``measured`` they only say how residuals compare, and what the
    edges and places miss scales all.  Fixed poses have almost none.
    """
    poses = poses.select(F.col("id").cast("long").alias("id"), "pose")
    own = [sparse.edge_terms(poses, edges)] + ([sparse.place_terms(poses, places)] if places is not None else [])
    blocks = [sparse.term_blocks(t, 6) for t in own]
    held = bool(fixed) or places is None
    if held:
        blocks.append(sparse.anchored(poses, fixed))
    if more is not None:
        blocks.append(more(poses))
    total = blocks[0]
    for b in blocks[1:]:
        total = total.unionByName(b)
    out = solution(sparse.summed(total, 6), 6, covariances=True, **parts).select("id", "covariance")
    if not measured:
        return out
    free = 6 * (poses.count() - (len(fixed) if fixed else 1 if held else 0))
    terms = own[0] if len(own) == 1 else own[0].unionByName(own[1])
    return out.withColumn("covariance", scaled("covariance", unit_variance(terms, free)))

"""Elimination level by level against dense systems, and covariances against dense inverses."""

import numpy as np
import pytest

from pointloom.plans import elimination, solvers, sparse
from tests.test_sparse import chain, frames


def track_terms(rng, ids, d, loops):
    """Terms along a track, with some loops and a place for the first node, and the dense system."""
    n = len(ids)
    terms, a, b = [], np.zeros((n * d, n * d)), np.zeros(n * d)

    def add(nodes, jac, res, w):
        nonlocal a, b
        terms.append(([ids[k] for k in nodes], np.asarray(jac).ravel().tolist(), res.tolist(), w))
        full = np.zeros((len(res), n * d))
        for k, j in zip(nodes, jac):
            full[:, d * k : d * k + d] += j
        a, b = a + w * full.T @ full, b + w * full.T @ res

    for i, j in [(k, k + 1) for k in range(n - 1)] + loops:
        add([i, j], [-np.eye(d) + 0.1 * rng.normal(size=(d, d)), np.eye(d)], rng.normal(size=d), float(rng.uniform(0.5, 2)))
    add([0, 1], [np.eye(d), np.zeros((d, d))], rng.normal(size=d), 3.0)
    return terms, a, b


@pytest.mark.parametrize("ids, loops", [(list(range(70)), []), ([3 * k - 50 for k in range(40)], [(0, 39), (5, 20), (7, 8)]), ([7, 9], [])])
def test_solution_and_covariances_match_dense(spark, ids, loops):
    d = 2
    terms, a, b = track_terms(np.random.default_rng(1), ids, d, loops)
    df = spark.createDataFrame(terms, "nodes array<long>, jac array<double>, res array<double>, weight double")
    got = {r["id"]: r for r in elimination.solution(sparse.summed(sparse.term_blocks(df, d), d), d, size=4, fan=2, covariances=True).collect()}
    x, inverse = np.linalg.solve(a, b).reshape(-1, d), np.linalg.inv(a)
    assert set(got) == set(ids)
    for k, i in enumerate(ids):
        assert np.allclose(got[i]["x"], x[k], atol=1e-8)
        own = inverse[d * k : d * k + d, d * k : d * k + d]
        assert np.allclose(np.reshape(got[i]["covariance"], (d, d)), own, rtol=1e-6, atol=1e-9)


def test_separate_tracks_end_at_their_own_level(spark):
    """Two tracks without a link, one within a part, one over many."""
    one, a, _ = track_terms(np.random.default_rng(2), list(range(3)), 1, [])
    two, b, _ = track_terms(np.random.default_rng(3), list(range(100, 130)), 1, [(2, 25)])
    df = spark.createDataFrame(one + two, "nodes array<long>, jac array<double>, res array<double>, weight double")
    got = {r["id"]: r["covariance"][0] for r in elimination.solution(sparse.summed(sparse.term_blocks(df, 1), 1), 1, size=4, fan=4, covariances=True).collect()}
    assert np.allclose([got[i] for i in range(3)], np.diag(np.linalg.inv(a)))
    assert np.allclose([got[i] for i in range(100, 130)], np.diag(np.linalg.inv(b)))


def test_empty_and_no_track(spark):
    none = spark.createDataFrame([], sparse.BLOCK)
    assert elimination.solution(none, 3, covariances=True).count() == 0
    n = 12
    full = spark.createDataFrame([(i, j, [1.0 + n * (i == j)]) for i in range(n) for j in range(n)], sparse.BLOCK)
    with pytest.raises(ValueError, match="no track"):
        elimination.solution(full, 1, size=2, fan=2, most=6)


def test_poses_and_their_covariances(spark):
    true, drift, edges = chain(np.random.default_rng(5), 14, 0.03)
    p, e = frames(spark, drift, edges)
    direct = lambda blocks, d: elimination.solution(blocks, d, size=4, fan=4)
    out = sparse.consistent(p, e, rounds=6, solve=direct)
    got = {r["id"]: np.reshape(r["pose"], (4, 4)) for r in out.collect()}
    assert np.allclose([got[i] for i in range(14)], true, atol=1e-4)
    # dense information at the same poses
    a = np.zeros((84, 84))
    for r in sparse.summed(sparse.term_blocks(sparse.edge_terms(out, e), 6).unionByName(sparse.anchored(out, None)), 6).where("col is not null").collect():
        a[6 * r["row"] : 6 * r["row"] + 6, 6 * r["col"] : 6 * r["col"] + 6] = np.reshape(r["value"], (6, 6))
    want = np.linalg.inv(a)
    for r in elimination.pose_covariances(out, e, size=4, fan=4).collect():
        own = slice(6 * r["id"], 6 * r["id"] + 6)
        assert np.allclose(np.reshape(r["covariance"], (6, 6)), want[own, own], rtol=1e-5, atol=1e-8)


def test_measured_variance(spark):
    """Residuals of known size: the unit variance is their mean square by degrees of freedom."""
    terms = spark.createDataFrame([([0], [1.0], [v], 2.0) for v in (1.0, -1.0, 2.0)], "nodes array<long>, jac array<double>, res array<double>, weight double")
    assert elimination.unit_variance(terms, 1) == pytest.approx(2 * 6 / 2)
    assert elimination.unit_variance(terms, 3) == 1.0


def test_blocks_are_made_once_and_motions_in_whole_batches(spark):
    """Sums of a system run the terms' Python once, and poses of a batch move as one by one."""
    df = spark.createDataFrame([([0, 1], [-1.0, 1.0], [2.0], 1.0)], "nodes array<long>, jac array<double>, res array<double>, weight double")
    sums = sparse.summed(sparse.term_blocks(df, 1), 1)
    assert sums._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert {(r["row"], r["col"], *r["value"]) for r in sums.collect()} == {(0, 0, 1.0), (0, 1, -1.0), (1, 0, -1.0), (1, 1, 1.0), (0, None, -2.0), (1, None, 2.0)}
    steps = np.vstack([np.random.default_rng(5).normal(size=(6, 6)), np.zeros(6)])
    assert np.allclose(solvers.exp_poses(steps), [solvers.exp_pose(d) for d in steps], atol=1e-14)

"""Separate tracks solved each in one task against dense systems, and against the solver that crosses the cluster."""

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__
from pointloom.plans import elimination, sparse, trackwise
from pointloom.plans.solvers import exp_pose, exp_poses, log_poses
from tests.test_sparse import chain

POSES, EDGES = "track string, id long, pose array<double>, name string", "track string, a long, b long, measured array<double>, weight double"


def shuffled(spark):
    """Bytes that all tasks so far have written for exchanges."""
    told = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(told.apply(i).totalShuffleWrite() for i in range(told.size()))


@pytest.mark.parametrize("n, loops", [(1, []), (2, []), (3, [(0, 2), (1, 1)]), (70, [(0, 69), (5, 40), (6, 41)]), (12, [(i, j) for i in range(12) for j in range(i)])])
def test_direct_matches_dense(n, loops):
    rng, d = np.random.default_rng(1), 3
    a, b = 0.1 * np.eye(n * d), rng.normal(size=(n, d))
    found = [(k, k, 0.1 * np.eye(d)) for k in range(n)]
    for i, j in [(k, k + 1) for k in range(n - 1)] + [(min(p), max(p)) for p in loops]:
        jac = rng.normal(size=(d, d, 2))
        full = np.zeros((d, n * d))
        full[:, i * d : i * d + d] += jac[:, :, 0]
        full[:, j * d : j * d + d] += jac[:, :, 1]
        h = full.T @ full
        a += h
        found += [(p, q, h[p * d : p * d + d, q * d : q * d + d]) for p, q in dict.fromkeys(((i, i), (j, j), (i, j)))]
    row, col, value = (np.array(v) for v in zip(*found))
    assert np.allclose(trackwise.direct(row, col, value, b).ravel(), np.linalg.solve(a, b.ravel()), atol=1e-9)


def test_direct_refuses_what_is_no_track():
    n = 200
    row, col = np.triu_indices(n)
    with pytest.raises(ValueError, match="no track"):
        trackwise.direct(row, col, np.where(row == col, 2.0 * n, 1.0)[:, None, None], np.ones((n, 1)))


def test_jacobians_of_edges_match_differences():
    rng = np.random.default_rng(2)
    a, z = exp_poses(rng.normal(size=(40, 6))), exp_poses(0.5 * rng.normal(size=(40, 6)))
    b = a @ z @ exp_poses(np.repeat([0.0, 1e-6, 0.1, 0.6], 10)[:, None] * rng.normal(size=(40, 6)))
    error = lambda a, b: log_poses(np.linalg.inv(z) @ np.linalg.inv(a) @ b)
    ja, jb, r, w = sparse.edge_system(a, b, z, np.full(40, 2.0))
    assert np.allclose(r, error(a, b), atol=1e-12) and np.allclose(w, 2 / (1 + r * r))
    for k in range(6):
        m, back = (exp_pose(s * 1e-5 * np.eye(6)[k]) for s in (1, -1))
        assert np.allclose(ja[:, :, k], (error(a @ m, b) - error(a @ back, b)) / 2e-5, atol=1e-5)
        assert np.allclose(jb[:, :, k], (error(a, b @ m) - error(a, b @ back)) / 2e-5, atol=1e-5)


def test_tracks_settle_as_over_the_cluster(spark):
    """Tracks of several lengths, one without a name, one alone and one without edges, gathered or not; their
    edges have noise, so that no round ends at nothing."""
    rng = np.random.default_rng(7)
    poses, edges, want = [], [], {}
    for k, (track, n, start) in enumerate((("a", 30, 0), ("b", 14, 100), (None, 18, 200))):
        _, drift, own = chain(rng, n, 0.03)
        own = [(i, j, z @ exp_pose(0.01 * rng.normal(size=6)), w) for i, j, z, w in own]
        poses += [(track, start + i, m.ravel().tolist(), f"{track}-{i}") for i, m in enumerate(drift)]
        edges += [(track, start + i, start + j, z.ravel().tolist(), w) for i, j, z, w in own]
        p = spark.createDataFrame([r[1:3] for r in poses if r[0] == track], "id long, pose array<double>")
        e = spark.createDataFrame([r[1:] for r in edges if r[0] == track], EDGES.split(", ", 1)[1])
        direct = lambda blocks, d: elimination.solution(blocks, d, size=4, fan=4)
        want |= {r["id"]: r["pose"] for r in sparse.consistent(p, e, fixed=[start], rounds=8, solve=direct).collect()}
    alone = [("c", 300, exp_pose(np.ones(6)).ravel().tolist(), "c-0"), ("d", 400, poses[0][2], "d-0"), ("d", 401, poses[1][2], "d-1")]
    poses, want = poses + alone, want | {i: m for _, i, m, _ in alone}
    edges += [("a", 3, 103, poses[1][2], 9.0), ("b", 100, 999, poses[1][2], 9.0), (None, None, 201, poses[1][2], 9.0), ("z", 0, 1, poses[1][2], 9.0)]  # these leave their track
    p, e = spark.createDataFrame(poses, POSES), spark.createDataFrame(edges, EDGES)
    for most in (50_000, 16):
        out = trackwise.consistent(p, e, rounds=8, most=most)
        got = {r["id"]: r for r in out.collect()}
        assert out.columns == p.columns and got.keys() == want.keys()
        assert all((got[i]["track"], got[i]["name"]) == (t, name) for t, i, _, name in poses)
        assert all(np.allclose(got[i]["pose"], want[i], atol=1e-6) for i in want)
    assert trackwise.consistent(p.limit(0), e).count() == 0
    assert trackwise.consistent(p, e.limit(0)).where("track = 'b'").count() == 14


def test_tracks_that_miss_numbers_leave_others_as_they_are(spark):
    true, drift, own = chain(np.random.default_rng(5), 14, 0.03)
    rows = [(t, s + i, m.ravel().tolist(), "") for t, s in (("a", 0), ("b", 50)) for i, m in enumerate(drift)]
    links = [(t, s + i, s + j, (z * (np.nan if t == "b" and i == 4 else 1)).ravel().tolist(), w) for t, s in (("a", 0), ("b", 50)) for i, j, z, w in own]
    got = trackwise.consistent(spark.createDataFrame(rows, POSES), spark.createDataFrame(links, EDGES)).where("track = 'a'").collect()
    assert all(np.allclose(np.reshape(r["pose"], (4, 4)), true[r["id"]], atol=1e-6) for r in got) and len(got) == 14


def test_long_tracks_of_a_group_go_one_after_another(spark, monkeypatch):
    """Tracks dealt to one group by chance: a system holds those that begin within GROUP poses, however many meet."""
    sizes, settled = [], trackwise.settled
    monkeypatch.setattr(trackwise, "settled", lambda pose, *rest: sizes.append(len(pose)) or settled(pose, *rest))
    true, drift, own = chain(np.random.default_rng(5), 3000, 0.0)
    n = 5
    rows = pa.table({"track": np.tile(np.arange(n), 3000), "id": np.arange(3000).repeat(n) * n + np.tile(np.arange(n), 3000), "pose": list(drift.reshape(-1, 16).repeat(n, axis=0))})
    links = [(t, i * n + t, j * n + t, z.ravel(), w) for t in range(n) for i, j, z, w in own]
    links = pa.table(dict(zip(("track", "a", "b", "measured", "weight"), map(list, zip(*links)))))
    got = trackwise._group(rows.column_names, 1e12, 4, 1e-8)(rows, links)
    assert np.allclose(sparse.matrix_of(got["pose"].combine_chunks(), 4, 4), true.repeat(n, axis=0), atol=1e-6)
    assert sum(sizes) == n * 3000 and max(sizes) == 6000


def test_closed_tracks_write_no_system(spark, monkeypatch):
    """Users' tracks are solved where they lie: no system crosses the cluster, and what exchanges write is some
    bytes an event (some 7,000 before)."""
    monkeypatch.setattr(elimination, "solution", None)
    before = shuffled(spark)
    rows = __spark_entry__.queries()["closed_tracks"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 1000 and shuffled(spark) - before < 1000 * len(rows)

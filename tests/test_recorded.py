"""A session's folder, made by hand: numbers in names, layouts of trajectories, thinning and the offset."""

import numpy as np
import pytest

from pointloom.sources import recorded
from pointloom.sources.points import las_bytes

IDENTITY = "1 0 0 {0} 0 1 0 0.5 0 0 1 0"


@pytest.fixture
def folder(tmp_path):
    rng = np.random.default_rng(2)
    clouds = {}
    for k, n in ((0, 2500), (12, 7)):
        clouds[k] = np.round(rng.uniform(0, 10, (n, 3)), 3)
        (tmp_path / f"scan_lio_{k}.las").write_bytes(las_bytes(*clouds[k].T, scale=1e-3))
    (tmp_path / "notes.las").write_bytes(las_bytes(*np.zeros((3, 1))))
    rows = [f"1000000000000000001 {IDENTITY.format(1)}", f"2 {IDENTITY.format(2)} 77\r", f"3 {IDENTITY.format(3)} 78 0.1 0.2 0.3", "4 1 2 3", ""]
    (tmp_path / "trajectory_lio_0.csv").write_text("a header line\n" + "\n".join(rows))
    return str(tmp_path), clouds


def test_scans_nodes_and_offset(spark, folder):
    path, clouds = folder
    s = recorded.load_session(spark, path, centre=True)
    picked = np.concatenate([clouds[0][::1000], clouds[12][::1000]])
    assert np.allclose(s.offset, picked.mean(axis=0), atol=1e-9)
    assert {(r["scan_id"], r["points"], r["nodes"]) for r in s.scans.collect()} == {(0, 2500, 3), (12, 7, 0)}
    got = s.points.where("scan_id = 12").orderBy("point_id").select("x", "y", "z").collect()
    assert np.allclose(np.array(got), clouds[12] - s.offset, atol=1e-9)
    nodes = {r["pose"][3]: r for r in s.nodes.collect()}
    assert nodes[1.0]["ts_ns"] == 1000000000000000001 and nodes[1.0]["ts_unix_ns"] is None
    assert nodes[2.0]["ts_unix_ns"] == 77 and nodes[2.0]["om"] is None
    assert (nodes[3.0]["ts_unix_ns"], nodes[3.0]["ka"]) == (78, 0.3)


def test_each_scan_is_thinned_by_itself(spark, folder):
    path, clouds = folder
    s = recorded.load_session(spark, path, sizes=(2.0, 5.0, 10.5))
    for k, xyz in clouds.items():
        seen, want = set(), []
        for i, c in enumerate(map(tuple, np.floor(xyz / [2.0, 5.0, 10.5]).astype(int))):
            if c not in seen:
                seen.add(c)
                want.append(i)
        assert [r[0] for r in s.points.where(f"scan_id = {k}").orderBy("point_id").select("point_id").collect()] == want
    assert s.offset == (0.0, 0.0, 0.0)


def test_folder_without_scans(spark, tmp_path):
    (tmp_path / "notes.las").write_bytes(las_bytes(*np.zeros((3, 1))))
    s = recorded.load_session(spark, str(tmp_path), centre=True)
    assert s.points.count() == s.nodes.count() == s.scans.count() == 0 and s.offset == (0.0, 0.0, 0.0)

import random
import re

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pointloom.llm import additive_ann, components, mixing, simhash
from tests.llm.cases import documents


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_fingerprints(spark):
    df = documents(spark)
    got = sorted((str(r["doc_id"]), r["fingerprint"]) for r in simhash.near_duplicates(df).collect())
    assert got == sorted((str(r["doc_id"]), f"{plain_fingerprint(r['text']):016x}") for r in df.collect())


@pytest.mark.parametrize("block", [2048, 7])
def test_groups_match_all_pairs(spark, monkeypatch, block):
    """Random fingerprints in clusters, chains and copies against all pairs; with a small block every
    key is a hot one."""
    rng = random.Random(4)
    fps = [rng.getrandbits(64) for _ in range(150)]
    for f in list(fps[:12]):
        for _ in range(20):
            for b in rng.sample(range(64), rng.randint(0, 3)):
                f ^= 1 << b
            fps.append(f)
    fps += [0, 0, 1, 3, 2**63, fps[0], fps[0]]
    df = spark.createDataFrame([(i, f - (1 << 64) * (f >> 63)) for i, f in enumerate(fps)], "doc_id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs: docs.withColumnRenamed("fp", "text").select(*simhash.identity(), F.col("text").alias("fp")))
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df, block).collect()}
    links = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    assert got == plain_components(range(len(fps)), links)


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_bit_sliced_comparison(radius):
    rng = np.random.default_rng(radius)
    sizes = np.array([1, 2, 63, 64, 65, 200])
    fps = rng.integers(0, 2**63, sizes.sum(), dtype=np.uint64)
    for i in range(1, len(fps), 2):
        fps[i] = fps[i - 1]
        for b in rng.choice(64, rng.integers(0, 5), replace=False):
            fps[i] ^= np.uint64(1) << np.uint64(b)
    a, b = simhash.star_links(fps, sizes, radius, blocks=10)
    at, got = 0, plain_components(range(len(fps)), [])
    want = []
    for n in sizes:
        want += [(i, j) for i in range(at, at + n) for j in range(at, i) if int(fps[i] ^ fps[j]).bit_count() <= radius]
        at += n
    value = {int(f): i for i, f in reversed(list(enumerate(fps.tolist())))}
    got = plain_components(range(len(fps)), [(value[int(x)], value[int(y)]) for x, y in zip(a, b)] + [(i, value[int(f)]) for i, f in enumerate(fps.tolist())])
    assert got == plain_components(range(len(fps)), want + [(i, value[int(f)]) for i, f in enumerate(fps.tolist())])


def test_one_of_each_group_stays(spark):
    df = documents(spark)
    kept = simhash.first_of_group(df)
    assert kept.columns == df.columns and {r["__rid"] for r in kept.collect()} == {"x"}
    groups = {r["component_id"] for r in simhash.near_duplicates(df).collect()}
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(ids) == sorted(groups)
    nameless = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (None, "something else entirely")], "doc_id long, text string")
    assert simhash.first_of_group(nameless).count() == 2
    assert simhash.first_of_group(documents(spark, empty=True)).count() == 0 == simhash.near_duplicates(documents(spark, empty=True)).count()


def test_components_of_chains_and_hubs(spark):
    rng = random.Random(6)
    links = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 50)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(60)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert got == plain_components(sorted(nodes), [x for x in links if x[0] != x[1]])


def sql_mix(df):
    con = duckdb.connect()
    documents = df.select("doc_id", "text", "source").toPandas()  # noqa: F841
    con.register("documents", documents)
    return sorted(con.execute(mixing.MIX_SQL).fetchall())


def test_mix_matches_sql(spark):
    for sf in ("sf0.001",):
        df = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
        for slot_rows in (None, 500, 3):
            assert sorted(map(tuple, mixing.mix(df, slot_rows=slot_rows).collect())) == sql_mix(df)


def test_targets_fill_up(spark):
    sizes = spark.createDataFrame([("a", 10, 1), ("b", 1000, 1), ("c", 100, 1), ("d", 0, 1), (None, 50, 1)], "source string, source_size long, source_rows long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    assert sum(got.values()) == pytest.approx(1.5 * 1160) and got["a"] == 20 and got["d"] == 0 and got["c"] == 200 and got[None] == 100
    assert got["b"] == pytest.approx(1740 - 320)


def test_mix_cases(spark):
    df = documents(spark)
    rows = mixing.mix(df).collect()
    assert len(rows) == df.count()
    assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in rows)
    assert sum(r["taken"] for r in rows) <= 1.5 * sum(r["size"] for r in rows)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(df.repartition(7)).collect()))
    out = mixing.mixed(df)
    assert out.columns == df.columns
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sum(words(r["text"]) for r in out.collect()) == sum(r["taken"] for r in rows)
    for empty in (documents(spark, empty=True), documents(spark, [None, "", " "])):
        assert mixing.mixed(empty).count() == 0
        assert all(r["taken"] == 0 for r in mixing.mix(empty).collect())


def cloud(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, v string, cell string")


def exact(rows, every, k):
    good = {i: np.pad(v, (0, 8 - len(v))) for i, v, *_ in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    out = {}
    for q in (i for i in good if i % every == 0):
        s = sorted((-float(good[q] @ v / np.linalg.norm(good[q]) / np.linalg.norm(v)), i) for i, v in good.items() if i != q)
        out[q] = [(i, -d) for d, i in s[:k]]
    return out


def test_search_cases(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist(), "x", "y") for i in range(60)] + [(100 + i, [1.0] * 8, None, None) for i in range(40)]
    rows += [(200, None, "", ""), (201, [0.0] * 8, "", ""), (202, [float("nan")] + [1.0] * 7, "", ""), (203, [None] + [1.0] * 7, "", ""), (204, [float("inf")] * 8, "", ""), (205, [1.0], "", ""), (206, [], "", ""), (None, [1.0] * 8, "", ""), (3, rows[3][1], "", "")]
    got = {}
    for r in sorted(additive_ann.nearest(cloud(spark, rows), every=10).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = exact(rows, 10, 5)
    assert set(got) == set(want)
    for q in want:
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]])
        if q >= 100:
            assert [i for i, _ in got[q]] == [i for i in range(100, 140) if i != q][:5]  # ties: the smaller ids
    assert additive_ann.nearest(cloud(spark, [])).count() == 0
    few = additive_ann.nearest(cloud(spark, [(0, [1.0, 2.0], "", ""), (1, [2.0, 1.0], "", "")])).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in few] == [(0, 1, 1)] and few[0]["score"] == pytest.approx(0.8)


def test_one_id_with_two_vectors_and_huge_components(spark):
    rows = [(0, [1e300, 1e300]), (0, [1.0, 0.0]), (1, [1e-300, 0.9e-300]), (2, [-1.0, 0.0]), (1, [0.0, 3.0])]
    got = sorted((r["rank"], r["vec_id"], round(r["score"], 6)) for r in additive_ann.nearest(cloud(spark, [(*r, "", "") for r in rows])).collect())
    one = np.array([[1.0, 1.0], [1.0, 0.0], [1.0, 0.9], [-1.0, 0.0], [0.0, 1.0]])
    one /= np.linalg.norm(one, axis=1, keepdims=True)
    want = []
    for q in (0, 1):  # both rows with id 0 ask, and each is a candidate of the other
        s = sorted((-round(float(one[q] @ one[i]), 6), rows[i][0]) for i in range(5) if i != q)
        want += [(rank, i, -x) for rank, (x, i) in enumerate(s, 1)]
    assert got == sorted(want)


def test_near_copies_are_reranked_whole(spark):
    """A third of the rows are near copies of one vector, more than any fixed list would hold; with all
    cells visited the result is exact."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2400, 24))
    x[:800] = x[0] + 0.003 * rng.normal(size=(800, 24))
    ids = rng.permutation(2400)
    got = {}
    for r in additive_ann.nearest(cloud(spark, [(int(i), v.tolist(), "", "") for i, v in zip(ids, x)]), every=40, probe=10_000).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for i in np.flatnonzero(ids % 40 == 0):
        s = unit @ unit[i]
        s[i] = -9
        assert [got[ids[i]][r] for r in range(1, 6)] == ids[np.argsort(-s)[:5]].tolist()


def test_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    pdf = df.toPandas().sort_values("vec_id")
    x = np.stack(pdf["embedding"]).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = pdf["vec_id"].to_numpy()
    got = {}
    for r in additive_ann.nearest(df).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = total = 0
    for i in np.flatnonzero(ids % 50 == 0):
        s = x @ x[i]
        s[i] = -9
        hits += len(got[ids[i]] & set(ids[np.argsort(-s, kind="stable")[:5]].tolist()))
        total += 5
    assert hits / total >= 0.9


def test_beam_search_is_better_than_greedy():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(800, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    books = additive_ann.fit_codebooks(x, m=4, k=16, cells=8)
    error = lambda beam: ((x - additive_ann.decoded(additive_ann.encode(x, books, beam), books)) ** 2).sum()
    assert error(4) < error(1)


def test_sources_end_near_their_targets(spark):
    """Within half the longest document of a source and of where the budget ends; a source of one document too."""
    import pyspark.sql.functions as F

    one = spark.createDataFrame([(1, "w " * 304, "a"), (2, "w " * 301, "b"), (3, "w " * 80, "c"), (4, None, "d")], "doc_id long, text string, source string")
    taken = {r["source_size"]: (r["taken"], r["target"]) for r in mixing.mix(one).collect()}
    assert taken[301][0] == 301 and abs(taken[301][0] - taken[301][1]) <= 301 / 2
    for sf in ("sf0.001", "sf0.01", "sf0.1"):
        docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
        rows = mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("longest")).collect()
        total, budget = sum(r["taken"] for r in rows), sum(r["target"] for r in rows)
        assert 0 <= budget - total <= max(r["longest"] for r in rows)
        for r in rows:
            assert abs(r["taken"] - r["target"]) <= r["longest"] / 2 + r["target"] * 0.02, (sf, r)


def test_rows_without_an_id_are_spread_and_mixed_alike(spark):
    rows = [(None if i % 3 else 7, f"own {i} " + "w " * (i % 50), "s" if i % 4 else "t") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    queue = mixing.queued(df)[0]
    assert queue.select("__place.key").distinct().count() == 2000
    got = sorted(map(str, mixing.mix(df).collect()))
    assert got == sorted(map(str, mixing.mix(df.repartition(9)).collect()))


def test_cells_and_share_of_rows_scored_follow_the_square_root():
    """More rows, more cells, with the same sample; cells of clustered vectors hold their neighbours."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(60_000, 16)) * 0.25 + rng.normal(size=(300, 16))[rng.integers(0, 300, 60_000)]
    x = additive_ann.unit(x)
    shares = []
    for n in (15_000, 60_000):
        books = additive_ann.fit_codebooks(x[:4000], cells=int(np.ceil(np.sqrt(n))), m=3, k=32)
        assert len(books[0]) * len(books[1]) >= np.sqrt(n)
        own = additive_ann.encode(x[:n], books)
        cell = own[:, 0].astype(int) * len(books[1]) + own[:, 1]
        q = np.arange(0, n, n // 60)
        near = np.argsort(-(x[q] @ x[:n].T), axis=1)[:, 1:6]
        place = np.argsort(additive_ann.cell_order(x[q], books), axis=1)
        ranks = np.sort(np.take_along_axis(place, cell[near], axis=1).ravel())
        probe = ranks[int(0.97 * len(ranks))] + 1
        visited = place[:, np.arange(place.shape[1])] < probe
        shares.append(float((visited * np.bincount(cell, minlength=visited.shape[1])).sum() / len(q) / n))
    assert shares[1] < shares[0] < 0.5, shares

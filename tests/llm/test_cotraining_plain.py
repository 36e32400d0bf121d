"""Co-training against a plain version that holds everything in dense arrays."""

import zlib

import numpy as np
import pytest

from pointloom.llm import cotraining as C
from tests.llm.cases import documents


def plain_logistic(x, y, weight, w, bias, steps):
    m, v, mb, vb = 0 * w, 0 * w, 0.0, 0.0
    for t in range(1, steps + 1):
        g = weight * (1 / (1 + np.exp(-np.clip(x @ w + bias, -35, 35))) - y) / weight.sum()
        gw, gb = x.T @ g + 1e-4 * w, g.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw**2, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        w = w - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        bias = bias - 0.1 * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    return w, bias


def plain_probabilities(rows, y, held, rounds=C.ROUNDS, most=C.PER_ROUND):
    """``rows``: (text features, metadata features) of each document; ``y``: label or None; ``held``: by document."""
    fit = [i for i, v in enumerate(y) if v is not None and not held[i]]
    out = [i for i, v in enumerate(y) if v is not None and held[i]]
    if len({y[i] for i in fit}) < 2 or not out:
        return np.ones(len(y))
    dense = []
    for view in (0, 1):
        known = []
        n, n1 = len(fit), sum(y[i] for i in fit)
        for f in sorted({f for i in fit for f in rows[i][view]}):
            have = [i for i in fit if f in rows[i][view]]
            good = sum(y[i] for i in have)
            share = len(have) / n
            z = (good / n1 - (len(have) - good) / (n - n1)) / max(share * (1 - share), 1e-12) ** 0.5 / (1 / n1 + 1 / (n - n1)) ** 0.5
            if len(have) >= C.LEAST_DOCS and abs(z) >= C.LEAST_Z:
                known.append(f)
        dense.append(np.array([[f in r[view] for f in known] for r in rows], float).reshape(len(rows), len(known)))
    learns = [[(i, y[i], 1.0) for i in fit] for _ in (0, 1)]
    given = [set(), set()]
    models = [(np.zeros(x.shape[1]), 0.0) for x in dense]
    rate = sum(y[i] for i in fit) / len(fit)
    for r in range(rounds + 1):
        for v in (0, 1):
            at, label, weight = (np.array(c) for c in zip(*learns[v]))
            models[v] = plain_logistic(dense[v][at.astype(int)], label, weight, *models[v], 80 if r == 0 else 30)
        z = np.column_stack([dense[v] @ models[v][0] + models[v][1] for v in (0, 1)])
        if r == rounds:
            break
        truth = np.array([y[i] for i in out], float)
        for v in (0, 1):
            w = C.combined(np.column_stack([z[out, v], np.zeros(len(out))]), truth)
            p = 1 / (1 + np.exp(-(w[0] * z[:, v] + w[2])))
            new = [i for i in range(len(y)) if y[i] is None and i not in given[v]]
            for value, share in ((1, rate), (0, 1 - rate)):
                sure = p if value else 1 - p
                able = sorted((i for i in new if sure[i] >= C.SURE), key=lambda i: -sure[i])[: max(1, int(most * share))]
                learns[1 - v] += [(i, value, 0.3) for i in able]
                given[v] |= set(able)
    w = C.combined(z[out], np.array([y[i] for i in out], float))
    return 1 / (1 + np.exp(-(z @ w[:2] + w[2]))), sum(map(len, given))


def test_scores_match_a_plain_version(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = {r["doc_id"]: r for r in C.quality_classifier(docs, labels).collect()}
    all_docs = sorted(docs.collect(), key=lambda r: r["doc_id"])
    label = {r["doc_id"]: r for r in labels.collect()}
    rows = [(C.text_features(r["text"], {}), set(C.meta_features(r["source"], r["lang"], r["n_chars"]))) for r in all_docs]
    held = [zlib.crc32(b"held %d" % r["doc_id"]) % 1000 < 1000 * C.HELD_OUT for r in all_docs]
    for name, column, flip in C.JUDGEMENTS:
        y = [None if (x := label.get(r["doc_id"])) is None or x[column] is None else (1 - x[column] if flip else x[column]) for r in all_docs]
        p, given = plain_probabilities(rows, y, held)
        assert given > 50  # the views do teach each other
        assert [got[r["doc_id"]][name] for r in all_docs] == pytest.approx(p.tolist(), abs=2e-6)


def test_repeated_ids_and_pool(spark):
    """Labelled ids that stand in many rows are fitted on once; documents without a label teach, however many."""
    texts = [("good calm words here " + str(i)) if i % 2 else f"awful worthless junk {i}" for i in range(80)]
    df = documents(spark, texts)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    many = df.union(df.where("doc_id = 3")).union(df.where("doc_id = 3")).union(df.where("doc_id = 4"))
    score = lambda d: {(r["doc_id"], r["quality"]) for r in C.quality_classifier(d, labels).collect()}
    assert C.labelled_rows(many, labels).num_rows == 40
    assert C.labelled_rows(many, labels, most=10).num_rows == 10
    size = C.labelled_rows(many, labels, most_size=60).num_rows
    assert 0 < size < 40
    assert score(many) == score(df)


def test_one_huge_document_does_not_empty_the_sample(spark):
    """A document with more features than all may have is passed over; those after it by hash still teach."""
    rows = [(i, " ".join(f"w{j}" for j in range(5000 if i % 7 == 0 else 5)), "s", "en", 1) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    got = C.labelled_rows(docs, labels, most_size=1000).column("doc_id").to_pylist()
    assert got == [i for i in range(60) if i % 7]

"""The filter audit against a plain loop over documents and orders, and against its SQL."""

import re
from collections import Counter
from itertools import permutations

import duckdb
import pytest

from pointloom.llm import filter_audit, queries

from .cases import documents

DATA = "/root/testdata/sf0.001"
COLUMNS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def plain(docs, labels):
    """{(part, order, step): figures}, each document walked through each order."""
    known = {}
    for doc_id, quality, toxic in labels:
        q, t = known.get(doc_id, (0, 0))
        known[doc_id] = (q or int(quality == 1), t or int(toxic == 1))
    fails = []
    for doc_id, text, source in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        copy = doc_id is not None and any((t or "") == text and d is not None and d < doc_id for d, t, _ in docs)
        conditions = (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), bool(re.search(r"[#$%&*|]", text)), copy)
        fails.append((source or "", {f for f, x in zip("ABCDE", conditions) if x}, *(known.get(doc_id, (0, 0)) if doc_id is not None else (0, 0))))
    out, shapley = {}, Counter()
    for part in {f[0] for f in fails}:
        own = [f[1:] for f in fails if f[0] == part]
        for order in map("".join, permutations("ABCDE")):
            left = list(own)
            for step, name in enumerate(order, 1):
                gone = [x for x in left if name in x[0]]
                left = [x for x in left if name not in x[0]]
                failing = [x for x in own if name in x[0]]
                shapley[part, name] += len(gone)
                out[part, order, step] = [len(left), len(gone), len(failing) - len(gone), sum(x[0] == {name} for x in own), sum(x[1] for x in gone), sum(x[2] for x in gone)]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def found(df):
    rows = df.collect()
    got = {(r.part, r.filter_order, r.step): tuple(r[c] for c in COLUMNS) for r in rows}
    assert len(got) == len(rows)
    return got


@pytest.mark.parametrize("partitions", [None, 1, 7, 40])
def test_awkward_rows(spark, partitions):
    docs = documents(spark)
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    labels = [(r[0], i % 3 % 2, i % 2) for i, r in enumerate(rows) if i % 4] + [(None, 1, 1), (6, None, 1), (7, 1, None), (7, 0, 0)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert found(filter_audit.audit(docs, table, partitions)) == plain(rows, labels)


def test_copies_over_many_partitions(spark):
    """One text holds over a third of the rows: it runs over several partitions, some of it alone in one."""
    import random

    rng = random.Random(3)
    rows = [(i, rng.choice(["same text", "same text", "other", None, "", f"own {i}"]), "s") for i in range(600)]
    rows += [(None, "same text", "s"), (0, "same text", "s"), (0, "same text", "s")]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for partitions in (3, 11):
        got = sorted((r.doc_id is None, r.doc_id, r["mask"]) for r in filter_audit.failure_masks(docs, partitions).collect())
        first = {}
        for d, t, _ in rows:
            if d is not None:
                first[t or ""] = min(first.get(t or "", d), d)
        want = sorted((d is None, d, 1 + 16 * (d is not None and first[t or ""] < d)) for d, t, _ in rows)
        assert [(d, m & 17) for _, d, m in got] == [(d, m) for _, d, m in want]


def test_empty(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(documents(spark, empty=True), labels).count() == 0


def test_against_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = {(r[0], r[1], r[2]): r[3:] for r in con.execute(filter_audit.AUDIT_SQL).fetchall()}
    got = found(queries.op13_filter_audit(spark, DATA))
    assert got == want and len(got) % 600 == 0

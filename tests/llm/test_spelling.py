"""Spelling variants against all pairs, against SQL, with crowded halves divided, and on awkward rows."""

import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from pointloom.llm import queries, spelling
from pointloom.llm.automata import Automaton

from .cases import documents

DATA = "/root/testdata/sf0.001"
ASCII = str.maketrans(spelling.UPPER, spelling.LOWER)


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def counted(rows, letters=6, count=5):
    words = Counter()
    for doc_id, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(ASCII)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            words[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    return {w: n for w, n in words.items() if len(w) >= letters and n >= count}


def plain(words, ratio=5):
    form, out = {}, {}
    for w, n in words.items():
        around = [v for v in words if near(w, v)]
        best = min(around, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * n else None
        out[w] = len(around)
    result = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        result.add((w, form[w], root, n, out[w], words[form[w]] if form[w] else None))
    return result


def found(df):
    rows = [tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_automaton_is_minimal_and_numbers_its_words():
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abé") for _ in range(rng.randint(1, 8))) for _ in range(400)})
    a = Automaton(words)
    for i, w in enumerate(words):
        state, number = a.root, 0
        for c in w:
            edge, there = a.step(*(spelling.np.array([x]) for x in (state, ord(c))))
            assert there[0]
            state, number = int(a.target[edge[0]]), number + int(a.skip[edge[0]])
        assert number == i and a.final[state]
    rests = {frozenset(w[k:] for w in words if w[:k] == p) for p in {w[:k] for w in words for k in range(len(w) + 1)} for k in [len(p)]}
    assert len(a.first) - 1 == len(rests)  # one state for each set of rests


def crowded(seed, n):
    """Words that share halves, runs of one letter, and chains of counts."""
    rng = random.Random(seed)
    words = {"".join(rng.choice("ab") for _ in range(rng.randint(6, 9))) for _ in range(n)}
    words |= {"common" + "".join(rng.choice("abcé") for _ in range(rng.randint(1, 3))) for _ in range(n)}
    words |= {"".join(rng.choice("xyß") for _ in range(3)) + "ending" for _ in range(n)} | {"a" * k for k in range(6, 14)}
    return {w: rng.choice([5, 6, 30, 160, 900, 5000]) for w in words}


@pytest.mark.parametrize("limit,bucket", [(20_000, 40_000), (12, 100), (2, 40_000)])
def test_crowded_halves(spark, limit, bucket):
    words = crowded(limit, 120)
    rows = [(1, " ".join(" ".join([w] * n) for w, n in words.items()))]
    known = counted(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(spelling.variants(docs, limit=limit, bucket_rows=bucket)) == plain(known)


def test_no_pair_is_found_twice_when_groups_are_divided(spark):
    words = spark.createDataFrame(sorted(crowded(9, 150).items()), "word string, n long")
    parts = spelling.near_words(words, limit=3, bucket_rows=500).groupBy("word").agg({"n_near": "sum"}).collect()
    known = [r.word for r in words.collect()]
    assert {r[0]: r[1] for r in parts} == {w: k for w in known if (k := sum(near(w, v) for v in known))}


def test_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = con.execute(spelling.VARIANTS_SQL).fetchall()
    names = [d[0] for d in con.description]
    assert names == ["word", "form", "root", "n", "n_near", "form_n"]
    got = found(queries.op12_spelling_variants(spark, DATA))
    assert len(want) == len(set(want)) and got == set(want)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    assert {(w, n) for w, _, _, n, _, _ in got} == set(counted(rows).items())


def test_awkward_rows(spark):
    docs = documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    odd = ["ÀÉÎõü " * 9 + "àéîõü " * 7 + "ÀÉÎõüx " * 60 + "ÀÉÎõüX" * 1, "x" * 3000 + (" " + "x" * 3000) * 5 + (" " + "x" * 2999) * 30, "don't_stop" * 20]
    extra = spark.createDataFrame([(900 + i, t, *[None] * 9) for i, t in enumerate(odd)], docs.schema)
    rows += [(900 + i, t) for i, t in enumerate(odd)]
    assert found(spelling.variants(docs.union(extra))) == plain(counted(rows))
    assert spelling.variants(documents(spark, empty=True)).count() == 0

import random

import numpy as np
import pytest

import corpus_pipeline
from pointloom.llm import simhash_sets
from tests.llm.cases import documents
from tests.llm.test_whole_table import plain_components


def plain_set(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def alike(a, b):
    return len(a & b) / len(a | b) >= 0.8


def edited(rng, words, n):
    words = list(words)
    for i in rng.sample(range(len(words)), n):
        words[i] = f"new{rng.randrange(10**6)}"
    return words


def family_texts():
    """Groups of documents with 0 to 8 of 200 words changed from one of theirs, and one whose members differ more."""
    rng = random.Random(5)
    texts = []
    for size, most in ((30, 3), (30, 5), (40, 8), (1, 0), (2, 4)):
        base = [f"w{rng.randrange(5000)}" for _ in range(200)]
        texts += [" ".join(edited(rng, base, rng.randint(0, most))) for _ in range(size)]
    return texts + [None, "", "a b", "A  b", "a b c d e f"]


def test_stage_keeps_one_of_each_pair_with_a_few_words_edited(spark):
    rng = random.Random(1)
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    docs = documents(spark, [" ".join(base), " ".join(edited(rng, base, 5)), " ".join(edited(rng, base, 60))])
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == [0, 2]


@pytest.mark.parametrize("block,crowd", [(512, 64), (5, 64), (5, 2), (512, 2)])
def test_groups_match_all_pairs(spark, monkeypatch, block, crowd):
    monkeypatch.setattr(simhash_sets.apart, "__defaults__", (block, 1_000_000))
    texts = family_texts()
    sets = [plain_set(t) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if alike(sets[i], sets[j])]
    want = sorted(set(plain_components(range(len(sets)), links).values()))
    got = simhash_sets.first_of_group(documents(spark, texts), crowd=crowd)
    assert sorted(r["doc_id"] for r in got.collect()) == want and len(want) > 6
    assert simhash_sets.first_of_group(documents(spark, empty=True)).count() == 0


def test_table_matches_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.collect()
    sets = {r["doc_id"]: plain_set(r["text"]) for r in rows}
    links = [(a, b) for a in sets for b in sets if b < a and alike(sets[a], sets[b])]
    got = simhash_sets.first_of_group(docs)
    assert got.columns == docs.columns
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(set(plain_components(sets, links).values()))


def test_block_links_and_similarity():
    texts = [t for t in family_texts() if t and len(t) > 20]
    sets = [simhash_sets.shingle_set(t) for t in texts]
    plain = [plain_set(t) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if alike(plain[i], plain[j])]
    assert links == [(i, j) for i in range(len(sets)) for j in range(i) if simhash_sets.similarity(sets[i], sets[j]) >= 0.8]
    a, b = simhash_sets.block_links(sets, np.arange(len(sets)), 0.8)
    assert plain_components(range(len(sets)), list(zip(a.tolist(), b.tolist()))) == plain_components(range(len(sets)), links)


def test_one_id_with_two_texts(spark):
    rows = [(1, "one two three four five six"), (1, "seven eight nine ten eleven twelve"), (1, "one two three four five six")]
    got = simhash_sets.first_of_group(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == sorted(set(rows))


def test_prefixes_lose_no_pair():
    """Any two sets 0.8 alike share a shingle of the shorter's short and the longer's long prefix, in any order."""
    rng = random.Random(4)
    for _ in range(3000):
        n = rng.randint(1, 60)
        a = rng.sample(range(300), n)
        b = list(a)
        for _ in range(rng.randint(0, n // 4 + 1)):
            if rng.random() < 0.5 and len(b) > 1:
                b.pop(rng.randrange(len(b)))
            else:
                b.append(rng.randrange(300, 400))
        short, long = sorted((set(a), set(b)), key=len)
        if len(short & long) / len(short | long) >= 0.8:
            order = list(range(400))
            rng.shuffle(order)
            first = lambda s, k: set(sorted(s, key=order.__getitem__)[: simhash_sets.prefix_lengths(len(s), 0.8)[k]])  # noqa: B023, E731
            assert first(short, 0) & first(long, 1)


def template_texts(rng, n, common=120, own=30):
    base = [f"c{i}" for i in range(common)]
    return [" ".join(base + [f"o{rng.randrange(10**7)}" for _ in range(own)]) for _ in range(n)]


def test_documents_of_a_template_do_not_all_meet(spark):
    """Alike at 0.63, so none is a copy; a few true copies among them are found, and hardly any pair is compared."""
    rng = random.Random(7)
    texts = template_texts(rng, 1500)
    copies = [" ".join([*texts[k].split()[:-2], "x", "y"]) for k in range(0, 100, 10)]
    docs = documents(spark, texts + copies).where("doc_id is not null")
    seen = []
    plain = simhash_sets.candidates_in
    simhash_sets.candidates_in = lambda rows, least: seen.append(rows.count()) or plain(rows, least)
    try:
        got = sorted(r["doc_id"] for r in simhash_sets.first_of_group(docs).collect())
    finally:
        simhash_sets.candidates_in = plain
    assert got == list(range(1500)) and seen[0] < 3000


def test_recall_at_the_limit(spark):
    """Pairs planted between 0.80 and 0.85 in the 0.01 table: at least 0.99 of them are found."""
    rng = random.Random(8)
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect() if r["text"] and len(r["text"].split()) > 150]
    rows, planted = [], []
    for t in texts[:400]:
        words = t.split()[:400]
        other = edited(rng, words, round(len(words) * 0.021))
        if 0.8 <= len(plain_set(" ".join(words)) & plain_set(" ".join(other))) / len(plain_set(" ".join(words)) | plain_set(" ".join(other))) < 0.85:
            planted.append((len(rows), len(rows) + 1))
            rows += [" ".join(words), " ".join(other)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash_sets.first_of_group(docs).collect()}
    assert len(planted) > 150 and sum(b not in kept for _, b in planted) >= 0.99 * len(planted)

import hashlib

import numpy as np

import corpus_pipeline
from pointloom.llm import mixing, pii, quality_bands, simhash
from pointloom.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.cases import documents
from tests.llm.test_filters import plain_figures
from tests.llm.test_simhash_sets import alike, plain_set
from tests.llm.test_whole_table import plain_components

SF = "/root/testdata/sf0.001"


def test_every_operator_has_its_query():
    assert [int(n[2:].split("_")[0]) for n in QUERIES] == list(range(1, 14))
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_stages_match_plain_versions(spark):
    """The stages by plain Python on the small table, each on what the one before kept."""
    import tokenizers

    from pointloom.llm.queries import tokenizer

    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    own = spark.read.parquet(f"{SF}/documents.parquet")
    bands = quality_bands.Bands(**quality_bands.fitted(own, spark.read.parquet(f"{SF}/labels.parquet")))
    kept = [i for i, r in docs.items() if not plain_figures(r["text"])[-1] and bands.verdict(r["text"])[-1] is None]
    sets = {i: plain_set(docs[i]["text"]) for i in kept}
    links = [(a, b) for a in kept for b in kept if a < b and alike(sets[a], sets[b])]
    first = sorted(set(plain_components(kept, links).values()))
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    clean = pii.redacted(spark.createDataFrame([docs[i] for i in first], schema)).collect()
    mix = {r["doc_id"]: r["taken"] // max(1, r["size"]) for r in mixing.mix(spark.createDataFrame(clean, schema)).collect()}
    lib = tokenizers.Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    want = []
    for r in clean:
        ids = lib.encode(r["text"] or "", add_special_tokens=False).ids
        row = (r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest())
        want += [row] * mix[r["doc_id"]]
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(want)
    assert simhash.RADIUS == 3 and len(want) > 50 and len(first) < len(kept)


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name


def chained(spark, docs):
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    return docs


def test_awkward_and_empty_tables(spark):
    """Nulls, empty and very long texts, repeated rows, null ids and extra columns with names the stages use."""
    df = documents(spark)
    at = df
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, "")
        assert at.schema.names == df.schema.names, name
    out = chained(spark, df).collect()
    assert {r["doc_id"] for r in out} <= {r["doc_id"] for r in df.collect()} and all(r["n_tokens"] > 0 for r in out)
    assert chained(spark, documents(spark, empty=True)).count() == 0
    assert quality_bands.passing(documents(spark, empty=True)).count() == 0
    assert chained(spark, documents(spark, [None, "", " "])).count() == 0


def test_ties_and_repeated_rows(spark):
    import random

    rng = random.Random(0)
    text = "\n".join(" ".join("".join(rng.choice("etaoinshrdlucm") for _ in range(rng.randint(2, 9))) for _ in range(40)) for _ in range(6))
    rows = [(i, text, "en", "s", len(text)) for i in (4, 2, 2, None, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert [r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()] == [2]

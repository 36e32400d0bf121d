from pointloom.llm import pii, quality_bands
from tests.llm.cases import documents

KEYS = ["04dbebab91ab85687d33eeaaf9ac699e1188f962", "14dbebab91ab85687d33eeaaf9ac699e1188f963", "24dbebab91ab85687d33eeaaf9ac699e1188f964"]


def test_context_reaches_over_earlier_proposals(spark):
    texts = [
        "ssn 123-45-6789, 987-65-4321 and 111-22-3333",
        f"tokens: {KEYS[0]}, {KEYS[1]}\n{KEYS[2]}",
        f"id 123-45-6789 then the ssn {KEYS[0][:4]} 987-65-4321",
        f"token={KEYS[0]}",
        f"https://h.org/?api_key={KEYS[1]}==&x=1",
        f"aws_secret_access_key_of_mine={KEYS[0]}",
        f"commit {KEYS[0]}, {KEYS[1]}; id 123-45-6789, 987-65-4321",
        f"my_secret_in_the_long_name: {KEYS[0]}, {KEYS[1]}",
    ]
    got = {r["doc_id"]: r["spans"] for r in pii.personal_data(documents(spark, texts)).collect()}
    where = lambda i, kind, *found: ",".join(f"{kind}:{texts[i].index(x)}:{texts[i].index(x) + len(x)}" for x in found)
    assert got[0] == where(0, "ssn", "123-45-6789", "987-65-4321", "111-22-3333")
    assert got[1] == where(1, "secret", *KEYS)
    assert got[2] == where(2, "ssn", "987-65-4321")
    assert got[3] == where(3, "secret", KEYS[0])
    assert got[4] == where(4, "secret", KEYS[1] + "==")
    assert got[5] == where(5, "secret", KEYS[0])
    assert got[6] == ""
    assert got[7].startswith(where(7, "secret", KEYS[0]))
    clean = {r["doc_id"]: r["text"] for r in pii.redacted(documents(spark, texts)).collect()}
    assert clean[1] == "tokens: <SECRET>, <SECRET>\n<SECRET>" and clean[3] == "token=<SECRET>"


def test_account_numbers_end_where_their_country_says(spark):
    texts = ["IBAN DE89 3704 0044 0532 0130 00 BIC COBADEFF", "NO93 8601 1117 947 OSLO and GB29 NWBK 6016 1331 9268 19 UK", "DE89 3704 0044 0532 0130 01 BIC COBADEFF"]
    got = {r["doc_id"]: r["spans"] for r in pii.personal_data(documents(spark, texts)).collect()}
    assert got == {0: "iban:5:32", 1: "iban:0:18,iban:28:55", 2: ""}


def test_fitted_bands_reject_rows_that_pass_the_base_rule(spark):
    """Limits from even ids; judged are whole documents of the odd ones."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    settings = quality_bands.fitted(docs, labels.where("doc_id % 2 = 0"))
    odd = labels.where("doc_id % 2 = 1")
    rows = quality_bands.quality_rules(docs.join(odd.select("doc_id"), "doc_id"), **settings).where("not base_failed").join(odd, "doc_id").collect()
    poor, good = ([r["kept"] for r in rows if r["quality"] == q] for q in (0, 1))
    assert len(poor) > 100 and sum(poor) / len(poor) < 0.3
    assert len(good) > 1000 and sum(good) / len(good) > 0.985


def ordinary_texts():
    """Texts on any machine with Python: its licence, modules of code, documentation strings, and prose in three scripts."""
    import argparse
    import inspect
    import pathlib
    import sysconfig

    licence = next(p for p in (pathlib.Path(sysconfig.get_path("stdlib")) / "LICENSE.txt", *pathlib.Path(sysconfig.get_path("stdlib")).glob("../../**/LICENSE*")) if p.exists()).read_text(errors="replace")
    code = inspect.getsource(argparse)
    doc = "\n".join(inspect.getdoc(f) or "" for f in vars(str).values() if callable(f))
    chinese = "春天来了，河边的柳树慢慢变绿。孩子们放学以后常常到河边去玩，有的放风筝，有的捉小鱼。老人坐在长椅上晒太阳，谈论着过去的日子。傍晚的时候，村子里升起炊烟，大家各自回家吃饭。夜里下了一场小雨，第二天早上空气格外清新。"
    russian = "Весной река поднимается и заливает луга. Рыбаки чинят лодки, а дети собирают на берегу камни. К вечеру ветер стихает, и над водой долго стоит туман; только изредка слышно, как на другом берегу лает собака."
    return [licence, licence[:1100], licence[2000:5000], code[:700], code[:4000], code, doc, chinese, russian, *(x * 1 for x in (chinese + russian,))]


def test_wide_bands_keep_ordinary_texts():
    bands = quality_bands.Bands()
    for text in ordinary_texts():
        assert bands.verdict(text)[-1] is None, (text[:60], len(text.encode()), bands.verdict(text))


def test_wide_bands_reject_repetition_and_noise():
    import base64
    import random

    rng, bands = random.Random(1), quality_bands.Bands()
    for n in (600, 3000, 20_000, 200_000):
        noise = base64.b85encode(rng.randbytes(n)).decode()
        assert bands.verdict(noise)[-1] == "incompressible", n
        assert bands.verdict("Click here to subscribe to our newsletter.\n" * (n // 40))[-1] == "repetitive", n
    half = base64.b85encode(rng.randbytes(30_000)).decode()
    assert bands.verdict(ordinary_texts()[0][:8000] + half)[-1] is not None


def test_bands_follow_the_corpus(spark):
    """A corpus of code and licences keeps its own kind, which bands of other text would not."""
    import inspect
    import pkgutil

    texts = []
    for m in pkgutil.iter_modules():
        if m.name in ("argparse", "ast", "calendar", "csv", "datetime", "difflib", "inspect", "locale", "mailbox", "optparse", "pdb", "pickle", "pydoc", "smtplib", "statistics", "tarfile", "textwrap", "typing", "uuid", "zipfile"):
            source = inspect.getsource(__import__(m.name))
            texts += [source[k : k + 3000] for k in range(0, len(source), 3000)]
    texts = [t for t in texts if not quality_bands.base_figures(t)[-1]]
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, 1) for i in range(0, len(texts), 2)] + [(None, 1), (1, None)], "doc_id long, quality int")
    settings = quality_bands.fitted(docs, labels)
    kept = [r["doc_id"] for r in quality_bands.quality_rules(docs, **settings).where("kept and doc_id is not null").collect()]
    assert len(texts) > 300 and len([i for i in kept if i % 2]) > 0.95 * (len(texts) // 2)
    narrow = quality_bands.fitted(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    assert narrow["bands"] != settings["bands"]
    assert quality_bands.fitted(docs, labels.limit(0)) == {} and quality_bands.fitted(docs.limit(0), labels) == {} and quality_bands.fitted(docs, None) == {}


def plain_verdict(text):
    """Ratio, chunks, chunks outside and verdict, by slicing and one compressor a piece."""
    import zstandard

    data = (text or "").encode()
    squeeze = lambda x: len(x) / len(zstandard.ZstdCompressor(level=3).compress(x)) if x else 0.0
    ratio = squeeze(data)
    low, high = [b[1:] for b in quality_bands.BANDS if b[0] <= len(data)][-1]
    pieces = [data[i : i + 4096] for i in range(0, len(data), 4096)] or [b""]
    if len(pieces) > 1 and len(pieces[-1]) < 2048:
        pieces[-2:] = [pieces[-2] + pieces[-1]]
    lowest, highest = quality_bands.CHUNK_BAND
    outside = sum(not lowest <= squeeze(x) <= highest for x in pieces) if len(pieces) > 1 else 0
    return ratio, len(pieces), outside, low <= ratio <= high and outside <= quality_bands.CHUNK_SHARE * len(pieces)


def test_bands_match_a_plain_version(spark):
    from tests.llm.test_filters import plain_figures

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").union(documents(spark).select("doc_id", "text"))
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["ratio"], r["n_chunks"], r["n_chunks_outside"], r["kept"]) for r in quality_bands.quality_rules(docs).collect())
    want = []
    for r in docs.collect():
        *figures, fine = plain_verdict(r["text"])
        want.append((r["doc_id"] is None, r["doc_id"] or 0, len((r["text"] or "").encode()), *figures, fine and not plain_figures(r["text"])[-1]))
    assert got == sorted(want)
    assert len({w[-1] for w in want}) == 2 and max(w[4] for w in want) > 5


def test_bands_are_fitted_to_all_good_rows(spark):
    """30,000 labelled good rows of one length: every one counts, as the quantiles of all say."""
    import numpy as np
    from pyspark.sql import functions as F

    x = np.random.default_rng(3).normal(2.0, 0.3, 30_000).round(6)
    values = spark.createDataFrame([(float(v),) for v in x], "x double")
    (got,) = quality_bands.ends(values, [])
    assert got["rows"] == 30_000 and np.allclose(got["ends"], np.percentile(x, [0.3, 99.7]), atol=1e-4)
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("a word "), F.col("id").cast("string")).alias("text"))
    figures = quality_bands.good_figures(docs, docs.select("doc_id", F.lit(1).alias("quality")))
    assert figures.count() == 30_000 and quality_bands.ends(values.limit(0), []) is not None

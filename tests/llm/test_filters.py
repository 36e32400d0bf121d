import hashlib
import math
import re
from collections import Counter

import pytest

from pointloom.llm import cotraining, pii, quality_bands, url_templates
from pointloom.llm.queries import RULES
from tests.llm.cases import documents


def plain_figures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {g for g, n in Counter(grams).items() if n > 1}
    covered = {i + k for i, g in enumerate(grams) if g in twice for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(words) < 50 or 100 * len(covered) > 50 * len(words)


def test_quality_figures_match_plain_ones(spark):
    df = documents(spark)
    got = quality_bands.quality_rules(df)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted((tuple(r)[:7] for r in got.collect()), key=key) == sorted(((r["doc_id"], *plain_figures(r["text"])) for r in df.collect()), key=key)
    assert quality_bands.quality_rules(documents(spark, empty=True)).count() == 0
    kept = quality_bands.passing(df)
    assert kept.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in got.where("kept").collect())


def test_bands_reject_repetition_and_noise():
    import random
    import zlib

    rng = random.Random(0)
    bands = quality_bands.Bands()
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    prose = " ".join(rng.choice(words) for _ in range(3000))
    assert bands.verdict(prose)[-1] is None
    assert bands.verdict(prose[:300] * 30)[-1] == "repetitive"
    noise = "".join(chr(33 + b % 94) for b in rng.randbytes(5000))
    assert bands.verdict(noise)[-1] == "incompressible"
    mixed = prose[:8000] + "ab " * 3000
    assert bands.verdict(mixed)[-1] in ("chunks", "repetitive")
    assert zlib.crc32(prose.encode()) and bands.verdict(None)[0] == 0.0


def luhn(x):
    total = 0
    for i, c in enumerate(reversed(x)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


PLAIN = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def plain_spans(text):
    out = []
    for k, (name, p) in enumerate(PLAIN):
        for m in re.finditer(p, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            ok = name == "email" or name == "ip" and all(int(x) <= 255 for x in m.group().split(".")) or name == "card" and 14 <= len(digits) <= 19 and luhn(digits) or name == "phone" and 10 <= len(digits) <= 15
            if ok:
                out.append((m.start(), k, m.end(), name))
    return ",".join(f"{n}:{a}:{b}" for a, k, b, n in sorted(out))


def test_base_spans_match_plain_ones(spark):
    import random

    rng = random.Random(3)
    parts = ["1.2.3.4", "10.0.0.255", "0", "256.1.1.1", "a@b.c", "x_", "@", "+1 ", "(55) ", "55", "5", "-", " ", ".", "4111 1111 1111 1111", "%", "é", "🙂", "\n", "300.1", "00012", "DE89370400440532013000"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 25))) for _ in range(1500)]
    texts += ["1" * 30000, "a" * 50000 + "@", "1.1." * 5000, None, "", "+1" + "-" * 9000, "5 " * 20000, "a.b@c." * 3000, "A1" * 20000]
    df = documents(spark, texts)
    got = {r["doc_id"]: r for r in pii.personal_data(df).collect()}
    for i, t in enumerate(texts):
        base = plain_spans(t)
        assert got[i]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest(), t
        assert [s for s in got[i]["spans"].split(",") if s.split(":")[0] in dict(PLAIN)] == [s for s in base.split(",") if s]
    assert pii.personal_data(documents(spark, empty=True)).count() == 0


def test_checksums_and_context(spark):
    texts = ["IBAN DE89 3704 0044 0532 0130 00 please", "IBAN DE89 3704 0044 0532 0130 01 please", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "commit 04dbebab91ab85687d33eeaaf9ac699e1188f962", "ssn 123-45-6789", "id 123-45-6789"]
    got = {r["doc_id"]: r["spans"] for r in pii.personal_data(documents(spark, texts)).collect()}
    assert got == {0: "iban:5:32", 1: "", 2: "secret:9:49", 3: "", 4: "ssn:4:15", 5: ""}


def test_redaction(spark):
    df = documents(spark)
    out = pii.redacted(df)
    assert out.columns == df.columns and out.count() == df.count()
    text = out.where("doc_id = 17").first()
    assert text["text"] == "card <CARD>, mail <EMAIL>, ip <IP> and 1.2.3.999, call <PHONE>" and text["n_chars"] == len(text["text"])
    assert out.where("doc_id = 0").first()["text"] is None


def test_plan_has_no_python(spark):
    plan = pii.personal_data(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"(?s)[^/?#]*", rest).group()
    path = re.match(r"(?s)[^?#]*", rest[len(host) :]).group()
    return re.sub("[A-Z]", lambda m: m.group().lower(), host), path


def plain_rule(host, path):
    best = None
    for kind, rule in RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = (kind, rule)
    return best


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "h", "clash", "clash") for i, u in enumerate(urls)], "page_id long, url string, host string, path string, rule string")


def test_urls_and_rules(spark):
    urls = [None, "", "nope", "http://A.Net", "http://x.NET/Q/1?y#z", "ftp://Example.net/en/a", "http://org/fr/x", "http://a://b.net/x", "x\n://É.org/fr/\n/y#?", "http://notnet/", "http://sub.example.com/de/1", "http://example.com/dex", "http://example.com/de", "https://h.org" + "/a" * 3000, "http://net/", "http://net/"]
    got = {r["page_id"]: r for r in url_templates.url_filter(pages(spark, urls), RULES).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        h, p = host_path(u)
        rule = plain_rule(h, p)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (h, p, rule and rule[1])
        assert got[i]["verdict"] == (rule[0] if rule else "allow")
    assert url_templates.url_filter(pages(spark, []), RULES).count() == 0


def test_templates_with_labels(spark):
    urls = [f"http://s.example.org/shop/{i}" for i in range(40)] + [f"http://s.example.org/news/{i}" for i in range(40)] + [f"http://s.example.org/user/name{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(60)]
    labelled = spark.createDataFrame([(i, True) for i in range(20)] + [(i, False) for i in range(40, 60)] + [(i, True) for i in range(80, 110)], "page_id long, bad boolean")
    got = {r["page_id"]: r["verdict"] for r in url_templates.url_filter(pages(spark, urls), RULES, labelled).collect()}
    assert {got[i] for i in range(40)} == {"block"} and {got[i] for i in range(40, 80)} == {"allow"}
    assert {got[i] for i in range(80, 140)} == {"block"}  # names generalise to one wildcard


def test_similar_branches_share_their_labels(spark):
    urls = [f"http://h.org/{a}/{i}" for a in ("aa", "bb", "cc") for i in range(4)]
    labelled = spark.createDataFrame([(i, True) for i in (0, 1, 2, 4, 5, 6, 8, 9, 10)], "page_id long, bad boolean")
    got = {r["verdict"] for r in url_templates.url_filter(pages(spark, urls), [], labelled).collect()}
    assert got == {"block"}  # three labels each are too few, nine are enough


def test_cotraining_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    from pyspark.sql import functions as F

    order = F.pmod(F.xxhash64("doc_id"), F.lit(3))
    got = {r["doc_id"]: r for r in cotraining.quality_classifier(docs, labels.where(order > 0)).collect()}
    assert len(got) == docs.count()
    held = labels.where(order == 0).collect()
    good = [got[r["doc_id"]]["kept"] for r in held if r["quality"] == 1 and r["toxic"] == 0]
    poor = [got[r["doc_id"]]["quality"] for r in held if r["quality"] == 0]
    fine = [got[r["doc_id"]]["quality"] for r in held if r["quality"] == 1]
    assert sum(good) / len(good) > 0.9
    auc = sum((a > b) + 0.5 * (a == b) for a in fine for b in poor) / (len(fine) * len(poor))
    assert auc > 0.85


def test_cotraining_cases(spark):
    df = documents(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = cotraining.quality_classifier(df, none).collect()
    assert len(out) == df.count() and all(r["kept"] and r["score"] == 1.0 for r in out)
    assert cotraining.quality_classifier(documents(spark, empty=True), none).count() == 0
    texts = [("good calm words here " + str(i)) if i % 2 else f"awful worthless junk {i}" for i in range(60)] + [None, ""]
    few = documents(spark, texts)
    some = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(None, 1, 0), (41, None, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in cotraining.quality_classifier(few, some).where("doc_id < 60").collect()}
    assert min(got[i]["quality"] for i in range(41, 60, 2)) > max(got[i]["quality"] for i in range(40, 60, 2))


def test_calibration_of_two_views():
    import numpy as np

    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 4000).astype(float)
    z = np.column_stack([3 * (y - 0.5) + rng.normal(0, 1.5, 4000), rng.normal(0, 1, 4000)])
    w = cotraining.combined(z, y)
    p = cotraining.sigmoid(z @ w[:2] + w[2])
    assert abs(w[1]) < 0.15 and math.isclose(p[(p > 0.6) & (p < 0.8)].mean(), y[(p > 0.6) & (p < 0.8)].mean(), abs_tol=0.06)
    sure = cotraining.combined(np.column_stack([np.where(y > 0, 500.0, -500.0), z[:, 1]]), y)
    assert np.isfinite(sure).all() and pytest.approx(1, abs=0.01) == cotraining.sigmoid(500 * sure[:1] + sure[2:])[0]


def test_templates_match_sql(spark):
    import duckdb

    urls = [f"http://x{i % 3}.example.net/shop/{i}" for i in range(90)] + [f"http://q.example.com/de/{i}" for i in range(60)] + [f"http://q.example.com/{a}/{i}" for a in ("dex", "fr", "de") for i in range(30)]
    urls += [f"http://q.example.com/u/name{chr(97 + i % 26)}{i}x/de/p" for i in range(50)] + [None, "x", "http://h.org" + "/a" * 12]
    df = pages(spark, urls)
    con = duckdb.connect()
    con.register("pages", df.select("page_id", "url").toPandas())
    want = sorted(con.execute(url_templates.TEMPLATES_SQL).fetchall(), key=str)
    got = sorted((tuple(r) for r in url_templates.url_filter(df, RULES).select("page_id", "host", "path", "rule", "verdict").collect()), key=str)
    assert got == want

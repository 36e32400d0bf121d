"""The path-template tree against a plain recursive version."""

import random
import re
from collections import defaultdict

from pointloom.llm import url_templates
from tests.llm.test_filters import host_path, pages


def plain_typed(segment):
    m = re.fullmatch(r"(?s)(.*?)(\.[A-Za-z]{1,5})?", segment)
    stem, ext = m.group(1), m.group(2) or ""
    if re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", stem):
        return "{date}" + ext
    if re.fullmatch(r"[0-9]+", stem):
        return "{n}" + ext
    if re.fullmatch(r"[0-9A-Fa-f]{8,}", stem) and re.search("[0-9]", stem) or re.fullmatch(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}", stem):
        return "{x}" + ext
    return segment


def plain_verdicts(urls, bad):
    """Verdict of each url (no rules) from labels ``bad`` (place: True or False)."""
    out = {}
    prior = sum(bad.values()) / len(bad) if bad else 0.0
    hosts = defaultdict(list)
    for i, u in enumerate(urls):
        host, path = host_path(u)
        hosts[host].append((i, tuple(plain_typed(s) for s in (path[1:] if path.startswith("/") else path).split("/"))))
    for rows in hosts.values():
        template = {}

        def walk(rows, above):
            rest = [(i, s) for i, s in rows if len(s) > len(above)]
            template.update({i: above for i, s in rows if len(s) == len(above)})
            free = [s[len(above)] for _, s in rest if not (s[len(above)].startswith("{") or s[len(above)] in ("*", ""))]
            star = len(set(free)) >= 20 and len(free) < 4 * len(set(free))
            below = defaultdict(list)
            for i, s in rest:
                own = s[len(above)]
                below["*" if star and not (own.startswith("{") or own in ("*", "")) else own].append((i, s))
            for own, part in below.items():
                walk(part, (*above, own))

        walk(rows, ())
        labels, bads = defaultdict(int), defaultdict(int)
        for i, t in template.items():
            for d in range(len(t) + 1):
                labels[t[:d]] += i in bad
                bads[t[:d]] += bad.get(i, False)

        def apart(node):
            n1, n2 = labels[node], labels[node[:-1]] - labels[node]
            if not n1 or not n2:
                return False
            b1, b2 = bads[node], bads[node[:-1]] - bads[node]
            p = (b1 + b2) / (n1 + n2)
            return abs(b1 / n1 - b2 / n2) > 2.58 * (p * (1 - p) * (1 / n1 + 1 / n2)) ** 0.5

        group = {i: max((t[:d] for d in range(1, len(t) + 1) if apart(t[:d])), key=len, default=()) for i, t in template.items()}
        sums = defaultdict(lambda: [0, 0])
        for i, g in group.items():
            sums[g][0] += i in bad
            sums[g][1] += bad.get(i, False)
        for i, g in group.items():
            n, b = sums[g]
            out[i] = "block" if n >= 5 and (b + 4 * prior) / (n + 4) >= 0.9 else "allow"
    return out


def judged(spark, urls, bad):
    labelled = spark.createDataFrame(list(bad.items()) or [], "page_id long, bad boolean")
    return {r["page_id"]: r["verdict"] for r in url_templates.url_filter(pages(spark, urls), [], labelled).collect()}


def random_site(rng):
    name = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(4, 7)))
    kinds = [
        lambda: f"/u/{name()}/{name()}/view",
        lambda: f"/shop/{rng.choice(('red', 'blue'))}/{rng.randrange(10**6)}",
        lambda: f"/news/{rng.randint(2000, 2020)}-01-0{rng.randint(1, 9)}/{name()}.html",
        lambda: f"/x/{rng.choice('pq')}/{rng.choice('rs')}/{rng.randrange(99)}/",
        lambda: "/deep" + "/s" * 30 + f"/{rng.choice(('good', 'evil'))}/{rng.randrange(50)}",
        lambda: "/{n}/*/" + rng.choice("ab"),
    ]
    share = {k: rng.random() for k in range(len(kinds))}
    urls, bad = [], {}
    for host in ("h1.org", "h2.org", "h3.org"):
        for _ in range(120):
            k = rng.randrange(len(kinds))
            u = f"http://{host}{kinds[k]()}"
            if rng.random() < 0.5:
                evil = "evil" in u or "/u/" in u and host == "h2.org" or "good" not in u and rng.random() < (share[k] > 0.5)
                bad[len(urls)] = evil
            urls.append(u)
    return urls, bad


def test_verdicts_match_a_plain_tree(spark):
    seen = set()
    for seed in range(3):
        urls, bad = random_site(random.Random(seed))
        want = plain_verdicts(urls, bad)
        assert judged(spark, urls, bad) == want
        seen |= set(want.values())
    assert seen == {"allow", "block"}


def test_unlabelled_branches_share_with_similar_siblings(spark):
    urls = [f"http://h.org/{a}/{b}/{i}" for a in ("aa", "bb") for b in ("one", "two") for i in range(25)]
    bad = {i: True for i in range(25)}  # aa/one alone has labels
    assert set(judged(spark, urls, bad).values()) == {"block"}
    bad |= {i: False for i in range(50, 75)}  # bb/one is fine, so bb stands apart, with its unlabelled half
    got = judged(spark, urls, bad)
    assert {got[i] for i in range(50)} == {"block"} and {got[i] for i in range(50, 100)} == {"allow"}
    assert got == plain_verdicts(urls, bad)


def test_deep_paths_differ_behind_thirty_segments(spark):
    urls = [f"http://h.org{'/a' * 30}/{end}/{i}" for end in ("good", "evil") for i in range(60)]
    bad = {i: i >= 60 for i in range(120) if i % 2}
    got = judged(spark, urls, bad)
    assert {got[i] for i in range(60)} == {"allow"} and {got[i] for i in range(60, 120)} == {"block"}


def test_segments_below_a_wildcard_are_one_node(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(8))
    urls = [f"http://h.org/u/{word()}/{word()}/view" for _ in range(60)] + [f"http://h.org/about/{i}" for i in range(30)]
    bad = {i: True for i in range(40)} | {i: False for i in range(60, 80)}
    got = judged(spark, urls, bad)
    assert {got[i] for i in range(60)} == {"block"} and {got[i] for i in range(60, 90)} == {"allow"}
    assert got == plain_verdicts(urls, bad)


def test_hot_typed_path_and_repeated_rows(spark):
    urls = [f"http://h.org/p/{i % 7}" for i in range(900)] + [None, "", "x"] * 5 + [f"http://h.org/q/{i}" for i in range(30)]
    bad = {i: True for i in range(0, 900, 9)} | {i: False for i in range(915, 930)}
    assert judged(spark, urls, bad) == plain_verdicts(urls, bad)


def test_prefix_hashes_of_deep_paths(spark):
    """Equal prefixes, and no others, have equal hashes; a path of thousands of segments takes no square of time."""
    import time

    from pyspark.sql import functions as F

    rows = [(["a", "b", "c"],), (["a", "b", "d"],), (["a"],), ([],), (["ab", "c"],), (["a", "bc"],)]
    got = [r[0] for r in spark.createDataFrame(rows, "s array<string>").select(url_templates.prefixes(F.col("s"))).collect()]
    seen = {}
    for (s,), h in zip(rows, got):
        assert len(h) == len(s) + 1
        for d, x in enumerate(h):
            assert seen.setdefault(x, tuple(s[:d])) == tuple(s[:d])
    assert len(seen) == len({tuple(s[:d]) for (s,) in rows for d in range(len(s) + 1)})
    deep = spark.createDataFrame([(["segment-%d" % i for i in range(4000)],)], "s array<string>")
    deep.select(url_templates.prefixes(F.col("s"))).collect()
    began = time.perf_counter()
    deep.select(F.size(url_templates.prefixes(F.col("s")))).collect()
    assert time.perf_counter() - began < 5

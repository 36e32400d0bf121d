"""The method's own kinds against a plain Python version, and the work against the number of matches."""

import random
import re
import time

from pointloom.llm import pii
from tests.llm.cases import documents
from tests.llm.test_filters import luhn

LENGTH = {c: n for n, cs in pii.IBAN_LENGTHS.items() for c in cs.split()}


def plain_iban(x):
    x = x.replace(" ", "")
    return 15 <= len(x) <= 34 and int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


PROPOSE = {
    "iban": re.compile(r"(?<![A-Za-z0-9])(?:(?:" + "|".join(rf"{c}[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for c, n in LENGTH.items()) + r")(?![A-Za-z0-9])|[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9]))"),
    "secret": re.compile(r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{20,}+={0,2}"),
    "ssn": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
}
CHECK = {"iban": plain_iban, "secret": lambda x: bool(re.search("[0-9]", x) and re.search("[A-Za-z]", x)), "ssn": lambda x: True}
WORDS = {"iban": (8, "iban|account|bank|konto", None), "secret": (2, r"token|secret|passw|api.?key|key\s*[=:]|credential", "sha|commit|hash|checksum"), "ssn": (2, "ssn|social security", "phone|fax")}


def plain_own(text, kind):
    """Spans whose words nearby (40 characters before; for items of a list, before its first) give them half a point."""
    out, context, end = [], "", 0
    for m in PROPOSE[kind].finditer(text):
        gap, near = text[end : m.start()], text[max(0, m.start() - 40) : m.start()]
        listed = end > 0 and len(gap) <= 40 and re.fullmatch(r"(?:[^A-Za-z0-9]|and|or)*", gap)
        context = context if listed else near
        words = (context + " " + near if listed else near).lower()
        tenths, up, down = WORDS[kind]
        tenths += 3 * bool(re.search(up, words)) - 3 * bool(down and re.search(down, words))
        if tenths >= 5 and CHECK[kind](m.group()):
            out.append(f"{kind}:{m.start()}:{m.end()}")
        end = m.end()
    return out


def test_own_kinds_match_plain_ones(spark):
    rng = random.Random(9)
    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))

    def iban():
        country = rng.choice(list(LENGTH))
        body = "".join(rng.choice("0123456789AB") for _ in range(LENGTH[country] - 4))
        check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
        x = f"{country}{check if rng.random() < 0.8 else 11:02d}{body}"
        return " ".join(x[i : i + 4] for i in range(0, len(x), 4)) if rng.random() < 0.5 else x

    parts = [iban, lambda: hexa(rng.choice((8, 20, 40))), lambda: f"{rng.randrange(1000):03d}-{rng.randrange(100):02d}-{rng.randrange(10**4):04d}", lambda: rng.choice(("token", "api_key", "key:", "secret", "commit", "sha", "ssn", "social security", "phone", "iban", "Konto", "and", "or", ",", "=", "é", "\n", "some words that keep the context far away from it", "A", "7"))]
    texts = [rng.choice((" ", "", ", ")).join(rng.choice(parts)() for _ in range(rng.randint(1, 14))) for _ in range(600)]
    got = {r["doc_id"]: r["spans"].split(",") for r in pii.personal_data(documents(spark, texts)).collect()}
    seen = set()
    for i, t in enumerate(texts):
        for kind in PROPOSE:
            want = plain_own(t, kind)
            assert [s for s in got[i] if s.startswith(kind + ":")] == want, (kind, t)
            seen |= {kind} if want else set()
    assert seen == set(PROPOSE)


def plain_redacted(text, spans):
    out, at = "", 0
    for kind, a, b in spans:
        if a >= at:
            out += text[at:a] + f"<{kind.upper()}>"
        at = max(at, b)
    return out + text[at:]


def test_redaction_matches_a_plain_one_over_many_blocks(spark):
    rng = random.Random(4)
    pieces = ["a@b.cd", "ünd", "10.1.2.3", "4111 1111 1111 1111", "+49 (30) 555-7713-20", " ", ", ", "x@y.z+1 333 444 5555", "DE89 3704 0044 0532 0130 00", "\n"]
    texts = [" ".join(rng.choice(pieces) for _ in range(n)) for n in (1, 3, 40, 700, 3000)]
    df = documents(spark, texts)
    spans = {r["doc_id"]: [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in r["spans"].split(",") if x)] for r in pii.personal_data(df).collect()}
    assert len(spans[4]) > 4 * pii.BLOCK
    for r in pii.redacted(df).collect():
        assert r["text"] == plain_redacted(texts[r["doc_id"]], spans[r["doc_id"]])
    assert pii.redacted(documents(spark, empty=True)).count() == 0 and luhn("4111111111111111")


def test_time_grows_with_the_matches(spark):
    took = {}
    for n in (8_000, 8_000, 32_000):
        df = documents(spark, ["ab@c.de or " * n])
        began = time.perf_counter()
        pii.redacted(df).write.format("noop").mode("overwrite").save()
        took[n] = time.perf_counter() - began
    assert took[32_000] < 4 * took[8_000] + 1

"""Personal data in texts, with built-in expressions only.

Regular expressions propose spans; checksums confirm them (Luhn for card numbers, mod 97 for bank
account numbers, cut by their country's length); words before them raise or lower a score, and the spans of the method's own kinds
count only from ``LEAST_SCORE`` on.  Spans are (kind, start, end) in code points, end exclusive.

Base kinds are email, ip, card and phone.  The method adds: iban (confirmed by mod 97), secret
(long hexadecimal or mixed tokens with a word like token or key before them) and ssn (with such a
word before it).

Positions come without a Python function: splitting by a pattern gives the text between its
matches, so running lengths of both give every place.  The work is in proportion to the text and the
number of matches: both are folded in blocks (``folded``).  Most patterns are possessive and begin where a
run of their characters begins (or where the match before ended), which keeps them linear on
documents with very long runs and changes no match.

Null and empty texts have no spans; repeated rows are read alike; long texts are read whole; extra
columns are kept by ``redacted``; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.llm.common import let

KINDS = ("email", "ip", "card", "phone", "iban", "secret", "ssn")
BASE = 4

#: Length of an account number by country (the countries of the IBAN registry).
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_ibans = "|".join(rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items())

#: Proposals. Each is leftmost and non-overlapping for its kind.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # as long as its country says; other countries, and numbers that go on in one piece, as far as they go
    "iban": rf"(?<![A-Za-z0-9])(?:(?:{_ibans})(?![A-Za-z0-9])|[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]){{11,30}}(?![A-Za-z0-9]))",
    # "=" only at the end, so that a key name before it is context
    "secret": r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{20,}+={0,2}+",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: What must be in a text before a kind's pattern is tried (a cheap test by characters).
HINTS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]", "iban": r"[A-Z]{2}[0-9]{2}", "secret": r"[A-Za-z0-9_+/=-]{20}", "ssn": r"[0-9]-[0-9]{2}-[0-9]"}
#: Characters before a span in which context words count. In a list (only marks, "and" and "or"
#: between its items) the words before the first item count for all.
NEAR = 40
LIST = r"^(?:[^A-Za-z0-9]|and|or)*$"
#: (score without context, words that raise it, words that lower it)
CONTEXT = {
    "email": (0.9, r"mail|contact|write", r""),
    "ip": (0.7, r"\bip\b|address|host|server", r"version|release"),
    "card": (0.8, r"card|visa|credit|payment", r"order|tracking|isbn"),
    "phone": (0.8, r"phone|tel|call|fax|mobile", r""),
    "iban": (0.8, r"iban|account|bank|konto", r""),
    "secret": (0.2, r"token|secret|passw|api.?key|key\s*[=:]|credential", r"sha|commit|hash|checksum"),
    "ssn": (0.2, r"ssn|social security", r"phone|fax"),
}
RAISE, LOWER, LEAST_SCORE = 0.3, 0.3, 0.5
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, n - i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, d).otherwise(F.pmod(d * 2, F.lit(10)) + F.floor(d * 2 / 10).cast("int"))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an account number without blanks passes mod 97: its first four characters go to the
    end, letters count from 10, and the number leaves 1."""
    turned = F.concat(F.substr(iban, F.lit(5)), F.substr(iban, F.lit(1), F.lit(4)))

    def add(rest: Column, i: Column) -> Column:
        c = F.ascii(F.substr(turned, i, F.lit(1)))
        return F.when(c < 58, (rest * 10 + c - 48) % 97).otherwise((rest * 100 + c - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def confirmed(kind: str, found: Column) -> Column:
    """The checks that a proposal must pass, by kind."""
    digits = F.regexp_replace(found, "[^0-9]", "")
    if kind == "ip":
        return found.rlike(rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$")
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    if kind == "iban":
        plain = F.regexp_replace(found, " ", "")
        return F.when(F.length(plain).between(15, 34), mod97(plain)).otherwise(False)
    if kind == "secret":
        return found.rlike("[0-9]") & found.rlike("[A-Za-z]")
    return F.lit(True)


def score(kind: str, context: Column) -> Column:
    start, up, down = CONTEXT[kind]
    near = F.lower(context)
    out = F.lit(start)
    out = out + F.when(near.rlike(up), RAISE).otherwise(0.0) if up else out
    out = out - F.when(near.rlike(down), LOWER).otherwise(0.0) if down else out
    return F.round(F.least(out, F.lit(1.0)), 2)


#: Items of an array that are folded into one output array before it is set down.
BLOCK = 256
SPAN = "struct<start:int,kind:int,end:int,score:double>"


def folded(items: Column, first: Column, step, block: int = BLOCK) -> Column:
    """Folds an array in blocks: ``step(state, items of the block)`` gives (state, output) as a struct
    of state and out, an array; the result is (state, rest of them) with all outputs end to end.

    Growing one array item by item copies it at every item.  Here an item copies at most its own
    block, and a block the short list of blocks before it.
    """
    n = F.ceil(F.size(items) / F.lit(block)).cast("int")

    def add(acc: Column, k: Column) -> Column:
        one = step(acc["state"], F.slice(items, k * block + 1, F.lit(block)))
        return let(one, lambda x: F.struct(x["state"].alias("state"), F.concat(acc["out"], F.array(x["out"])).alias("out")))

    blocks = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(blocks, first, add)


def spans_of(text: Column, kind: str) -> Column:
    """Confirmed spans of one kind: array of (start, kind, end, score)."""
    number = KINDS.index(kind)
    pattern = PATTERNS[kind]
    pieces = F.arrays_zip(F.split(text, pattern, -1).alias("between"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    empty = F.array().cast(f"array<{SPAN}>")
    last = lambda *parts: F.right(F.concat(*parts), F.lit(NEAR))

    def item(acc: Column, x: Column) -> Column:
        between, found, at = x["between"], x["found"], acc["state"]["at"]
        listed = (at > 0) & (F.length(between) <= NEAR) & between.rlike(LIST)
        seen = F.struct((at + F.length(between)).alias("start"), last(acc["state"]["tail"], between).alias("near"), listed.alias("listed"))

        def judged(s: Column) -> Column:
            end = s["start"] + F.coalesce(F.length(found), F.lit(0))
            context = F.when(s["listed"], acc["state"]["context"]).otherwise(s["near"])
            own = score(kind, F.when(s["listed"], F.concat(context, F.lit(" "), s["near"])).otherwise(s["near"]))
            span = F.struct(s["start"].alias("start"), F.lit(number).alias("kind"), end.alias("end"), own.alias("score"))
            ok = found.isNotNull() & confirmed(kind, found)
            if number >= BASE:
                ok = ok & (own >= LEAST_SCORE)
            # the tail is carried on: substring() would read a long text from its start each time
            state = F.struct(end.alias("at"), last(s["near"], F.coalesce(found, F.lit(""))).alias("tail"), context.alias("context"))
            return F.struct(state.alias("state"), F.when(ok, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

        return let(seen, judged)

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"), F.lit("").alias("context"))
    inner = lambda state, part: F.aggregate(part, F.struct(state.alias("state"), empty.alias("out")), item)
    first = F.struct(start.alias("state"), F.array().cast(f"array<array<{SPAN}>>").alias("out"))
    found = let(pieces, lambda p: F.flatten(folded(p, first, inner)["out"]))
    return F.when(text.rlike(HINTS[kind]), found).otherwise(empty)


def all_spans() -> Column:
    """The sorted array of all spans of column text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return F.array_sort(F.concat(*[spans_of(text, k) for k in KINDS])).alias("__spans")


def written_out(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, and n_iban, n_secret, n_ssn, scores."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), all_spans())
    of = lambda i: F.size(F.filter("__spans", lambda s: s["kind"] == i)).cast("long")
    base = F.filter("__spans", lambda s: s["kind"] < BASE)
    return rows.select(
        "doc_id",
        *[of(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:BASE])],
        F.sha2(written_out(base).cast("binary"), 256).alias("base_sha256"),
        written_out(F.col("__spans")).alias("spans"),
        *[of(i + BASE).alias(f"n_{k}") for i, k in enumerate(KINDS[BASE:])],
        F.array_join(F.transform("__spans", lambda s: s["score"].cast("string")), ",").alias("scores"),
    )


def redacted(docs: DataFrame) -> DataFrame:
    """Documents with every span replaced by its kind in angle brackets; overlapping spans become
    one, named after the first.  Other columns stay; n_chars, if there, is counted again.

    The text is taken off piece by piece, a block of spans at a time, so no span reads it from its
    start."""
    rows = docs.select(F.struct("*").alias("__doc"), all_spans())  # packed, so that no name of theirs can clash
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    text = F.col("__doc.text")

    def item(acc: Column, s: Column) -> Column:
        ahead = s["start"] - acc["at"]  # below zero: inside the span before
        out = F.when(ahead < 0, acc["out"]).otherwise(F.concat(acc["out"], F.substr(acc["rest"], F.lit(1), F.greatest(ahead, F.lit(0))), F.element_at(names, s["kind"] + 1)))
        rest = F.substr(acc["rest"], F.greatest(s["end"] - acc["at"], F.lit(0)) + 1)
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), rest.alias("rest"), out.alias("out"))

    def block(state: Column, part: Column) -> Column:
        """The spans of one block, on the piece of text up to the last of their ends."""

        def cut(x: Column) -> Column:
            own = F.struct(state["at"].alias("at"), F.substr(state["rest"], F.lit(1), x["n"]).alias("rest"), F.lit("").alias("out"))
            after = F.struct((state["at"] + x["n"]).alias("at"), F.substr(state["rest"], x["n"] + 1).alias("rest"))
            return let(F.aggregate(x["part"], own, item), lambda done: F.struct(after.alias("state"), done["out"].alias("out")))

        end = F.array_max(F.transform(part, lambda s: s["end"]))
        return let(F.struct(part.alias("part"), F.greatest(end - state["at"], F.lit(0)).alias("n")), cut)

    start = F.struct(F.lit(0).alias("at"), text.alias("rest"))
    first = F.struct(start.alias("state"), F.array().cast("array<string>").alias("out"))
    done = let(folded(F.col("__spans"), first, block), lambda x: F.concat(F.array_join(x["out"], ""), x["state"]["rest"]))
    rows = rows.select("__doc", F.when(F.size("__spans") > 0, done).otherwise(text).alias("__text"))
    own = {"text": F.col("__text")}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.length("__text").cast(docs.schema["n_chars"].dataType)
    return rows.select(*[own.get(n, F.col("__doc").getField(n)).alias(n) for n in docs.columns])

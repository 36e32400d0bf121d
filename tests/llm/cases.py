"""Small documents with every awkward case, shared by the tests of this folder."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __rid string, path string, slot string, size string, codes string, target string"


def documents(spark, texts=None, empty=False):
    """A table with nulls, empty and long texts, repeated rows and clashing extra columns."""
    rng = random.Random(5)
    words = ["the", "of", "and", "Baum", "élan", "straße", "日本", "x1", "don't", "a_b", "foo,", "bar.", "###", "42"]
    prose = lambda n: " ".join(rng.choice(words) + str(rng.randrange(50)) * (rng.random() < 0.5) for _ in range(n))
    if texts is None:
        base = prose(120)
        texts = [None, "", " ", "\n\n", "one", "two words", base, base, base + " more", prose(300), prose(300) + "\n" + prose(80), "tab\tand\xa0odd  blanks\r\n " + prose(60), "same line\n" * 40, "z" * 5000, prose(9000), "<|endoftext|> in <|startoftext|>text<|endoftext|>", "naïve café\u0301 ΑΣ İstanbul \x1c\x1d end", "card 4111 1111 1111 1111, mail a.b@c.de, ip 10.0.0.255 and 1.2.3.999, call +1 (017) 555-7713"]
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 7 == 0 else f"s{i % 3}", None if t is None else len(t), "x", "y", "z", "w", "v", "u") for i, t in enumerate(texts)]
    if texts and len(texts) > 8:
        rows += [(None, *r[1:]) for r in rows[6:9]] + [rows[9], rows[9]]
    return spark.createDataFrame([] if empty else rows, SCHEMA)

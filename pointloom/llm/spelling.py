"""Spelling variants: words one letter apart, the far more frequent of which is the form of the other.

*Search.*  If two words differ by one letter, either their first halves are equal or their last halves
are.  So every word goes into groups by half and length: with words as long or one longer, and with
words one shorter, each by its first and by its last half.  A task takes a bucket of groups, builds a
minimal acyclic automaton of their words (reversed ones for last halves) and completes each word's exact
half with one error; perfect-hash numbers give the found words' counts.  A pair whose first halves are
equal counts there only, so nothing is found twice and partial results per word can be added up: what
leaves a task is one row a word, however many words lie near it.

*Crowded halves.*  A group with over ``LIMIT`` words is divided: the error is in the first or in the second
half of what isn't fixed yet, so its words go into groups with more letters fixed, once at the front and
once at the end.  That is repeated while a group is too large, at most until one letter is open, and
then a group has fewer words than the square of the alphabet.  Buckets follow from the number of
rows, so a task's work doesn't grow with the table.

*Roots.*  A form has at least five times its word's count, so chains are short (27 steps at 2^63); they
are followed by pointer doubling, with joins that deal crowded forms over many parts.

Null and empty texts have no words; a null doc_id is an empty string in the checksum; rows that repeat a
doc_id or a text count each time; long texts and words are read whole; extra columns are not read; an
empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.llm.automata import Automaton, one_error
from pointloom.llm.common import discard, skewed_join, written

RUN = r"[A-Za-z\x{C0}-\x{FF}]"
LEAST_LETTERS, LEAST_COUNT, RATIO = 6, 5, 5
#: One in so many runs, by checksum, loses a letter.
SLIP = 199
#: Most words of a group that is not divided, and about how many rows (and letters) a bucket has.
LIMIT, BUCKET_ROWS, BUCKET_LETTERS = 20_000, 40_000, 1_000_000
#: Queries that walk an automaton together.
TOGETHER = 8192
KEY = ["m", "l", "r", "below", "left", "right"]
FOUND = "word string, n_near long, best_n long, best string"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def vocabulary(docs: DataFrame, letters: int = LEAST_LETTERS, count: int = LEAST_COUNT, slip: int = SLIP) -> DataFrame:
    """(word, n) of the words with at least that many letters and occurrences."""
    runs = F.regexp_extract_all(F.translate(F.col("text").cast("string"), UPPER, LOWER), F.lit(f"{RUN}{{{letters},}}"), F.lit(0))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(runs).alias("run"))
    rows = rows.withColumn("h", F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary"))).withColumn("at", (F.col("h") % F.length("run")).cast("int"))
    slipped = F.concat(F.substring("run", F.lit(1), F.col("at")), F.substring("run", F.col("at") + 2, F.length("run")))
    words = rows.select(F.when(F.col("h") % slip == 0, slipped).otherwise(F.col("run")).alias("word")).where(F.length("word") >= letters)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= count)


def fixed_parts(l: Column, r: Column) -> list[Column]:
    """left and right, the first l and the last r letters of the word."""
    return [F.substring("word", F.lit(1), l).alias("left"), F.when(r == 0, F.lit("")).otherwise(F.substring("word", -r, r)).alias("right")]


def halves(words: DataFrame) -> DataFrame:
    """Each word's rows (m, l, r, below, left, right, word, n): m is the length of the shorter word of a pair,
    l and r the letters fixed at both ends; a pair counts if it shares fewer than ``below`` first letters."""
    m, h = F.col("m"), F.floor(F.col("m") / 2).cast("int")
    rows = words.select("word", "n", F.explode(F.array(F.length("word") - 1, F.length("word"))).alias("m"))
    parts = F.array(F.struct(h.alias("l"), F.lit(0).alias("r"), (m + 2).alias("below")), F.struct(F.lit(0).alias("l"), (m - h).alias("r"), h.alias("below")))
    rows = rows.select("word", "n", "m", F.inline(parts))
    return rows.select("m", "l", "r", "below", *fixed_parts(F.col("l"), F.col("r")), "word", "n")


def divided(rows: DataFrame) -> DataFrame:
    """Rows of groups that are too large, in groups with half as many letters open."""
    h = F.col("l") + F.floor((F.col("m") - F.col("l") - F.col("r")) / 2).cast("int")
    parts = F.array(F.struct(h.alias("l"), F.col("r"), F.col("below")), F.struct(F.col("l"), (F.col("m") - h).alias("r"), h.alias("below")))
    rows = rows.select("word", "n", "m", F.inline(parts))
    return rows.select("m", "l", "r", "below", *fixed_parts(F.col("l"), F.col("r")), "word", "n")


def bounded_groups(words: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The rows of ``halves``, with every group of over ``limit`` words divided."""
    rows, done = halves(words), None
    while True:
        sizes = written(rows.groupBy(*KEY).agg(F.count("*").alias("__rows")), "group-sizes")
        large = sizes.where((F.col("__rows") > limit) & (F.col("m") - F.col("l") - F.col("r") > 1))
        if large.isEmpty():
            discard(sizes)
            return rows if done is None else done.unionByName(rows)
        rows = written(skewed_join(rows, large.select(*KEY, F.lit(True).alias("__large")), KEY, "left", F.xxhash64("word"), sizes), "groups")
        discard(sizes)
        small = rows.where("__large is null").drop("__large")
        done = small if done is None else done.unionByName(small)
        rows = divided(rows.where("__large"))


def near_in(group: pd.DataFrame) -> pd.DataFrame:
    """FOUND rows of the words of one bucket: near words in their groups, and the most frequent of them."""
    out = []
    forward = group["l"].to_numpy() >= group["r"].to_numpy()
    for way in (True, False):
        rows = group[forward == way]
        gid = rows.groupby(KEY, sort=False).ngroup().to_numpy()
        some = np.bincount(gid, minlength=1)[gid] > 1  # a word alone in its group has no near word there
        rows, gid = rows[some], gid[some]
        if not len(rows):
            continue
        gid = np.unique(gid, return_inverse=True)[1]
        words = rows["word"].tolist()
        # the group's number goes before the word as a letter of its own
        keyed = [chr(0x10000 + g) + (w if way else w[::-1]) for g, w in zip(gid.tolist(), words)]
        order = sorted(range(len(keyed)), key=keyed.__getitem__)
        rows, words, keyed = rows.iloc[order], [words[i] for i in order], [keyed[i] for i in order]
        automaton = Automaton(keyed)
        n, m, below = (rows[c].to_numpy(np.int64) for c in ("n", "m", "below"))
        exact = 1 + rows["l" if way else "r"].to_numpy(np.int64)
        length = np.fromiter(map(len, keyed), np.int64, len(keyed))
        start = np.cumsum(length) - length
        flat = np.frombuffer("".join(keyed).encode("utf-32-le"), np.uint32).astype(np.int64)
        preferred = np.empty(len(words), np.int64)  # larger counts first, then the order of code points
        preferred[sorted(range(len(words)), key=lambda i: (-n[i], words[i]))] = np.arange(len(words))
        best_of = np.argsort(preferred)
        for a in range(0, len(words), TOGETHER):
            part = slice(a, a + TOGETHER)
            q, v = one_error(automaton, flat, start[part], length[part], exact[part], length[part] - 1 > m[part])
            q = q + a
            # first letters in common, up to the limit of the pair's group
            alike, held = np.ones(len(q), bool), np.zeros(len(q), bool)
            for j in range(int(below[q].max(initial=0))):
                held |= alike & (below[q] == j)
                live = np.flatnonzero(alike & ~held & (j < m[q]))
                place = (lambda x: start[x] + 1 + j) if way else (lambda x: start[x] + length[x] - 1 - j)  # noqa: B023
                alike[live] = flat[place(q[live])] == flat[place(v[live])]
                if not len(live):
                    break
            keep = ~alike | (below[q] > m[q])
            q, v = q[keep], v[keep]
            if not len(q):
                continue
            own, first, near = np.unique(q, return_index=True, return_counts=True)
            best = best_of[np.minimum.reduceat(preferred[v], first)]
            out.append(pd.DataFrame({"word": [words[i] for i in own], "n_near": near, "best_n": n[best], "best": [words[i] for i in best]}))
    return pd.concat(out) if out else pd.DataFrame({"word": [], "n_near": [], "best_n": [], "best": []})


def near_words(words: DataFrame, limit: int = LIMIT, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """FOUND rows, several a word: parts of its near words with their number and the most frequent."""
    rows = bounded_groups(words, limit)
    total, letters = words.agg(F.count("*"), F.sum(F.length("word"))).first()
    buckets = max(1, math.ceil(4 * total / bucket_rows), math.ceil(4 * (letters or 0) / BUCKET_LETTERS))
    return rows.groupBy(F.pmod(F.xxhash64(*KEY), F.lit(buckets)).alias("bucket")).applyInPandas(near_in, FOUND)


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the rows (word, form): where forms lead in the end."""
    ends = written(forms.select("word", F.col("form").alias("to")), "roots")
    while True:
        ahead = ends.select(F.col("word").alias("to"), F.col("to").alias("next"))
        further = written(skewed_join(ends, ahead, ["to"], "left", F.xxhash64("word")), "roots")
        discard(ends)
        ends = written(further.select("word", F.coalesce("next", "to").alias("to")), "roots")
        moved = not further.where("next is not null").isEmpty()
        discard(further)
        if not moved:
            return ends.withColumnRenamed("to", "root")


def variants(docs: DataFrame, ratio: int = RATIO, limit: int = LIMIT, bucket_rows: int = BUCKET_ROWS, **words) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word."""
    known = written(vocabulary(docs, **words), "words")
    none = [F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("best_n"), F.lit(None).cast("string").alias("best")]
    parts = known.select("word", "n", *none).unionByName(near_words(known, limit, bucket_rows).withColumn("n", F.lit(None).cast("long")))
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("less"), "best")))
    rows = parts.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("b"))
    is_form = -F.col("b.less") >= ratio * F.col("n")
    rows = written(rows.select("word", F.when(is_form, F.col("b.best")).alias("form"), "n", "n_near", F.when(is_form, -F.col("b.less")).alias("form_n")), "forms")
    ends = roots(rows.where("form is not null"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: The same in SQL, with the checksum bit by bit and near words by equal rests after a deletion.
VARIANTS_SQL = r"""
WITH RECURSIVE runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents),
counted AS (
  SELECT doc_id, run, count(*) AS times, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS code
  FROM runs WHERE length(run) >= 6 GROUP BY doc_id, run),
bits AS (
  SELECT *, list_transform(range(4 * length(code)), lambda i: ((instr('0123456789ABCDEF', code[2 * (i // 8) + (CASE WHEN i % 8 < 4 THEN 2 ELSE 1 END)]) - 1) >> (i % 4)) & 1) AS bit
  FROM counted),
checked AS (
  SELECT run, times, xor(4294967295, list_reduce(list_prepend(4294967295, bit),
         lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1)))) AS h
  FROM bits),
slipped AS (
  SELECT times, CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word
  FROM checked),
words AS (
  SELECT word, sum(times)::BIGINT AS n FROM slipped WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5),
rests AS (
  SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT a.word, b.word AS near FROM rests a JOIN rests b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT r.word, w.word FROM rests r JOIN words w ON r.rest = w.word
  UNION SELECT w.word, r.word FROM rests r JOIN words w ON r.rest = w.word),
ranked AS (
  SELECT p.word, p.near, b.n, count(*) OVER (PARTITION BY p.word) AS n_near, row_number() OVER (PARTITION BY p.word ORDER BY b.n DESC, p.near) AS nth
  FROM pairs p JOIN words b ON p.near = b.word),
formed AS (
  SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.n >= 5 * w.n THEN r.near END AS form, CASE WHEN r.n >= 5 * w.n THEN r.n END AS form_n
  FROM words w LEFT JOIN ranked r ON w.word = r.word AND r.nth = 1),
walk AS (
  SELECT word, word AS at FROM formed
  UNION ALL SELECT k.word, f.form FROM walk k JOIN formed f ON k.at = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, k.at AS root, f.n, f.n_near, f.form_n
FROM formed f JOIN walk k ON f.word = k.word JOIN formed e ON k.at = e.word
WHERE e.form IS NULL
"""

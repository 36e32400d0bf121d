"""SimHash near-duplicates for a similarity of shingle sets: one document of each group stays.

The same bit-sliced comparison as in ``simhash``, for documents whose sets of 5-word shingles have a
Jaccard similarity of 0.8 or more; the links' components are the groups.  At that similarity 64-bit
fingerprints differ in about 10 bits, almost never in over ``RADIUS``, and no table of bit blocks
separates anything at such a radius.  So which fingerprints are compared is dealt otherwise: by
``BANDS`` keys of ``ROWS`` minima each of the hashed shingles, which a pair at exactly 0.8 misses all
with a probability of (1 - 0.8 ** ROWS) ** BANDS = 7e-6 and a closer one more rarely.  What lies within
the radius is verified on the whole shingle sets, so no link is an estimate; sets of under ``SMALL``
shingles, whose fingerprints vary more, are verified without it.

*How.*  Equal sets are one class, so copies cost nothing.  Under each key all classes meet the one
with the smallest id first; that joins a large group of near copies with a row for each.  What is left
are keys that hold several components.  The small ones are compared as they are.  Crowded ones, as pages of
one template make them (much alike, though under 0.8), are split by content: their classes' shingles
are ordered by how rare they are among all these classes, and two sets 0.8 alike must share one of the
first fifth of the longer and of the first ninth of the shorter.  So classes meet under those
shingles alone, where what a template repeats comes last, and no pair is lost by it.  Groups of the same
classes count once, and a group still too large is cut into parts of bounded size: those that every
pair needs one of (of the shorter's ninth, or outside of a component) against all.

Groups are compared bit-sliced, on fingerprints alone; only members with another component's within the
radius get their shingles and are compared exactly, in the same parts.  So no task holds more than two
parts and no pair of a key is left out.

Null and empty texts have no shingle and are one group; texts of under five words have one shingle;
long texts are read whole; repeated rows stay once, rows with one doc_id and different texts are
different documents; other columns are kept; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.llm.bpe_core import slices
from pointloom.llm.common import skewed_join, written
from pointloom.llm.components import connected_components
from pointloom.llm.simhash import fingerprint, identity, joined_roots, near_pairs, shingle_hashes

SHINGLE, LEAST = 5, 0.8
#: Bits in which fingerprints of sets 0.8 alike may differ: five standard deviations above the mean.
RADIUS, SMALL = 24, 64
BANDS, ROWS = 30, 5
#: Most documents, and about most shingles, in a part of a key.
BLOCK, SHINGLES = 512, 1_000_000
#: A key with more classes is split by content.  Counters by which shingles' frequencies are estimated.
CROWD, COUNTERS = 64, 1 << 20
_rng = np.random.default_rng(42)
FACTORS, SHIFTS = (_rng.integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
ID = ["__missing", "__rid", "__hash"]


def shingle_set(text: str | None) -> np.ndarray:
    """The sorted hashes of the text's shingles, each once."""
    return np.unique(shingle_hashes(text, SHINGLE))


def band_keys(hashes: np.ndarray) -> list[int]:
    """A key for each band; equal in two sets with a probability of their similarity to the power of ROWS."""
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(hashes), 2048):
        mixed = hashes[None, a : a + 2048] * FACTORS + SHIFTS
        least = np.minimum(least, (mixed >> np.uint64(32)).min(axis=1).astype(np.uint32))
    rows = least.reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(rows[i].tobytes(), i) - (1 << 63) for i in range(BANDS)]


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets."""
    if not len(a) and not len(b):
        return 1.0
    both = np.sort(np.concatenate([a, b]), kind="stable")
    same = int((both[1:] == both[:-1]).sum())
    return same / (len(both) - same)


def block_links(shingles: list[np.ndarray], roots: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b) of links that span all pairs of different roots with at least that similarity."""
    n = np.array(list(map(len, shingles)), np.int64)
    own, place, count = np.unique(np.concatenate(shingles), return_inverse=True, return_counts=True)
    doc, shared = np.repeat(np.arange(len(n)), n), count > 1
    column = np.cumsum(shared) - 1
    doc, place = doc[shared[place]], column[place[shared[place]]]
    order = np.argsort(place, kind="stable")
    doc, place = doc[order], place[order]
    same = np.zeros((len(n), len(n)))
    for a in range(0, int(shared.sum()), 4096):
        at = slice(*np.searchsorted(place, [a, a + 4096]))
        part = np.zeros((len(n), 4096), np.float32)
        part[doc[at], place[at] - a] = 1
        same += part @ part.T
    near = (same / (n[:, None] + n - same) >= least) & (roots[:, None] != roots)
    top = joined_roots(np.arange(len(n)), *np.nonzero(near))
    own = np.flatnonzero(top != np.arange(len(n)))
    return top[own], own


def named(docs: DataFrame) -> list:
    return [*identity(), F.xxhash64("text").alias("__hash")]


def sketches(docs: DataFrame) -> DataFrame:
    """sid (a hash of the shingle set), n (its size), fp (its fingerprint) and keys of every document, with its ID."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py()) for t in batch.column(3)]
            sid = [xxhash.xxh64_intdigest(s.tobytes(), 7) - (1 << 63) for s in sets]
            keys = pa.array([band_keys(s) for s in sets], pa.list_(pa.int64()))
            fp = np.array([fingerprint(s) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sid, pa.int64()), pa.array(list(map(len, sets)), pa.int64()), pa.array(fp), keys], [*ID, "sid", "n", "fp", "keys"])

    return docs.select(*named(docs), "text").mapInArrow(run, "__missing boolean, __rid long, __hash long, sid long, n long, fp long, keys array<long>")


def sets_of(texts: DataFrame) -> DataFrame:
    """(sid, shingles) of the rows (sid, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(t.as_py()).tobytes() for t in batch.column(1)], pa.binary())], ["sid", "shingles"])

    return texts.mapInArrow(run, "sid long, shingles binary")


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The rows of ``pairs(a, b)`` whose sets have at least that similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = lambda i: (np.frombuffer(x.as_py(), np.uint64) for x in batch.column(i))
            near = [similarity(x, y) >= least for x, y in zip(of(2), of(3))]
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    one, two = (sets.select(F.col("sid").alias(x), F.col("shingles").alias(f"{x}_set")) for x in "ab")
    return pairs.join(one, "a").join(two, "b").select("a", "b", "a_set", "b_set").mapInArrow(run, "a long, b long")


def prefix_lengths(n: int, least: float) -> tuple[int, int]:
    """Of a set's n shingles in a common order, how many must hold one shared with a set that is alike and not
    smaller, and with any that is alike."""
    return n - math.ceil(2 * least / (1 + least) * n - 1e-9) + 1, n - math.ceil(least * n - 1e-9) + 1


def frequencies(sets: DataFrame) -> np.ndarray:
    """How many of the sets' shingles fall to each of ``COUNTERS`` counters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for x in batch.column(0):
                np.add.at(total, (np.frombuffer(x.as_py(), np.uint64) % np.uint64(COUNTERS)).astype(np.int64), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["counter", "n"])

    rows = sets.select("shingles").mapInArrow(run, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(COUNTERS, np.int64)
    out[np.asarray(rows["counter"])] = np.asarray(rows["n"])
    return out


def rare_shingles(sets: DataFrame, least: float) -> DataFrame:
    """(key, sid, root, n, fp, short) of the rows (sid, root, n, fp, shingles): under each of the first shingles of
    a set, rarest first, that may occur in another; ``short`` marks those that count where it is the smaller set."""
    often = sets.sparkSession.sparkContext.broadcast(frequencies(sets))
    names = ["key", "sid", "root", "n", "fp", "short"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows, short = [], [], []
            for i, x in enumerate(batch.column(4)):
                shingles = np.frombuffer(x.as_py(), np.uint64)
                if not len(shingles):
                    continue
                count = often.value[(shingles % np.uint64(COUNTERS)).astype(np.int64)]
                first, all_first = prefix_lengths(len(shingles), least)
                order = np.lexsort((shingles, count))[:all_first]
                shared = count[order] > 1  # what counts once is in no other set
                keys.append(shingles[order][shared].view(np.int64))
                short.append(np.flatnonzero(shared) < first)
                rows.append(np.full(len(keys[-1]), i))
            if keys:
                at = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), *(batch.column(k).take(at) for k in range(4)), pa.array(np.concatenate(short))], names)

    return sets.select("sid", "root", "n", "fp", "shingles").mapInArrow(run, "key long, sid long, root long, n long, fp long, short boolean")


def apart(labelled: DataFrame, block: int = BLOCK, most: int = SHINGLES) -> DataFrame:
    """The rows (key, p, q, sid, root, n, fp) of keys that hold several roots, each set of members once.

    Every pair needs a member marked ``short``, one outside the smallest root and one outside the largest;
    the fewest of these are cut into parts p, all members into parts q, and every p meets every q.
    """
    outside = {"short": F.col("short"), "low": F.col("root") != F.col("low"), "high": F.col("root") != F.col("high")}
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    ends = labelled.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("rows"), F.sum("n").alias("total"), one(F.col("short")).alias("short_rows"), *[F.sum(F.xxhash64("sid", F.lit(i)).cast("decimal(38,0)")).alias(f"sign{i}") for i in range(2)])
    ends = ends.where("low <> high and short_rows > 0")
    sums = written(ends.groupBy("rows", "sign0", "sign1").agg(F.min(F.struct("key", "low", "high", "total", "short_rows")).alias("k")).select("k.*", "rows"), "keys")
    counts = sums.select("key", F.col("rows").alias("__rows"))
    rest = written(skewed_join(labelled, sums.drop("short_rows"), ["key"], "inner", F.xxhash64("sid"), counts), "members")
    acts = rest.groupBy("key").agg(*[one(c).alias(k) for k, c in outside.items()])
    # the members every pair needs one of: the fewest
    least = F.least("short", "low", "high")
    parts = lambda n: F.greatest(F.lit(1), F.ceil(F.greatest(n / block, n / F.col("rows") * F.col("total") / most))).cast("int")
    acts = acts.join(sums.select("key", "rows", "total"), "key").select("key", F.when(F.col("short") == least, "short").when(F.col("low") == least, "low").otherwise("high").alias("way"), parts(least).alias("ps"), parts(F.col("rows")).alias("qs"))
    rest = skewed_join(rest, acts, ["key"], "inner", F.xxhash64("sid"), counts)
    acting = F.when(F.col("way") == "short", outside["short"]).when(F.col("way") == "low", outside["low"]).otherwise(outside["high"])
    own = lambda n: F.pmod(F.xxhash64("sid"), n).cast("int")
    to = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    beside = F.transform(to("ps"), lambda p: F.struct(p.alias("p"), own(F.col("qs")).alias("q")))
    across = F.transform(to("qs"), lambda q: F.struct(own(F.col("ps")).alias("p"), q.alias("q")))
    meets = F.array_distinct(F.when(acting, F.concat(beside, across)).otherwise(beside))
    return rest.select("key", "sid", "root", "n", "fp", F.explode(meets).alias("m")).select("key", "m.p", "m.q", "sid", "root", "n", "fp")


def beside_others(roots: np.ndarray, n: np.ndarray, fp: np.ndarray, sizes: np.ndarray, least: float) -> np.ndarray:
    """Which members have one of another root in their group whose set may be alike enough: sizes that
    allow it, and fingerprints within the radius (or small sets)."""
    out = np.zeros(len(fp), bool)
    small = n < SMALL
    compared = np.flatnonzero(~small)
    group = np.repeat(np.arange(len(sizes)), sizes)
    own_sizes = np.bincount(group[compared], minlength=len(sizes))
    for a, b in near_pairs(fp[compared].view(np.uint64), own_sizes, RADIUS):
        a, b = compared[a], compared[b]
        near = (roots[a] != roots[b]) & (np.minimum(n[a], n[b]) >= least * np.maximum(n[a], n[b]))
        out[a[near]] = out[b[near]] = True
    some = np.bincount(group[small], minlength=len(sizes)) > 0
    return out | small | (some[group] & (n * least <= SMALL))


def candidates_in(rows: DataFrame, least: float) -> DataFrame:
    """The rows (key, p, q, sid, root) of the groups of ``apart`` that need their shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            sizes = np.diff(np.asarray(lists.offsets)).astype(np.int64)
            flat = lists.flatten()
            for a, b in slices(sizes, 1 << 17):
                low, high = (int(np.asarray(lists.offsets)[x] - np.asarray(lists.offsets)[0]) for x in (a, b))
                own = flat.slice(low, high - low)
                of = lambda name: np.asarray(own.field(name))  # noqa: B023, E731
                keep = beside_others(of("root"), of("n"), of("fp"), sizes[a:b], least)
                at = pa.array(np.repeat(np.arange(a, b), sizes[a:b])[keep])
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in range(3)), pa.array(of("sid")[keep]), pa.array(of("root")[keep])], ["key", "p", "q", "sid", "root"])

    grouped = rows.repartition("key", "p", "q").groupBy("key", "p", "q").agg(F.collect_list(F.struct("sid", "root", "n", "fp")).alias("group"))
    return grouped.where(F.size("group") > 1).mapInArrow(run, "key long, p int, q int, sid long, root long")


def links_in(rows: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links (a, b) inside the groups (key, p, q) of candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in batch.column(0):
                group = group.values
                shingles = [np.frombuffer(x, np.uint64) for x in group.field("shingles").to_pylist()]
                sid = np.asarray(group.field("sid"))
                a, b = block_links(shingles, np.asarray(group.field("root")), least)
                yield pa.RecordBatch.from_arrays([pa.array(sid[a], pa.int64()), pa.array(sid[b], pa.int64())], ["a", "b"])

    grouped = rows.join(sets, "sid").repartition("key", "p", "q").groupBy("key", "p", "q").agg(F.collect_list(F.struct("sid", "root", "shingles")).alias("group"))
    return grouped.where(F.size("group") > 1).select("group").mapInArrow(run, "a long, b long").distinct()


def firsts(docs: DataFrame, least: float = LEAST, crowd: int = CROWD) -> DataFrame:
    """The ID of the first document of each group; keys of over ``crowd`` classes are split by content."""
    own = written(sketches(docs), "sketches")
    classes = written(own.groupBy("sid").agg(F.min(F.struct(*ID)).alias("first"), *[F.first(c).alias(c) for c in ("n", "fp", "keys")]), "classes")
    keyed = classes.select("sid", "n", "fp", F.explode("keys").alias("key"))
    center = written(keyed.groupBy("key").agg(F.min(F.struct("sid", "n", "fp")).alias("c"), F.count("*").alias("rows")).where("rows > 1"), "centers")
    members = written(skewed_join(keyed, center.select("key", "c", "rows"), ["key"], "inner", F.col("sid"), center.select("key", F.col("rows").alias("__rows"))).select("key", "sid", "n", "fp", "c", "rows"), "members")

    may = (F.least("n", "c.n") >= least * F.greatest("n", "c.n")) & ((F.bit_count(F.col("fp").bitwiseXOR(F.col("c.fp"))) <= RADIUS) | (F.least("n", "c.n") < SMALL))
    stars = written(members.where("sid <> c.sid").where(may).select(F.col("c.sid").alias("a"), F.col("sid").alias("b")).distinct(), "stars")
    crowded = F.col("rows") > crowd
    # the shingles of all that meets a center, and of all crowded keys, in one pass over the texts
    asked = [stars.select(F.col("a").alias("sid")), stars.select("b"), members.where(crowded).select("sid")]
    sets = sets_for(docs, classes, asked[0].union(asked[1]).union(asked[2]))
    links = written(verified(stars, sets, least), "star-links")

    roots = written(connected_components(links).withColumnRenamed("node", "sid"), "roots")
    labelled = written(members.join(roots, "sid", "left").select("key", "sid", "n", "fp", F.coalesce("root", "sid").alias("root"), crowded.alias("crowded")), "labelled")
    open_keys = labelled.where("crowded").groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("__rows")).where("low <> high")
    split = skewed_join(labelled.where("crowded"), open_keys.select("key"), ["key"], "inner", F.xxhash64("sid"), open_keys.select("key", "__rows"))
    split = written(split.select("sid", "root", "n", "fp").distinct(), "crowd")
    meeting = labelled.where("not crowded").select("key", "sid", "root", "n", "fp", F.lit(True).alias("short"))
    if not split.isEmpty():
        meeting = meeting.union(written(rare_shingles(split.join(sets, "sid"), least), "rare-shingles"))
    compared = written(candidates_in(apart(meeting), least), "compared")
    more = compared.select("sid").join(sets, "sid", "left_anti")
    if not more.isEmpty():
        sets = sets.union(sets_for(docs, classes, more))
    links = links.union(written(links_in(compared, sets, least), "block-links"))

    roots = connected_components(links).withColumnRenamed("node", "sid")
    groups = classes.join(roots, "sid", "left").groupBy(F.coalesce("root", "sid").alias("root")).agg(F.min("first").alias("first"))
    return written(groups.select("first.*"), "firsts")


def sets_for(docs: DataFrame, classes: DataFrame, sids: DataFrame) -> DataFrame:
    """(sid, shingles) of the classes in ``sids``, stored: the texts of their first documents, read whole again."""
    asked = classes.join(sids.distinct(), "sid", "left_semi").select("sid", "first.*")
    return written(sets_of(docs.select(*named(docs), "text").join(asked, ID).select("sid", "text").dropDuplicates(["sid"])), "sets")


def first_of_group(docs: DataFrame, least: float = LEAST, crowd: int = CROWD) -> DataFrame:
    """The document with the smallest doc_id of each group, once, with all its columns."""
    rows = docs.select(*named(docs), F.struct("*").alias("__doc"))  # packed, so that no name of theirs can clash
    return rows.join(firsts(docs, least, crowd), ID, "left_semi").dropDuplicates(ID).select("__doc.*")

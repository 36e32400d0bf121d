"""SimHash near-duplicates with bit-sliced comparison.

A fingerprint has 64 bits, each the majority of that bit over the XXH64 hashes (seed 42) of the
text's 3-word shingles.  Fingerprints that differ in at most 3 bits are linked, and the links'
components are the groups.

*Which pairs are compared.*  Distinct fingerprints only.  The 64 bits are cut into four blocks of
16; two fingerprints within 3 bits agree on a whole block i.  The other 48 bits are cut into four
blocks of 12, of which they agree on a block j as well.  So every such pair meets in one of 16
tables under a 28-bit key (block i, block j): no pair within the radius is lost.

*How.*  The members of a key are held as 64 bit planes: word w of plane p has bit p of fingerprints
64 w .. 64 w + 63.  All distances to a probe are counted at once by carry-save adders over the
planes (three counter bits and a sticky overflow); once every lane of a probe's block is over the
radius, the block is abandoned.  Links inside a key are reduced to a spanning forest there, so a
group of n never gives n * n rows.

*Hot keys.*  Keys with over ``BLOCK`` members are cut into parts by hash; every pair of parts is
compared on its own, so no task ever holds more than two parts.

Null and empty texts have fingerprint zero and are linked like any other; texts of one or two
words have one shingle; repeated rows share a group; long texts are hashed whole; extra columns
are not read; an empty table gives an empty result.

``simhash_sets`` has the operator's form for a similarity of shingle sets, which the pipeline uses.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.llm.common import skewed_join, written
from pointloom.llm.components import connected_components

SEED, RADIUS, SHINGLE = 42, 3, 3
#: Most fingerprints in a part of a hot key.
BLOCK = 2048


def shingle_hashes(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """XXH64 of each run of ``width`` words, A-Z lower-cased; fewer words are one shingle."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = xxhash.xxh64_intdigest
    line = b" ".join(words)
    if len(words) <= width:
        return np.array([h(line, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - width + 1]
    return np.fromiter((h(line[a:b], SEED) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist())), np.uint64, len(starts))


def fingerprint(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes; repeats count."""
    if not len(hashes):
        return 0
    total = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[a : a + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """fp (the 64 bits as a long) of every document, with its __missing and __rid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(shingle_hashes(t.as_py())) for t in batch.column(2)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp.view(np.int64), pa.int64())], ["__missing", "__rid", "fp"])

    return docs.select(*identity(), "text").mapInArrow(run, "__missing boolean, __rid long, fp long")


def transposed(rows: np.ndarray) -> np.ndarray:
    """(64, words) bit planes of 64-bit rows, 64 rows to a word."""
    bits = np.unpackbits(rows.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")  # lane, plane
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def near_lanes(plane: np.ndarray, used: np.ndarray, probes: np.ndarray, words: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Which lanes lie within ``radius`` of a probe.

    Block i is word ``words[i]`` of the planes against fingerprint ``probes[i]``; ``used`` marks the
    filled lanes of each word.  Gives (block, lane) of every hit.  All 64 distances of a block are
    counted at once by carry-save adders, in counters that begin so high that they run over at
    ``radius`` + 1; blocks whose lanes have all run over are dropped.
    """
    full, none = ~np.uint64(0), np.uint64(0)
    block, w, probe = np.arange(len(words)), words, probes
    width = max(1, radius.bit_length())
    begin = (1 << width) - 1 - radius
    count = [np.full(len(words), full if begin >> b & 1 else none) for b in range(width)]
    over = ~used[words]
    for k in range(64):
        carry = plane[k, w] ^ (none - ((probe >> np.uint64(k)) & np.uint64(1)))  # lanes that differ in bit k
        for b in range(width):
            carry, count[b] = count[b] & carry, count[b] ^ carry
        over |= carry
        if k % 4 == 3:
            live = over != full
            if not live.all():
                block, w, probe, over, count = block[live], w[live], probe[live], over[live], [c[live] for c in count]
                if not len(block):
                    break
    row, lane = np.nonzero(np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    return block[row], lane


def joined_roots(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``root`` (each member's smallest known fellow) after links a - b."""
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = low != high
        if not apart.any():
            return root
        root = root.copy()
        np.minimum.at(root, high[apart], low[apart])
        while not np.array_equal(root, again := root[root]):
            root = again


def near_pairs(fps: np.ndarray, sizes: np.ndarray, radius: int = RADIUS, blocks: int = 1 << 15) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (a, b) of all pairs within ``radius`` in each group (and of each member with itself).

    ``fps`` has the groups' members end to end.  At most ``blocks`` blocks of 64 comparisons are held at once.
    """
    n_words = (sizes + 63) // 64
    first_word = np.cumsum(n_words) - n_words
    group = np.repeat(np.arange(len(sizes)), sizes)
    local = np.arange(len(fps)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    lane_of = first_word[group] * 64 + local
    rows = np.zeros(int(n_words.sum()) * 64, np.uint64)
    member = np.full(len(rows), -1)
    rows[lane_of], member[lane_of] = fps, np.arange(len(fps))
    plane, used = transposed(rows), np.packbits(member >= 0, bitorder="little").view(np.uint64)
    own_word = lane_of // 64
    meets = first_word[group] + n_words[group] - own_word  # a probe meets its own word and those after it
    ends = np.cumsum(meets)
    at = 0
    while at < len(fps):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + blocks, "right")))
        probe = np.repeat(np.arange(at, to), meets[at:to])
        step = np.arange(len(probe)) - np.repeat(ends[at:to] - meets[at:to] - (ends[at - 1] if at else 0), meets[at:to])
        words = own_word[probe] + step
        block, lane = near_lanes(plane, used, fps[probe], words, radius)
        yield probe[block], member[words[block] * 64 + lane]
        at = to


def star_links(fps: np.ndarray, sizes: np.ndarray, radius: int = RADIUS, blocks: int = 1 << 15) -> tuple[np.ndarray, np.ndarray]:
    """Links (smaller place's fingerprint, fingerprint) that span what lies within ``radius`` in each group."""
    root = np.arange(len(fps))
    for a, b in near_pairs(fps, sizes, radius, blocks):
        root = joined_roots(root, a, b)
    own = np.flatnonzero(root != np.arange(len(fps)))
    return fps[root[own]], fps[own]


def links_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Star links of the groups in a column of fingerprint lists."""
    for batch in batches:
        lists = batch.column(0)
        ends = np.asarray(lists.offsets)
        values = np.asarray(lists.values).view(np.uint64)
        at = 0
        while at < len(lists):  # a few thousand words of lanes together
            to = min(max(at + 1, int(np.searchsorted(ends, ends[at] + (1 << 17), "right")) - 1), at + 2048, len(lists))
            a, b = star_links(values[ends[at] : ends[to]], np.diff(ends[at : to + 1]).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64), pa.int64()), pa.array(b.view(np.int64), pa.int64())], ["a", "b"])
            at = to


def candidate_groups(fps: DataFrame, block: int = BLOCK) -> DataFrame:
    """Lists (column members) of fingerprints to be compared; every pair within the radius is in one.

    ``fps`` has distinct values in column fp.
    """
    bits = lambda low, n: F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << n) - 1))
    tables = []
    for i in range(4):
        low, mid, high = (bits(16 * k, 16) for k in range(4) if k != i)
        rest = low + F.shiftleft(mid, 16) + F.shiftleft(high, 32)  # the other 48 bits
        tables += [F.lit((i * 4 + j) << 28) + F.shiftleft(bits(16 * i, 16), 12) + F.shiftrightunsigned(rest, 12 * j).bitwiseAND(F.lit(4095)) for j in range(4)]
    keyed = fps.select("fp", F.explode(F.array(*tables)).alias("key"))
    counts = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    some = skewed_join(keyed, counts, ["key"], "inner", F.xxhash64("fp"), counts.select("key", F.col("n").alias("__rows"))).withColumn("parts", F.ceil(F.col("n") / block).cast("int"))
    some = some.withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    # part p meets every part from itself on
    meets = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda q: F.struct(F.least("part", q).alias("p"), F.greatest("part", q).alias("q")))
    pairs = some.select("fp", "key", F.explode(meets).alias("m")).select("fp", "key", "m.p", "m.q")
    # dealt by all three, or the parts of a hot key would stay together
    grouped = pairs.repartition("key", "p", "q").groupBy("key", "p", "q").agg(F.collect_list("fp").alias("members"))
    return grouped.where(F.size("members") > 1).select("members")


def identity() -> list:
    """Columns __missing and __rid, which order documents by doc_id and, where that is null, after all
    others by a hash of the text."""
    return [F.col("doc_id").isNull().alias("__missing"), F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("__rid")]


def _groups(docs: DataFrame, block: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents with fingerprints, their number by fingerprint, and for each fingerprint the first
    document of its group."""
    own = written(fingerprints(docs), "fingerprints")
    classes = written(own.groupBy("fp").agg(F.min(F.struct("__missing", "__rid")).alias("own_first"), F.count("*").alias("__rows")), "classes")
    links = candidate_groups(classes.select("fp"), block).mapInArrow(links_in, "a long, b long")
    roots = connected_components(links).withColumnRenamed("node", "fp")
    least = roots.join(classes, "fp").groupBy("root").agg(F.min("own_first").alias("first"))
    labels = skewed_join(roots, least, ["root"], "inner", F.xxhash64("fp")).select("fp", "first")
    firsts = written(classes.join(labels, "fp", "left").select("fp", F.coalesce("first", "own_first").alias("first")), "labels")
    return own, classes.select("fp", "__rows"), firsts


def near_duplicates(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the smallest doc_id of the group; null
    if the group has none)."""
    own, counts, firsts = _groups(docs, block)
    component = F.when(~F.col("first.__missing"), F.col("first.__rid"))
    out = skewed_join(own, firsts, ["fp"], "inner", F.col("__rid"), counts)
    return out.select(F.when(~F.col("__missing"), F.col("__rid")).alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), component.alias("component_id"))


def first_of_group(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The document with the smallest doc_id of each group, once, with all its columns.  Rows with one
    doc_id and different texts are different documents; if both begin a group, both stay."""
    firsts = _groups(docs, block)[2].select("first.*").distinct()
    rows = docs.select(*identity(), F.xxhash64("text").alias("__hash"), F.struct("*").alias("__doc"))  # packed, so that no name of theirs can clash
    kept = rows.join(firsts, ["__missing", "__rid"], "left_semi")
    return kept.dropDuplicates(["__missing", "__rid", "__hash"]).select("__doc.*")

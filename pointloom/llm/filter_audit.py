"""How the filters of a corpus act together: what each removes in every order they may be applied in.

A document's failures are one mask of five bits; all that the report asks (kept, removed, redundant,
unique, lost good and toxic documents, Shapley sums over the 120 orders) is a sum over the 32 masks of a
part.  So one pass finds the masks and additive counters by (part, mask) give the rest.

*Duplicates by sorting.*  Rows are range-partitioned by text fingerprint and doc_id and sorted inside a
partition by fingerprint, full text and doc_id.  Every row is compared with the row before it, texts in
full.  A copied text may run over many partitions, however many copies it has: each partition reports
its first and last text with their smallest doc_id, and rows of a partition's first text that found
nothing smaller before them look there.  That table has two rows a partition, so it is broadcast; in it,
texts are named by their fingerprint, SHA-256.

Texts cross one exchange; labels meet counters by (doc_id, part, mask), so a doc_id that recurs very
often is one row by then.

Null and empty texts are the same text, without words (it fails A, and of the others E at most); a null
source is the part named by the empty string; a row with a null doc_id is compared with nobody's and has no
label; rows that repeat a doc_id are not smaller than each other; of several labels of a doc_id any 1
counts; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.llm.common import WORD, written

FILTERS = "ABCDE"
ALL = 1 << len(FILTERS)
DUPLICATE = 1 << FILTERS.index("E")

MARKED = "doc_id long, part string, mask int, fp string, kind string"


def own_mask(text: Column, words: Column) -> Column:
    """Bits of the failures a document shows by itself: length, distinct words, capitals, symbols."""
    n = F.size(words)
    fails = (
        n < 200,
        100 * F.size(F.array_distinct(words)) < 50 * n,
        100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 2 * F.length(text),
        F.coalesce(text.rlike("[#$%&*|]"), F.lit(False)),
    )
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails[1:], 1)), F.when(fails[0], 1).otherwise(0)).cast("int")


def with_predecessors(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, part, mask, text, fp), sorted, as MARKED: kind is "row" or, in the first text of a
    partition, "open"; two rows of kind "end" name a partition's first and last text and their smallest doc_id."""
    names = [x.split()[0] for x in MARKED.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, least, ends, runs = None, None, [], 0
        for batch in batches:
            ids, fps, texts = batch.column(0).to_pylist(), batch.column(4).to_pylist(), batch.column(3)
            masks, fp_out, kind = batch.column(2).to_pylist(), [], []
            for i, (doc_id, fp) in enumerate(zip(ids, fps)):
                if before is None or fp != before[0] or texts[i].as_py() != before[1]:
                    if runs == 1:
                        ends.append((before[0], least))
                    before, least, runs = (fp, texts[i].as_py()), doc_id, runs + 1
                smaller = least is not None and doc_id is not None and least < doc_id
                masks[i] |= DUPLICATE * smaller
                opens = runs == 1 and not smaller
                kind.append("open" if opens else "row")
                fp_out.append(fp if opens else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(masks, pa.int32()), pa.array(fp_out, pa.string()), pa.array(kind, pa.string())], names)
        if before is not None:
            ends.append((before[0], least))
        columns = [[e[1] for e in ends], [None] * len(ends), [None] * len(ends), [e[0] for e in ends], ["end"] * len(ends)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    return rows.mapInArrow(run, MARKED)


def failure_masks(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """doc_id, part and mask (bit 0 for A to bit 4 for E) of every document, stored."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.withColumn("fp", F.sha2("text", 256))
    by = [F.col("fp"), F.col("doc_id").asc_nulls_last()]
    dealt = rows.repartitionByRange(partitions, *by) if partitions else rows.repartitionByRange(*by)
    # masks are taken behind the exchange, as the sampling of ranges computes all that lies before it
    dealt = dealt.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).sortWithinPartitions("fp", "text", F.col("doc_id").asc_nulls_last())
    dealt = dealt.select("doc_id", "part", own_mask(F.col("text"), F.col("words")).alias("mask"), "text", "fp")
    marked = written(with_predecessors(dealt), "marked")
    ends = marked.where("kind = 'end'").groupBy("fp").agg(F.min("doc_id").alias("least"))
    rows = marked.where("kind <> 'end'").join(F.broadcast(ends), "fp", "left")
    late = F.coalesce((F.col("kind") == "open") & (F.col("least") < F.col("doc_id")), F.lit(False))
    return rows.select("doc_id", "part", F.when(late, F.col("mask").bitwiseOR(F.lit(DUPLICATE))).otherwise(F.col("mask")).alias("mask"))


def counters(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents, good and toxic ones by (part, mask)."""
    rows = masks.groupBy("doc_id", "part", "mask").agg(F.count("*").alias("n"))
    one = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c)
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(one("quality"), one("toxic"))
    lost = lambda c: F.sum(F.col("n") * F.coalesce(F.col(c), F.lit(0)))
    return rows.join(known, "doc_id", "left").groupBy("part", "mask").agg(F.sum("n").alias("n"), lost("quality").alias("good"), lost("toxic").alias("toxic"))


def steps() -> Column:
    """Every order and step: filter_order, step, own (the bit of its filter) and earlier (those before it)."""
    plan, bit = [], {f: 1 << i for i, f in enumerate(FILTERS)}
    for order in permutations(FILTERS):
        plan += [{"filter_order": "".join(order), "step": k + 1, "own": bit[f], "earlier": sum(bit[e] for e in order[:k])} for k, f in enumerate(order)]
    return F.from_json(F.lit(json.dumps(plan)), "array<struct<filter_order: string, step: int, own: int, earlier: int>>")


def audit(docs: DataFrame, labels: DataFrame, partitions: int | None = None) -> DataFrame:
    """One row per part, order and step with kept, removed, redundant, unique_fails, good_lost,
    toxic_lost and shapley."""
    cells = counters(failure_masks(docs, partitions), labels)
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 32 at most
    rows = parts.select("part", "cells", F.inline(steps()))

    def total(which, value=lambda c: c["n"]) -> Column:
        return F.aggregate(F.filter("cells", which), F.lit(0).cast("long"), lambda s, c: s + value(c))

    own, earlier = F.col("own"), F.col("earlier")
    fails = lambda c: c["mask"].bitwiseAND(own) != 0
    gone = lambda c: c["mask"].bitwiseAND(earlier) != 0
    here = lambda c: fails(c) & ~gone(c)
    # in all orders, each failure of a document is its first equally often
    orders = len(list(permutations(FILTERS)))
    share = lambda c: (c["n"] * F.lit(orders) / F.bit_count(c["mask"])).cast("long")
    return rows.select(
        "part",
        "filter_order",
        "step",
        total(lambda c: ~fails(c) & ~gone(c)).alias("kept"),
        total(here).alias("removed"),
        total(lambda c: fails(c) & gone(c)).alias("redundant"),
        total(lambda c: c["mask"] == own).alias("unique_fails"),
        total(here, lambda c: c["good"]).alias("good_lost"),
        total(here, lambda c: c["toxic"]).alias("toxic_lost"),
        total(fails, share).alias("shapley"),
    )


#: The same in SQL, document by document, order by order.
AUDIT_SQL = r"""
WITH docs AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
worded AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM docs),
failing AS (
  SELECT doc_id, part,
         [len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws),
          100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t), regexp_matches(t, '[#$%&*|]'),
          coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false)] AS fails
  FROM worded),
judged AS (
  SELECT f.*, coalesce(l.good, 0) AS good, coalesce(l.bad, 0) AS bad
  FROM failing f LEFT JOIN (
    SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS bad FROM labels GROUP BY doc_id) l USING (doc_id)),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT [a.x, b.x, c.x, d.x, e.x] AS seq FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
plan AS (
  SELECT array_to_string(seq, '') AS filter_order, step, ascii(seq[step]) - 64 AS own,
         list_transform(seq[1:step - 1], lambda y: ascii(y) - 64) AS earlier
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
acted AS (
  SELECT part, filter_order, step, own, good, bad, fails[own] AS fails,
         coalesce(list_bool_or(list_transform(earlier, lambda i: fails[i])), false) AS gone,
         len(list_filter(fails, lambda y: y)) = 1 AS single
  FROM judged, plan),
summed AS (
  SELECT part, filter_order, step, own,
         count(*) FILTER (NOT fails AND NOT gone) AS kept,
         count(*) FILTER (fails AND NOT gone) AS removed,
         count(*) FILTER (fails AND gone) AS redundant,
         count(*) FILTER (fails AND single) AS unique_fails,
         coalesce(sum(good) FILTER (fails AND NOT gone), 0)::BIGINT AS good_lost,
         coalesce(sum(bad) FILTER (fails AND NOT gone), 0)::BIGINT AS toxic_lost
  FROM acted GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM summed
"""

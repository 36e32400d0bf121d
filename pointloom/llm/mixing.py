"""Mixing sources to target weights by weighted fair queueing.

Every source's documents, in a shuffled order, queue for the mix.  A document's virtual finish
time is the words of its source before it and half its own, divided by the source's target; a second
lap through a source goes on counting.  All documents are then ordered by finish time over the
whole table and taken until the total budget is used up, so at any point of the order each source
has had its due share.  As a document counts from its middle, a source ends within half a document of
its target (and of where the budget ends), one that has a single document too.

Sources in order of code points (null last) weigh 3, 1, 2, repeating.  Targets share 150 % of all
words by weight; a source stops at twice its words and its excess goes to the others, by weight,
until none is above.

*Prefix sums without one big window.*  A source's documents fall by the hash that shuffles them
into slots, as many as the square root of its rows.  Words are summed by (source, slot), the table of
slots gets its running sums, and only inside a slot are rows ordered: no window holds more than about
the square root of a source.  The global order is cut the same way: words are summed by ranges of
finish time, the square root of all rows to a unit of it, and only the one range in which the budget
runs out is ordered row by row.

The shuffle is md5 of doc_id and of the text's md5, so a rerun agrees, and rows that share a doc_id, or
have none, are spread by their texts; rows alike in both are taken together or not at all.  Null texts have no words and take none; a null
source is a source of its own; extra columns are kept by ``mixed`` and not read by ``mix``; an
empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointloom.llm.common import word_count, written

WEIGHTS = (3, 1, 2)
SHARE_PERCENT, MOST = 150, 2


def source_targets(sizes: DataFrame, weights=WEIGHTS, share_percent: int = SHARE_PERCENT, most: int = MOST) -> DataFrame:
    """From (source, source_size, source_rows): also target.

    The water level solves sum(min(level * weight, most * size)) = budget: sources sorted by
    capacity over weight fill up in that order, and the first that doesn't fill sets the level of
    all after it.  One row a source, whatever its documents.
    """
    rank = F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights)))
    w = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (rank + 1).cast("int")).cast("long")).withColumn("cap", F.col("source_size") * most)
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    budget = F.sum("source_size").over(whole) * F.lit(share_percent) / F.lit(100)
    w = w.withColumn("own", (budget - F.coalesce(F.sum("cap").over(fill), F.lit(0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(fill), F.lit(0))))
    nth = F.row_number().over(Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()))
    w = w.withColumn("nth", nth).withColumn("level", F.min(F.when(F.col("own") * F.col("weight") < F.col("cap"), F.struct("nth", "own"))).over(whole)["own"])
    full = F.col("level").isNull() | (F.col("level") * F.col("weight") >= F.col("cap"))
    return w.select("source", "source_size", "source_rows", F.when(full, F.col("cap").cast("double")).otherwise(F.col("level") * F.col("weight")).alias("target"))


def place() -> F.Column:
    """Column __place, the shuffled order within a source."""
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))).cast("binary"))
    tie = F.coalesce(F.xxhash64("text"), F.lit(0))
    return F.struct(key.alias("key"), F.col("doc_id").isNull().alias("missing"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), tie.alias("tie")).alias("__place")


def queued(docs: DataFrame, weights=WEIGHTS, share_percent: int = SHARE_PERCENT, most: int = MOST, slot_rows: int | None = None) -> tuple[DataFrame, float | None]:
    """Every row with source, size, source_size, target, __place and reached (words of the source up
    to its middle; ``slot_rows`` sets the rows of a slot), and the finish time up to which the mix takes documents (null: there are no words)."""
    rows = written(docs.select("source", word_count("text").alias("size"), place()), "sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    targets = written(source_targets(sizes, weights, share_percent, most), "targets")
    named = targets.withColumnRenamed("source", "__source")
    rows = rows.join(named, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    unit = F.conv(F.substring("__place.key", 1, 8), 16, 10).cast("long")
    slots = F.ceil(F.sqrt("source_rows") if slot_rows is None else F.col("source_rows") / slot_rows)
    rows = rows.withColumn("slot", F.floor(unit * slots / F.lit(1 << 32)).cast("long"))
    before = F.coalesce(F.sum("__sum").over(Window.partitionBy("source").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = rows.groupBy("source", "slot").agg(F.sum("size").alias("__sum")).select(F.col("source").alias("__source"), F.col("slot").alias("__slot"), before.alias("__before"))
    # rows alike count together, up to the middle of all of them
    inner = F.sum("size").over(Window.partitionBy("source", "slot").orderBy("__place")) - F.sum("size").over(Window.partitionBy("source", "slot", "__place")) / 2
    own = rows.withColumn("__own", inner).join(starts, F.col("source").eqNullSafe(F.col("__source")) & (F.col("slot") == F.col("__slot")))
    own = written(own.select("source", "size", "source_size", "target", "__place", (F.col("__own") + F.col("__before")).alias("reached")), "queue")

    total, n_rows = targets.agg(F.sum("source_size"), F.sum("source_rows")).first()
    if not total:
        return own, None
    budget = total * share_percent / 100
    lap = F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("lap")
    turns = own.where("size > 0").select("size", "target", "source_size", "reached", lap).select("size", ((F.col("reached") + F.col("lap") * F.col("source_size")) / F.col("target")).alias("finish"))
    turns = turns.withColumn("range", F.floor(F.least("finish", F.lit(1e6)) * math.ceil(math.sqrt(n_rows))).cast("long"))
    by_range = turns.groupBy("range").agg(F.sum("size").alias("words")).withColumn("upto", F.sum("words").over(Window.orderBy("range")))
    over = by_range.where(F.col("upto") > budget).agg(F.min("range").alias("range"), F.min(F.col("upto") - F.col("words")).alias("before")).first()
    if over["range"] is None:
        return own, float("inf")
    inside = turns.where(F.col("range") == over["range"]).groupBy("finish").agg(F.sum("size").alias("words"))
    inside = inside.withColumn("upto", F.sum("words").over(Window.orderBy("finish")) + F.lit(over["before"]))
    first_out = inside.where(F.col("upto") > budget).agg(F.min("finish")).first()[0]
    return own, first_out


def finish(most_lap: int) -> F.Column:
    return (F.col("reached") + F.lit(most_lap) * F.col("source_size")) / F.col("target")


def times(first_out: float | None, most: int = MOST) -> F.Column:
    """How often a queued row is taken: its laps that finish before the first that goes over the budget."""
    if first_out is None:
        return F.lit(0)
    laps = [F.when((F.col("size") > 0) & (finish(k) < F.lit(first_out)), 1).otherwise(0) for k in range(most)]
    return sum(laps[1:], laps[0])


def mix(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, size, source_size, target, taken (words, repeats counted), and position: the finish
    time of the row's first lap, by which the mix is ordered (null where it isn't taken)."""
    own, first_out = queued(docs, **settings)
    n = times(first_out, settings.get("most", MOST))
    doc_id = F.when(~F.col("__place.missing"), F.col("__place.id")).alias("doc_id")
    return own.select(doc_id, "size", "source_size", "target", (F.col("size") * n).cast("long").alias("taken"), F.when(n > 0, finish(0)).alias("position"))


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: every row as often as it is taken, with all its columns.

    In a source the mix takes a prefix of the shuffled order on each lap, so a row needs only the
    last place of each lap: a join with one short row a source, and no exchange of texts.
    """
    most = settings.get("most", MOST)
    own, first_out = queued(docs, **settings)
    if first_out is None:
        return docs.limit(0)
    last = [F.max(F.when((F.col("size") > 0) & (finish(k) < F.lit(first_out)), F.col("__place"))).alias(f"__last{k}") for k in range(most)]
    ends = written(own.groupBy("source").agg(*last).withColumnRenamed("source", "__source"), "ends")
    # packed, so that no name of the documents' own can clash
    rows = docs.select(F.struct("*").alias("__doc"), place(), (word_count("text") > 0).alias("__words"), F.col("source").alias("__own"))
    rows = rows.join(ends, F.col("__own").eqNullSafe(F.col("__source")))
    laps = [F.when(F.col("__words") & (F.col("__place") <= F.col(f"__last{k}")), 1).otherwise(0) for k in range(most)]
    rows = rows.withColumn("__times", sum(laps[1:], laps[0])).where("__times > 0")
    return rows.withColumn("__lap", F.explode(F.sequence(F.lit(1), F.col("__times")))).select("__doc.*")


#: The same in SQL, over a table of documents with unique doc_ids.
MIX_SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, md5(doc_id::VARCHAR || ':' || md5(coalesce(text, ''))) AS k,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::BIGINT AS weight,
         2 * source_size AS cap FROM src),
filled AS (
  SELECT *, ((sum(source_size) OVER () * 150 / 100.0) -
      coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) /
     (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS own,
     row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS nth
  FROM ranked),
levelled AS (
  SELECT *, (SELECT arg_min(own, nth) FROM filled WHERE own * weight < cap) AS level FROM filled),
targets AS (
  SELECT source, source_size, CASE WHEN level IS NULL OR level * weight >= cap THEN cap::DOUBLE ELSE level * weight END AS target FROM levelled),
queue AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.doc_id) - s.size / 2.0 AS reached
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
turns AS (
  SELECT size, (reached + lap * source_size) / target AS finish FROM queue, (VALUES (0), (1)) laps(lap) WHERE size > 0),
upto AS (
  SELECT finish, sum(words) OVER (ORDER BY finish) AS words FROM (SELECT finish, sum(size) AS words FROM turns GROUP BY finish)),
cut AS (
  SELECT min(finish) AS first_out FROM upto WHERE words > (SELECT sum(source_size) * 150 / 100.0 FROM src)),
taken AS (
  SELECT q.*, CASE WHEN size = 0 THEN 0 ELSE (reached / target < first_out)::INT + ((reached + source_size) / target < first_out)::INT END AS n
  FROM queue q, (SELECT coalesce(first_out, 'inf'::DOUBLE) AS first_out FROM cut))
SELECT doc_id, size, source_size, target, (size * n)::BIGINT AS taken,
       CASE WHEN n > 0 THEN reached / target END AS position
FROM taken
"""

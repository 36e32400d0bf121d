"""Scans over ordered rows of a key in which one key may hold any share of the rows.

Rows are range-partitioned by key and order, so a long key lies in many partitions, one after another.
Each partition is scanned by itself and stored; what a partition needs from those before it (a product,
a path length, the last place at which a rule fired) is worked out on a table with a row for each
(key, partition), and then added.  No task holds more than one partition, and at most one key of a
partition continues from the one before, so what is broadcast has a row a partition.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointloom.functions import pose as P
from pointloom.operators.joins import asof_join
from pointloom.sources.store import stored

#: Rows of a partition, about.
ROWS = 500_000
#: Paths are whole numbers of this length, so that sums are exact and a path equal to its reach is no matter of chance.
UNIT = 1e-9
START = np.eye(4)


def ranged(rows: DataFrame, keys: list[str], order: list[str], partitions: int | None = None, each: int = ROWS) -> DataFrame:
    """Rows dealt by ranges of key and order, sorted, with __key (the keys as text)."""
    own = rows.withColumn("__key", F.to_json(F.struct(*keys)) if keys else F.lit(""))
    if partitions is None:
        partitions = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // each))
    return own.repartitionByRange(partitions, "__key", *order).sortWithinPartitions("__key", *order)


def scanned(rows: DataFrame, step: Callable[[], Callable], adds: str, inputs: list[str], drops: list[str] | None = None, whole: bool = False) -> DataFrame:
    """``rows`` of ``ranged`` with __pid, __i (place in the partition) and the columns ``adds``, but those of ``drops``, stored.

    ``step()`` makes a function of (whether a row begins its key in this partition, its ``inputs``) that is
    called row after row and returns the added values; with ``whole``, batch after batch, of an array and Arrow
    columns, and returns the columns.
    """
    schema = T.StructType(list(rows.schema)).add("__i", "long")
    types = T._parse_datatype_string(adds) if adds else T.StructType([])
    for f in types:
        schema = schema.add(f)
    kinds = {T.DoubleType(): pa.float64(), T.LongType(): pa.int64(), T.ArrayType(T.DoubleType()): pa.list_(pa.float64())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call, before, i = step(), None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            col = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: B023, E731
            key = col("__key")
            begins = np.append(key[0].as_py() != before, np.asarray(pc.not_equal(key.slice(1), key.slice(0, n - 1))))
            before = key[n - 1].as_py()
            if whole:
                columns = call(begins, *map(col, inputs))
            else:
                out = [call(*values) for values in zip(begins.tolist(), *(col(c).to_pylist() for c in inputs))]
                columns = [pa.array(values, kinds[f.dataType]) for f, values in zip(types, zip(*out))]
            batch = batch.append_column("__i", pa.array(np.arange(i, i + n)))
            i += n
            for f, values in zip(types, columns):
                batch = batch.append_column(f.name, values)
            yield batch

    out = rows.mapInArrow(run, schema)
    return stored(out.withColumn("__pid", F.spark_partition_id()).drop(*drops or []), "scan")


def chained_poses(rows: DataFrame, keys: list[str], order: list[str], relative: str | Column = "relative", partitions: int | None = None, begins: str | None = None) -> DataFrame:
    """Adds pose: the product of the relative poses (null: none) up to each row of a key, and a column ``begins``,
    if named: whether the row is its key's first.  A Column as ``relative`` is worked out behind the exchange and
    not kept."""

    def step():
        at = np.eye(4)

        def call(begins, m):
            nonlocal at
            steps = np.tile(np.eye(4), (len(m), 1, 1))
            steps[np.asarray(m.is_valid())] = np.asarray(m.flatten(), float).reshape(-1, 4, 4)
            out = np.empty_like(steps)
            for i, first in enumerate(begins.tolist()):
                at = np.matmul(START if first else at, steps[i], out=out[i])
            at = at.copy()  # of its batch
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * 16, pa.int32()), pa.array(out.ravel()))
            return lists, pa.array(begins.astype(np.int64))

        return call

    own = ranged(rows, keys, order, partitions)
    if isinstance(relative, Column):
        local = scanned(own.withColumn("__relative", relative), step, "pose array<double>, __begins long", ["__relative"], ["__relative"], whole=True)
    else:
        local = scanned(own, step, "pose array<double>, __begins long", [relative], whole=True)
    ends = local.groupBy("__key", "__pid").agg(F.max("__i").alias("__i"))
    some = ends.withColumn("__n", F.count("*").over(Window.partitionBy("__key"))).where("__n > 1").drop("__n")  # two a partition at most
    totals = local.join(F.broadcast(some), ["__key", "__pid", "__i"]).select("__key", "__pid", "pose")

    def carries(pdf: pd.DataFrame) -> pd.DataFrame:
        at, out = np.eye(4), []
        for pid, m in pdf.sort_values("__pid")[["__pid", "pose"]].itertuples(index=False):
            out.append((pdf["__key"].iloc[0], pid, at.ravel().tolist()))
            at = at @ np.reshape(m, (4, 4))
        return pd.DataFrame(out[1:], columns=["__key", "__pid", "__carry"])

    carry = totals.groupBy("__key").applyInPandas(carries, "__key string, __pid int, __carry array<double>")
    out = local.join(F.broadcast(carry), ["__key", "__pid"], "left")
    pose = F.when(F.col("__carry").isNotNull(), P.product("__carry", "pose")).otherwise(F.col("pose"))
    out = out.withColumn("pose", pose)
    if begins:
        out = out.withColumn(begins, (F.col("__begins") == 1) & F.col("__carry").isNull())
    return out.select(*rows.columns, "pose", *([begins] if begins else []))


def numbered(rows: DataFrame, order: list[str], name: str = "n", partitions: int | None = None) -> DataFrame:
    """Adds the place of each row in the order of all, from 0: partitions count their own, and add what lies
    before them."""
    local = scanned(ranged(rows, [], order, partitions), lambda: lambda begins: (), "", [], whole=True)
    counts = local.groupBy("__pid").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("__pid", before.alias("__before"))  # a row a partition
    return local.join(F.broadcast(starts), "__pid").withColumn(name, F.col("__before") + F.col("__i")).select(*rows.columns, name)


def paths(rows: DataFrame, keys: list[str], order: list[str], values: list[str], partitions: int | None = None) -> DataFrame:
    """Rows with __key, __pid, __i and __d: the path over ``values`` since the key's first row, in UNITs, each step
    rounded (9e9 of the values' unit are the longest).  A step from or to a missing value has no length."""

    def step():
        last, gone = None, 0

        def call(begins, *at):
            nonlocal last, gone
            at = np.array([np.nan if v is None else float(v) for v in at])
            d = 0 if begins or last is None else math.floor(float(np.sqrt(np.nansum((at - last) ** 2))) / UNIT + 0.5)
            last, gone = at, 0 if begins else gone + d
            return (gone,)

        return call

    local = scanned(ranged(rows, keys, order, partitions), step, "__d long", values)
    at = F.array(*[F.col(v).cast("double") for v in values])
    ends = local.groupBy("__key", "__pid").agg(F.min_by(at, "__i").alias("first"), F.max_by(at, "__i").alias("last"), F.max("__d").alias("own"))
    w = Window.partitionBy("__key").orderBy("__pid")  # a row a partition
    gap = F.sqrt(F.aggregate(F.zip_with("first", F.lag("last").over(w), lambda a, b: F.coalesce((a - b) * (a - b), F.lit(0.0))), F.lit(0.0), lambda s, x: s + x))
    ends = ends.withColumn("gap", F.coalesce(F.floor(gap / F.lit(UNIT) + F.lit(0.5)), F.lit(0)))
    ends = ends.withColumn("lagged", F.lag("own", 1, 0).over(w))
    carry = ends.select("__key", "__pid", F.sum(F.col("gap") + F.col("lagged")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("__before")).where("__before > 0")
    out = local.join(carry, ["__key", "__pid"], "left").withColumn("__d", F.col("__d") + F.coalesce("__before", F.lit(0)))
    return stored(out.drop("__before"), "paths")


def fired(rows: DataFrame, reach: dict[str, float], strict: bool, first: bool) -> DataFrame:
    """Rows of ``paths`` with __rule, with __fires: a rule that starts anew wherever it fires.

    Of the rows after the last that fired (the key's first row at the beginning; with ``first`` that one
    fires), the first whose path since then is at least (``strict``: over) the reach of its __rule fires;
    rows with no rule never do.

    A partition finds its next firing row from each of its rows by binary search, so that a row that fires
    first in it leads to one that fires last in it.  Only rows that can fire first, those within reach of the
    partition's beginning, are linked across partitions; pointer doubling finds which do.
    """
    if min(reach.values()) <= 0:
        raise ValueError("a reach must be positive")
    side = "right" if strict else "left"
    kinds = sorted(reach)
    reach = {k: math.floor(v / UNIT + 0.5) for k, v in reach.items()}  # as paths are

    def nexts(d: np.ndarray, kind: np.ndarray) -> np.ndarray:
        out = np.full(len(d), len(d))
        for k in kinds:
            own = np.flatnonzero(kind == k)
            at = np.maximum(np.searchsorted(d[own], d + reach[k], side), np.searchsorted(own, np.arange(len(d)), "right"))
            out = np.minimum(out, np.append(own, len(d))[at])
        return out

    def runs(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        pdf = pdf.sort_values("__i")
        cuts = np.flatnonzero(pdf["__key"].to_numpy()[1:] != pdf["__key"].to_numpy()[:-1]) + 1
        for a, b in zip([0, *cuts], [*cuts, len(pdf)]):
            yield pdf.iloc[a:b]

    def entries(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for run in runs(pdf):
            d, kind = run["__d"].to_numpy(), run["__rule"].to_numpy()
            to = nexts(d, kind)
            end, ahead = np.arange(len(d)), to
            while (ahead < len(d)).any():  # the last row that fires after each
                inside = ahead < len(d)
                end = np.where(inside, end[np.minimum(ahead, len(d) - 1)], end)
                ahead = np.where(inside, ahead[np.minimum(ahead, len(d) - 1)], ahead)
            for k in kinds:
                own = np.flatnonzero(kind == k)
                own = own[: np.searchsorted(d[own], d[0] + reach[k], "right") + 1]
                out.append(pd.DataFrame({"__key": run["__key"].iloc[0], "id": (run["__pid"].to_numpy(np.int64)[own] << 40) + run["__i"].to_numpy()[own], "rule": k, "d": d[own], "leave": d[end[own]]}))
        return pd.concat(out) if out else pd.DataFrame({"__key": [], "id": [], "rule": [], "d": [], "leave": []})

    own = rows.select("__key", "__pid", "__i", "__d", "__rule")
    nodes = stored(own.groupBy("__pid").applyInPandas(entries, "__key string, id long, rule string, d long, leave long").distinct(), "entries")

    def following(asked: DataFrame) -> DataFrame:
        """(id, to) of rows (id, __key, leave): the first node of any rule that fires after."""
        out = None
        for k in kinds:
            right = nodes.where(F.col("rule") == k).select("__key", F.col("d").alias("at"), F.col("id").alias("to"))
            hit = asof_join(asked.select("id", "__key", (F.col("leave") + reach[k]).alias("want")), right, "want", "at", ["__key"], "forward", strict=strict, tie="to", bucket=64 * reach[k])
            hit = hit.select("id", F.col("r_to").alias("to"))
            out = hit if out is None else out.unionByName(hit)
        return out.groupBy("id").agg(F.min("to").alias("to"))

    jump = stored(following(nodes), "jumps")
    if first:
        reached = nodes.groupBy("__key").agg(F.min("id").alias("id")).select("id")
    else:
        starts = own.groupBy("__key").agg(F.min(F.col("__pid").cast("long") * (1 << 40) + F.col("__i")).alias("id"))
        reached = following(starts.withColumn("leave", F.lit(0).cast("long"))).select(F.col("to").alias("id")).where("id is not null")
    reached = stored(reached.distinct(), "reached")
    while True:
        more = reached.join(jump, "id").where("to is not null").select(F.col("to").alias("id"))
        more = stored(more.join(reached, "id", "left_anti").distinct(), "more")
        if more.isEmpty():
            break
        reached = stored(reached.union(more), "reached")
        jump = stored(jump.join(jump.select(F.col("id").alias("to"), F.col("to").alias("next")), "to", "left").select("id", F.col("next").alias("to")), "jumps")

    first_of = reached.join(nodes.select("id", "__key").distinct(), "id").groupBy("__key", F.shiftright("id", 40).cast("int").alias("__pid")).agg(F.min(F.col("id") % (1 << 40)).alias("__enter"))
    schema = T.StructType(list(rows.schema)).add("__fires", "boolean")
    names = schema.names

    def mark(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for run in runs(pdf):
            fires = np.zeros(len(run), bool)
            if pd.notna(enter := run["__enter"].iloc[0]):
                to = nexts(run["__d"].to_numpy(), run["__rule"].to_numpy())
                at = int(np.searchsorted(run["__i"].to_numpy(), int(enter)))
                while at < len(run):
                    fires[at] = True
                    at = to[at]
            out.append(run.assign(__fires=fires))
        return pd.concat(out)[names] if out else pdf.assign(__fires=False)[names]

    return rows.join(first_of, ["__key", "__pid"], "left").groupBy("__pid").applyInPandas(mark, schema)


def greedy_segments(rows: DataFrame, keys: list[str], order: list[str], values: list[str], reach: float, partitions: int | None = None) -> DataFrame:
    """Adds segment: a new one begins once the path since its first row exceeds ``reach``."""
    path = paths(rows, keys, order, values, partitions).withColumn("__rule", F.lit("all"))
    out = stored(fired(path, {"all": reach}, True, False), "fired")
    counts = out.groupBy("__key", "__pid").agg(F.sum(F.col("__fires").cast("long")).alias("n"))
    before = F.sum("n").over(Window.partitionBy("__key").orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1))
    w = Window.partitionBy("__key", "__pid").orderBy("__i")  # inside a partition
    out = out.withColumn("__own", F.sum(F.col("__fires").cast("long")).over(w)).join(counts.select("__key", "__pid", F.coalesce(before, F.lit(0)).alias("__before")), ["__key", "__pid"])
    return out.withColumn("segment", F.col("__own") + F.col("__before")).select(*rows.columns, "segment")


def spaced_matches(rows: DataFrame, keys: list[str], order: list[str], values: list[str], matched: str, reach: float, partitions: int | None = None) -> DataFrame:
    """Rows at which the path since the last row taken reaches ``reach`` and that have a match
    (column ``matched`` not null); the path goes on counting where there is none."""
    path = paths(rows, keys, order, values, partitions).withColumn("__rule", F.when(F.col(matched).isNotNull(), "match"))
    return fired(path, {"match": reach}, False, False).where("__fires").select(*rows.columns)


def thinned(rows: DataFrame, keys: list[str], order: list[str], values: list[str], straight: float, curved: float, in_curve: str = "in_curve", partitions: int | None = None) -> DataFrame:
    """Rows a distance apart: ``straight`` on straight parts, ``curved`` in curves; each key's first
    row stays and its counter is its own."""
    path = paths(rows, keys, order, values, partitions).withColumn("__rule", F.when(F.col(in_curve), "curve").otherwise("straight"))
    return fired(path, {"curve": curved, "straight": straight}, False, True).where("__fires").select(*rows.columns)

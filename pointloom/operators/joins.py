"""Joins that Spark has no operator for: as-of, interval, interpolation and distance joins.

None of them compares all pairs.  Time joins are one union and one window over the time order;
distance joins go through grid cells as equi-joins, so Catalyst picks and AQE adapts the strategy; nearest
neighbours go through blocks of space, whose pairs are compared inside a task and never listed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointloom.functions.geometry import cell
from pointloom.sources.store import stored


def _last_known(both: DataFrame, by: list[str], order: list[Column], value: str, bucket: Column | None, forward: bool) -> DataFrame:
    """Adds __hit: the last (or next) non-null ``value`` in the order of a group.

    With ``bucket`` a group is ordered in pieces, and what a piece starts with comes from a short
    table of one row a piece: a group with most of the rows is then not one task's work.
    """
    take = F.first if forward else F.last
    frame = (0, Window.unboundedFollowing) if forward else (Window.unboundedPreceding, 0)
    if bucket is None:
        return both.withColumn("__hit", take(value, ignorenulls=True).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(*frame)))
    both = both.withColumn("__bucket", F.coalesce(bucket, F.lit(-(1 << 62))))  # rows without a time have a piece of their own
    inner = Window.partitionBy(*by, "__bucket").orderBy(*order).rowsBetween(*frame)
    edge = F.min if forward else F.max
    ends = both.where(F.col(value).isNotNull()).groupBy(*by, "__bucket").agg(edge(F.struct("__ts", "__tie", value))[value].alias("__end"))
    pieces = both.select(*by, "__bucket").distinct().join(ends, [*by, "__bucket"], "left")
    outside = (1, Window.unboundedFollowing) if forward else (Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("__carry", take("__end", ignorenulls=True).over(Window.partitionBy(*by).orderBy("__bucket").rowsBetween(*outside))).drop("__end")
    out = both.withColumn("__own", take(value, ignorenulls=True).over(inner)).join(pieces, [*by, "__bucket"])
    return out.withColumn("__hit", F.coalesce("__own", "__carry")).drop("__own", "__carry", "__bucket")


def asof_join(
    left: DataFrame,
    right: DataFrame,
    left_ts: str,
    right_ts: str,
    by: list[str] | None = None,
    direction: str = "backward",
    strict: bool = False,
    tolerance: float | None = None,
    tie: str | None = None,
    bucket: float | None = None,
    prefix: str = "r_",
) -> DataFrame:
    """Every left row with the nearest right row in time, in its group (``by`` columns of both).

    ``direction``: backward (the last at or before), forward (the first at or after) or nearest (of
    both, the earlier on equal distance).  ``strict`` leaves out equal times, ``tolerance`` those
    further away.  Of right rows with one time the largest ``tie`` column wins (smallest, forward).
    Right columns come as ``prefix`` + name, null where nothing fits; left rows with a null time
    fit nothing.  ``bucket`` is a width of time by which large groups are ordered in pieces; without
    groups and ``bucket`` the pieces are ranges of about as many rows.
    """
    by = by or []
    if direction == "nearest":
        a = asof_join(left.withColumn("__id", F.monotonically_increasing_id()), right, left_ts, right_ts, by, "backward", strict, tolerance, tie, bucket, "__b_")
        a = asof_join(a, right, left_ts, right_ts, by, "forward", strict, tolerance, tie, bucket, "__f_")
        back, ahead = F.col(left_ts) - F.col(f"__b_{right_ts}"), F.col(f"__f_{right_ts}") - F.col(left_ts)
        first = F.col(f"__b_{right_ts}").isNotNull() & (F.col(f"__f_{right_ts}").isNull() | (back <= ahead))
        names = [x for x in right.columns if x not in by]
        return a.select(*left.columns, *[F.when(first, F.col(f"__b_{x}")).otherwise(F.col(f"__f_{x}")).alias(prefix + x) for x in names])
    forward = direction == "forward"
    names = [x for x in right.columns if x not in by]
    zero = F.lit(0).cast("long")
    lrow, rrow = F.struct(*left.columns), F.struct(*[F.col(x) for x in names])
    own = left.select(*by, F.col(left_ts).alias("__ts"), zero.alias("__tie"), F.lit(0).alias("__right"), lrow.alias("__l"))
    other = right.where(F.col(right_ts).isNotNull()).select(*by, F.col(right_ts).alias("__ts"), (F.col(tie).cast("long") if tie else zero).alias("__tie"), F.lit(1).alias("__right"), rrow.alias("__r"))
    both = own.unionByName(other, allowMissingColumns=True)
    # at one time right rows stand where left rows see them, or, if strict, where they don't
    if forward:
        order = [F.col("__ts"), (F.col("__right") if not strict else -F.col("__right")), F.col("__tie")]
    else:
        order = [F.col("__ts"), (-F.col("__right") if not strict else F.col("__right")), F.col("__tie")]
    piece = None if bucket is None else F.floor(F.col("__ts").cast("double") / F.lit(float(bucket)))
    if bucket is None and not by:  # without groups all rows were one task's work: ranges of the order are the pieces
        at = [f"__o{i}" for i in range(len(order))]
        ranged = both.withColumns(dict(zip(at, order))).repartitionByRange(*at)
        both = stored(ranged.withColumn("__range", F.spark_partition_id().cast("long")).drop(*at), "asof")
        piece = F.col("__range")
    hit = _last_known(both, by, order, "__r", piece, forward).where("__right = 0")
    found = F.col("__hit")
    if tolerance is not None:
        gap = F.col(f"__hit.{right_ts}") - F.col("__ts") if forward else F.col("__ts") - F.col(f"__hit.{right_ts}")
        found = F.when(gap <= tolerance, found)
    found = F.when(F.col("__ts").isNotNull(), found)
    hit = hit.withColumn("__hit", found)
    return hit.select(*[F.col(f"__l.{x}").alias(x) for x in left.columns], *[F.col(f"__hit.{x}").alias(prefix + x) for x in names])


def interval_join(points: DataFrame, spans: DataFrame, ts: str, start: str, end: str, by: list[str] | None = None, bucket: float | None = None) -> DataFrame:
    """Every point with the span [start, end) that holds it; spans of a group don't overlap.

    One as-of join onto the starts, then the end is tested.
    """
    out = asof_join(points, spans, ts, start, by, "backward", bucket=bucket, prefix="__s_")
    names = [x for x in spans.columns if x not in (by or [])]
    return out.where(F.col(f"__s_{end}") > F.col(ts)).select(*points.columns, *[F.col(f"__s_{x}").alias(x) for x in names])


def range_join(points: DataFrame, spans: DataFrame, ts: str, start: str, end: str, width: float, by: list[str] | None = None) -> DataFrame:
    """Every point with every span [start, end) that holds it; spans may overlap.  Spans are laid
    over time cells of ``width``, so choose it near their usual length."""
    by = by or []
    at = lambda c: F.floor(F.col(c).cast("double") / F.lit(float(width)))
    s = spans.where(F.col(end) > F.col(start)).withColumn("__cell", F.explode(F.sequence(at(start), at(end))))
    p = points.withColumn("__cell", at(ts))
    return p.join(s, [*by, "__cell"]).where((F.col(ts) >= F.col(start)) & (F.col(ts) < F.col(end))).drop("__cell")


def interpolated(queries: DataFrame, series: DataFrame, query_ts: str, ts: str, value: str, by: list[str] | None = None, clamp: bool = False, compat: bool = False) -> DataFrame:
    """Queries with ``value`` of the series at their time, linearly between the rows around it.

    An exact hit takes its row.  Outside the series: null, or the end value if ``clamp``.
    ``compat`` also gives null at the first key and before the second.
    """
    by = by or []
    s = series.select(*by, ts, value)
    if compat:
        first = s.groupBy(*by).agg(F.min(ts).alias("__first"))
        second = s.join(first, by) if by else s.crossJoin(first)  # one row without groups
        second = second.where(F.col(ts) > F.col("__first")).groupBy(*by).agg(F.min(ts).alias("__second"))
    q = asof_join(queries, s, query_ts, ts, by, "backward", prefix="__a_")
    q = asof_join(q, s, query_ts, ts, by, "forward", prefix="__b_")
    a, b, va, vb, t = (F.col(x) for x in (f"__a_{ts}", f"__b_{ts}", f"__a_{value}", f"__b_{value}", query_ts))
    part = F.try_divide((t - a).cast("double"), (b - a).cast("double"))
    out = F.when(a == b, va).when(a.isNotNull() & b.isNotNull(), va + (vb - va) * part)
    if clamp:
        out = F.coalesce(out, F.when(a.isNull(), vb), F.when(b.isNull(), va))
    q = q.withColumn("__value", out)
    if compat:
        q = q.join(second, by, "left") if by else q.crossJoin(second)
        q = q.withColumn("__value", F.when(t >= F.col("__second"), F.col("__value")))
    return q.select(*queries.columns, F.col("__value").alias(value))


def _celled(points: DataFrame, dims: list[str], radius: float) -> DataFrame:
    return points.withColumns({f"__c{i}": cell(d, radius, "floor") for i, d in enumerate(dims)})


#: One in so many rows makes a cell hot, and so many parts does it get.
SPLITS = 64


def split_hot(left: DataFrame, right: DataFrame, keys: list[str], spread: Column) -> tuple[DataFrame, DataFrame]:
    """Both sides of an equi-join on ``keys`` with a further key __part, by which a key with over one in
    ``SPLITS`` rows of ``left`` is many tasks' work: its left rows are dealt by ``spread``, its right rows
    stand in every part.  There can't be ``SPLITS`` hot keys, so their list is broadcast."""
    counts = left.groupBy(*keys).agg(F.count("*").alias("__rows"))
    total = counts.agg(F.sum("__rows").alias("__total"))
    hot = counts.crossJoin(F.broadcast(total)).where((F.col("__rows") > F.col("__total") / SPLITS) & (F.col("__rows") > 1000)).select(*keys, F.lit(True).alias("__hot"))  # total: a single row
    a = left.join(F.broadcast(hot), keys, "left").withColumn("__part", F.when(F.col("__hot"), F.pmod(spread, F.lit(SPLITS)).cast("int")).otherwise(0)).drop("__hot")
    parts = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(SPLITS - 1))).otherwise(F.array(F.lit(0)))
    b = right.join(F.broadcast(hot), keys, "left").withColumn("__part", F.explode(parts)).drop("__hot")
    return a, b


def radius_pairs(left: DataFrame, right: DataFrame, dims: list[str], radius: float, on: list[str] | None = None, strict: bool = False) -> DataFrame:
    """All pairs of a left (l) and a right (r) row within ``radius``, with columns l, r (structs) and d.

    The right side is written into each cell around it (3 per dimension; the smaller side should
    stand there), and cells of the radius' width make it an equi-join.  ``on`` adds equal columns.
    Crowded cells are split (``split_hot``), so one cell with most of the points is not one task's work.
    """
    on = on or []
    keys = [f"__c{i}" for i in range(len(dims))]
    a = _celled(left, dims, radius).select(*keys, *[F.col(k).alias(f"__k{i}") for i, k in enumerate(on)], F.struct(*left.columns).alias("l"))
    b = _celled(right, dims, radius).select(*keys, *[F.col(k).alias(f"__k{i}") for i, k in enumerate(on)], F.struct(*right.columns).alias("r"))
    steps = F.array(*[F.lit(x) for x in (-1, 0, 1)])
    for k in keys:
        b = b.withColumn("__step", F.explode(steps)).withColumn(k, F.col(k) + F.col("__step")).drop("__step")
    d2 = sum(((F.col(f"l.{x}") - F.col(f"r.{x}")) * (F.col(f"l.{x}") - F.col(f"r.{x}")) for x in dims[1:]), (F.col(f"l.{dims[0]}") - F.col(f"r.{dims[0]}")) * (F.col(f"l.{dims[0]}") - F.col(f"r.{dims[0]}")))
    equal = keys + [f"__k{i}" for i in range(len(on))]
    a, b = split_hot(a, b, equal, F.xxhash64("l"))
    out = a.join(b, [*equal, "__part"]).withColumn("d", F.sqrt(d2))
    return out.where(F.col("d") < radius if strict else F.col("d") <= radius).select("l", "r", "d")


#: Right rows of a block of the nearest-neighbour search, about, and the rows from which the cuts are taken.
BLOCK_ROWS, CUT_ROWS = 20_000, 200_000
#: Pairs that are compared at once inside a block.
AT_ONCE = 100_000


def cuts(rows: np.ndarray, leaves: int) -> list[tuple]:
    """A tree of (axis, value, low, high) that cuts places (n, dims) into about ``leaves`` parts of as many rows,
    each along its widest axis; a leaf is (-1, its number, 0, 0)."""
    tree: list[tuple] = []
    found = 0

    def grow(at: np.ndarray, n: int) -> int:
        nonlocal found
        k = len(tree)
        tree.append(())
        axis = int(np.argmax(np.ptp(at, axis=0))) if len(at) > 1 else 0
        cut = split_at(at[:, axis]) if n > 1 and len(at) > 1 else None
        if cut is None:
            tree[k] = (-1, found, 0, 0)
            found += 1
        else:
            low = at[:, axis] <= cut
            tree[k] = (axis, cut, grow(at[low], n // 2), grow(at[~low], n - n // 2))
        return k

    grow(rows, leaves)
    return tree


def split_at(values: np.ndarray) -> float | None:
    """A value with about as many values up to it as above; none, if all are equal."""
    top = values.max()
    cut = np.partition(values, (len(values) - 1) // 2)[(len(values) - 1) // 2]
    if cut < top:
        return float(cut)
    below = values[values < top]
    return float(below.max()) if len(below) else None


def leaves_of(tree: list[tuple], at: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) of every leaf that a ball around a place (n, dims) of radius ``reach`` touches."""
    rows, out = [(0, np.arange(len(at)))], []
    while rows:
        k, own = rows.pop()
        axis, cut, low, high = tree[k]
        if axis < 0:
            out.append((own, np.full(len(own), cut)))
            continue
        x, r = at[own, axis], reach[own] * (1 + 1e-12)
        rows += [(low, own[x - r <= cut]), (high, own[x + r > cut])]
    return np.concatenate([o for o, _ in out]), np.concatenate([c for _, c in out]).astype(np.int64)


def search(left: np.ndarray, right: np.ndarray, ids: np.ndarray, best: np.ndarray, found: np.ndarray) -> None:
    """Sets ``best`` (at first how far to look) and ``found`` to the distance and place of each left row's nearest
    right one (n, dims), of equally near ones that with the smallest of ``ids``.  Right rows are halved along
    their widest axis, and a left row looks across a cut only as far as its best hit."""
    work = [(np.arange(len(left)), np.arange(len(right)))]
    while work:
        l, r = work.pop()
        if not len(l) or not len(r):
            continue
        axis = int(np.argmax(np.ptp(right[r], axis=0)))
        cut = split_at(right[r, axis]) if len(r) > 1 and len(l) * len(r) > AT_ONCE else None
        if cut is None:
            each = max(1, AT_ONCE // len(r))
            r = r[np.argsort(ids[r], kind="stable")]
            for some in (l[k : k + each] for k in range(0, len(l), each)):
                d = left[some, None, 0] - right[None, r, 0]
                square = d * d
                for i in range(1, left.shape[1]):
                    d = left[some, None, i] - right[None, r, i]
                    square += d * d
                at = np.sqrt(square)
                near = at.argmin(axis=1)  # the first: the smallest id
                d = at[np.arange(len(some)), near]
                new = r[near]
                better = (d < best[some]) | ((d == best[some]) & ((found[some] < 0) | (ids[new] < ids[found[some]])))
                best[some[better]], found[some[better]] = d[better], new[better]
            continue
        x = left[l, axis]
        low, high = r[right[r, axis] <= cut], r[right[r, axis] > cut]
        side = x <= cut
        # own sides are taken first, so that little is left to look at across the cut
        search_own = ((l[side], low, l[side], high), (l[~side], high, l[~side], low))
        for own, here, over, there in search_own:
            b, f = best[own], found[own]
            search(left[own], right[here], ids[here], b, g := np.full(len(own), -1))
            hit = g >= 0
            take = hit & ((b < best[own]) | (f < 0) | (ids[here[g]] < ids[f]))
            best[own[take]], found[own[take]] = b[take], here[g[take]]
            reach = best[over] * (1 + 1e-12)
            work.append((over[np.abs(left[over, axis] - cut) <= reach], there))


def nearest(left: DataFrame, right: DataFrame, dims: list[str], radius: float, left_id: str, right_id: str, on: list[str] | None = None) -> DataFrame:
    """(on.., left_id, l, r, d): every left row that has a right one within ``radius`` with the nearest, both as
    structs; of equally near ones that with the smallest ``right_id``.  ``on`` adds equal columns.

    Pairs are never listed: blocks of space hold about ``BLOCK_ROWS`` right rows each (cuts from a bounded sample
    say only where a block ends), left rows meet those of their own block, and go on to the others that lie
    nearer than their hit.  Of right rows at one place one stands for all, and crowded blocks are split by left
    rows (``split_hot``).
    """
    on = on or []
    finite = lambda c: F.col(c).isNotNull() & (F.abs(F.col(c).cast("double")) < float("inf"))
    fine = lambda df: df.where(" AND ".join(f"`{k}` IS NOT NULL" for k in on) or "true").where(reduce(lambda a, b: a & b, map(finite, dims)))
    place = lambda df: [F.col(c).cast("double").alias(f"__x{i}") for i, c in enumerate(dims)]
    keys = [f"__k{i}" for i in range(len(on))]
    named = [F.col(c).alias(k) for c, k in zip(on, keys)]
    axes = [f"__x{i}" for i in range(len(dims))]
    rows = fine(right).select(*named, *place(right), F.col(right_id).alias("__rid"), F.struct(*right.columns).alias("r"))
    rows = stored(rows.groupBy(*keys, *axes).agg(F.min("__rid").alias("__rid"), F.min_by("r", "__rid").alias("r")), "nearest-right")
    rows_of = rows.groupBy(*keys).count().agg(F.max("count").alias("most"), F.sum("count").alias("all")).first()
    some = max(1, (rows_of["all"] or 0) // CUT_ROWS)
    sample = np.array(rows.where(F.pmod(F.xxhash64(*axes), F.lit(some)) == 0).select(*axes).collect(), float).reshape(-1, len(dims))
    tree = cuts(sample, -(-(rows_of["most"] or 0) // BLOCK_ROWS))

    def dealt(df: DataFrame, reach: str | None = None) -> DataFrame:
        """Rows with __leaf: their own, or with ``reach`` the others that they touch."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                col = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: B023, E731
                at = np.stack([np.asarray(col(c), float) for c in axes], axis=1)
                own, leaf = leaves_of(tree, at, np.zeros(len(at)))
                if reach is not None:
                    home = np.empty(len(at), np.int64)
                    home[own] = leaf
                    own, leaf = leaves_of(tree, at, np.asarray(col(reach), float))
                    own, leaf = own[leaf != home[own]], leaf[leaf != home[own]]
                yield batch.take(pa.array(own)).append_column("__leaf", pa.array(leaf))

        return df.mapInArrow(run, T.StructType(list(df.schema)).add("__leaf", "long"))

    def met(lefts: DataFrame, blocks: DataFrame) -> DataFrame:
        a, b = split_hot(lefts, blocks, [*keys, "__leaf"], F.xxhash64("__lid", *axes))
        schema = T.StructType([f for f in a.schema if f.name not in ("__d", "r", "__rid", "__leaf", "__part")]).add("__d", "double").add(blocks.schema["r"]).add(blocks.schema["__rid"])
        names = schema.fieldNames()

        def run(one: pa.Table, two: pa.Table) -> pa.Table:
            at = [np.stack([np.asarray(t.column(c), float) for c in axes], axis=1) for t in (one, two)]
            best, found = np.asarray(one.column("__d"), float).copy(), np.full(one.num_rows, -1)
            search(*at, np.asarray(two.column("__rid")), best, found)
            hit = np.flatnonzero(found >= 0)
            out = one.drop_columns(["__d"]).take(pa.array(hit)).append_column("__d", pa.array(best[hit]))
            twos = two.take(pa.array(found[hit]))
            return out.append_column("r", twos.column("r")).append_column("__rid", twos.column("__rid")).select(names)

        groups = [*keys, "__leaf", "__part"]
        return a.groupBy(*groups).cogroup(b.groupBy(*groups)).applyInArrow(run, schema)

    blocks = dealt(rows)
    lefts = fine(left).select(*named, *place(left), F.col(left_id).alias("__lid"), F.struct(*left.columns).alias("l"), F.lit(float(radius)).alias("__d"))
    if len(tree) == 1:
        hits = met(dealt(lefts), blocks)
    else:
        own = stored(dealt(lefts), "nearest-left")
        first = stored(met(own, blocks), "nearest-hits")
        bound = first.groupBy(*keys, "__lid").agg(F.min("__d").alias("__hit"))
        further = own.drop("__leaf").join(bound, [*keys, "__lid"], "left").withColumn("__d", F.coalesce("__hit", "__d")).drop("__hit")
        hits = first.unionByName(met(dealt(further, "__d"), blocks))
    best = hits.groupBy(*keys, "__lid").agg(F.min_by(F.struct("l", "r", "__d"), F.struct("__d", "__rid")).alias("b"))
    return best.select(*[F.col(k).alias(c) for c, k in zip(on, keys)], F.col("__lid").alias(left_id), "b.l", "b.r", F.col("b.__d").alias("d"))


def nearest_within(left: DataFrame, right: DataFrame, dims: list[str], radius: float, left_id: str, right_id: str, on: list[str] | None = None) -> DataFrame:
    """(left_id, nn_id, d): the nearest right row within ``radius`` of every left row that has one;
    of equally near ones the smallest id."""
    near = nearest(left.select(*dict.fromkeys([left_id, *dims, *(on or [])])), right.select(*dict.fromkeys([right_id, *dims, *(on or [])])), dims, radius, left_id, right_id, on)
    out = near.select(left_id, F.col(f"r.{right_id}").alias("nn_id"), "d")
    return out.groupBy(left_id).agg(F.min(F.struct("d", "nn_id")).alias("b")).select(left_id, "b.nn_id", "b.d") if on else out


def self_pairs(points: DataFrame, dims: list[str], radius: float, key: str, group: str | None = None) -> DataFrame:
    """(a, b, d) of pairs within ``radius`` with a < b; with ``group`` only of rising groups."""
    p = radius_pairs(points, points, dims, radius, strict=True)
    order = (F.col(f"l.{group}") < F.col(f"r.{group}")) if group else (F.col(f"l.{key}") < F.col(f"r.{key}"))
    return p.where(order).select(F.col(f"l.{key}").alias("a"), F.col(f"r.{key}").alias("b"), "d")


def required_join(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Inner join that fails if a left row finds no partner (unlike one that drops it)."""
    marked = left.join(right.withColumn("__there", F.lit(True)), on, "left")
    check = F.assert_true(F.col("__there").isNotNull(), F.concat(F.lit(f"no row for {on} "), F.coalesce(F.col(on).cast("string"), F.lit("null"))))
    return marked.withColumn("__ok", check).where("__ok is null").drop("__there", "__ok")


def edge_neighbours(edges: DataFrame, scans: DataFrame, reach: int, start: str = "scan_from", end: str = "scan_to", scan: str = "scan_id") -> DataFrame:
    """Edges with every scan whose index lies within ``reach`` of either end."""
    around = lambda c: F.sequence(F.col(c) - reach, F.col(c) + reach)
    e = edges.withColumn(scan, F.explode(F.array_distinct(F.concat(around(start), around(end)))))
    return e.join(scans, scan)


def asof_after_first(left: DataFrame, right: DataFrame, left_ts: str, right_ts: str, tolerance: float, by: list[str] | None = None, tie: str | None = None, prefix: str = "r_") -> DataFrame:
    """The right row before each left one, within ``tolerance``, where a group's very first right row
    never matches: it has no row before it to measure a motion from."""
    by = by or []
    order = F.struct(right_ts, *([tie] if tie else []))
    first = right.groupBy(*by).agg(F.min(order).alias("__first"))
    rest = right.join(first, by) if by else right.crossJoin(F.broadcast(first))  # a single row without groups
    rest = rest.where(order > F.col("__first")).drop("__first")
    return asof_join(left, rest, left_ts, right_ts, by, "backward", tolerance=tolerance, tie=tie, prefix=prefix)


def band_neighbours(points: DataFrame, radius: float, band: float, key: str = "id") -> DataFrame:
    """(a, b) of different points within ``radius`` of each other in the plane and ``band`` in height."""
    p = points.select(key, "x", "y", "z")
    near = radius_pairs(p, p, ["x", "y"], radius).where((F.abs(F.col("l.z") - F.col("r.z")) < band) & (F.col(f"l.{key}") != F.col(f"r.{key}")))
    return near.select(F.col(f"l.{key}").alias("a"), F.col(f"r.{key}").alias("b"))


def nearest_to_ray(points: DataFrame, origin: tuple, direction: tuple, key: str = "id", by: list[str] | None = None) -> DataFrame:
    """The point nearest to the line through ``origin`` along ``direction`` (of every group): its key and d."""
    from pointloom.functions.geometry import point_line_distance

    d = point_line_distance(("x", "y", "z"), origin, direction)
    best = points.withColumn("__d", d).groupBy(*(by or [])).agg(F.min(F.struct(F.col("__d").alias("d"), F.col(key).alias("k"))).alias("b"))
    return best.select(*(by or []), F.col("b.k").alias(key), F.col("b.d").alias("d"))

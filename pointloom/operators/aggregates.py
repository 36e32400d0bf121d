"""Grid and trajectory aggregates: each is one groupBy over algebraic sums, so partial sums are
taken before the exchange and a crowded cell is not gathered anywhere."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.functions.geometry import c, cell


def with_cells(points: DataFrame, dims: list[str], size: float, mode: str = "trunc", names: list[str] | None = None) -> DataFrame:
    return points.withColumns({n: cell(d, size, mode) for n, d in zip(names or [f"i{d}" for d in dims], dims)})


def decimate(points: DataFrame, dims: list[str], size: float, order: str, compat: bool = False) -> DataFrame:
    """One row of every voxel, the one with the lowest ``order``; ``compat`` leaves out the first voxel."""
    keys = [f"i{d}" for d in dims]
    best = with_cells(points, dims, size).groupBy(*keys).agg(F.min_by(F.struct(*points.columns), order).alias("row"))
    if compat:
        first = best.agg(F.min(F.struct(*keys)).alias("first")).first()["first"]
        if first is not None:
            best = best.where(F.struct(*keys) != F.struct(*[F.lit(first[k]).alias(k) for k in keys]))
    return best.select(*keys, "row.*")


def moments(dims: list[str]) -> list[Column]:
    """n, means and population covariances (cov_ab) of the dims, in one pass."""
    out = [F.count("*").alias("n"), *[F.avg(c(d)).alias(f"mean_{d}") for d in dims]]
    for a, b in combinations_with_replacement(dims, 2):
        out.append(F.covar_pop(c(a), c(b)).alias(f"cov_{a}{b}"))
    return out


def voxel_moments(points: DataFrame, dims: list[str], size: float, least: int = 5, extra_keys: list[str] | None = None) -> DataFrame:
    keys = [*(extra_keys or []), *[f"i{d}" for d in dims]]
    return with_cells(points, dims, size).groupBy(*keys).agg(*moments(dims)).where(F.col("n") >= least)


def levels(points: DataFrame, dims: list[str], sizes: dict[str, float], least: int = 1) -> DataFrame:
    """Voxel counts and means on several grids at once: one scan, one exchange."""
    grids = F.array(*[F.struct(F.lit(n).alias("level"), *[cell(d, s).alias(f"i{d}") for d in dims]) for n, s in sizes.items()])
    rows = points.withColumn("g", F.explode(grids)).select("g.*", *dims)
    return rows.groupBy("level", *[f"i{d}" for d in dims]).agg(F.count("*").alias("n"), *[F.avg(d).alias(f"mean_{d}") for d in dims]).where(F.col("n") >= least)


def coarse_to_fine(points: DataFrame, dims: list[str], coarse: float, fine: float, more_than: int) -> DataFrame:
    """Fine counts inside the coarse cells that hold more than ``more_than`` points."""
    p = with_cells(with_cells(points, dims, coarse, names=[f"c{d}" for d in dims]), dims, fine)
    ck, fk = [f"c{d}" for d in dims], [f"i{d}" for d in dims]
    small = p.groupBy(*ck, *fk).agg(F.count("*").alias("n"))  # counts are summed further, points are not read again
    full = small.groupBy(*ck).agg(F.sum("n").alias("n_coarse")).where(F.col("n_coarse") > more_than)
    return small.join(full, ck)


def bounds(points: DataFrame, dims: list[str]) -> DataFrame:
    return points.agg(F.count("*").alias("n"), *[f(d).alias(f"{n}_{d}") for d in dims for n, f in (("min", F.min), ("max", F.max))])


def grid_params(points: DataFrame, dims: list[str], size: float, margin: float = 0.0) -> DataFrame:
    """Bounds with a margin and the number of buckets of each axis."""
    b = bounds(points, dims)
    low, high = {d: F.col(f"min_{d}") - margin for d in dims}, {d: F.col(f"max_{d}") + margin for d in dims}
    n = {d: (F.floor((high[d] - low[d]) / size) + 1).cast("long") for d in dims}
    total = F.lit(1).cast("long")
    for d in dims:
        total = total * n[d]
    return b.select(*[low[d].alias(f"min_{d}") for d in dims], *[high[d].alias(f"max_{d}") for d in dims], *[n[d].alias(f"n_{d}") for d in dims], total.alias("n_buckets"))


def lowest_per_cell(points: DataFrame, size: float, key: str, x: str = "x", y: str = "y", z: str = "z") -> DataFrame:
    """(ix, iy, key, z) of the lowest point of each xy cell; of equally low ones the smallest key."""
    low = F.min(F.struct(F.col(z).alias("z"), F.col(key).alias("k")))
    return with_cells(points, [x, y], size, names=["ix", "iy"]).groupBy("ix", "iy").agg(low.alias("m")).select("ix", "iy", F.col("m.k").alias(key), F.col("m.z").alias(z))


def histogram(points: DataFrame, value: str, width: float) -> DataFrame:
    return points.groupBy(cell(value, width).alias("bin")).agg(F.count("*").alias("n"))


def histogram_stats(bins: DataFrame, width: float) -> DataFrame:
    """Weighted mean and standard deviation of a histogram's bin positions."""
    x, n = F.col("bin") * width, F.col("n")
    mean = F.sum(x * n) / F.sum(n)
    return bins.agg(mean.alias("mean"), F.sqrt(F.greatest(F.sum(x * x * n) / F.sum(n) - mean * mean, F.lit(0.0))).alias("std"))


def normal_equations(rows: DataFrame, jacobian: list[str], residual: str, keys: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """Upper triangle of J'WJ (ata_ij), J'Wr (atb_i) and r'Wr (rtr) by key: only sums cross the exchange."""
    w = F.col(weight) if weight else F.lit(1.0)
    n = len(jacobian)
    ata = [F.sum(F.col(jacobian[i]) * F.col(jacobian[j]) * w).alias(f"ata_{i}{j}") for i in range(n) for j in range(i, n)]
    atb = [F.sum(F.col(jacobian[i]) * F.col(residual) * w).alias(f"atb_{i}") for i in range(n)]
    return rows.groupBy(*(keys or [])).agg(F.count("*").alias("n"), *ata, *atb, F.sum(F.col(residual) * F.col(residual) * w).alias("rtr"))


def rms(rows: DataFrame, residuals: list[str], keys: list[str] | None = None) -> DataFrame:
    """Root of the summed squares of the residuals over the count; -1 when there are no rows."""
    square = sum((F.col(r) * F.col(r) for r in residuals[1:]), F.col(residuals[0]) * F.col(residuals[0]))
    return rows.groupBy(*(keys or [])).agg(F.coalesce(F.sqrt(F.avg(square)), F.lit(-1.0)).alias("rms"), F.count("*").alias("n"))


def consistent_ground(points: DataFrame, keys: list[str], z: str, least: int, most_sigma: float) -> DataFrame:
    """Cells with enough points and a small spread of heights."""
    return points.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(z).alias("mean_z"), F.stddev_pop(z).alias("sigma_z")).where((F.col("n") >= least) & (F.col("sigma_z") < most_sigma))


def sample_period(series: DataFrame, ts: str, keys: list[str] | None = None, default: float = 1 / 200) -> DataFrame:
    gap = F.try_divide((F.max(ts) - F.min(ts)).cast("double"), (F.count(ts) - 1).cast("double"))
    return series.groupBy(*(keys or [])).agg(F.coalesce(gap, F.lit(default)).alias("period"))


def upper_median_of_first(series: DataFrame, value: str, order: list[str], n: int = 1000) -> DataFrame:
    """The element n // 2 (from 0, in rising order) of the first ``n`` values; fewer rows use their own half.
    Only the n first rows are sorted together."""
    first = series.where(F.col(value).isNotNull()).orderBy(*order).limit(n)
    values = F.array_sort(F.collect_list(value))
    return first.agg(F.when(F.size(values) > 0, F.element_at(values, (F.floor(F.size(values) / 2) + 1).cast("int"))).alias("median"), F.count("*").alias("n"))


def zone_map(rows: DataFrame, keys: list, values: list[str]) -> DataFrame:
    """Smallest and largest values of each part of a table, to choose parts before reading them."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *[f(v).alias(f"{n}_{v}") for v in values for n, f in (("min", F.min), ("max", F.max))])


def chamfer_and_friends(pairs_ab: DataFrame, pairs_ba: DataFrame, n_a: int, n_b: int, within: float) -> DataFrame:
    """Cloud metrics from the nearest distances (column d) of each side: chamfer, hausdorff,
    precision, recall and F1 at a distance.  ``n_a``, ``n_b``: rows of each side."""
    a = pairs_ab.agg(F.avg("d").alias("ma"), F.max("d").alias("ha"), F.sum(F.when(F.col("d") <= within, 1).otherwise(0)).alias("ca"))
    b = pairs_ba.agg(F.avg("d").alias("mb"), F.max("d").alias("hb"), F.sum(F.when(F.col("d") <= within, 1).otherwise(0)).alias("cb"))
    p, r = F.col("ca") / n_a, F.col("cb") / n_b
    return a.crossJoin(b).select((F.col("ma") + F.col("mb")).alias("chamfer"), F.greatest("ha", "hb").alias("hausdorff"), p.alias("precision"), r.alias("recall"), F.try_divide(2 * p * r, p + r).alias("f1"))


def dense_index(rows: DataFrame, value: str, name: str) -> DataFrame:
    """Adds the index of a value among the ordered distinct values (from 0).  The distinct values
    are numbered once and joined back, so rows are not ordered in one task."""
    distinct = rows.select(value).where(F.col(value).isNotNull()).distinct().withColumn(name, F.row_number().over(Window.orderBy(value)) - 1)
    return rows.join(distinct, value, "left").withColumn(name, F.coalesce(name, F.lit(-1)))


def bucket_index(points: DataFrame, dims: list[str], size: float) -> DataFrame:
    """Cells in the order of their keys with count and the places (begin, end) of their rows in a table
    sorted by cell.  Counts are summed along the first axis, then inside each of its columns, so no
    window holds all cells."""
    keys = [f"i{d}" for d in dims]
    cells = with_cells(points, dims, size).groupBy(*keys).agg(F.count("*").alias("n"))
    columns = cells.groupBy(keys[0]).agg(F.sum("n").alias("__sum"))
    before = F.coalesce(F.sum("__sum").over(Window.orderBy(keys[0]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each cell of one axis
    starts = columns.select(keys[0], before.alias("__start"))
    inner = F.sum("n").over(Window.partitionBy(keys[0]).orderBy(*keys[1:]).rowsBetween(Window.unboundedPreceding, 0))
    out = cells.withColumn("__upto", inner).join(starts, keys[0])
    return out.select(*keys, "n", (F.col("__start") + F.col("__upto") - F.col("n")).alias("begin"), (F.col("__start") + F.col("__upto")).alias("end"))


def largest_buckets(points: DataFrame, dims: list[str], size: float, more_than: int) -> DataFrame:
    """Cells with more than so many points, the largest first."""
    keys = [f"i{d}" for d in dims]
    return with_cells(points, dims, size).groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > more_than).orderBy(F.desc("n"), *keys)


def pair_normal_equations(rows: DataFrame, first: list[str], second: list[str], residual: str, pose_a: str, pose_b: str, weight: str | None = None) -> DataFrame:
    """Sparse normal equations of observations between two poses each: (row, col, i, j, ata) blocks with
    row <= col, and (row, i, atb) as the blocks with col null and j null.

    ``first`` and ``second`` are the Jacobian's columns for ``pose_a`` and ``pose_b``.  Every observation
    gives its own three blocks and two right sides as small sums by (row, col), so the exchange carries a
    row for each pair of poses that see each other, not for each observation.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    n = len(first)
    a, b = F.col(pose_a), F.col(pose_b)
    swap = a > b
    side = lambda low: [F.when(swap, F.col(y if low else x)).otherwise(F.col(x if low else y)) for x, y in zip(first, second)]
    own = rows.select(F.least(a, b).alias("p"), F.greatest(a, b).alias("q"), *[v.alias(f"u{i}") for i, v in enumerate(side(True))], *[v.alias(f"v{i}") for i, v in enumerate(side(False))], F.col(residual).alias("r"), w.alias("w"))
    sums = []
    for x, y in (("u", "u"), ("u", "v"), ("v", "v")):
        sums += [F.sum(F.col(f"{x}{i}") * F.col(f"{y}{j}") * F.col("w")).alias(f"{x}{y}_{i}_{j}") for i in range(n) for j in range(n)]
    sums += [F.sum(F.col(f"{x}{i}") * F.col("r") * F.col("w")).alias(f"{x}r_{i}") for x in "uv" for i in range(n)]
    pairs = own.groupBy("p", "q").agg(*sums)
    none = F.lit(None)
    long, whole = none.cast("long"), lambda i: F.lit(i).cast("int")
    block = lambda row, col, i, j, value: F.struct(row.cast("long").alias("row"), col.cast("long").alias("col"), whole(i).alias("i"), whole(j).alias("j"), F.col(value).alias("value"))
    p, q = F.col("p"), F.col("q")
    parts = [block(p, p, i, j, f"uu_{i}_{j}") for i in range(n) for j in range(n)] + [block(p, q, i, j, f"uv_{i}_{j}") for i in range(n) for j in range(n)] + [block(q, q, i, j, f"vv_{i}_{j}") for i in range(n) for j in range(n)]
    parts += [block(p, long, i, None, f"ur_{i}") for i in range(n)] + [block(q, long, i, None, f"vr_{i}") for i in range(n)]
    return pairs.select(F.explode(F.array(*parts)).alias("b")).select("b.*").groupBy("row", "col", "i", "j").agg(F.sum("value").alias("value"))


def mahalanobis(points: DataFrame, gaussians: DataFrame, size: float, mode: str = "floor", floor: float = 0.0) -> DataFrame:
    """(n, mean_square): points against the Gaussian of their own voxel; singular ones are left out."""
    from pointloom.functions.geometry import held

    keys = ["ix", "iy", "iz"]
    j = with_cells(points, ["x", "y", "z"], size, mode, keys).join(gaussians.drop("n"), keys)
    d = [F.col(a) - F.col(f"mean_{a}") for a in "xyz"]

    def square(x, y, z, xx, xy, xz, yy, yz, zz):
        cof = (yy * zz - yz * yz, xz * yz - xy * zz, xy * yz - xz * yy, xx * zz - xz * xz, xy * xz - xx * yz, xx * yy - xy * xy)
        det = xx * cof[0] + xy * cof[1] + xz * cof[2]
        top = x * x * cof[0] + y * y * cof[3] + z * z * cof[5] + 2 * (x * y * cof[1] + x * z * cof[2] + y * z * cof[4])
        return F.when(det > 0, top / det)

    covs = [F.col(f"cov_{n}") + (floor * floor if n[0] == n[1] else 0.0) for n in ("xx", "xy", "xz", "yy", "yz", "zz")]
    return j.select(held(square, *d, *covs).alias("m")).where("m is not null").agg(F.count("*").alias("n"), F.avg("m").alias("mean_square"))


def load_counters(points: DataFrame, kept, ts: str = "ts", keys: list[str] | None = None) -> DataFrame:
    """What a loader reports: rows in all, without a time, and left out by the condition ``kept``."""
    return points.groupBy(*(keys or [])).agg(F.count("*").alias("total"), F.count_if(F.col(ts) == 0).alias("without_time"), F.count_if(~F.coalesce(kept, F.lit(False))).alias("filtered"))


def first_failure(rows: DataFrame, value: str, ts: str, keys: list[str] | None = None) -> DataFrame:
    """Where a computation first went wrong: the smallest time at which ``value`` isn't a finite number
    (null: nowhere), and how often."""
    bad = F.col(value).isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    return rows.groupBy(*(keys or [])).agg(F.min(F.when(bad, F.col(ts))).alias("ts_failure"), F.count_if(bad).alias("failures"))


def wasserstein(a: DataFrame, b: DataFrame, value: str, width: float) -> DataFrame:
    """Earth mover's distance of one coordinate of two clouds, from histograms of ``width``: the area
    between both cumulative shares.  Windows run over bins, not rows; along several directions it gives
    the sliced distance of clouds."""
    both = a.select(F.lit(1).alias("__a"), F.col(value).alias("v")).unionByName(b.select(F.lit(0).alias("__a"), F.col(value).alias("v")))
    bins = both.groupBy(cell("v", width, "floor").alias("bin")).agg(F.sum("__a").alias("na"), F.sum(1 - F.col("__a")).alias("nb"))
    w = Window.orderBy("bin")
    run, all_ = w.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    gap = F.abs(F.sum("na").over(run) / F.sum("na").over(all_) - F.sum("nb").over(run) / F.sum("nb").over(all_))
    step = F.coalesce(F.lead("bin").over(w) - F.col("bin"), F.lit(0)) * width
    return bins.select((gap * step).alias("part")).agg(F.sum("part").alias("emd"))


def normal_histogram(normals: DataFrame, bins: int = 101) -> DataFrame:
    """(ix, iy, iz, n): unit normals (nx, ny, nz) counted in a sparse cube of ``bins`` cells a side over
    [-1, 1].  Histograms of parts add up by key; rows with a null component take no part."""
    at = lambda a: F.least(F.floor((F.col(f"n{a}") + 1) / 2 * bins), F.lit(bins - 1)).cast("int").alias(f"i{a}")
    rows = normals.where("nx is not null and ny is not null and nz is not null")
    return rows.select(*map(at, "xyz")).groupBy("ix", "iy", "iz").agg(F.count("*").alias("n"))


def histogram_modes(histogram: DataFrame, least: int = 1) -> DataFrame:
    """Cells with at least ``least`` normals that no cell beside them exceeds (of equals the smaller key): the
    directions of walls.  A cell is written to its 27 neighbours and compared with their largest, with no join."""
    key = ["ix", "iy", "iz"]
    beside = F.array(*[F.struct(*[(F.col(a) + d).alias(a) for a, d in zip(key, (i, j, k))]) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)])
    own = F.struct(F.col("n"), *[(-F.col(a)).alias(a) for a in key])
    best = histogram.select(F.explode(beside).alias("c"), own.alias("own")).select("c.*", "own").groupBy(*key).agg(F.max("own").alias("b"))
    same = [F.col(a) == -F.col(f"b.{a}") for a in key]
    return best.where(same[0] & same[1] & same[2] & (F.col("b.n") >= least)).select(*key, F.col("b.n").alias("n"))


def sliced_distance(a: DataFrame, b: DataFrame, directions: list[tuple[float, float, float]], width: float) -> DataFrame:
    """(direction, distance): the earth mover's distance of two clouds along each direction, over bins of
    ``width``: both are projected onto all directions in one explode, and what is left are two running sums
    of bins.  The mean over directions is the sliced distance in space."""
    slices = F.array(*[F.struct(F.lit(i).alias("direction"), F.floor(sum((F.col(c) * float(v) for c, v in zip("yz", d[1:])), F.col("x") * float(d[0])) / width).alias("bin")) for i, d in enumerate(directions)])
    both = a.select(slices.alias("s"), F.lit(1).alias("own")).unionByName(b.select(slices.alias("s"), F.lit(0).alias("own")))
    bins = both.select(F.explode("s").alias("s"), "own").groupBy("s.direction", "s.bin").agg(F.sum("own").alias("na"), F.sum(1 - F.col("own")).alias("nb"))
    order = Window.partitionBy("direction").orderBy("bin")
    whole = Window.partitionBy("direction")
    apart = F.abs(F.sum("na").over(order) / F.sum("na").over(whole) - F.sum("nb").over(order) / F.sum("nb").over(whole))
    rows = bins.select("direction", (apart * (F.lead("bin").over(order) - F.col("bin")) * width).alias("part"))
    return rows.groupBy("direction").agg(F.coalesce(F.sum("part"), F.lit(0.0)).alias("distance"))

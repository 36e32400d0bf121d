"""Column functions on points, angles and bits."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def c(x: ColumnLike | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def held(f: Callable[..., Column], *xs: ColumnLike) -> Column:
    """f of the values, each worked out once.  A function that uses a computed argument many times
    would otherwise repeat its whole expression each time; columns by name need no such care."""
    if all(isinstance(x, str) for x in xs):
        return f(*map(F.col, xs))
    one = F.array(F.struct(*[c(x).alias(f"v{i}") for i, x in enumerate(xs)]))
    return F.get(F.transform(one, lambda s: f(*[s[f"v{i}"] for i in range(len(xs))])), F.lit(0))


def norm(*xs: ColumnLike) -> Column:
    return F.sqrt(reduce(lambda a, b: a + b, [c(x) * c(x) for x in xs]))


def cell(x: ColumnLike, size: float, mode: str = "trunc") -> Column:
    """Integer cell of a coordinate. ``trunc`` goes toward zero (the cell around 0 is of double
    width), ``floor`` gives cells of one width, which neighbour joins need. Non-finite: null."""
    q = c(x) / F.lit(float(size))
    ok = ~F.isnan(q) & (F.abs(q) < F.lit(2.0**31))
    if mode == "floor":
        return F.when(ok, F.floor(q).cast("int"))
    return F.when(ok, F.when(q < 0, F.ceil(q)).otherwise(F.floor(q)).cast("int"))


def packed_key(*cells: ColumnLike) -> Column:
    """Cells as 16-bit parts of one long, the first highest; parts beyond 16 bits wrap."""
    out = F.lit(0).cast("long")
    for x in cells:
        out = F.shiftleft(out, 16).bitwiseOR(c(x).cast("long").bitwiseAND(F.lit(65535)))
    return out


def spherical(x: ColumnLike, y: ColumnLike, z: ColumnLike) -> Column:
    """struct(r, polar = atan2(y, x), azimuth = acos(z / r)); null where r is 0."""
    r = norm(x, y, z)
    return F.when(r > 0, F.struct(r.alias("r"), F.atan2(c(y), c(x)).alias("polar"), F.acos(c(z) / r).alias("azimuth")))


def normalised_angle(a: ColumnLike) -> Column:
    """An angle in (-pi, pi]."""
    two = F.lit(2) * F.pi()
    r = c(a) - two * F.floor(c(a) / two)
    return F.when(r > F.pi(), r - two).otherwise(r)


def planarity(*values: ColumnLike) -> Column:
    """1 - product of 3 v / sum over the eigenvalues; null where they sum to 0."""
    total = reduce(lambda a, b: a + b, map(c, values))
    parts = [F.try_divide(3 * c(v), total) for v in values]
    return 1 - reduce(lambda a, b: a * b, parts)


def point_line_distance(point: tuple, start: tuple, direction: tuple) -> Column:
    """Distance of a point from the line through ``start`` along ``direction``."""
    d = [c(a) - c(b) for a, b in zip(point, start)]
    u = list(map(c, direction))
    cross = [d[1] * u[2] - d[2] * u[1], d[2] * u[0] - d[0] * u[2], d[0] * u[1] - d[1] * u[0]]
    return F.try_divide(norm(*cross), norm(*u))


def ray_plane(origin: tuple, direction: tuple, plane: tuple) -> Column:
    """struct(x, y, z) where the ray meets a x + b y + c z + d = 0; null where it runs along it."""
    o, u, p = (list(map(c, v)) for v in (origin, direction, plane))
    down = sum((a * b for a, b in zip(p, u)), F.lit(0.0))
    t = F.try_divide(-(sum((a * b for a, b in zip(p, o)), F.lit(0.0)) + p[3]), down)
    return F.when(t.isNotNull(), F.struct(*[(a + t * b).alias(n) for n, a, b in zip("xyz", o, u)]))


def gray_to_binary(g: ColumnLike, bits: int = 32) -> Column:
    """The number whose reflected binary code is ``g``."""
    out, shift = c(g).cast("long"), 1
    while shift < bits:
        out = out.bitwiseXOR(F.shiftrightunsigned(out, shift))
        shift *= 2
    return out


def pack_flags(flags: list[ColumnLike]) -> Column:
    """Booleans as the bits of a long, the first lowest; null is false."""
    return reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(F.coalesce(c(f), F.lit(False)).cast("long"), i) for i, f in enumerate(flags)])


def pack_rgb(r: ColumnLike, g: ColumnLike, b: ColumnLike) -> Column:
    return F.shiftleft(c(r).cast("int"), 16).bitwiseOR(F.shiftleft(c(g).cast("int"), 8)).bitwiseOR(c(b).cast("int"))


def transform(pose: ColumnLike, x: ColumnLike, y: ColumnLike, z: ColumnLike) -> Column:
    """struct(x, y, z) of a point under a row-major 4x4 pose (array<double> of 16)."""
    def run(m: Column, x: Column, y: Column, z: Column) -> Column:
        return F.struct(*[(m[4 * i] * x + m[4 * i + 1] * y + m[4 * i + 2] * z + m[4 * i + 3]).alias(n) for i, n in enumerate("xyz")])

    return held(run, pose, x, y, z)


def truth(text: ColumnLike) -> Column:
    """Whether a flag written as text or JSON boolean means yes."""
    return F.coalesce(F.upper(F.trim(c(text).cast("string"))).isin("TRUE", "1", "YES"), F.lit(False))


def base_name(path: ColumnLike) -> Column:
    """Last part of a path with either slash."""
    return F.element_at(F.split(F.regexp_replace(c(path), r"\\", "/"), "/"), -1)


def stem(path: ColumnLike) -> Column:
    return F.regexp_replace(base_name(path), r"\.[^.]*$", "")


def chunk_index(path: ColumnLike) -> Column:
    """The last four characters of a file's stem."""
    return F.right(stem(path), F.lit(4))

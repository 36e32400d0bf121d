"""Rigid poses as row-major array<double> of 16, with their other encodings.

Arguments are bound before use (``held``), so functions can be nested without their expressions
growing with every use.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pointloom.functions.geometry import ColumnLike, held


def _last_row() -> list[Column]:
    return [F.lit(float(x)) for x in (0, 0, 0, 1)]


def identity() -> Column:
    return F.array(*[F.lit(1.0 if i % 5 == 0 else 0.0) for i in range(16)])


def product(a: ColumnLike, b: ColumnLike) -> Column:
    """a * b."""

    def run(p: Column, q: Column) -> Column:
        return F.array(*[p[4 * i] * q[j] + p[4 * i + 1] * q[4 + j] + p[4 * i + 2] * q[8 + j] + p[4 * i + 3] * q[12 + j] for i in range(4) for j in range(4)])

    return held(run, a, b)


def inverse(a: ColumnLike) -> Column:
    """Of a rigid pose: transposed rotation, turned back translation."""

    def run(m: Column) -> Column:
        rows = []
        for i in range(3):
            rows += [m[i], m[4 + i], m[8 + i], -(m[i] * m[3] + m[4 + i] * m[7] + m[8 + i] * m[11])]
        return F.array(*rows, *_last_row())

    return held(run, a)


def from_rows(r: list[Column], t: list[Column]) -> Column:
    out = []
    for i in range(3):
        out += [*r[3 * i : 3 * i + 3], t[i]]
    return F.array(*out, *_last_row())


def from_tait_bryan(px, py, pz, om, fi, ka) -> Column:
    """Translation and rotations about x, then y, then z: R = Rx(om) Ry(fi) Rz(ka)."""

    def run(px, py, pz, om, fi, ka) -> Column:
        return held(turned, px, py, pz, *[f(a) for a in (om, fi, ka) for f in (F.sin, F.cos)])

    def turned(px, py, pz, so, co, sf, cf, sk, ck) -> Column:
        r = [cf * ck, -cf * sk, sf, co * sk + so * sf * ck, co * ck - so * sf * sk, -so * cf, so * sk - co * sf * ck, so * ck + co * sf * sk, co * cf]
        return from_rows(r, [px, py, pz])

    return held(run, px, py, pz, om, fi, ka)


def to_tait_bryan(pose: ColumnLike) -> Column:
    """struct(px, py, pz, om, fi, ka); at a pitch of +-90 degrees om is 0 and ka takes the rest."""

    def run(m: Column) -> Column:
        up, down = m[2] >= 1.0, m[2] <= -1.0
        fi = F.when(up, F.pi() / 2).when(down, -F.pi() / 2).otherwise(F.asin(m[2]))
        om = F.when(up | down, F.lit(0.0)).otherwise(F.atan2(-m[6], m[10]))
        ka = F.when(up | down, F.atan2(m[4], m[5])).otherwise(F.atan2(-m[1], m[0]))
        return F.struct(m[3].alias("px"), m[7].alias("py"), m[11].alias("pz"), om.alias("om"), fi.alias("fi"), ka.alias("ka"))

    return held(run, pose)


def from_quaternion(tx, ty, tz, qw, qx, qy, qz) -> Column:
    """Of any non-zero quaternion; it is normalised first."""

    def unit(tx, ty, tz, w, x, y, z) -> Column:
        n = F.sqrt(w * w + x * x + y * y + z * z)
        return held(lambda tx, ty, tz, n, w, x, y, z: held(run, tx, ty, tz, *[F.try_divide(v, n) for v in (w, x, y, z)]), tx, ty, tz, n, w, x, y, z)

    def run(tx, ty, tz, w, x, y, z) -> Column:
        r = [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w), 2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w), 2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]
        return from_rows(r, [tx, ty, tz])

    return held(unit, tx, ty, tz, qw, qx, qy, qz)


def to_quaternion(pose: ColumnLike) -> Column:
    """struct(qw, qx, qy, qz) with qw >= 0, from the largest of the four squares."""

    def run(m: Column) -> Column:
        squares = F.array(1 + m[0] + m[5] + m[10], 1 + m[0] - m[5] - m[10], 1 - m[0] + m[5] - m[10], 1 - m[0] - m[5] + m[10])
        return held(lambda m, q: held(pick, m, q, 2 * F.sqrt(F.array_max(q))), m, squares)

    def pick(m: Column, q: Column, s: Column) -> Column:
        d = [(m[9] - m[6]) / s, (m[2] - m[8]) / s, (m[4] - m[1]) / s]
        xy, xz, yz = (m[1] + m[4]) / s, (m[2] + m[8]) / s, (m[6] + m[9]) / s
        cases = [F.array(s / 4, *d), F.array(d[0], s / 4, xy, xz), F.array(d[1], xy, s / 4, yz), F.array(d[2], xz, yz, s / 4)]
        most = F.array_position(q, F.array_max(q))
        best = F.when(most == 1, cases[0]).when(most == 2, cases[1]).when(most == 3, cases[2]).otherwise(cases[3])
        return held(lambda v: F.struct(*[(F.when(v[0] < 0, -v[k]).otherwise(v[k])).alias(n) for k, n in enumerate(("qw", "qx", "qy", "qz"))]), best)

    return held(run, pose)


def from_rodrigues(px, py, pz, sx, sy, sz) -> Column:
    """Translation and rotation vector (axis times angle)."""

    def run(px, py, pz, x, y, z) -> Column:
        angle = F.sqrt(x * x + y * y + z * z)
        return held(turned, px, py, pz, x, y, z, angle)

    def turned(px, py, pz, x, y, z, angle) -> Column:
        k = F.coalesce(F.try_divide(F.sin(angle / 2), angle), F.lit(0.5))
        return from_quaternion(px, py, pz, F.cos(angle / 2), x * k, y * k, z * k)

    return held(run, px, py, pz, sx, sy, sz)


def to_rodrigues(pose: ColumnLike) -> Column:
    """struct(px, py, pz, sx, sy, sz)."""

    def run(m: Column, q: Column) -> Column:
        n = F.sqrt(q["qx"] * q["qx"] + q["qy"] * q["qy"] + q["qz"] * q["qz"])
        k = F.coalesce(F.try_divide(2 * F.atan2(n, q["qw"]), n), F.lit(2.0))
        return held(lambda m, q, k: F.struct(m[3].alias("px"), m[7].alias("py"), m[11].alias("pz"), *[(q[f"q{a}"] * k).alias(f"s{a}") for a in "xyz"]), m, q, k)

    return held(lambda m: held(run, m, to_quaternion(m)), pose)


def interpolate(a: ColumnLike, b: ColumnLike, alpha: ColumnLike) -> Column:
    """Between two poses: translation linearly, rotation along the shorter arc; alpha is held in [0, 1]."""
    names = ("qw", "qx", "qy", "qz")

    def run(m: Column, n: Column, alpha: Column) -> Column:
        return held(angled, m, n, to_quaternion(m), to_quaternion(n), F.least(F.greatest(alpha, F.lit(0.0)), F.lit(1.0)))

    def angled(m, n, p, q, t) -> Column:
        dot = p["qw"] * q["qw"] + p["qx"] * q["qx"] + p["qy"] * q["qy"] + p["qz"] * q["qz"]
        return held(mixed, m, n, p, q, t, F.acos(F.least(F.abs(dot), F.lit(1.0))), F.when(dot < 0, -1.0).otherwise(1.0))

    def mixed(m, n, p, q, t, angle, sign) -> Column:
        near = F.sin(angle) < 1e-9
        u = F.when(near, 1 - t).otherwise(F.try_divide(F.sin((1 - t) * angle), F.sin(angle)))
        v = sign * F.when(near, t).otherwise(F.try_divide(F.sin(t * angle), F.sin(angle)))
        return held(lambda m, n, p, q, t, u, v: from_quaternion(*[m[k] + t * (n[k] - m[k]) for k in (3, 7, 11)], *[u * p[x] + v * q[x] for x in names]), m, n, p, q, t, u, v)

    return held(run, a, b, alpha)

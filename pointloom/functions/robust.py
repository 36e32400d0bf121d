"""M-estimators as columns: rho (loss), upsilon (influence) and w (weight = upsilon / r).

Definitions are the textbook ones; a weight without a finite value at r = 0 is null there.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pointloom.functions.geometry import ColumnLike, c

#: Usual tuning constants (fixed values).
TUNING = {"fair": 1.3998, "huber": 1.345, "cauchy": 2.3849, "welsch": 2.9846, "tukey": 4.6851, "lp": 1.2, "barron": 1.0}


def estimator(name: str, r: ColumnLike, k: float | None = None, alpha: float = 1.0) -> tuple[Column, Column, Column]:
    """(rho, upsilon, w) of a residual for one of l1, l2, l1l2, lp, fair, huber, cauchy, geman,
    welsch, tukey, barron; ``k`` is the tuning constant (the exponent for lp, the scale for barron)."""
    r = c(r).cast("double")
    k = TUNING.get(name, 1.0) if k is None else float(k)
    a, sq = F.abs(r), r * r
    if name == "l1":
        return a, F.signum(r), F.try_divide(F.lit(1.0), a)
    if name == "l2":
        return sq / 2, r, F.lit(1.0)
    if name == "l1l2":
        s = F.sqrt(1 + sq / 2)
        return 2 * (s - 1), r / s, 1 / s
    if name == "lp":
        p = F.pow(a, k - 1)
        return F.pow(a, k) / k, F.signum(r) * p, F.try_divide(p, a)
    if name == "fair":
        s = 1 + a / k
        return k * k * (a / k - F.log(s)), r / s, 1 / s
    if name == "huber":
        inside = a <= k
        return F.when(inside, sq / 2).otherwise(k * (a - k / 2)), F.when(inside, r).otherwise(k * F.signum(r)), F.when(inside, 1.0).otherwise(F.try_divide(F.lit(k), a))
    if name == "cauchy":
        s = 1 + sq / (k * k)
        return k * k / 2 * F.log(s), r / s, 1 / s
    if name == "geman":
        s = (1 + sq) * (1 + sq)
        return sq / 2 / (1 + sq), r / s, 1 / s
    if name == "welsch":
        e = F.exp(-sq / (k * k))
        return k * k / 2 * (1 - e), r * e, e
    if name == "tukey":
        u = 1 - sq / (k * k)
        inside = a <= k
        return F.when(inside, k * k / 6 * (1 - u * u * u)).otherwise(k * k / 6), F.when(inside, r * u * u).otherwise(0.0), F.when(inside, u * u).otherwise(0.0)
    if name == "barron":
        x = sq / (k * k)
        if alpha == 2:
            return x / 2, r / (k * k), F.lit(1 / (k * k))
        if alpha == 0:
            w = 2 / (sq + 2 * k * k)
            return F.log(x / 2 + 1), r * w, w
        if alpha == float("-inf"):
            w = F.exp(-x / 2) / (k * k)
            return 1 - F.exp(-x / 2), r * w, w
        b = abs(alpha - 2)
        w = F.pow(x / b + 1, alpha / 2 - 1) / (k * k)
        return b / alpha * (F.pow(x / b + 1, alpha / 2) - 1), r * w, w
    raise ValueError(name)


ESTIMATORS = ("l1", "l2", "l1l2", "lp", "fair", "huber", "cauchy", "geman", "welsch", "tukey", "barron")


def barron_partition(alpha: float, scale: float = 1.0, reach: float = 10.0, steps: int = 100) -> Column:
    """Integral of exp(-rho) over [-reach, reach] by midpoints; for adaptive alpha."""
    h = 2 * reach / steps
    return F.aggregate(F.sequence(F.lit(0), F.lit(steps - 1)), F.lit(0.0), lambda s, i: s + h * F.exp(-estimator("barron", -reach + (i + 0.5) * h, scale, alpha)[0]))

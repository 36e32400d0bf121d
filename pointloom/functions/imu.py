"""Units and validity of inertial samples as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pointloom.functions.geometry import ColumnLike, c, norm

#: Standard gravity (fixed value).
GRAVITY = 9.80665


def metres(g: ColumnLike) -> Column:
    """Acceleration in m/s^2 from multiples of gravity."""
    return c(g) * GRAVITY


def radians(degrees: ColumnLike) -> Column:
    return F.radians(c(degrees))


def valid(ax: ColumnLike, ay: ColumnLike, az: ColumnLike, most: float = 50.0) -> Column:
    """Whether an acceleration is finite and shorter than ``most``."""
    n = norm(ax, ay, az)
    return F.coalesce(~F.isnan(n) & (n < most), F.lit(False))

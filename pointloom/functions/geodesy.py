"""Map projections and local frames as columns, from the published series for WGS 84."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.functions.geometry import ColumnLike, c, held

#: WGS 84 (fixed values).
A, FLATTENING = 6378137.0, 1 / 298.257223563
E2 = FLATTENING * (2 - FLATTENING)


def transverse_mercator(lat: ColumnLike, lon: ColumnLike, lon0: float | Column, scale: float, false_east: float, false_north: float) -> Column:
    """struct(east, north) by Krueger's series to the fourth order in the third flattening."""
    n = FLATTENING / (2 - FLATTENING)
    radius = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 / 3 * n**2 + 5 / 16 * n**3 + 41 / 180 * n**4, 13 / 48 * n**2 - 3 / 5 * n**3 + 557 / 1440 * n**4, 61 / 240 * n**3 - 103 / 140 * n**4, 49561 / 161280 * n**4]
    phi, lam = F.radians(c(lat)), F.radians(c(lon) - lon0)
    e = math.sqrt(E2)
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(alpha, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return F.struct((false_east + scale * radius * x).alias("east"), (false_north + scale * radius * y).alias("north"))


def puwg92(lat: ColumnLike, lon: ColumnLike) -> Column:
    """Polish national grid (EPSG:2180): meridian 19, scale 0.9993."""
    return transverse_mercator(lat, lon, 19.0, 0.9993, 500_000.0, -5_300_000.0)


def utm(lat: ColumnLike, lon: ColumnLike) -> Column:
    """struct(zone, east, north) in the zone of the longitude."""
    zone = F.least(F.floor((c(lon) + 180) / 6) + 1, F.lit(60)).cast("int")
    p = transverse_mercator(lat, lon, zone * 6 - 183, 0.9996, 500_000.0, 0.0)
    return F.struct(zone.alias("zone"), p["east"].alias("east"), (p["north"] + F.when(c(lat) < 0, 10_000_000.0).otherwise(0.0)).alias("north"))


def web_mercator(lat: ColumnLike, lon: ColumnLike) -> Column:
    return F.struct((A * F.radians(c(lon))).alias("x"), (A * F.atanh(F.sin(F.radians(c(lat))))).alias("y"))


def local_mercator(lat: ColumnLike, lon: ColumnLike, lat0: float, lon0: float) -> Column:
    """struct(x, y) in metres from a reference point: Mercator differences at its scale."""
    k = math.cos(math.radians(lat0))
    y0 = math.atanh(math.sin(math.radians(lat0)))
    return F.struct((A * k * F.radians(c(lon) - lon0)).alias("x"), (A * k * (F.atanh(F.sin(F.radians(c(lat)))) - y0)).alias("y"))


def geocentric(lat: ColumnLike, lon: ColumnLike, h: ColumnLike) -> Column:
    phi, lam = F.radians(c(lat)), F.radians(c(lon))
    n = A / F.sqrt(1 - E2 * F.sin(phi) * F.sin(phi))
    return F.struct(((n + c(h)) * F.cos(phi) * F.cos(lam)).alias("x"), ((n + c(h)) * F.cos(phi) * F.sin(lam)).alias("y"), ((n * (1 - E2) + c(h)) * F.sin(phi)).alias("z"))


def enu(lat: ColumnLike, lon: ColumnLike, h: ColumnLike, lat0: float, lon0: float, h0: float) -> Column:
    """struct(e, n, u) in the topocentric frame of a reference point."""
    p, l = math.radians(lat0), math.radians(lon0)
    n0 = A / math.sqrt(1 - E2 * math.sin(p) ** 2)
    x0, y0, z0 = (n0 + h0) * math.cos(p) * math.cos(l), (n0 + h0) * math.cos(p) * math.sin(l), (n0 * (1 - E2) + h0) * math.sin(p)
    g = geocentric(lat, lon, h)
    dx, dy, dz = g["x"] - x0, g["y"] - y0, g["z"] - z0
    return F.struct(
        (-math.sin(l) * dx + math.cos(l) * dy).alias("e"),
        (-math.sin(p) * math.cos(l) * dx - math.sin(p) * math.sin(l) * dy + math.cos(p) * dz).alias("n"),
        (math.cos(p) * math.cos(l) * dx + math.cos(p) * math.sin(l) * dy + math.sin(p) * dz).alias("u"),
    )


def from_web_mercator(x: ColumnLike, y: ColumnLike) -> Column:
    """struct(lat, lon) in degrees."""
    return F.struct(F.degrees(F.asin(F.tanh(c(y) / A))).alias("lat"), F.degrees(c(x) / A).alias("lon"))


def from_transverse_mercator(east: ColumnLike, north: ColumnLike, lon0: float | Column, scale: float, false_east: float, false_north: float) -> Column:
    """struct(lat, lon): the inverse of ``transverse_mercator``, by the inverse series and five fixed-point
    steps for the latitude."""
    n = FLATTENING / (2 - FLATTENING)
    radius = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = [n / 2 - 2 / 3 * n**2 + 37 / 96 * n**3 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 / 1440 * n**4, 17 / 480 * n**3 - 37 / 840 * n**4, 4397 / 161280 * n**4]
    e = math.sqrt(E2)

    def run(xi: Column, eta: Column, lon0: Column) -> Column:
        x, y = eta, xi
        for j, b in enumerate(beta, 1):
            x = x - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
            y = y - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        return held(angles, x, y, lon0)

    def angles(x: Column, y: Column, lon0: Column) -> Column:
        conformal = F.asin(F.sin(y) / F.cosh(x))
        whole = F.log(F.tan(F.pi() / 4 + conformal / 2))
        lat = conformal
        for _ in range(5):
            lat = held(lambda p, q: 2 * F.atan(F.exp(q + e * F.atanh(e * F.sin(p)))) - F.pi() / 2, lat, whole)
        return F.struct(F.degrees(lat).alias("lat"), (F.degrees(F.atan2(F.sinh(x), F.cos(y))) + lon0).alias("lon"))

    return held(run, (c(north) - false_north) / (scale * radius), (c(east) - false_east) / (scale * radius), c(lon0))


def with_geoid(fixes: DataFrame, grid: DataFrame, step: float, height: str = "height") -> DataFrame:
    """Adds orthometric: heights less the geoid's separation, between the four grid points around a fix.

    ``grid`` has (iy, ix, separation) at iy * step degrees of latitude and ix * step of longitude; a fix
    outside it gets null.  Each fix meets four grid rows by an equi-join.
    """
    iy, ix = F.floor(F.col("lat") / step), F.floor(F.col("lon") / step)
    fy, fx = F.col("lat") / step - iy, F.col("lon") / step - ix
    corner = lambda a, b, w: F.struct((iy + a).cast("long").alias("iy"), (ix + b).cast("long").alias("ix"), w.alias("w"))
    corners = F.array(corner(0, 0, (1 - fy) * (1 - fx)), corner(0, 1, (1 - fy) * fx), corner(1, 0, fy * (1 - fx)), corner(1, 1, fy * fx))
    rows = fixes.select(F.struct(*fixes.columns).alias("__fix"), F.explode(corners).alias("k")).select("__fix", "k.*").join(grid.selectExpr("cast(iy as long) iy", "cast(ix as long) ix", "separation"), ["iy", "ix"], "left")
    out = rows.groupBy("__fix").agg(F.sum(F.col("w") * F.col("separation")).alias("__n"), F.count("separation").alias("__c"))
    return out.select("__fix.*", F.when(F.col("__c") == 4, F.col(f"__fix.{height}") - F.col("__n")).alias("orthometric"))

"""NMEA sentences as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pointloom.functions.geometry import ColumnLike, c


def stamped(line: ColumnLike) -> Column:
    """struct(lidar_ns, unix_ns, sentence) of a stamped line; null if it isn't one."""
    p = r"^\s*(-?[0-9]+)\s+(-?[0-9]+)\s+(\$.*?)\s*$"
    part = lambda i: F.regexp_extract(c(line), p, i)
    return F.when(c(line).rlike(p), F.struct(part(1).try_cast("long").alias("lidar_ns"), part(2).try_cast("long").alias("unix_ns"), part(3).alias("sentence")))


def checksum(sentence: ColumnLike) -> Column:
    """XOR of the characters between $ and *, null without them."""
    body = F.regexp_extract(c(sentence), r"^\$([^*]*)\*[0-9A-Fa-f]{2}$", 1)
    x = F.aggregate(F.split(body, ""), F.lit(0), lambda a, ch: a.bitwiseXOR(F.ascii(ch)))
    return F.when(c(sentence).rlike(r"^\$[^*]*\*[0-9A-Fa-f]{2}$"), x)


def valid(sentence: ColumnLike) -> Column:
    """Whether the sentence carries its own checksum."""
    given = F.conv(F.right(c(sentence), F.lit(2)), 16, 10).try_cast("int")
    return F.coalesce(checksum(sentence) == given, F.lit(False))


def degrees(value: ColumnLike, hemisphere: ColumnLike) -> Column:
    """Decimal degrees of ddmm.mmmm or dddmm.mmmm; south and west are negative; null if not a number."""
    v = c(value).try_cast("double")
    whole = F.floor(v / 100)
    return F.when(c(hemisphere).isin("S", "W"), -1.0).otherwise(1.0) * (whole + (v - whole * 100) / 60)


def _number(parts: Column, i: int, empty: float | None = 0.0) -> Column:
    own = F.nullif(F.get(parts, F.lit(i)), F.lit("")).try_cast("double")
    return own if empty is None else F.coalesce(own, F.lit(empty))


def _fields(sentence: ColumnLike) -> Column:
    return F.split(F.regexp_replace(c(sentence), r"\*.*$", ""), ",")


def gga(sentence: ColumnLike) -> Column:
    """struct of a GGA sentence of at least 15 fields; empty numbers are 0, a missing age -1."""
    p = _fields(sentence)
    ok = (F.size(p) >= 15) & F.get(p, F.lit(0)).rlike(r"^\$..GGA$")
    return F.when(ok, F.struct(degrees(p[2], p[3]).alias("lat"), degrees(p[4], p[5]).alias("lon"), _number(p, 6).cast("int").alias("fix"), _number(p, 7).cast("int").alias("sats"), _number(p, 8).alias("hdop"), _number(p, 9).alias("alt"), _number(p, 11).alias("undulation"), _number(p, 13, -1.0).alias("age")))


def rmc(sentence: ColumnLike) -> Column:
    """struct of an RMC sentence of at least 12 fields."""
    p = _fields(sentence)
    ok = (F.size(p) >= 12) & F.get(p, F.lit(0)).rlike(r"^\$..RMC$")
    return F.when(ok, F.struct(p[1].alias("utc"), (p[2] == "A").alias("active"), degrees(p[3], p[4]).alias("lat"), degrees(p[5], p[6]).alias("lon"), _number(p, 7).alias("knots"), _number(p, 8).alias("course"), p[9].alias("date")))

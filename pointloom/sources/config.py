"""Settings files, listings and manifests (driver side; a few lines each)."""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass, fields, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = (0, 1, 0)


@dataclass(frozen=True)
class OdometryParams:
    """Settings of ``plans.registration.run_odometry`` and the scan before it."""

    size: float = 0.3
    per_batch: int = 20
    rounds: int = 5
    least: int = 5
    inner: float = 0.3
    outer: float = 70.0
    decimation: float = 0.01


def load_params(path: str, base: OdometryParams | None = None) -> OdometryParams:
    """Known keys of a TOML file (any table) over the defaults; a file of a newer version is refused."""
    with open(path, "rb") as f:
        data = tomllib.load(f)
    flat: dict[str, Any] = {}
    for k, v in data.items():
        flat |= v if isinstance(v, dict) else {k: v}
    if (version := flat.get("version")) is not None and not compatible(str(version)):
        raise ValueError(f"settings of version {version} are newer than {'.'.join(map(str, VERSION))}")
    known = {f.name: type(f.default) for f in fields(OdometryParams)}
    return replace(base or OdometryParams(), **{k: known[k](v) for k, v in flat.items() if k in known})


def compatible(version: str) -> bool:
    """Whether settings of a version can be read: the same major number and not a newer minor one."""
    m = re.fullmatch(r"v?(\d+)\.(\d+)(?:\.(\d+))?.*", version.strip())
    return bool(m) and int(m[1]) == VERSION[0] and int(m[2]) <= VERSION[1]


def opencv_intrinsics(path: str) -> dict[str, list[float] | int]:
    """image_width, image_height, camera_matrix, distortion_coefficients of a camera YAML."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    out: dict[str, list[float] | int] = {}
    for name in ("image_width", "image_height"):
        if m := re.search(rf"^{name}\s*:\s*(\d+)", text, re.M):
            out[name] = int(m[1])
    for name in ("camera_matrix", "distortion_coefficients"):
        if m := re.search(rf"^{name}\s*:.*?data\s*:\s*\[(.*?)\]", text, re.M | re.S):
            out[name] = [float(v) for v in m[1].replace("\n", " ").split(",") if v.strip()]
    return out


def listing(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(path, length) of files whose whole name matches a regular expression; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    return files.where(F.regexp_extract("path", r"([^/]*)$", 1).rlike(f"^(?:{pattern})$")).orderBy("path")


def chunks_in(manifest: DataFrame, start: int, end: int) -> list[str]:
    """Files of a manifest (path, first_ns, last_ns) that overlap a span of time: a few out of many,
    chosen before any is read."""
    return [r["path"] for r in manifest.where((F.col("last_ns") >= start) & (F.col("first_ns") <= end)).orderBy("first_ns").select("path").collect()]


def expected_files(found: DataFrame, names: DataFrame, on: str = "name") -> tuple[DataFrame, DataFrame]:
    """Of the expected names those that are there and those that are missing."""
    return names.join(found, on, "left_semi"), names.join(found, on, "left_anti")


def write_params(params: OdometryParams, path: str) -> None:
    """Settings as a TOML file that ``load_params`` reads; for a file the driver holds."""
    rows = [f"{f.name} = {getattr(params, f.name)!r}" for f in fields(OdometryParams)]
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join([f'version = "{".".join(map(str, VERSION))}"', "", "[odometry]", *rows]) + "\n")


def results_document(batches: DataFrame, params: OdometryParams | None = None) -> str:
    """A JSON report of a run: number of batches and poses, path length and duration from a table of
    batches (batch, poses, length, seconds), with its settings; one row of sums comes to the driver."""
    import json
    from dataclasses import asdict

    r = batches.agg(F.count("*").alias("batches"), F.sum("poses").alias("poses"), F.sum("length").alias("length_m"), F.sum("seconds").alias("seconds")).first().asDict()
    return json.dumps({"version": ".".join(map(str, VERSION)), "results": r, "params": asdict(params or OdometryParams())}, indent=1)

"""Structured Streaming forms: messages of fixed rate and a sliding local map."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(rows: DataFrame, ts: str, width: str, keys: list[str] | None = None, late: str | None = None) -> DataFrame:
    """Counts and sums of value by windows on the absolute grid; works on tables and streams.
    ``late`` is the watermark of a stream; rows behind it are dropped."""
    rows = rows.withColumn("__ts", F.col(ts).cast("timestamp"))
    if late:
        rows = rows.withWatermark("__ts", late)
    g = rows.groupBy(F.window("__ts", width), *(keys or [])).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("window.start").alias("start"), *(keys or []), "n", "total")


def sessions(rows: DataFrame, ts: str, gap: str, keys: list[str], late: str | None = None) -> DataFrame:
    rows = rows.withColumn("__ts", F.col(ts).cast("timestamp"))
    if late:
        rows = rows.withWatermark("__ts", late)
    g = rows.groupBy(F.session_window("__ts", gap), *keys).agg(F.count("*").alias("n"))
    return g.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n")


STATE = "gone double, x double, y double, z double, cells array<bigint>, counts array<bigint>, ages array<double>"
OUTPUT = "key long, ts double, n_voxels long, gone double, rebuilt boolean"


def local_map(rows: DataFrame, key: str, reach: float, size: float) -> DataFrame:
    """A voxel map that follows each key: points (ts, x, y, z) are counted into voxels; once the
    path since the last rebuild exceeds ``reach``, voxels last seen in the older half of it go.

    State a key: the path, the last position and the voxels; one row out for each batch of a key.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        gone, x, y, z, cells, counts, ages = state.get if state.exists else (0.0, None, None, None, [], [], [])
        voxels = {c: [n, a] for c, n, a in zip(cells, counts, ages)}
        pdf = pd.concat(list(batches)).sort_values("ts", kind="stable")
        rebuilt = False
        for t, px, py, pz in pdf[["ts", "x", "y", "z"]].itertuples(index=False):
            if x is not None:
                gone += ((px - x) ** 2 + (py - y) ** 2 + (pz - z) ** 2) ** 0.5
            x, y, z = px, py, pz
            c = 0
            for v in (px, py, pz):
                c = c << 20 | (int(v // size) & 0xFFFFF)
            own = voxels.setdefault(c, [0, 0.0])
            own[0], own[1] = own[0] + 1, gone
            if gone > reach:
                voxels = {c: [n, a - gone] for c, (n, a) in voxels.items() if a >= gone / 2}
                gone, rebuilt = 0.0, True
        state.update((gone, x, y, z, list(voxels), [int(v[0]) for v in voxels.values()], [float(v[1]) for v in voxels.values()]))
        yield pd.DataFrame({"key": [k[0]], "ts": [float(pdf["ts"].iloc[-1])], "n_voxels": [len(voxels)], "gone": [float(gone)], "rebuilt": [rebuilt]})

    return rows.groupBy(key).applyInPandasWithState(run, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)

"""Writers: Parquet is the default store; these serve programs that read something else."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_las(points: DataFrame, folder: str, group: str | None = None) -> list[str]:
    """LAS files, one a partition (one a value of ``group`` if given); returns their paths.

    Files are written by the tasks under names of their own attempt; only those of finished tasks
    are returned, so a task run again leaves nothing that counts.
    """
    names = points.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs

        from pointloom.sources.points import las_bytes

        rows = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if len(b)]) else None
        if rows is None:
            return
        store, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        store.create_dir(base, recursive=True)
        parts = [(None, rows)]
        if group:
            keys = rows.column(group).combine_chunks()
            parts = [(k, rows.filter(pa.compute.equal(keys, k))) for k in keys.unique()]
        out = []
        for key, part in parts:
            col = lambda n: part.column(n).to_numpy() if n in names else None  # noqa: E731, B023
            path = f"{base}/{'points' if key is None else f'{group}-{key.as_py()}'}-{uuid.uuid4().hex[:12]}.las"
            with store.open_output_stream(path) as f:
                f.write(las_bytes(col("x"), col("y"), col("z"), col("intensity"), col("ts"), col("lidar_id"), col("scan_id")))
            out.append(path)
        yield pa.RecordBatch.from_pydict({"path": out})

    dealt = points.repartition(group) if group else points
    return [r["path"] for r in dealt.mapInArrow(run, "path string").collect()]  # a path a file


def write_tum(poses: DataFrame, path: str) -> None:
    """Lines of ts tx ty tz qx qy qz qw from ts_ns and pose, in time order."""
    from pointloom.functions.pose import to_quaternion

    m = F.col("pose")
    q = poses.withColumn("__q", to_quaternion("pose"))
    parts = [F.format_string("%.9f", F.col("ts_ns") / 1e9), *[F.format_string("%.9f", v) for v in (m[3], m[7], m[11], *[F.col(f"__q.{a}") for a in ("qx", "qy", "qz", "qw")])]]
    q.repartitionByRange("ts_ns").sortWithinPartitions("ts_ns").select(F.concat_ws(" ", *parts)).write.text(path)


def write_table(rows: DataFrame, path: str, sep: str = ",", header: bool = True) -> None:
    rows.write.csv(path, sep=sep, header=header)


def session_json(scans: DataFrame, edges: DataFrame | None = None, visible_only: bool = True) -> str:
    """A session document: files in scan order (visible ones only) and edges; a row a scan."""
    import json

    keep = scans.where("visible") if visible_only and "visible" in scans.columns else scans
    files = [{"file_name": r["file_name"]} for r in keep.orderBy("scan_id").select("file_name").collect()]
    links = [r.asDict() for r in edges.collect()] if edges is not None else []
    return json.dumps({"Session Settings": {}, "laz_file_names": files, "loop_closure_edges": links}, indent=1)


def result_chunks(batches: DataFrame, per_chunk: int = 51, least_tail: int = 10) -> DataFrame:
    """Adds chunk to batches (column batch): runs of ``per_chunk``; a last one of at most
    ``least_tail`` batches is left out."""
    out = batches.withColumn("chunk", F.floor(F.col("batch") / per_chunk))
    sizes = out.groupBy("chunk").agg(F.countDistinct("batch").alias("__n"))
    return out.join(sizes.where(F.col("__n") > least_tail), "chunk").drop("__n")


def rescaled_times(rows: DataFrame, column: str, factor: float) -> DataFrame:
    return rows.withColumn(column, F.col(column) * F.lit(factor))


def message_layout(points: DataFrame, layout: str, start: float = 0.0) -> DataFrame:
    """Columns of a point message: generic (all), velodyne (no laser_id), ouster (t: ns from the
    start), hesai (absolute timestamp)."""
    base = ["x", "y", "z", "intensity", "ring"]
    if layout == "generic":
        return points.select(*base, "laser_id", "timestamp")
    if layout == "velodyne":
        return points.select(*base, (F.col("timestamp") - start).cast("float").alias("time"))
    if layout == "ouster":
        return points.select(*base, F.round((F.col("timestamp") - start) * 1e9).cast("long").alias("t"))
    if layout == "hesai":
        return points.select(*base, "timestamp")
    raise ValueError(layout)


def colmap_images(images: DataFrame, path: str, camera_id: int = 1) -> None:
    """Lines ``id qw qx qy qz tx ty tz camera name`` (world to camera), each with an empty line of
    observations after it, from image_id, name and pose (camera in the world)."""
    from pointloom.functions.pose import inverse, to_quaternion

    rows = images.withColumn("__m", inverse("pose")).withColumn("__q", to_quaternion("__m"))
    m = F.col("__m")
    parts = [F.col("image_id"), *[F.col(f"__q.{q}") for q in ("qw", "qx", "qy", "qz")], m[3], m[7], m[11], F.lit(camera_id), F.col("name")]
    rows.select(F.concat(F.concat_ws(" ", *[p.cast("string") for p in parts]), F.lit("\n"))).write.text(path)


def colmap_points(points: DataFrame, path: str, every: int = 1) -> None:
    """Lines ``id x y z r g b error`` of every n-th point."""
    rows = points.where(F.pmod(F.col("id"), F.lit(every)) == 0)
    rows.select(F.concat_ws(" ", *[F.col(c).cast("string") for c in ("id", "x", "y", "z", "r", "g", "b")], F.lit("0"))).write.text(path)


def dxf_polyline(track: DataFrame, order: str = "ts_ns") -> str:
    """A DXF document with one 3D polyline through x, y, z in order; for a track that a driver holds."""
    head = ["0", "SECTION", "2", "ENTITIES", "0", "POLYLINE", "8", "track", "66", "1", "70", "8"]
    body: list[str] = []
    for r in track.orderBy(order).select("x", "y", "z").collect():
        body += ["0", "VERTEX", "8", "track", "10", f"{r['x']:.6f}", "20", f"{r['y']:.6f}", "30", f"{r['z']:.6f}", "70", "32"]
    return "\n".join([*head, *body, "0", "SEQEND", "0", "ENDSEC", "0", "EOF"]) + "\n"


def scale_board(rows: int, cols: int, step: float, spark) -> DataFrame:
    """(row, col, x, y, z) lattice of a board."""
    out = spark.range(rows).select(F.col("id").cast("int").alias("row")).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(cols - 1))))
    return out.select("row", "col", (F.col("col") * step).alias("x"), (F.col("row") * step).alias("y"), F.lit(0.0).alias("z"))


def ply_bytes(x, y, z, intensity=None) -> bytes:
    """A binary little-endian PLY of vertices."""
    import numpy as np

    names = ["x", "y", "z", *["intensity"] * (intensity is not None)]
    raw = np.zeros(len(x), np.dtype([(n, "<f8") for n in names]))
    for n, v in zip(names, (x, y, z, intensity)):
        raw[n] = v
    head = ["ply", "format binary_little_endian 1.0", f"element vertex {len(raw)}", *[f"property double {n}" for n in names], "end_header"]
    return ("\n".join(head) + "\n").encode() + raw.tobytes()


def pcd_bytes(x, y, z, intensity=None) -> bytes:
    """A binary PCD file of version 0.7."""
    import numpy as np

    names = ["x", "y", "z", *["intensity"] * (intensity is not None)]
    raw = np.zeros(len(x), np.dtype([(n, "<f8") for n in names]))
    for n, v in zip(names, (x, y, z, intensity)):
        raw[n] = v
    k = len(names)
    head = ["# .PCD v0.7", "VERSION 0.7", "FIELDS " + " ".join(names), "SIZE" + " 8" * k, "TYPE" + " F" * k, "COUNT" + " 1" * k, f"WIDTH {len(raw)}", "HEIGHT 1", "VIEWPOINT 0 0 0 1 0 0 0", f"POINTS {len(raw)}", "DATA binary"]
    return ("\n".join(head) + "\n").encode() + raw.tobytes()


def write_points(points: DataFrame, folder: str, kind: str) -> list[str]:
    """PLY or PCD files (x, y, z and, if there, intensity), one a partition, or text lines; returns the
    files' paths.  As with ``write_las``, only files of finished tasks count."""
    with_intensity = "intensity" in points.columns
    if kind == "txt":
        cols = [F.col(n).cast("string") for n in ("x", "y", "z", *["intensity"] * with_intensity)]
        points.select(F.concat_ws(" ", *cols)).write.text(folder)
        return [folder]
    encode = {"ply": ply_bytes, "pcd": pcd_bytes}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs

        held = [b for b in batches if len(b)]
        if not held:
            return
        rows = pa.Table.from_batches(held)
        store, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        store.create_dir(base, recursive=True)
        path = f"{base}/points-{uuid.uuid4().hex[:12]}.{kind}"
        with store.open_output_stream(path) as f:
            f.write(encode(*[c.to_numpy() for c in rows.columns]))
        yield pa.RecordBatch.from_pydict({"path": [path]})

    names = ["x", "y", "z", *["intensity"] * with_intensity]
    return [r["path"] for r in points.select(names).mapInArrow(run, "path string").collect()]  # a path a file


def write_trajectory(poses: DataFrame, path: str) -> None:
    """Lines of ts_ns and the row-major 3x4 pose, in time order, as ``text.trajectory`` reads them."""
    rows = poses.repartitionByRange("ts_ns").sortWithinPartitions("ts_ns")
    rows.select(F.concat_ws(" ", F.col("ts_ns").cast("string"), *[F.format_string("%.9f", F.col("pose")[i]) for i in range(12)])).write.text(path)


def pose_list_text(scans: DataFrame, name: str = "name", order: str = "scan_id") -> str:
    """A pose list: the count, then each scan's name and four rows of four numbers; a few lines a scan,
    put together on the driver."""
    rows = scans.orderBy(order).select(name, "pose").collect()
    lines = [str(len(rows))]
    for n, m in rows:
        lines += [n, *[" ".join(f"{v:.9f}" for v in m[4 * i : 4 * i + 4]) for i in range(4)]]
    return "\n".join(lines) + "\n"


def gnss_points(fixes: DataFrame, lat0: float, lon0: float, h0: float) -> DataFrame:
    """Fixes (ts, lat, lon, height) as points x, y, z of the local frame, ready for ``write_las``."""
    from pointloom.functions.geodesy import enu

    p = fixes.withColumn("__p", enu("lat", "lon", "height", lat0, lon0, h0))
    return p.select(F.col("__p.e").alias("x"), F.col("__p.n").alias("y"), F.col("__p.u").alias("z"), "ts")


def roi_lines(rois: DataFrame, path: str) -> None:
    """Regions (name, x, y, z, size) as lines of name, centre and edge length."""
    rois.select(F.concat_ws(" ", *[F.col(c).cast("string") for c in ("name", "x", "y", "z", "size")])).write.text(path)


def roi_constraints(spark, path: str) -> DataFrame:
    """(name, x, y, z, size) from such lines; others are skipped."""
    from pointloom.sources.text import lines

    parts = F.split(F.trim("line"), r"\s+")
    rows = lines(spark, path).where(F.size(parts) == 5).select(parts[0].alias("name"), *[parts[i].try_cast("double").alias(n) for i, n in enumerate(("x", "y", "z", "size"), 1)])
    return rows.dropna()


def kml_lines(fixes: DataFrame, order: str = "ts") -> DataFrame:
    """Fixes (lat, lon, alt and the order) as lines of a KML document: one row a line, in order of ``n``.
    The placemarks are made on the executors; head and tail are two rows."""
    mark = F.format_string("<Placemark><Point><coordinates>%.8f,%.8f,%.3f</coordinates></Point></Placemark>", F.col("lon").cast("double"), F.col("lat").cast("double"), F.col("alt").cast("double"))
    ends = fixes.sparkSession.createDataFrame([(0, '<?xml version="1.0" encoding="UTF-8"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document>'), (2, "</Document></kml>")], "part int, line string")
    rows = fixes.select(F.lit(1).alias("part"), F.col(order).alias("n"), mark.alias("line"))
    return ends.selectExpr("part", "null as n", "line").unionByName(rows)


def write_kml(fixes: DataFrame, path: str, order: str = "ts") -> None:
    kml_lines(fixes, order).repartitionByRange("part", "n").sortWithinPartitions("part", "n").select("line").write.text(path)

"""Spark data sources by name: ``spark.read.format("las").load(folder)`` after ``register(spark)``, and
``df.write.format("las").save(folder)``.

*Reading.*  One partition a file.  With the option ``pushdown`` (and
``spark.sql.python.filterPushdown.enabled``) conditions on x, y and z reach the reader: LAS files whose header bounds exclude them are not opened
further.  For very many files use ``catalogued``, whose bounds are a table.

*Writing.*  Tasks write files under names of their own attempt, a bounded number of points each.  Only when all
have ended does the driver write a list of the files that count, and readers of a folder with such lists
read nothing else: a task that was killed, or run twice, leaves nothing that is read.  A failed job's files
are deleted.

Files are read and written with pyarrow's file systems.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from pointloom.sources import points

#: Points of a file that is written.
MOST = 2_000_000
LISTED = "_files-"


class OneFile(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)


def store_of(path: str):
    """The file system of a path and the path on it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def files_in(path: str, glob: str) -> list[str]:
    """Files of a folder: those that its lists name, or, without lists, all whose names fit."""
    from fnmatch import fnmatch

    from pyarrow import fs

    store, base = store_of(path)
    info = store.get_file_info(base)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(base, recursive=True))
    prefix = path[: path.index("://") + 3] if "://" in path else ""
    names = [f.path for f in found if f.type == fs.FileType.File]
    lists = [n for n in names if n.rsplit("/", 1)[-1].startswith(LISTED)]
    if lists:
        listed = set()
        for n in lists:
            with store.open_input_stream(n) as f:
                listed |= set(f.read().decode().split("\n"))
        names = [n for n in names if n.rsplit("/", 1)[-1] in listed]
    return [prefix + n for n in sorted(names) if fnmatch(n.rsplit("/", 1)[-1], glob)]


class PointsReader(DataSourceReader):
    def __init__(self, kind: str, path: str, glob: str):
        self.kind, self.path, self.glob = kind, path, glob

    def partitions(self) -> list[OneFile]:
        return [OneFile(f) for f in files_in(self.path, self.glob)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no file is left
            return
        uri = partition.value
        store, base = store_of(uri)
        with store.open_input_stream(base) as f:
            yield from points.batches_of(uri, f.read(), self.kind)


class PrunedReader(PointsReader):
    """Leaves out LAS files whose header bounds exclude a query's conditions."""

    def __init__(self, path: str, glob: str):
        super().__init__("las", path, glob)
        self.low, self.high = {}, {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            name = getattr(f, "attribute", ("",))[0]
            if name in ("x", "y", "z"):
                if isinstance(f, GreaterThan | GreaterThanOrEqual | EqualTo):
                    self.low[name] = max(self.low.get(name, f.value), f.value)
                if isinstance(f, LessThan | LessThanOrEqual | EqualTo):
                    self.high[name] = min(self.high.get(name, f.value), f.value)
            yield f  # Spark tests every row again

    def may_hold(self, path: str) -> bool:
        store, base = store_of(path)
        with store.open_input_stream(base) as f:
            bounds = points.las_bounds(f.read(227))
        return bounds is None or all(bounds[f"max_{a}"] >= v for a, v in self.low.items()) and all(bounds[f"min_{a}"] <= v for a, v in self.high.items())

    def partitions(self) -> list[OneFile]:
        return [p for p in super().partitions() if not (self.low or self.high) or self.may_hold(p.value)]


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class PointsWriter(DataSourceArrowWriter):
    def __init__(self, kind: str, path: str, most: int):
        self.kind, self.path, self.most = kind, path, most

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pointloom.sources import sinks

        store, base = store_of(self.path)
        store.create_dir(base, recursive=True)
        attempt, out, held = uuid.uuid4().hex[:12], [], []

        def flush() -> None:
            rows = pa.Table.from_batches(held)
            col = lambda n: rows.column(n).to_numpy() if n in rows.column_names else None
            if self.kind == "las":
                data = points.las_bytes(col("x"), col("y"), col("z"), col("intensity"), col("ts"), col("user_data"), col("scan_id"))
            else:
                data = {"ply": sinks.ply_bytes, "pcd": sinks.pcd_bytes}[self.kind](*[col(c) for c in ("x", "y", "z", "intensity") if c in rows.column_names])
            name = f"points-{attempt}-{len(out)}.{self.kind}"
            with store.open_output_stream(f"{base}/{name}") as f:
                f.write(data)
            out.append(name)
            held.clear()

        for batch in iterator:
            for a in range(0, len(batch), self.most):
                part = batch.slice(a, self.most)
                if held and sum(map(len, held)) + len(part) > self.most:
                    flush()
                held.append(part)
        if held:
            flush()
        return Written(out)

    def commit(self, messages: list[Written | None]) -> None:
        store, base = store_of(self.path)
        store.create_dir(base, recursive=True)
        with store.open_output_stream(f"{base}/{LISTED}{uuid.uuid4().hex}") as f:
            f.write("\n".join(n for m in messages if m for n in m.files).encode())

    def abort(self, messages: list[Written | None]) -> None:
        store, base = store_of(self.path)
        for m in messages:
            for n in m.files if m else []:
                store.delete_file(f"{base}/{n}")


def _source(kind: str, glob: str) -> type[DataSource]:
    class Points(DataSource):
        @classmethod
        def name(cls) -> str:
            return kind

        def schema(self) -> str:
            return points.SCHEMA

        def reader(self, schema) -> PointsReader:
            path, names = self.options["path"], self.options.get("pathGlobFilter", glob)
            return PrunedReader(path, names) if kind == "las" and self.options.get("pushdown", "false") == "true" else PointsReader(kind, path, names)

        def writer(self, schema, overwrite: bool) -> PointsWriter:
            if overwrite:
                raise ValueError("append only: choose a new folder")
            return PointsWriter(kind, self.options["path"], int(self.options.get("most", MOST)))

    return Points


def register(spark: SparkSession) -> None:
    """Make las, ply and pcd known to ``spark.read.format``, and the cell functions to SQL."""
    for kind in ("las", "ply", "pcd"):
        spark.dataSource.register(_source(kind, f"*.{kind}"))
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION voxel_cell(x DOUBLE, size DOUBLE) RETURNS INT RETURN CAST(floor(x / size) AS INT)")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION neighbour_cells(ix INT, iy INT, iz INT) RETURNS TABLE (jx INT, jy INT, jz INT) "
        "RETURN SELECT ix + a.d, iy + b.d, iz + c.d FROM VALUES (-1), (0), (1) AS a(d), VALUES (-1), (0), (1) AS b(d), VALUES (-1), (0), (1) AS c(d)"
    )

"""MCAP containers of point and inertial messages, written and read record by record.

The container format is public (magic, then records of an opcode, a length and a body); messages
are ROS 2 ``sensor_msgs`` in little-endian CDR.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np

MAGIC = b"\x89MCAP0\r\n"
#: Opcodes (fixed values).
HEADER, FOOTER, SCHEMA, CHANNEL, MESSAGE, DATA_END = 1, 2, 3, 4, 5, 15
#: Fields of a point by layout: name, numpy type, code of the message's field type (fixed values).
LAYOUTS = {
    "generic": [("x", "<f4", 7), ("y", "<f4", 7), ("z", "<f4", 7), ("intensity", "<f4", 7), ("ring", "<u2", 4), ("laser_id", "u1", 2), ("pad", "u1", 2), ("timestamp", "<f8", 8)],
    "velodyne": [("x", "<f4", 7), ("y", "<f4", 7), ("z", "<f4", 7), ("intensity", "<f4", 7), ("ring", "<u2", 4), ("time", "<f4", 7)],
    "ouster": [("x", "<f4", 7), ("y", "<f4", 7), ("z", "<f4", 7), ("intensity", "<f4", 7), ("ring", "<u2", 4), ("t", "<u4", 6)],
    "hesai": [("x", "<f4", 7), ("y", "<f4", 7), ("z", "<f4", 7), ("intensity", "<f4", 7), ("ring", "<u2", 4), ("timestamp", "<f8", 8)],
}


def _text(s: str) -> bytes:
    b = s.encode()
    return struct.pack("<I", len(b)) + b


class Cdr:
    """Little-endian CDR with its alignment."""

    def __init__(self) -> None:
        self.out = bytearray(b"\x00\x01\x00\x00")

    def put(self, fmt: str, *values) -> None:
        size = struct.calcsize("<" + fmt[-1])
        self.out += b"\0" * (-(len(self.out) - 4) % size)
        self.out += struct.pack("<" + fmt, *values)

    def text(self, s: str) -> None:
        b = s.encode() + b"\0"
        self.put("I", len(b))
        self.out += b


def cloud_message(points: np.ndarray, layout: str, ns: int, frame: str = "lidar") -> bytes:
    """PointCloud2 of a structured array with the layout's fields."""
    dtype = np.dtype([(n, t) for n, t, _ in LAYOUTS[layout]])
    raw = np.zeros(len(points), dtype)
    for n in dtype.names:
        if n != "pad":
            raw[n] = points[n]
    c = Cdr()
    c.put("i", ns // 10**9)
    c.put("I", ns % 10**9)
    c.text(frame)
    c.put("I", 1)
    c.put("I", len(raw))
    fields = [(n, code) for n, _, code in LAYOUTS[layout] if n != "pad"]
    c.put("I", len(fields))
    for n, code in fields:
        c.text(n)
        c.put("I", dtype.fields[n][1])
        c.put("B", code)
        c.put("I", 1)
    c.put("B", 0)
    c.put("I", dtype.itemsize)
    c.put("I", dtype.itemsize * len(raw))
    data = raw.tobytes()
    c.put("I", len(data))
    c.out += data
    c.put("B", 1)
    return bytes(c.out)


def imu_message(ns: int, gyro: tuple, acc: tuple, frame: str = "imu") -> bytes:
    c = Cdr()
    c.put("i", ns // 10**9)
    c.put("I", ns % 10**9)
    c.text(frame)
    for v in (0.0, 0.0, 0.0, 1.0, -1.0, *[0.0] * 8, *gyro, *[0.0] * 9, *acc, *[0.0] * 9):
        c.put("d", float(v))
    return bytes(c.out)


class Writer:
    """A container of one file object."""

    def __init__(self, f) -> None:
        self.f, self.channels, self.sequence = f, {}, 0
        f.write(MAGIC)
        self.record(HEADER, _text("ros2") + _text("pointloom"))

    def record(self, op: int, body: bytes) -> None:
        self.f.write(bytes([op]) + struct.pack("<Q", len(body)) + body)

    def channel(self, topic: str, schema: str) -> int:
        if topic not in self.channels:
            n = len(self.channels) + 1
            self.record(SCHEMA, struct.pack("<H", n) + _text(schema) + _text("ros2msg") + struct.pack("<I", 0))
            self.record(CHANNEL, struct.pack("<HH", n, n) + _text(topic) + _text("cdr") + struct.pack("<I", 0))
            self.channels[topic] = n
        return self.channels[topic]

    def message(self, topic: str, schema: str, ns: int, data: bytes) -> None:
        n = self.channel(topic, schema)
        self.record(MESSAGE, struct.pack("<HIQQ", n, self.sequence, ns, ns) + data)
        self.sequence += 1

    def close(self) -> None:
        self.record(DATA_END, struct.pack("<I", 0))
        self.record(FOOTER, struct.pack("<QQI", 0, 0, 0))
        self.f.write(MAGIC)


def messages(data: bytes) -> Iterator[tuple[str, int, bytes]]:
    """(topic, ns, body) of a container without chunks."""
    if data[:8] != MAGIC:
        raise ValueError("not an MCAP file")
    at, topics = 8, {}
    while at < len(data) - 8:
        op, n = data[at], struct.unpack_from("<Q", data, at + 1)[0]
        body = data[at + 9 : at + 9 + n]
        at += 9 + n
        if op == CHANNEL:
            size = struct.unpack_from("<I", body, 4)[0]
            topics[struct.unpack_from("<H", body)[0]] = body[8 : 8 + size].decode()
        elif op == MESSAGE:
            channel, _, ns, _ = struct.unpack_from("<HIQQ", body)
            yield topics[channel], ns, body[22:]
        elif op == FOOTER:
            return


def cloud_points(body: bytes, layout: str) -> np.ndarray:
    """Points of a PointCloud2 body written here."""
    dtype = np.dtype([(n, t) for n, t, _ in LAYOUTS[layout]])
    n = 4
    n += 8
    frame = struct.unpack_from("<I", body, n)[0]
    n += 4 + frame
    n += -(n - 4) % 4
    width, fields = struct.unpack_from("<I", body, n + 4)[0], struct.unpack_from("<I", body, n + 8)[0]
    n += 12
    for _ in range(fields):
        n += -(n - 4) % 4
        n += 4 + struct.unpack_from("<I", body, n)[0]
        n += -(n - 4) % 4
        n += 4 + 1
        n += -(n - 4) % 4
        n += 4
    n += 1
    n += -(n - 4) % 4
    n += 12
    return np.frombuffer(body, dtype, width, n)


def write_mcap(points, folder: str, hz: float, layout: str = "generic", topic: str = "/points") -> list[str]:
    """Containers of a table (ts, x, y, z, ...): points go into bins of 1 / hz seconds on the absolute
    grid, a message each; a file for each range of time.  Returns the files' paths."""
    from pyspark.sql import functions as F

    names = [n for n, _, _ in LAYOUTS[layout] if n != "pad"]
    rows = points.withColumn("__bin", F.floor(F.col("ts") * hz)).repartitionByRange("__bin").sortWithinPartitions("__bin", "ts")

    def run(batches):
        import itertools
        import uuid

        import pyarrow as pa
        from pyarrow import fs

        it = (b for b in batches if b.num_rows)
        head = next(it, None)
        if head is None:
            return
        store, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        store.create_dir(base, recursive=True)
        path = f"{base}/points-{uuid.uuid4().hex[:12]}.mcap"
        with store.open_output_stream(path) as f:
            out, held, at = Writer(f), [], None

            def flush():
                raw = {n: np.concatenate([h[n] for h in held]) for n in names}
                own = np.zeros(len(raw["x"]), [(n, raw[n].dtype) for n in names])
                for n in names:
                    own[n] = raw[n]
                ns = int(at / hz * 1e9)
                out.message(topic, "sensor_msgs/msg/PointCloud2", ns, cloud_message(own, layout, ns))

            for b in itertools.chain([head], it):
                bins = np.asarray(b.column(b.schema.get_field_index("__bin")))
                cols = {n: b.column(b.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in names}
                edges = [0, *(np.flatnonzero(np.diff(bins)) + 1).tolist(), len(bins)]
                for x, y in zip(edges[:-1], edges[1:]):
                    if held and bins[x] != at:
                        flush()
                        held = []
                    at = int(bins[x])
                    held.append({n: c[x:y] for n, c in cols.items()})
            flush()
            out.close()
        yield pa.RecordBatch.from_pydict({"path": [path]})

    return [r["path"] for r in rows.mapInArrow(run, "path string").collect()]  # a path a file

"""Recorded robot logs: an ``mcap`` data source, and decoders of the messages that matter here.

The source gives one row per message and one partition per chunk of the file, of the topics asked for
only. Channels are learnt from the whole file, as a chunk may use those of earlier ones; a message of an
unknown channel is an error. Paths must be readable by every executor.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

MAGIC = b"\x89MCAP0\r\n"
SCHEMA = "topic string, log_time_ns bigint, seq bigint, data binary"
POINTS, JOINT_STATE, ANGLE, IMU = "/velodyne_points", "/rotating_platform/joint_state", "/rotating_platform/angle", "/imu"
_FOOTER, _CHANNEL, _MESSAGE, _CHUNK, _STATISTICS, _DATA_END = 0x02, 0x04, 0x05, 0x06, 0x0B, 0x0F


def resolve(path: str) -> list[str]:
    """The log files a path names: itself, or those of a folder by name; compressed ones if there are no others."""
    p = Path(path.removeprefix("file://"))
    if p.is_file():
        if p.suffix == ".mcap" or p.name.endswith(".mcap.zstd"):
            return [str(p)]
        raise FileNotFoundError(f"{path} is not an MCAP file")
    found = sorted(map(str, p.glob("*.mcap"))) or sorted(map(str, p.glob("*.mcap.zstd")))
    if not found:
        raise FileNotFoundError(f"no MCAP file in {path}")
    return found


def _text(b: bytes, at: int) -> tuple[str, int]:
    n = struct.unpack_from("<I", b, at)[0]
    return b[at + 4 : at + 4 + n].decode(), at + 4 + n


def _channel(b: bytes) -> tuple[int, str]:
    return struct.unpack_from("<H", b)[0], _text(b, 4)[0]


def records(data: bytes) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at + 9 <= len(data):
        op, n = data[at], struct.unpack_from("<Q", data, at + 1)[0]
        yield op, data[at + 9 : at + 9 + n]
        at += 9 + n


def chunk_records(body: bytes) -> bytes:
    """The records inside a chunk."""
    size = struct.unpack_from("<Q", body, 16)[0]
    kind, at = _text(body, 28)
    n = struct.unpack_from("<Q", body, at)[0]
    packed = body[at + 8 : at + 8 + n]
    if kind == "":
        return packed
    if kind == "zstd":
        return zstandard.ZstdDecompressor().decompress(packed, max_output_size=size)
    if kind == "lz4":
        return pa.CompressedInputStream(pa.BufferReader(packed), "lz4").read()
    raise ValueError(f"unknown chunk compression {kind}")


class _Chunk(InputPartition):
    def __init__(self, path: str, offset: int, length: int, channels: dict[int, str]):
        self.path, self.offset, self.length, self.channels = path, offset, length, channels


class McapReader(DataSourceReader):
    def __init__(self, options):
        self.files = resolve(options["path"])
        self.topics = {t for t in options.get("topics", "").split(",") if t}

    def partitions(self):
        out = []
        for path in self.files:
            if path.endswith(".zstd"):
                out.append(_Chunk(path, 0, -1, {}))
                continue
            channels: dict[int, str] = {}
            chunks: list[_Chunk] = []
            with open(path, "rb") as f:
                if f.read(8) != MAGIC:
                    raise ValueError(f"{path} is not an MCAP file")
                loose, ended, repeated, stated = None, False, False, 0
                while len(head := f.read(9)) == 9:  # record heads only; bodies are skipped
                    op, n = head[0], struct.unpack("<Q", head[1:])[0]
                    at = f.tell()
                    if op == _CHANNEL:
                        k, topic = _channel(f.read(n))
                        channels[k] = topic
                        repeated |= ended
                    elif op == _CHUNK:
                        chunks.append(_Chunk(path, at, n, channels))
                    elif op == _MESSAGE:
                        loose = loose or _Chunk(path, 8, -1, channels)
                    elif op == _STATISTICS:
                        stated = struct.unpack_from("<I", f.read(n), 10)[0]
                    elif op == _DATA_END:  # the summary follows, which repeats the channels of all chunks
                        ended = True
                    elif op == _FOOTER:
                        break
                    f.seek(at + n)
                if len(chunks) + bool(loose) > 1 and (not repeated or len(channels) < stated):
                    # A chunk may use channels of earlier ones, and without a summary only those tell.
                    for c in chunks:
                        f.seek(c.offset)
                        channels.update(_channel(b) for op, b in records(chunk_records(f.read(c.length))) if op == _CHANNEL)
            out += chunks + ([loose] if loose else [])
        return out or [_Chunk("", 0, 0, {})]

    def pushFilters(self, filters):
        """Takes over equality and membership of the topic, so that other messages aren't even copied."""
        for f in filters:
            if isinstance(f, EqualTo) and tuple(f.attribute) == ("topic",) and isinstance(f.value, str):
                wanted = {f.value}
            elif isinstance(f, In) and tuple(f.attribute) == ("topic",) and all(isinstance(v, str) for v in f.value):
                wanted = set(f.value)
            else:
                yield f
                continue
            # No topic at all is left where filters exclude each other.
            self.topics = (self.topics & wanted if self.topics else wanted) or {""}

    def read(self, part):
        if not part.path:
            return
        if part.path.endswith(".zstd"):
            with open(part.path, "rb") as f:
                data = zstandard.ZstdDecompressor().stream_reader(f).read()
            streams = [chunk_records(b) if op == _CHUNK else struct.pack("<BQ", op, len(b)) + b for op, b in records(data[8:]) if op in (_CHUNK, _MESSAGE, _CHANNEL)]
        else:
            with open(part.path, "rb") as f:
                f.seek(part.offset)
                data = f.read(part.length) if part.length >= 0 else f.read()
            streams = [chunk_records(data)] if part.length >= 0 else [data]
        channels, rows = dict(part.channels), []
        for stream in streams:
            for op, body in records(stream):
                if op == _CHANNEL:
                    k, topic = _channel(body)
                    channels[k] = topic
                elif op == _MESSAGE:
                    k, seq, log = struct.unpack_from("<HIQ", body)
                    if k not in channels:
                        raise ValueError(f"{part.path}: message of unknown channel {k}")
                    if not self.topics or channels[k] in self.topics:
                        rows.append((channels[k], log, seq, body[22:]))
                    if len(rows) == 1000:
                        yield self._batch(rows)
                        rows = []
                elif op == _DATA_END:
                    break
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows):
        topic, log, seq, data = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(topic, pa.string()), pa.array(log, pa.int64()), pa.array(seq, pa.int64()), pa.array(data, pa.binary())], ["topic", "log_time_ns", "seq", "data"])


class McapSource(DataSource):
    """``spark.read.format("mcap").option("topics", "/a,/b").load(path)``"""

    @classmethod
    def name(cls):
        return "mcap"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return McapReader(self.options)


def register(spark: SparkSession) -> None:
    """Make ``mcap`` known to the session, and let Spark hand filters to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(McapSource)


class Cdr:
    """Reads one little-endian CDR message; alignment counts from after the four head bytes."""

    def __init__(self, data: bytes):
        if data[1] & 1 == 0:
            raise ValueError("big-endian messages are not supported")
        self.data, self.at = data, 4

    def get(self, kind: str):
        size = struct.calcsize(kind)
        self.at += -(self.at - 4) % size
        out = struct.unpack_from("<" + kind, self.data, self.at)[0]
        self.at += size
        return out

    def text(self) -> str:
        n = self.get("I")
        out = self.data[self.at : self.at + n - 1].decode()
        self.at += n
        return out

    def doubles(self, n: int) -> list[float]:
        if not n:
            return []
        self.at += -(self.at - 4) % 8
        out = struct.unpack_from(f"<{n}d", self.data, self.at)
        self.at += 8 * n
        return list(out)

    def stamp(self) -> int:
        """The header's time in ns; the frame name is skipped."""
        sec, nano = self.get("i"), self.get("I")
        self.text()
        return sec * 1_000_000_000 + nano


def joint_state(data: bytes) -> tuple[int, list[float]]:
    c = Cdr(data)
    stamp = c.stamp()
    for _ in range(c.get("I")):
        c.text()
    return stamp, c.doubles(c.get("I"))


def imu_acceleration(data: bytes) -> tuple[float, float, float]:
    c = Cdr(data)
    c.stamp()
    c.doubles(4 + 9 + 3 + 9)  # orientation, angular velocity and their covariances
    return tuple(c.doubles(3))  # type: ignore[return-value]


_TYPES = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 8: "f8"}


def point_cloud(data: bytes) -> tuple[int, np.ndarray, np.ndarray | None]:
    """Stamp, coordinates and, if the cloud has it, each point's time offset in seconds."""
    c = Cdr(data)
    stamp = c.stamp()
    height, width = c.get("I"), c.get("I")
    fields = {}
    for _ in range(c.get("I")):
        name, offset, kind, count = c.text(), c.get("I"), c.get("B"), c.get("I")
        fields[name] = (offset, _TYPES.get(kind, "u1"), count)
    order = ">" if c.get("?") else "<"
    step, _ = c.get("I"), c.get("I")
    size = c.get("I")
    names = [n for n in ("x", "y", "z", "time") if n in fields]
    dtype = np.dtype({"names": names, "formats": [order + fields[n][1] for n in names], "offsets": [fields[n][0] for n in names], "itemsize": step})
    rows = np.frombuffer(c.data, dtype, min(height * width, size // step), c.at)
    return stamp, np.stack([rows[n] for n in "xyz"], 1), rows["time"] if "time" in names else None


def _decode_points(batches):
    for batch in batches:
        for frame, data in zip(batch.column("frame_id").to_pylist(), batch.column("data").to_pylist(), strict=True):
            stamp, p, time = point_cloud(data)
            n = len(p)
            times = pa.nulls(n, pa.float64()) if time is None else pa.array(time.astype(float))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, frame)), pa.array(np.arange(n), pa.int32()), pa.array(np.full(n, stamp)), *(pa.array(p[:, i].astype(np.float32)) for i in range(3)), times], ["frame_id", "pt_idx", "stamp_ns", "x", "y", "z", "time"]
            )


def _decoder(decode, kinds):
    names = [k.split()[0] for k in kinds.split(", ")]

    def run(batches):
        for batch in batches:
            rows = [(t, *decode(d)) for t, d in zip(batch.column("log_time_ns").to_pylist(), batch.column("data").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in rows]) for i, n in enumerate(names)})

    return run


def read_bag(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """``points``, ``joint_state``, ``platform_angle`` and ``imu`` of a log, one scan per kind asked for.

    Of a folder the first log by name is read; the ``mcap`` source itself reads all that a path names.
    Frames are numbered by log time; nothing is read until a result is used.
    """
    register(spark)
    path = resolve(path)[0]
    of = lambda topic: spark.read.format("mcap").option("topics", topic).load(path)
    # A frame's number is its log time, so that no global numbering is needed.
    clouds = of(POINTS).select(F.col("log_time_ns").alias("frame_id"), "data")
    js, an, im = "log_time_ns bigint, stamp_ns bigint, position array<double>", "log_time_ns bigint, deg double", "log_time_ns bigint, ax double, ay double, az double"
    return {
        "points": clouds.mapInArrow(_decode_points, "frame_id bigint, pt_idx int, stamp_ns bigint, x float, y float, z float, time double"),
        "joint_state": of(JOINT_STATE).mapInArrow(_decoder(joint_state, js), js),
        "platform_angle": of(ANGLE).mapInArrow(_decoder(lambda d: (Cdr(d).get("d"),), an), an),
        "imu": of(IMU).mapInArrow(_decoder(imu_acceleration, im), im),
    }

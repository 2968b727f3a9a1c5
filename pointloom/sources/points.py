"""Reading and writing point-cloud files with Spark's own file systems.

Files that executors can open are read in ranges by many tasks (``ranges``) and written by many tasks at the
points' places (``in_place``). Elsewhere, and in formats without either, a file is a row of Spark's binary source,
and one output file a stream that the driver passes on in order, one partition at a time.
"""

from __future__ import annotations

import posixpath
import uuid
import warnings
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.functions.geometry import doubles, xyz
from pointloom.operators.outliers import bounds, sample_points
from pointloom.sources.codecs import DECODERS, ENCODERS, E57Stream, encode_frames, encode_npz, encode_obj, encode_stl, npz_frames, read_npz
from pointloom.sources.in_place import mounted, write_in_place
from pointloom.sources.ranges import read_ranges

SCHEMA = "cloud string, pt_idx bigint, x double, y double, z double"
_BATCH = 1 << 16
#: NPZ needs the whole cloud at once; larger clouds go to the other formats.
WHOLE_POINTS = 20_000_000
DXF_POINTS = 200_000


def _suffix(path: str) -> str:
    return posixpath.splitext(path)[1].lower().lstrip(".")


def _decode(batches):
    for batch in batches:
        for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            suffix = _suffix(path)
            if suffix not in DECODERS:
                raise ValueError(f"unsupported point file {path}: known are {', '.join(sorted(DECODERS))}")
            p = DECODERS[suffix](data)
            stem = posixpath.splitext(posixpath.basename(path))[0]
            for a in range(0, len(p), _BATCH):
                q = p[a : a + _BATCH].astype(float)
                yield pa.RecordBatch.from_arrays([pa.array([stem] * len(q)), pa.array(np.arange(a, a + len(q))), *(pa.array(q[:, i]) for i in range(3))], ["cloud", "pt_idx", "x", "y", "z"])


def read_points(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Points of one or more files or globs, ``cloud`` being the file's stem; the suffix names the format."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    for p in paths:
        if (s := _suffix(p)) and s not in DECODERS:
            raise ValueError(f"unsupported point file {p}: known are {', '.join(sorted(DECODERS))}")
    points, others = read_ranges(spark, find_files(spark, paths), SCHEMA)
    if not others:
        return points
    files = spark.read.format("binaryFile").load(others).select("path", "content")
    return points.union(files.mapInArrow(_decode, SCHEMA))


def find_files(spark: SparkSession, paths: Sequence[str] = (), suffix: str = "e57", default: str = ".") -> list[str]:
    """The files that paths name, sorted by path: files and globs as given, a single folder's files of the
    suffix, and without paths those of the folder ``default``. Files are found on any file system of Spark's.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    paths, out = [paths] if isinstance(paths, str) else list(paths) or [default], []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        fs = path.getFileSystem(conf)
        if len(paths) == 1 and fs.exists(path) and fs.getFileStatus(path).isDirectory():
            path = jvm.org.apache.hadoop.fs.Path(f"{p.rstrip('/')}/*.{suffix}")
        found = [str(f.getPath()) for f in fs.globStatus(path) or ()]
        if not found:
            raise FileNotFoundError(f"nothing at {path}")
        out += found
    return sorted(out)


def load_clouds(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Points of several files, ``cloud`` being the stem; files without points are left out with a warning."""
    points = read_points(spark, paths)
    files = find_files(spark, paths)
    full = {r["cloud"] for r in points.select("cloud").distinct().collect()}  # a row per file
    stems = {f: posixpath.splitext(posixpath.basename(f))[0] for f in files}
    for f in (f for f, stem in stems.items() if stem not in full):
        warnings.warn(f"no points in {f}; it is left out", stacklevel=2)
    if not full:
        raise ValueError("no points in any file")
    return points


def read_frames(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A frame archive's points (cloud, frame_id, pt_idx, stamp_ns, x, y, z) and its encoder (cloud, t_ns, angle).

    Frames are numbered in their order; nothing is filtered. The members of one archive are read by one task.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def points(batches):
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                stem, stamps = posixpath.splitext(posixpath.basename(name))[0], read_npz(data).get("timestamps")
                for i, f in enumerate(npz_frames(data)):
                    n = len(f)
                    stamp = pa.nulls(n, pa.int64()) if stamps is None else pa.array(np.full(n, int(stamps[i])))
                    yield pa.RecordBatch.from_arrays([pa.array([stem] * n, pa.string()), pa.array(np.full(n, i)), pa.array(np.arange(n)), stamp, *(pa.array(f[:, c].astype(np.float32)) for c in range(3))], ["cloud", "frame_id", "pt_idx", "stamp_ns", "x", "y", "z"])

    def encoder(batches):
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                stem, members = posixpath.splitext(posixpath.basename(name))[0], read_npz(data)
                t, v = (np.asarray(members.get(m, []), float) for m in ("angle_times", "angle_values"))
                yield pa.RecordBatch.from_arrays([pa.array([stem] * len(t), pa.string()), pa.array(t.astype(np.int64)), pa.array(v)], ["cloud", "t_ns", "angle"])

    return files.mapInArrow(points, "cloud string, frame_id bigint, pt_idx bigint, stamp_ns bigint, x float, y float, z float"), files.mapInArrow(encoder, "cloud string, t_ns bigint, angle double")


def write_frames(points: DataFrame, encoder: DataFrame, path: str) -> str:
    """A frame archive of points (frame_id, pt_idx, stamp_ns, x, y, z) and the unwrapped encoder (t_ns, angle).

    Members are ``points``, one array of floats per frame, ``timestamps``, ``angle_times`` and
    ``angle_values``. The archive is written whole, so there are ``WHOLE_POINTS`` points at most.
    """
    path = with_suffix(path, "npz")
    if points.limit(WHOLE_POINTS + 1).count() > WHOLE_POINTS:
        raise ValueError(f"an archive is written whole and takes {WHOLE_POINTS} points at most")
    t = points.select("stamp_ns", "frame_id", "pt_idx", *(F.col(c).cast("float") for c in "xyz")).orderBy("stamp_ns", "frame_id", "pt_idx").toArrow()
    e = encoder.select(F.col("t_ns").cast("double"), F.col("angle").cast("double")).orderBy("t_ns").toArrow()
    frame, stamp = t.column("frame_id").to_numpy(), t.column("stamp_ns").to_numpy()
    first = np.flatnonzero(np.concatenate(([True], frame[1:] != frame[:-1]))) if len(frame) else np.zeros(0, np.int64)
    p = np.stack([t.column(c).to_numpy() for c in "xyz"], 1) if len(frame) else np.zeros((0, 3))
    data = encode_frames(np.split(p, first[1:]) if len(first) else [], stamp[first], e.column("t_ns").to_numpy(), e.column("angle").to_numpy())
    write_bytes(points.sparkSession, path, data)
    return path


def with_suffix(path: str, suffix: str) -> str:
    """The path with the suffix, unless it has it."""
    return path if path.lower().endswith(f".{suffix}") else f"{path}.{suffix}"


class _Output:
    """A file on any file system Spark knows; moved into place when complete."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark.sparkContext._jvm
        self.path = jvm.org.apache.hadoop.fs.Path(path)
        self.part = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.part")
        self.fs = self.path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.fs.setWriteChecksum(False)
        self.out = self.fs.create(self.part, True)

    def write(self, data: bytes) -> None:
        if data:
            self.out.write(bytearray(data))

    def close(self) -> None:
        self.out.close()
        self.fs.delete(self.path, False)
        if not self.fs.rename(self.part, self.path):
            raise OSError(f"can't move {self.part} to {self.path}")


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    out = _Output(spark, path)
    out.write(data)
    out.close()


def _collected(points: DataFrame) -> np.ndarray:
    if points.limit(WHOLE_POINTS + 1).count() > WHOLE_POINTS:
        raise ValueError(f"this format is written whole and takes {WHOLE_POINTS} points at most")
    t = points.toArrow()
    return np.stack([t.column(c).to_numpy() for c in "xyz"], 1).astype(float)


def write_points(points: DataFrame, path: str, fmt: str | None = None, order: Sequence[str] = (), seed: int = 0) -> str:
    """Write x, y, z to one file; returns its path. ``order`` fixes the rows' order.

    DXF takes a seeded sample of at most ``DXF_POINTS``. An existing file is replaced when the new one is
    complete, so a cloud may be written over the file it is read from.
    """
    spark, fmt = points.sparkSession, fmt or _suffix(path)
    path = with_suffix(path, fmt)
    if order:
        points = points.orderBy(*order)
    p = points.select(*(c.alias(n) for c, n in zip(doubles(xyz()), "xyz", strict=True)))
    if fmt == "npz":
        write_bytes(spark, path, encode_npz(_collected(p)))
        return path
    if fmt not in ENCODERS and fmt != "e57":
        raise ValueError(f"unsupported format {fmt}: known are {', '.join(sorted([*ENCODERS, 'e57', 'npz']))}")
    if fmt == "dxf":
        p = sample_points(p, DXF_POINTS, seed) if p.limit(DXF_POINTS + 1).count() > DXF_POINTS else p
    p = p.persist()
    narrow = p.select(*(F.col(c).cast("float").cast("double").alias(c) for c in "xyz")) if fmt == "las" else p
    s = bounds(narrow).first().asDict()
    place = mounted(spark, path)
    if place and fmt != "dxf":
        write_in_place(p, place, fmt, s)
        p.unpersist()
        return path
    # Packets of an E57 file run through, so that its pieces are put together on the driver, one at a time.
    stream = E57Stream(s["n"]) if fmt == "e57" else None
    body = (lambda q, _: np.ascontiguousarray(q, float).tobytes()) if stream else ENCODERS[fmt].body

    def run(batches):
        for batch in batches:
            q = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in "xyz"], 1)
            yield pa.RecordBatch.from_arrays([pa.array([body(q, s)], pa.binary())], ["data"])

    out = _Output(spark, path)
    out.write(stream.head() if stream else ENCODERS[fmt].head(s["n"], s))
    for row in p.mapInArrow(run, "data binary").toLocalIterator(prefetchPartitions=True):
        out.write(stream.body(np.frombuffer(bytes(row["data"])).reshape(-1, 3)) if stream else row["data"])
    out.write(stream.tail() if stream else ENCODERS[fmt].tail)
    out.close()
    p.unpersist()
    return path


def export_points(points: DataFrame, stem: str, fmt: str = "all", order: Sequence[str] = ()) -> list[str]:
    """One format, or xyz, pts, e57 and las in this order."""
    return [write_points(points, f"{stem}.{f}", f, order) for f in (("xyz", "pts", "e57", "las") if fmt == "all" else (fmt,))]


def export_map(points: DataFrame, path: str) -> str:
    """A voxel map (kx, ky, kz, x, y, z) in order of its cells: E57 by suffix, else PCD."""
    suffix = "e57" if path.lower().endswith(".e57") else "pcd"
    return write_points(points, path, suffix, order=["kx", "ky", "kz"])


def export_mesh(vertices: DataFrame, triangles: DataFrame, points: DataFrame, stem: str, fmt: str = "all") -> list[str]:
    """One of obj, stl and dxf (the cloud's points), or all three in this order."""
    formats = ("obj", "stl", "dxf") if fmt == "all" else (fmt,)
    return [write_points(points, f"{stem}.dxf", "dxf") if f == "dxf" else write_mesh(vertices, triangles, f"{stem}.{f}") for f in formats]


def write_mesh(vertices: DataFrame, triangles: DataFrame, path: str) -> str:
    """OBJ or STL by suffix; a mesh comes from a bounded sample and is written whole."""
    v = vertices.orderBy("vid").toArrow()
    t = triangles.toArrow()
    of = lambda table, names: np.stack([table.column(c).to_numpy() for c in names], 1)
    tri = of(t, "abc")
    data = encode_stl(of(v, "xyz"), tri) if _suffix(path) == "stl" else encode_obj(of(v, "xyz"), of(v, ["nx", "ny", "nz"]), tri)
    write_bytes(vertices.sparkSession, path, data)
    return path

"""Point files read in ranges: one file gives many tasks, and none holds it whole.

A first job reads the head of each file where it lies and lists ranges of it: by the stride of a point for
binary PCD, PLY and LAS, by bytes for lines. A line belongs to the range in which it begins; points are
numbered by the lines of the ranges before, which a job counts. Ranges are then dealt out and decoded in
batches. Files are opened by ``pyarrow.fs``, which knows local and mounted paths and object stores.
"""

from __future__ import annotations

import io
import pickle
import posixpath
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pointloom.sources.codecs import _PCD_TYPES, _PLY_TYPES, las_layout, pcd_head, ply_head

#: Points of a range of fixed stride, bytes of a range of lines, bytes of a head at most, points of a batch.
POINTS, BYTES, HEAD, BATCH = 1 << 20, 8 << 20, 1 << 20, 1 << 16
_PLAN = "path string, layout binary, start bigint, size bigint"


@dataclass(frozen=True)
class Layout:
    """Where a file's points begin, how many there are (None: as many as lines) and how one is read."""

    kind: str  # 'fixed', 'lines' or 'whole'
    at: int = 0
    count: int | None = None
    dtype: object = None  # of one point, with fields x, y, z
    scale: tuple = ()  # of integers, and what is added
    columns: tuple[int, ...] = (0, 1, 2)


def layout_of(suffix: str, head: bytes) -> Layout:
    """How a file is read, from its first bytes."""
    if suffix == "pcd":
        h, at = pcd_head(head)
        counts, kind = [int(c) for c in h.get("COUNT", ["1"] * len(h["FIELDS"]))], h["DATA"][0].lower()
        n, starts = int(h["POINTS"][0]), np.cumsum([0, *counts[:-1]]).tolist()
        if kind == "ascii":
            return Layout("lines", at, n, columns=tuple(starts[h["FIELDS"].index(c)] for c in "xyz"))
        if kind == "binary":
            kinds = [np.dtype((_PCD_TYPES[t, int(s)], (c,) if c > 1 else ())) for t, s, c in zip(h["TYPE"], h["SIZE"], counts, strict=True)]
            return Layout("fixed", at, n, _dtype(h["FIELDS"], kinds))
    elif suffix == "ply":
        kind, n, names, types, at = ply_head(head)
        if kind == "ascii":
            return Layout("lines", at, n, columns=tuple(names.index(c) for c in "xyz"))
        order = "<" if "little" in kind else ">"
        return Layout("fixed", at, n, _dtype(names, [np.dtype(order + _PLY_TYPES[t]) for t in types]))
    elif suffix == "las":
        at, size, n, scale, shift = las_layout(head)
        return Layout("fixed", at, n, np.dtype({"names": ["x", "y", "z"], "formats": ["<i4"] * 3, "offsets": [0, 4, 8], "itemsize": size}), (tuple(scale), tuple(shift)))
    elif suffix in ("xyz", "pts"):
        first, _, _ = head.partition(b"\n")
        return Layout("lines", len(first) + 1 if len(first.split()) == 1 else 0)
    return Layout("whole")


def _dtype(names: list[str], kinds: list[np.dtype]) -> np.dtype:
    offsets = np.cumsum([0, *(k.itemsize for k in kinds)]).tolist()
    own = [names.index(c) for c in "xyz"]
    return np.dtype({"names": ["x", "y", "z"], "formats": [kinds[i] for i in own], "offsets": [offsets[i] for i in own], "itemsize": offsets[-1]})


def _opened(path: str):
    files, p = fs.FileSystem.from_uri(path)
    return files.open_input_file(p)


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for path in batch.column("path").to_pylist():
            with _opened(path) as f:
                size, own = f.size(), layout_of(posixpath.splitext(path)[1].lower().lstrip("."), f.read(HEAD))
            if own.kind == "fixed":
                if own.at + own.count * own.dtype.itemsize > size:
                    raise ValueError(f"{path} ends before its {own.count} points")
                parts = [(a, min(POINTS, own.count - a)) for a in range(0, own.count, POINTS)]
            elif own.kind == "lines":
                parts = [(a, min(BYTES, size - a)) for a in range(own.at, size, BYTES)]
            else:
                parts = [(0, size)]
            rows += [(path, pickle.dumps(own), a, n) for a, n in parts]
        kinds = (pa.string(), pa.binary(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["path", "layout", "start", "size"])


def _lines(path: str, own: Layout, start: int, size: int) -> Iterator[bytes]:
    """Whole lines that begin in the range, in blocks; blank ones aren't points."""
    with _opened(path) as f:
        at = start
        if start > own.at:  # the line before may reach into the range
            f.seek(start - 1)
            at = start - 1 + _skip_line(f)
        f.seek(at)
        left = b""
        while at < start + size:
            data = f.read(min(1 << 20, start + size - at))
            if not data:
                break
            at += len(data)
            cut = data.rfind(b"\n") + 1
            if cut:
                yield left + data[:cut]
                left = data[cut:]
            else:
                left += data
        if left:
            while left and not left.endswith(b"\n") and (data := f.read(1 << 16)):
                cut = data.find(b"\n") + 1
                left += data[:cut] if cut else data
            yield left


def _skip_line(f) -> int:
    """Bytes up to and with the next end of line."""
    n = 0
    while data := f.read(1 << 16):
        cut = data.find(b"\n") + 1
        if cut:
            return n + cut
        n += len(data)
    return n


def _rows(block: bytes, columns: tuple[int, ...]) -> np.ndarray:
    return np.loadtxt(io.BytesIO(block), ndmin=2, usecols=columns) if block.strip() else np.zeros((0, 3))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = []
        for path, own, start, size in zip(*(batch.column(c).to_pylist() for c in ("path", "layout", "start", "size")), strict=True):
            own = pickle.loads(own)
            n.append(sum(len([1 for x in b.split(b"\n") if x.strip()]) for b in _lines(path, own, start, size)) if own.kind == "lines" else size)
        yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("start"), pa.array(n, pa.int64())], ["path", "start", "n"])


def _points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, own, start, size, first in zip(*(batch.column(c).to_pylist() for c in ("path", "layout", "start", "size", "first")), strict=True):
            own, stem, i = pickle.loads(own), posixpath.splitext(posixpath.basename(path))[0], first
            for p in _decoded(path, own, start, size):
                if own.count is not None:
                    p = p[: max(0, own.count - i)]
                if len(p):
                    yield pa.RecordBatch.from_arrays([pa.array([stem] * len(p)), pa.array(np.arange(i, i + len(p))), *(pa.array(np.ascontiguousarray(p[:, c])) for c in range(3))], ["cloud", "pt_idx", "x", "y", "z"])
                i += len(p)


def _decoded(path: str, own: Layout, start: int, size: int) -> Iterator[np.ndarray]:
    if own.kind == "lines":
        for block in _lines(path, own, start, size):
            yield _rows(block, own.columns)
        return
    stride = own.dtype.itemsize
    with _opened(path) as f:
        f.seek(own.at + start * stride)
        for a in range(0, size, BATCH):
            rows = np.frombuffer(f.read(min(BATCH, size - a) * stride), own.dtype)
            p = np.stack([rows[c] for c in "xyz"], 1).astype(float)
            yield p * own.scale[0] + own.scale[1] if own.scale else p


def readable(path: str) -> bool:
    """Whether tasks can open ``path`` in ranges."""
    try:
        fs.FileSystem.from_uri(path)
        return True
    except (pa.ArrowInvalid, OSError, pa.ArrowNotImplementedError):
        return False


def read_ranges(spark: SparkSession, files: list[str], schema: str) -> tuple[DataFrame, list[str]]:
    """Points of those of ``files`` that can be read in ranges, and the other files."""
    own = [f for f in files if readable(f)]
    named = spark.createDataFrame([(f,) for f in own], "path string").repartition(max(1, len(own)), "path")
    plan = named.mapInArrow(_ranges, _PLAN).collect()  # a row per range
    whole = {r["path"] for r in plan if pickle.loads(r["layout"]).kind == "whole"}
    parts = [r for r in plan if r["path"] not in whole]
    others = [f for f in files if f not in own or f in whole]
    ranges = spark.createDataFrame(parts, _PLAN).repartition(max(1, len(parts)), "path", "start")
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    counts = ranges.mapInArrow(_count, "path string, start bigint, n bigint").select("path", "start", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    lines = any(pickle.loads(r["layout"]).kind == "lines" for r in parts)
    # Points of fixed stride are numbered by their place alone.
    first = ranges.join(counts, ["path", "start"]) if lines else ranges.withColumn("first", F.col("start"))
    return first.repartition(max(1, len(parts)), "path", "start").mapInArrow(_points, schema), others

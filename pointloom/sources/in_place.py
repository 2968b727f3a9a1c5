"""One file written by many tasks, each at the place of its points.

Points are written down with their numbers first. Where a piece of the file begins follows from those numbers:
by the stride of a point, for lines by the pieces' lengths, which a job counts before, and for pages by the
packets before them. Tasks write their pieces into one file that has its full size already; the driver adds
head and tail and moves it into place. A task that runs twice writes the same bytes at the same place.

That needs a folder that driver and executors can open, such as a network mount; on object stores, where no
file can be written in parts, ``points.write_points`` passes pieces through the driver.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.functions.storage import discard, materialize
from pointloom.sources.codecs import ENCODERS, E57Stream

#: Points of a piece; a multiple of what an E57 packet holds.
PIECE = 64_000
_ROW_BITS = 33
_WROTE = "piece bigint, bytes bigint"


def mounted(spark: SparkSession, path: str) -> str | None:
    """``path`` as a path of the operating system, if its file system is one."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    uri = urlparse(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString())
    return unquote(uri.path) if uri.scheme == "file" else None


def numbered_points(points: DataFrame) -> tuple[DataFrame, int]:
    """``points`` written with their numbers ``_i`` from 0 in their order, and how many there are."""
    raw = materialize(points.withColumn("_row", F.monotonically_increasing_id()), "points-to-write")
    task = F.shiftright("_row", _ROW_BITS)
    counts = dict(raw.groupBy(task.alias("t")).agg(F.max("_row").alias("m")).select("t", F.col("m").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)) + 1).collect())  # a row per task that wrote
    order = sorted(counts)
    starts = np.concatenate(([0], np.cumsum([counts[t] for t in order]))).astype(np.int64)
    table = raw.sparkSession.createDataFrame(pa.table([pa.array(order, pa.int64()), pa.array(starts[:-1])], ["_task", "_start"]))
    i = F.col("_start") + F.col("_row").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return raw.withColumn("_task", task).join(F.broadcast(table), "_task").select(i.alias("_i"), "x", "y", "z"), int(starts[-1])


def _by_piece(numbered: DataFrame, ahead: int, each: Callable[[int, np.ndarray, np.ndarray], int]) -> DataFrame:
    """``each(piece, own points, first points of the next piece)`` for every piece, and what it returns."""
    piece = F.floor(F.col("_i") / PIECE)
    pieces = F.array(piece)
    if ahead:
        pieces = F.when((F.col("_i") % PIECE < ahead) & (piece > 0), F.array(piece, piece - 1)).otherwise(pieces)
    dealt = numbered.withColumn("_piece", F.explode(pieces)).repartition("_piece").sortWithinPartitions("_piece", "_i")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def done() -> pa.RecordBatch:
            rows = np.concatenate(held)
            own = rows[:, 0] < (key + 1) * PIECE
            return pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([each(key, rows[own, 1:], rows[~own, 1:])], pa.int64())], ["piece", "bytes"])

        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("_i", "x", "y", "z")], 1)
            of = batch.column("_piece").to_numpy(zero_copy_only=False)
            edges = np.concatenate(([0], np.flatnonzero(np.diff(of)) + 1, [len(of)]))
            for a, z in zip(edges[:-1], edges[1:], strict=True):
                if a < z and of[a] != key:
                    if held:
                        yield done()
                    key, held = int(of[a]), []
                held.append(rows[a:z])
        if held:
            yield done()

    return dealt.mapInArrow(run, _WROTE)


def write_in_place(points: DataFrame, path: str, fmt: str, s: dict) -> None:
    """Write x, y, z in their order to the mounted ``path``; ``s`` has the bounds that heads need."""
    numbered, n = numbered_points(points)
    part = f"{path}.{uuid.uuid4().hex}.part"
    ahead, discarded = 0, numbered
    if fmt == "e57":
        stream = E57Stream(n)
        head, tail, size, ahead = b"", b"", stream.size, E57Stream.AHEAD
        place = lambda k, own, after: stream.pages_of(k * PIECE, own, after)
    else:
        coder = ENCODERS[fmt]
        head, tail, body = coder.head(n, s), coder.tail, coder.body
        if fmt in ("pcd", "ply", "las"):
            stride = len(body(np.zeros((1, 3)), s))
            starts = [len(head) + k * PIECE * stride for k in range(-(-n // PIECE) + 1)]
            end = len(head) + n * stride
        else:
            lengths = dict(_by_piece(numbered, 0, lambda k, own, _: len(body(own, s))).collect())  # a row per piece
            starts = [len(head) + int(v) for v in np.concatenate(([0], np.cumsum([lengths[k] for k in sorted(lengths)])))]
            end = starts[-1]
        size = end + len(tail)
        place = lambda k, own, _: (starts[k], body(own, s))

    def each(k: int, own: np.ndarray, after: np.ndarray) -> int:
        at, data = place(k, own, after)
        with open(part, "r+b") as f:
            f.seek(at)
            f.write(data)
        return len(data)

    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(part, "wb") as f:
        f.truncate(size)
        if fmt == "e57" and not n:
            f.write(stream.pages_of(0, np.zeros((0, 3)), np.zeros((0, 3)))[1])
        f.write(head) if head else None
        f.seek(size - len(tail))
        f.write(tail)
    wrote = _by_piece(numbered, ahead, each).agg(F.sum("bytes")).first()[0] or 0
    if n and wrote != size - len(head) - len(tail):
        os.remove(part)
        raise OSError(f"{wrote} bytes of points were written to {path}, not {size - len(head) - len(tail)}")
    os.replace(part, path)
    discard(discarded)

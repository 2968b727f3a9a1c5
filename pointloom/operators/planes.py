"""Plane finding: seeded RANSAC with distributed counting, exact residual statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from pointloom.config import PlaneConfig
from pointloom.functions.geometry import doubles, finite, plane_type, xyz
from pointloom.functions.storage import discard, materialize
from pointloom.operators.quantiles import exact_quantile
from pointloom.operators.voxel import voxel_centroid

_ROWS, _DEALS = 2048, 100


def plane_distance(plane: tuple[float, float, float, float]) -> Column:
    """Signed distance of each point to a plane with unit normal."""
    x, y, z = doubles(xyz())
    return x * plane[0] + y * plane[1] + z * plane[2] + plane[3]


def plane_inliers(points: DataFrame, plane: tuple[float, float, float, float], distance: float) -> DataFrame:
    return points.where(F.abs(plane_distance(plane)) < distance)


def plane_outliers(points: DataFrame, plane: tuple[float, float, float, float], distance: float) -> DataFrame:
    """What is left without the plane's inliers."""
    return points.where(F.abs(plane_distance(plane)) >= distance)


def plane_residuals(points: DataFrame, plane: tuple[float, float, float, float]) -> DataFrame:
    """One row: RMS, exact 95th percentile of the distance, number of points."""
    d = plane_distance(plane)
    p95 = exact_quantile(points.select(F.abs(d).alias("_d")), "_d", 0.95).get(None)
    return points.agg(F.sqrt(F.avg(d * d)).alias("rms"), F.lit(p95).cast("double").alias("p95"), F.count("*").alias("n_pts"))


def _planes_through(p: np.ndarray) -> np.ndarray:
    """Planes through triples of points (n, 3, 3), without those of points on a line."""
    n = np.cross(p[:, 1] - p[:, 0], p[:, 2] - p[:, 0])
    size = np.linalg.norm(n, axis=1)
    n, p = n[size > 1e-12] / size[size > 1e-12, None], p[size > 1e-12]
    return np.hstack([n, -(n * p[:, 0]).sum(1, keepdims=True)])


def _candidates(left: DataFrame, counts: dict, cfg: PlaneConfig, round_: int) -> dict:
    """``iterations`` planes of each cloud through seeded random triples; 3 * iterations points of each come to the driver.

    Where a cloud has fewer, or some lie on a line, its points are dealt into triples again. There are
    fewer candidates only if so many deals of the points in a row give none.
    """
    parts, most = 1 << 30, 3 * cfg.iterations
    # A threshold for each cloud first, so that about so many points are sent, however many tasks there are.
    share = {c: min(1.0, (most + 6 * (most**0.5 + 1)) / n) for c, n in counts.items()}
    limits = _per_cloud(left, {c: int(s * parts) for c, s in share.items()}, pa.int64(), "_limit")
    order = F.pmod(F.xxhash64(*doubles(xyz()), F.lit(cfg.seed + round_)), F.lit(parts))
    few = left.join(F.broadcast(limits), "cloud").withColumn("_h", order).where("_h < _limit")  # a row per cloud
    points: dict = {}
    for r in sorted(few.select("cloud", "_h", "x", "y", "z").collect(), key=lambda r: tuple(r)[1:]):
        points.setdefault(r["cloud"], []).append((r["x"], r["y"], r["z"]))
    return {c: _through_triples(np.array(p[:most], float).reshape(-1, 3), cfg, round_) for c, p in points.items()}


def _through_triples(p: np.ndarray, cfg: PlaneConfig, round_: int) -> np.ndarray:
    rng = np.random.default_rng([cfg.seed, round_])
    found, total, fruitless = [], 0, 0
    while len(p) >= 3 and total < cfg.iterations and fruitless < _DEALS:
        planes = _planes_through(p[: len(p) // 3 * 3].reshape(-1, 3, 3))
        found.append(planes)
        total, fruitless = total + len(planes), 0 if len(planes) else fruitless + 1
        p = rng.permutation(p)
    return np.concatenate([np.zeros((0, 4)), *found])[: cfg.iterations]


def _per_cloud(clouds: DataFrame, values: dict, kind: pa.DataType, name: str) -> DataFrame:
    """The driver's value of each cloud as a table."""
    own = pa.array(list(values), to_arrow_type(clouds.schema["cloud"].dataType))
    return clouds.sparkSession.createDataFrame(pa.table([own, pa.array(list(values.values()), kind)], ["cloud", name]))


def _best(left: DataFrame, planes: dict, distance: float) -> dict:
    """Of each cloud the candidate with most inliers, the first of equals, and their number: one job for all.

    Tasks count per batch; what they send is a number for each candidate that has inliers.
    """
    names = list(planes)
    sent = left.sparkSession.sparkContext.broadcast([planes[c] for c in names])  # 4 * iterations numbers a cloud
    index = _per_cloud(left, {c: i for i, c in enumerate(names)}, pa.int32(), "_i")

    def run(batches):
        own = sent.value
        total = [np.zeros(len(p), np.int64) for p in own]
        for batch in batches:
            which = batch.column("_i").to_numpy(zero_copy_only=False)
            p = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in "xyz"], 1).astype(float)
            for i in np.unique(which):
                mine, plane = p[which == i], own[i]
                for a in range(0, len(mine), _ROWS):
                    total[i] += (np.abs(mine[a : a + _ROWS] @ plane[:, :3].T + plane[:, 3]) < distance).sum(0)
        for i, n in enumerate(total):
            on = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(on), i, np.int32)), pa.array(on), pa.array(n[on])], ["_i", "plane", "n"])

    marked = left.join(F.broadcast(index), "cloud").select("_i", "x", "y", "z")
    counts = marked.mapInArrow(run, "_i int, plane bigint, n bigint").groupBy("_i", "plane").agg(F.sum("n").alias("n"))
    best = counts.groupBy("_i").agg(F.max(F.struct("n", -F.col("plane"))).alias("b")).select("_i", -F.col("b.col2"), "b.n")
    return {names[i]: (int(plane), int(n)) for i, plane, n in best.collect()}


def _refit(on: DataFrame) -> dict:
    """Least-squares planes from nine sums of each cloud."""
    c = [F.col(n) for n in "xyz"]
    rows = on.groupBy("cloud").agg(F.count("*").alias("n"), *(F.sum(a).alias(n) for a, n in zip(c, "xyz", strict=True)), *(F.sum(c[i] * c[j]).alias(f"s{i}{j}") for i in range(3) for j in range(i, 3))).collect()
    out = {}
    for row in rows:
        mean = np.array([row[n] for n in "xyz"]) / row["n"]
        cov = np.array([[row[f"s{min(i, j)}{max(i, j)}"] for j in range(3)] for i in range(3)]) / row["n"] - np.outer(mean, mean)
        n = np.linalg.eigh(cov)[1][:, 0]
        out[row["cloud"]] = [*n.tolist(), float(-n @ mean)]
    return out


def _distances(left: DataFrame, planes: dict) -> DataFrame:
    """``left`` with ``_d``, the distance to its cloud's plane; clouds without one go."""
    table = _per_cloud(left, planes, pa.list_(pa.float64()), "_plane")
    d = F.expr("abs(x * _plane[0] + y * _plane[1] + z * _plane[2] + _plane[3])")
    return left.join(F.broadcast(table), "cloud").withColumn("_d", d).drop("_plane")  # a row per cloud


def find_planes(clouds: DataFrame, cfg: PlaneConfig = PlaneConfig(), cloud: str | None = None) -> DataFrame:
    """Up to ``max_planes`` rows ``type, rms, p95, n_pts, normal`` of each cloud, its largest plane first.

    Clouds, told apart by the column ``cloud`` (which leads the rows then), are searched together: the number of
    jobs follows the rounds, not the clouds. They are thinned by voxels; a round takes the best of seeded
    candidates, refits it to its inliers, measures them and goes on without them. A cloud leaves when too few of
    its points are left or fit. Points that aren't finite and rows of a null cloud take no part.
    """
    spark = clouds.sparkSession
    named = clouds.select((F.col(cloud) if cloud else F.lit(0)).alias("cloud"), *(c.alias(n) for c, n in zip(doubles(xyz()), "xyz", strict=True)))
    named = named.where(finite(*xyz()) & F.col("cloud").isNotNull())
    left = materialize(voxel_centroid(named, cfg.voxel, ["cloud"]).select("cloud", "x", "y", "z"), "thinned")
    rows = []
    for round_ in range(cfg.max_planes):
        counts = {c: n for c, n in left.groupBy("cloud").agg(F.count("*")).collect() if n >= max(3, cfg.min_points)}  # a row per cloud
        planes = {c: p for c, p in _candidates(left, counts, cfg, round_).items() if len(p)} if counts else {}
        best = {c: x for c, x in _best(left, planes, cfg.distance).items() if x[1] >= cfg.min_points} if planes else {}
        if not best:
            break
        found = {c: planes[c][i].tolist() for c, (i, _) in best.items()}
        near = materialize(_distances(left, found), "distances")
        refit = _refit(near.where(F.col("_d") < cfg.distance))
        residual = _distances(near.where(F.col("_d") < cfg.distance).drop("_d"), refit)
        p95 = exact_quantile(residual, "_d", 0.95, "cloud")
        for r in sorted(residual.groupBy("cloud").agg(F.sqrt(F.avg(F.col("_d") * F.col("_d"))), F.count("*")).collect()):
            rows.append((r[0], round_, r[1], p95[r[0]], r[2], refit[r[0]][:3]))
        before, left = left, materialize(near.where(F.col("_d") >= cfg.distance).drop("_d"), "left-of-planes")
        discard(before, near)
    kind = named.schema["cloud"].dataType.simpleString()
    rows.sort(key=lambda r: r[:2])
    found = spark.createDataFrame(rows, f"cloud {kind}, round int, rms double, p95 double, n_pts long, normal array<double>")
    n = F.col("normal")
    return found.select(*([F.col("cloud").alias(cloud)] if cloud else []), plane_type(n[0], n[1], n[2]).alias("type"), "rms", "p95", "n_pts", "normal")

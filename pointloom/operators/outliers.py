"""Statistical outlier removal and small picking and colouring operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.functions.geometry import compare_color, distance_ramp, doubles, height_ramp, norm, xyz
from pointloom.functions.storage import broadcast_if_small, materialize
from pointloom.operators.neighbors import knn


def neighbor_distances(points: DataFrame, key: Sequence[str], k: int = 20, start: float | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Each point's mean distance to its k nearest, itself counted at distance 0."""
    near = knn(points, k, key, start, by)
    return near.groupBy(*by, *key).agg(F.avg(F.sqrt("d2")).alias("mean_distance"))


def outlier_stats(distances: DataFrame, ratio: float = 2.0, by: Sequence[str] = ()) -> DataFrame:
    """Mean and sample deviation of the distances, and the limit."""
    out = distances.where("mean_distance > 0").groupBy(*by).agg(F.avg("mean_distance").alias("mean"), F.stddev_samp("mean_distance").alias("std"), F.count("*").alias("n"))
    return out.withColumn("threshold", F.col("mean") + ratio * F.col("std"))


def remove_outliers(points: DataFrame, key: Sequence[str], k: int = 20, ratio: float = 2.0, start: float | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Points whose mean distance is above 0 and below the limit, per cloud."""
    d = materialize(neighbor_distances(points, key, k, start, by), "neighbour-distances")
    limit = outlier_stats(d, ratio, by)
    kept = d.join(broadcast_if_small(limit), list(by)) if by else d.crossJoin(F.broadcast(limit))  # one row
    kept = kept.where((F.col("mean_distance") > 0) & (F.col("mean_distance") < F.col("threshold"))).select(*by, *key)
    return points.join(kept, [*by, *key], "left_semi")


def pick_nearest_to_ray(points: DataFrame, origin: Sequence[float], direction: Sequence[float], threshold: float, key: Sequence[str]) -> DataFrame:
    """The point in front that is nearest the ray, if it is within ``threshold``; the least key of equals."""
    size = sum(v * v for v in direction) ** 0.5
    d = [v / size for v in direction]
    p = [c - float(o) for c, o in zip(doubles(xyz()), origin, strict=True)]
    along = sum(c * v for c, v in zip(p, d, strict=True))
    cross = (p[1] * d[2] - p[2] * d[1], p[2] * d[0] - p[0] * d[2], p[0] * d[1] - p[1] * d[0])
    near = points.withColumns({"along": along, "distance": norm(cross)}).where("along > 0")
    return near.orderBy("distance", *key).limit(1).where(F.col("distance") <= threshold)


def color_by_height(points: DataFrame) -> DataFrame:
    """Adds r, g, b by height over the cloud's extent."""
    bounds = points.agg(F.min(F.col("z").cast("double")).alias("_lo"), F.max(F.col("z").cast("double")).alias("_hi"))
    df = points.crossJoin(F.broadcast(bounds))  # one row
    return df.withColumns(dict(zip("rgb", height_ramp(F.col("z").cast("double"), F.col("_lo"), F.col("_hi")), strict=True))).drop("_lo", "_hi")


def color_by_distance(points: DataFrame) -> DataFrame:
    """Adds r, g, b by distance from the origin over the cloud's extent."""
    df = points.withColumn("_d", norm(doubles(xyz())))
    df = df.crossJoin(F.broadcast(df.agg(F.min("_d").alias("_lo"), F.max("_d").alias("_hi"))))  # one row
    return df.withColumns(dict(zip("rgb", distance_ramp(F.col("_d"), F.col("_lo"), F.col("_hi")), strict=True))).drop("_lo", "_hi", "_d")


def color_by_cloud(points: DataFrame, cloud: str = "cloud") -> DataFrame:
    return points.withColumns(dict(zip("rgb", compare_color(F.col(cloud)), strict=True)))


def sample_points(points: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` points without replacement, or all if there are fewer."""
    count = points.count()
    # A threshold first, so that no task sorts or sends more than its share of about n points.
    share = n / max(count, 1) + 6 * (n**0.5 + 1) / max(count, 1)
    marked = points.withColumn("_r", F.rand(seed))
    few = marked.where(F.col("_r") < share) if share < 1 else marked
    return few.orderBy("_r").limit(n).drop("_r")


def bounds(points: DataFrame) -> DataFrame:
    """One row: least, largest and mean coordinates and the number of points."""
    c = list(zip(doubles(xyz()), "xyz", strict=True))
    return points.agg(*(F.min(a).alias(f"min_{n}") for a, n in c), *(F.max(a).alias(f"max_{n}") for a, n in c), *(F.avg(a).alias(f"mean_{n}") for a, n in c), F.count("*").alias("n"))

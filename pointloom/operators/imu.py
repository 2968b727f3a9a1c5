"""Tilt correction from resting accelerometer samples."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.functions.geometry import axis_angle

MAX_SAMPLES, MIN_SAMPLES, DEAD_BAND_DEG = 500, 10, 0.1


def first_samples(imu: DataFrame, order: tuple[str, ...] = ("log_time_ns",), n: int = MAX_SAMPLES) -> DataFrame:
    return imu.orderBy(*order).limit(n)


def gravity_mean(samples: DataFrame) -> DataFrame:
    """One row: mean acceleration, its unit vector, the tilt from +x in degrees, the number of samples."""
    mean = samples.agg(*(F.avg(f"a{c}").alias(f"m{c}") for c in "xyz"), F.count("*").alias("n"))
    size = F.sqrt(sum(F.col(f"m{c}") ** 2 for c in "xyz"))
    unit = mean.select("n", *(f"m{c}" for c in "xyz"), *((F.col(f"m{c}") / size).alias(f"g{c}") for c in "xyz"))
    return unit.withColumn("tilt_deg", F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("gx"))))))


def tilt_matrix(imu: DataFrame, order: tuple[str, ...] = ("log_time_ns",)) -> np.ndarray:
    """The rotation that takes gravity to +x; identity for few samples or a tilt inside the dead band."""
    row = gravity_mean(first_samples(imu, order)).first()
    if row["n"] < MIN_SAMPLES or row["tilt_deg"] is None or row["tilt_deg"] < DEAD_BAND_DEG:
        return np.eye(3)
    g = np.array([row["gx"], row["gy"], row["gz"]])
    axis = np.cross(g, [1.0, 0.0, 0.0])
    if np.linalg.norm(axis) < 1e-9:
        return np.eye(3)
    return axis_angle(axis, math.radians(row["tilt_deg"]))

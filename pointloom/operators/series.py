"""Time series of a rotating platform: source choice, unwrapping, interpolation, gates.

All take ``by``: the columns that name a series (a recording), so that many are processed at once. Within
a long series work is dealt over time buckets, and only one row per bucket meets its neighbours.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.functions.geometry import TWO_PI
from pointloom.functions.storage import broadcast_if_small

#: Samples of one series that one task orders.
BUCKET_SAMPLES = 100_000


def _bucketed(samples: DataFrame, t: str, by: Sequence[str], per_bucket: int) -> tuple[DataFrame, int]:
    """Time buckets of about ``per_bucket`` samples on average; one row comes to the driver."""
    spread = samples.groupBy(*by).agg(F.min(t).alias("a"), F.max(t).alias("b"), F.count("*").alias("n"))
    row = spread.agg(F.max((F.col("b") - F.col("a")) / F.greatest(F.lit(1.0), F.col("n") / per_bucket))).first()
    width = max(1, int(row[0] or 0) + 1)
    return samples.withColumn("_b", F.floor(F.col(t) / width)), width


def ordered_lag(samples: DataFrame, t: str, value: Column, name: str, order: Sequence[str], by: Sequence[str] = (), per_bucket: int = BUCKET_SAMPLES) -> DataFrame:
    """Adds ``name``: ``value`` of the sample before, across buckets too; keeps ``_b``, the bucket."""
    marked, _ = _bucketed(samples, t, by, per_bucket)
    marked = marked.withColumn("_v", value)
    within = Window.partitionBy(*by, "_b").orderBy(*order)
    last = marked.groupBy(*by, "_b").agg(F.max_by("_v", F.struct(*order)).alias("_last"))
    last = last.withColumn("_before", F.lag("_last").over(Window.partitionBy(*by).orderBy("_b"))).drop("_last")
    out = marked.withColumn(name, F.lag("_v").over(within)).withColumn("_first", F.row_number().over(within) == 1)
    out = out.join(last, [*by, "_b"]).withColumn(name, F.when(F.col("_first"), F.col("_before")).otherwise(F.col(name)))
    return out.drop("_v", "_first", "_before")


def unwrap(samples: DataFrame, t: str = "t_ns", angle: str = "angle", out: str = "unwrapped", ties: Sequence[str] = (), by: Sequence[str] = (), per_bucket: int = BUCKET_SAMPLES) -> DataFrame:
    """Adds the angle without jumps of a turn; a step of exactly half a turn upwards stays upwards."""
    order = [t, *ties]
    df = ordered_lag(samples, t, F.col(angle), "_prev", order, by, per_bucket)
    step = F.col(angle) - F.col("_prev")
    wrapped = F.pmod(step + math.pi, F.lit(TWO_PI)) - math.pi
    wrapped = F.when((wrapped == -math.pi) & (step > 0), F.lit(math.pi)).otherwise(wrapped)
    df = df.withColumn("_fix", F.when(F.col("_prev").isNull() | (F.abs(step) < math.pi), 0.0).otherwise(wrapped - step)).drop("_prev")
    sums = df.groupBy(*by, "_b").agg(F.sum("_fix").alias("_s"))
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*by, "_b", F.coalesce(F.sum("_s").over(before), F.lit(0.0)).alias("_base"))
    within = Window.partitionBy(*by, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.join(sums, [*by, "_b"]).withColumn(out, F.col(angle) + F.col("_base") + F.sum("_fix").over(within))
    return df.drop("_b", "_fix", "_base")


def interpolate(queries: DataFrame, samples: DataFrame, t: str = "t", sample_t: str = "t_ns", value: str = "angle", out: str = "theta", ties: Sequence[str] = (), by: Sequence[str] = ()) -> DataFrame:
    """Adds the samples' value at each query's time: linear between neighbours, held at both ends.

    Segments between consecutive samples are spread over the time buckets that they touch, of about their
    own series' spacing, and meet the queries in an equi-join on the bucket: no range join, no sort of the
    queries. Of samples at one time the last by ``ties`` counts. Without samples no row is returned.
    """
    ends = samples.groupBy(*by).agg(
        F.min(sample_t).alias("_t0"),
        F.max(sample_t).alias("_t1"),
        F.max_by(value, F.struct(-F.col(sample_t), *ties)).alias("_v0"),
        F.max_by(value, F.struct(sample_t, *ties)).alias("_v1"),
        F.count("*").alias("_n"),
    )
    ends = ends.withColumn("_w", F.floor((F.col("_t1") - F.col("_t0")) / F.col("_n")) + 1)
    ends = broadcast_if_small(ends) if by else ends  # one row per series
    prior = ordered_lag(samples, sample_t, F.struct(F.col(sample_t).alias("t"), F.col(value).alias("v")), "_p", [sample_t, *ties], by)
    # A segment ends at its sample, excluded, and starts at the one before.
    seg = prior.where(F.col("_p").isNotNull() & (F.col("_p.t") < F.col(sample_t)))
    seg = seg.select(*by, F.col("_p.t").alias("_a"), F.col("_p.v").alias("_va"), F.col(sample_t).alias("_z"), F.col(value).alias("_vz"))
    bucket = lambda c: F.floor(c / F.col("_w"))
    width = ends.select(*by, "_w")
    seg = seg.join(width, list(by)) if by else seg.crossJoin(F.broadcast(width))
    seg = seg.withColumn("_bk", F.explode(F.sequence(bucket(F.col("_a")), bucket(F.col("_z")))))
    q = queries.join(ends, list(by)) if by else queries.crossJoin(F.broadcast(ends))  # one row
    # Times at or beyond an end meet no segment; they are spread by their hash, not gathered in the end's bucket.
    inside = (F.col(t) > F.col("_t0")) & (F.col(t) < F.col("_t1"))
    at = F.when(inside, bucket(F.col(t))).otherwise(-1 - F.pmod(F.xxhash64(t), F.lit(4096)))
    q = q.where("_n > 0").withColumn("_q", F.greatest(F.col("_t0"), F.least(F.col("_t1"), F.col(t)))).withColumn("_bk", at)
    # At most one segment holds a time, so the outer join keeps each query once.
    seg = seg.select(*(F.col(c).alias(f"_s{c}") for c in [*by, "_bk"]), "_a", "_va", "_z", "_vz")
    same = [q[c] == seg[f"_s{c}"] for c in [*by, "_bk"]]
    met = q.join(seg, [*same, q["_q"] >= seg["_a"], q["_q"] < seg["_z"]], "left")
    share = (F.col("_q") - F.col("_a")) / (F.col("_z") - F.col("_a"))
    inner = F.col("_va") + share * (F.col("_vz") - F.col("_va"))
    theta = F.when(F.col("_q") >= F.col("_t1"), F.col("_v1")).when(F.col("_q") <= F.col("_t0"), F.col("_v0")).otherwise(inner)
    return met.withColumn(out, theta).select(*queries.columns, out)


def select_encoder(joint_state: DataFrame, platform_angle: DataFrame, min_joint: int = 10, min_angle: int = 2) -> tuple[DataFrame, str]:
    """The encoder series (t_ns, angle) and where it is from: joint states if there are enough, else angles.

    Joint states give the first position in radians at their own stamp; angles are in degrees at log time.
    """
    joint = joint_state.where(F.size("position") > 0)
    if joint.limit(min_joint).count() >= min_joint:
        return joint.select(F.col("log_time_ns").alias("t_ns"), F.col("position")[0].alias("angle")), "joint_state"
    found = platform_angle.select(F.col("log_time_ns").alias("t_ns"), F.radians("deg").alias("angle"))
    if platform_angle.limit(min_angle).count() >= min_angle:
        return found, "platform_angle"
    return found.limit(0), "none"


def trim_end(df: DataFrame, t: str, last: DataFrame, last_t: str, seconds: float) -> DataFrame:
    """Rows up to ``seconds`` before the last time of ``last``; 0 keeps all."""
    if seconds <= 0:
        return df
    end = last.agg(F.max(last_t).alias("_end"))
    return df.crossJoin(F.broadcast(end)).where(F.col(t) <= F.col("_end") - F.lit(int(seconds * 1e9))).drop("_end")  # one row


def samples_before(frames: DataFrame, samples: DataFrame, t: str, sample_t: str, window: int, out: str = "n_samples", by: Sequence[str] = ()) -> DataFrame:
    """Adds how many samples lie in [t - window, t], both ends included.

    Samples are copied to the two buckets of the window's width that they can count in, and counted per frame
    by a range frame within a bucket, so memory follows the samples of a bucket only.
    """
    f = frames.withColumns({"_t": F.col(t), "_b": F.floor(F.col(t) / window), "_s": F.lit(0)})
    s = samples.select(*by, F.col(sample_t).alias("_t"), F.explode(F.array(F.floor(F.col(sample_t) / window), F.floor(F.col(sample_t) / window) + 1)).alias("_b"), F.lit(1).alias("_s"))
    frame = Window.partitionBy(*by, "_b").orderBy("_t").rangeBetween(-window, 0)
    # Frames go through the window themselves, so no row numbers have to agree between two readings of them.
    counted = f.unionByName(s, allowMissingColumns=True).withColumn(out, F.sum("_s").over(frame)).where("_s = 0")
    return counted.select(*[c for c in frames.columns if c != out], out)


def clock_regression(samples: DataFrame, device_ns: str = "stamp_ns", log_ns: str = "log_time_ns") -> DataFrame:
    """Slope, drift and residual RMS of log time against device time; times are centred to keep digits."""
    low = samples.agg(F.min(device_ns).alias("_d"), F.min(log_ns).alias("_l"))
    df = samples.crossJoin(F.broadcast(low)).select((F.col(device_ns) - F.col("_d")).cast("double").alias("d"), (F.col(log_ns) - F.col("_l")).cast("double").alias("l"))  # one row
    fit = df.agg(F.regr_slope("l", "d").alias("slope"), F.regr_intercept("l", "d").alias("intercept"))
    off = F.col("l") - F.col("slope") * F.col("d") - F.col("intercept")
    both = df.crossJoin(F.broadcast(fit))  # one row; residuals themselves, since differences of sums lose digits
    return both.agg(F.first("slope").alias("slope"), F.first("intercept").alias("intercept"), F.sqrt(F.avg(off * off)).alias("rms"), F.count("*").alias("n"))

"""Time series against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.operators import series


def _samples(spark, t, v):
    return spark.createDataFrame([(int(a), float(b)) for a, b in zip(t, v, strict=True)], "t_ns long, angle double")


@pytest.mark.parametrize("per_bucket", [7, 1000])
def test_unwrap_is_numpy_unwrap(spark, per_bucket):
    rng = np.random.default_rng(0)
    v = np.concatenate([np.cumsum(rng.normal(0, 2, 200)) % (2 * np.pi), [0.0, np.pi, 0.0, np.pi]])
    t = np.cumsum(rng.integers(1, 50, len(v)))
    got = [r.unwrapped for r in series.unwrap(_samples(spark, t, v), per_bucket=per_bucket).orderBy("t_ns").collect()]
    assert np.allclose(got, np.unwrap(v), atol=1e-9)


def test_interpolate_is_numpy_interp_and_holds_the_ends(spark):
    rng = np.random.default_rng(1)
    t = np.unique(rng.integers(0, 10**9, 60)) + 10**18
    v = rng.normal(size=len(t))
    q = np.concatenate([rng.integers(10**18 - 10**8, 10**18 + 11 * 10**8, 300), t[[0, 5, -1]]])
    queries = spark.createDataFrame([(i, int(x)) for i, x in enumerate(q)], "id long, t long")
    got = {r.id: r.theta for r in series.interpolate(queries, _samples(spark, t, v)).collect()}
    want = np.interp((q - t[0]).astype(float), (t - t[0]).astype(float), v)
    assert len(got) == len(q)
    assert np.allclose([got[i] for i in range(len(q))], want, atol=1e-9)


def test_interpolate_keeps_series_apart(spark):
    s = spark.createDataFrame([("a", 0, 0.0), ("a", 10, 10.0), ("b", 0, 5.0)], "bag string, t_ns long, angle double")
    q = spark.createDataFrame([("a", 5), ("b", 5), ("b", -5)], "bag string, t long")
    got = {(r.bag, r.t): r.theta for r in series.interpolate(q, s, by=["bag"]).collect()}
    assert got == {("a", 5): 5.0, ("b", 5): 5.0, ("b", -5): 5.0}


def test_interpolate_without_samples_gives_no_rows(spark):
    assert series.interpolate(spark.range(3).select(F.col("id").alias("t")), _samples(spark, [], [])).count() == 0


def test_samples_before_counts_both_ends(spark):
    rng = np.random.default_rng(2)
    t, f = rng.integers(0, 3000, 80), rng.integers(0, 3000, 50)
    frames = spark.createDataFrame([(i, int(x)) for i, x in enumerate(f)], "id long, t long")
    got = {r.id: r.n_samples for r in series.samples_before(frames, _samples(spark, t, t), "t", "t_ns", 110).collect()}
    assert [got[i] or 0 for i in range(len(f))] == [int(((t >= x - 110) & (t <= x)).sum()) for x in f]


def test_encoder_selection(spark):
    joint = lambda n: spark.createDataFrame([(i, [0.1 * i]) for i in range(n)], "log_time_ns long, position array<double>")
    angle = lambda n: spark.createDataFrame([(i, 180.0) for i in range(n)], "log_time_ns long, deg double")
    assert series.select_encoder(joint(10), angle(5))[1] == "joint_state"
    found, origin = series.select_encoder(joint(9), angle(2))
    assert origin == "platform_angle" and np.isclose(found.first().angle, np.pi)
    assert series.select_encoder(joint(9), angle(1))[1] == "none"


def test_clock_regression(spark):
    d = np.arange(100) * 10**7 + 17 * 10**17
    log = 10**18 + (np.arange(100) * 10**7 * 1.000007).astype(np.int64)
    row = series.clock_regression(spark.createDataFrame([(int(a), int(b)) for a, b in zip(d, log, strict=True)], "stamp_ns long, log_time_ns long")).first()
    assert abs(row.slope - 1.000007) < 1e-9 and row.rms < 4 and row.n == 100


def test_times_beyond_the_ends_are_held_and_spread(spark):
    """Most queries lie past the end, which must not gather them in one key."""
    samples = [(1000 * i, float(i % 7)) for i in range(50)]
    queries = [(t,) for t in [*range(-500, 50_000, 331), *range(49_000, 500_000, 97)]]
    out = series.interpolate(spark.createDataFrame(queries, "t long"), spark.createDataFrame(samples, "t_ns long, angle double")).collect()
    want = dict(zip([q[0] for q in queries], np.interp([q[0] for q in queries], *zip(*samples)), strict=True))
    assert len(out) == len(queries) and all(abs(r.theta - want[r.t]) < 1e-9 for r in out)

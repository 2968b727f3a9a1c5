"""Exact quantiles against numpy, groups together."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.operators.quantiles import exact_quantile


@pytest.mark.parametrize("bins", [4, 1024])
def test_groups_of_every_kind(spark, bins):
    rng = np.random.default_rng(2)
    groups = {
        "even": rng.uniform(-5, 5, 3001),
        "tail": np.exp(rng.normal(0, 12, 2000)),
        "ties": rng.integers(0, 3, 1000).astype(float),
        "same": np.full(50, 1.5),
        "two": np.array([1.0, 1.0 + 2**-52]),
        "one": np.array([-7.0]),
        "wide": np.array([-1.7e308, 0.0, 1e-300, 5e-324, 1.7e308]),
    }
    rows = [(g, float(v)) for g, own in groups.items() for v in own] + [("even", None), ("even", math.nan), ("one", math.inf), (None, 3.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    for share in (0.0, 0.1, 0.5, 0.95, 1.0):
        found = exact_quantile(df, "v", share, "g", bins)
        want = {r.g: r.p for r in df.where("abs(v) < DOUBLE('Infinity') AND g IS NOT NULL").groupBy("g").agg(F.percentile("v", share).alias("p")).collect()}
        assert found == pytest.approx(want, rel=1e-15)


def test_without_groups_or_values(spark):
    df = spark.range(11).withColumn("v", F.col("id") * 2.0)
    assert exact_quantile(df, "v", 0.25) == {None: 5.0}
    assert exact_quantile(df.limit(0), "v", 0.5) == {}

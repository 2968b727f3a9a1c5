"""Plane search: as many candidates as stated, on small clouds as well."""

import numpy as np
import pytest

from pointloom.config import PlaneConfig
from pointloom.operators import planes


def cloud(spark, p):
    return spark.createDataFrame([(0, *map(float, q)) for q in p], "cloud int, x double, y double, z double")


def candidates(df, cfg):
    return planes._candidates(df, {0: df.count()}, cfg, 0)[0]


@pytest.mark.parametrize("n", [4, 50, 299, 400])
def test_small_clouds_have_all_candidates(spark, n):
    df = cloud(spark, np.random.default_rng(n).uniform(0, 1, (n, 3)))
    cfg = PlaneConfig(iterations=100)
    got = candidates(df, cfg)
    assert got.shape == (100, 4) and np.allclose(np.linalg.norm(got[:, :3], axis=1), 1)
    assert np.array_equal(got, candidates(df, cfg))
    if n >= 50:
        assert len(np.unique(got.round(9), axis=0)) == 100


def test_points_on_a_line_have_none(spark):
    assert candidates(cloud(spark, [(i, 0, 0) for i in range(30)]), PlaneConfig(iterations=100)).shape == (0, 4)
    assert candidates(cloud(spark, [(0, 0, 0), (1, 2, 3)]), PlaneConfig(iterations=100)).shape == (0, 4)


def test_clouds_are_searched_together(spark):
    """Two clouds at once give what each gives alone; points that aren't finite and nameless ones don't count."""
    rng = np.random.default_rng(3)
    flat = {c: np.column_stack([rng.uniform(0, 1, (400, 2)), np.full(400, h)])[:, order] for c, h, order in (("a", 0.5, [0, 1, 2]), ("b", 2.0, [2, 0, 1]))}
    rows = [(c, *map(float, q)) for c, p in flat.items() for q in p] + [("a", float("nan"), 0.0, 0.0), (None, 1.0, 1.0, 1.0), ("few", 0.0, 0.0, 0.0)]
    both = spark.createDataFrame(rows, "name string, x double, y double, z double")
    cfg = PlaneConfig(min_points=100, iterations=50, voxel=1e-4)
    found = planes.find_planes(both, cfg, "name").collect()
    assert [(r["name"], r["type"], r["n_pts"]) for r in found] == [("a", "пол/потолок", 400), ("b", "стена X", 400)]
    alone = planes.find_planes(both.where("name = 'b'").drop("name"), cfg).collect()
    assert [tuple(r) for r in alone] == [tuple(r)[1:] for r in found if r["name"] == "b"]

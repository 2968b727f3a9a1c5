"""Neighbours and outliers of groups of very different sizes."""

import numpy as np

from pointloom.operators import neighbors, outliers


def skewed(spark):
    """Groups of 100, 3 and 1 points, one point without a group, one without a coordinate."""
    rng = np.random.default_rng(5)
    p = {"big": rng.uniform(0, 3, (100, 3)), "small": rng.uniform(0, 1, (3, 3)), "single": rng.uniform(0, 1, (1, 3))}
    rows, i = [(1000, None, 0.0, 0.0, 0.0), (1001, "big", None, 0.0, 0.0), (1002, "big", float("nan"), 0.0, 0.0)], 0
    want = {}
    for g, q in p.items():
        d = ((q[:, None] - q[None]) ** 2).sum(-1)
        for j in range(len(q)):
            want[i + j] = [i + int(x) for x in np.argsort(d[j], kind="stable")[:20]]
        rows += [(i + j, g, *map(float, v)) for j, v in enumerate(q)]
        i += len(q)
    return spark.createDataFrame(rows, "id long, label string, x double, y double, z double"), want, p


def test_each_group_has_its_own_number_of_neighbours(spark):
    df, want, _ = skewed(spark)
    got = {}
    for r in sorted(neighbors.knn(df, 20, ["id"], 0.1, ["label"]).collect(), key=lambda r: (r.id, r.rank)):
        got.setdefault(r.id, []).append(r.t_id)
    assert got == want
    assert [len(got[i]) for i in (0, 100, 103)] == [20, 3, 1]


def test_a_small_group_leaves_the_distances_of_others(spark):
    df, _, p = skewed(spark)
    q = p["big"]
    d = np.sort(np.sqrt(((q[:, None] - q[None]) ** 2).sum(-1)), axis=1)[:, :20].mean(1)
    got = {r.label: r for r in outliers.outlier_stats(outliers.neighbor_distances(df, ["id"], by=["label"]), by=["label"]).collect()}
    assert got["big"].n == 100 and np.isclose(got["big"]["mean"], d.mean()) and np.isclose(got["big"]["threshold"], d.mean() + 2 * d.std(ddof=1))
    kept = {r.id for r in outliers.remove_outliers(df, ["id"], by=["label"]).where("label = 'big'").collect()}
    assert kept == set(np.flatnonzero(d < d.mean() + 2 * d.std(ddof=1)).tolist())

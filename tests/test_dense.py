"""Searches within a radius that holds very many points cost what k asks for."""

import numpy as np
import pytest

from pointloom.operators import neighbors


@pytest.fixture(scope="module")
def cloud(spark):
    p = np.random.default_rng(3).normal(size=(3000, 3)) * 0.05
    return p, spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "id long, x double, y double, z double")


def _brute(p, k, radius):
    d2 = ((p[:, None] - p[None]) ** 2).sum(2)
    near = np.argsort(d2, axis=1, kind="stable")[:, :k]
    return {(i, int(j), r + 1) for i in range(len(p)) for r, j in enumerate(near[i]) if d2[i, j] <= radius * radius}


def test_the_first_ring_suits_the_density_and_results_are_exact(spark, cloud, monkeypatch):
    p, df = cloud
    rings = []
    search = neighbors.neighbours
    monkeypatch.setattr(neighbors, "neighbours", lambda s, t, radius, *a, **b: (rings.append(s.selectExpr(f"max({radius})").first()[0]), search(s, t, radius, *a, **b))[1])
    got = {(r.id, r.t_id, r.rank) for r in neighbors.knn_within(df, 5, 0.1, ["id"]).collect()}
    assert got == _brute(p, 5, 0.1)
    assert rings[0] < 0.03 and rings[-1] <= 0.1


def test_normals_are_those_of_all_neighbours_within_the_radius(spark, cloud):
    p, df = cloud
    near = {}
    for i, j, _ in _brute(p, 30, 0.05):
        near.setdefault(i, []).append(j)
    got = {r.id: (r.n_near, np.array([r.nx, r.ny, r.nz])) for r in neighbors.estimate_normals(df, ["id"], 0.05, counted=True).collect()}
    assert {i: n for i, (n, _) in got.items()} == {i: len(v) for i, v in near.items()}
    for i, (n, v) in got.items():
        c = np.cov(p[near[i]].T, bias=True) if n >= 3 else None
        assert np.allclose(v, (0, 0, 1)) if n < 3 else abs(v @ c @ v - np.linalg.eigvalsh(c)[0]) < 1e-12


def test_icp_of_a_dense_cloud_searches_narrow_rings_first(spark, cloud, monkeypatch):
    from pointloom.functions import geometry as G
    from pointloom.operators import registration

    _, df = cloud
    m, rings, search = G.rigid(G.rotation("z", 0.002), (0.0005, -0.0005, 0.0002)), [], registration.neighbours
    monkeypatch.setattr(registration, "neighbours", lambda s, t, radius, *a, **b: (rings.append(radius), search(s, t, radius, *a, **b))[1])
    found, fitness, rmse = registration.icp(df, registration.transformed(df, m), 0.1, ["id"], iterations=10)
    assert rings[0] < 0.03 and fitness == 1 and rmse < 1e-6 and np.abs(found - m).max() < 1e-6

"""The mesh is made of all points, oriented in Spark as along one spanning tree."""

import numpy as np
from pyspark.sql import functions as F

from pointloom.operators import mesh


def sphere(n, seed=4):
    p = np.random.default_rng(seed).normal(size=(n, 3))
    return p / np.linalg.norm(p, axis=1, keepdims=True)


def test_blocks_orient_as_one_tree(spark):
    rng = np.random.default_rng(6)
    p = np.concatenate([sphere(400), sphere(300, 5) + [3, 0, 0], [[9.0, 9, 9]]])
    n = p + rng.normal(0, 0.3, p.shape)
    n = n / np.linalg.norm(n, axis=1, keepdims=True) * np.where(rng.random(len(p)) < 0.5, 1, -1)[:, None]
    d = np.linalg.norm(p[:, None] - p[None], axis=2)
    near = np.argsort(d, axis=1)[:, 1:7]
    a, b = np.repeat(np.arange(len(p)), 6), near.ravel()
    a, b = (x[d[a, b] < 0.6] for x in (a, b))
    want = mesh.orient_along(p, n, a, b)
    block = rng.integers(0, 300, len(p))
    points = spark.createDataFrame([(i, int(block[i]), *map(float, p[i]), *map(float, n[i])) for i in range(len(p))], "id long, block int, x double, y double, z double, nx double, ny double, nz double")
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    dot = (n[lo] * n[hi]).sum(1)
    rows = [(int(i), int(j), int(i), int(j), float(abs(w)), int(w < 0), int(block[i]), int(block[j])) for i, j, w in zip(lo, hi, dot, strict=True)]
    got = mesh.oriented(points, spark.createDataFrame(rows, mesh._EDGE), 300).orderBy("id").collect()
    assert np.array_equal(np.array([(r.nx, r.ny, r.nz) for r in got]), want)


def test_every_point_counts(spark, monkeypatch):
    monkeypatch.setattr(mesh, "MAX_SAMPLES", 500, raising=False)
    monkeypatch.setattr(mesh, "BLOCK_POINTS", 300, raising=False)
    weights = []
    p = sphere(3000)
    sums = mesh.np.fft.rfftn
    monkeypatch.setattr(mesh.np.fft, "rfftn", lambda x, *a, **k: weights.append(x.sum()) or sums(x, *a, **k))
    df = spark.createDataFrame([tuple(map(float, q)) for q in p] + [(float("nan"), 0.0, 0.0)], "x double, y double, z double")
    v, t = mesh.build_mesh(df, 5, 0.3)
    got = np.array([tuple(r) for r in v.select("x", "y", "z", "nx", "ny", "nz").collect()])
    assert abs(max(weights) - 3000) < 1e-3
    assert t.count() > 500 and abs(np.median(np.linalg.norm(got[:, :3], axis=1)) - 1) < 0.1
    assert ((got[:, :3] * got[:, 3:]).sum(1) > 0).mean() > 0.95


def test_weights_of_cells(spark):
    rng = np.random.default_rng(1)
    p, n = rng.uniform(0, 1, (200, 3)), rng.normal(size=(200, 3))
    df = spark.createDataFrame([tuple(map(float, r)) for r in np.hstack([p, n])], "x double, y double, z double, nx double, ny double, nz double")
    origin, step = mesh._lattice(p.min(0), p.max(0), 8)
    cells = mesh.cell_sums(df, origin, step, 8).agg(*(F.sum(c) for c in ("w", "nx", "ny", "nz"))).first()
    assert np.allclose(np.array(cells) / mesh._ONE, [200, *n.sum(0)], atol=1e-6)

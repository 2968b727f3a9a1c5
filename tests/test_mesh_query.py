"""The mesh query and the bound of its depth."""

import numpy as np
import pytest

from pointloom.operators import mesh
from pointloom.plans import registry


def test_a_depth_above_the_bound_is_an_error():
    p = np.random.default_rng(0).normal(size=(200, 3))
    with pytest.raises(ValueError, match="depth 9"):
        mesh.reconstruct(p / np.linalg.norm(p, axis=1, keepdims=True), 9, 0.5)


def test_the_query_gives_triangles_of_its_vertices(spark):
    rows = registry.mesh(spark, "/root/testdata/sf0.001").collect()
    n = {r.vid for r in rows if r.part == "vertex"}
    triangles = [(r.a, r.b, r.c) for r in rows if r.part == "triangle"]
    assert triangles and {v for t in triangles for v in t} == n


def test_orientation_follows_the_tree_and_dense_points_take_little_memory():
    import tracemalloc

    rng = np.random.default_rng(1)
    p = rng.normal(size=(4000, 3))
    p /= np.linalg.norm(p, axis=1, keepdims=True)
    mixed = p * np.where(rng.random(4000) < 0.5, 1, -1)[:, None]
    tracemalloc.start()
    out = mesh.orient_normals(p, mixed, 1.0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert ((out * p).sum(1) > 0).all()
    assert peak < 250e6  # 1,158 MB when all pairs were held at once

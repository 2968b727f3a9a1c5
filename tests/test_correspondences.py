"""Correspondences kept between rounds are those of a new search, and few searches are made."""

import numpy as np
from pyspark.sql import functions as F

from pointloom.config import IcpConfig
from pointloom.functions import geometry as G
from pointloom.operators import registration
from pointloom.operators.neighbors import nearest_within
from pointloom.operators.voxel import KEYS


def clouds(spark, *ps):
    rows = [(c, i, 0, 0, *map(float, q)) for c, p in enumerate(ps) for i, q in enumerate(p)]
    return spark.createDataFrame(rows, f"cloud int, {', '.join(f'{k} long' for k in KEYS)}, x double, y double, z double")


def test_kept_ones_are_those_of_a_new_search(spark, monkeypatch):
    rng = np.random.default_rng(0)
    df = clouds(spark, rng.uniform(0, 1, (800, 3)), rng.uniform(0, 1, (700, 3)), rng.uniform(0, 1.2, (600, 3)))
    asked, plain = [], registration.neighbours
    monkeypatch.setattr(registration, "neighbours", lambda *a, **k: asked.append(k.get("few", False)) or plain(*a, **k))
    ends = {0: (1, 0), 1: (2, 0)}
    met = registration._Correspondences(df, df, ends, [])
    for turn, distance in ((0.3, 0.2), (0.3001, 0.2), (0.3002, 0.05), (0.31, 0.1), (0.9, 0.1), (0.9, 0.1)):
        t = {p: G.rigid(G.rotation("z", turn), (turn / 100, 0, 0)) for p in ends}
        got = {(r.pair, round(r.s_x, 9), round(r.s_y, 9)): (r.t_x, r.t_y, r.t_z, r.d2) for r in met.met(t, distance).collect()}
        want = {}
        for p, (a, b) in ends.items():
            moved = registration.transformed(df.where(F.col("cloud") == a), t[p])
            for r in nearest_within(moved, df.where(F.col("cloud") == b), distance, KEYS, KEYS).collect():
                want[p, round(r.s_x, 9), round(r.s_y, 9)] = (r.t_x, r.t_y, r.t_z, r.d2)
        assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-12) for k in want)
    assert asked.count(False) <= 3 and True in asked


def test_small_motions_need_one_search(spark, monkeypatch):
    p = np.random.default_rng(3).uniform(-3, 3, (500, 3))
    m = G.rigid(G.rotation("z", 1e-3), (2e-3, -1e-3, 1e-3))
    asked, plain = [], registration.neighbours
    monkeypatch.setattr(registration, "neighbours", lambda *a, **k: asked.append(k.get("few", False)) or plain(*a, **k))
    df = clouds(spark, p, (p - m[:3, 3]) @ m[:3, :3])
    found = registration.pairwise_icp(df, [(1, 0, np.eye(4))], "cloud", IcpConfig(voxel=0.01), polish=True)[0]
    assert np.abs(found[0] - m).max() < 1e-12 and found[1] == 1 and asked.count(False) == 1

"""Moving one cloud against another: by hand, by picks, by chaining slices again; sampling, plane samples."""

import numpy as np
from pyspark.sql import functions as F

from pointloom.config import IcpConfig, SliceConfig
from pointloom.functions import geometry as G
from pointloom.operators import outliers, registration


def cloud(spark, p, **more):
    df = spark.createDataFrame([(i, *map(float, q)) for i, q in enumerate(p)], "id long, x double, y double, z double")
    return df.withColumns({k: F.lit(v) for k, v in more.items()})


def test_moves_by_hand():
    scene, right, forward = G.rotation("z", 0.5), (0.0, -1.0, 0.0), (1.0, 0.0, 0.0)
    m = G.rigid(G.rotation("x", 0.2), (1, 2, 3))
    got = G.moved_in_view(m, right, forward, 10, 4, 2.0)
    assert np.allclose(got[:3, :3], m[:3, :3]) and np.allclose(got[:3, 3] - m[:3, 3], [0, 0.2, -0.08])
    assert np.allclose(scene @ (G.moved_in_view(m, right, forward, 10, 4, 2.0, scene)[:3, 3] - m[:3, 3]), [0, 0.2, -0.08])
    assert np.allclose(G.pushed(m, forward, 3.0)[:3, 3], [2.5, 2, 3]) and np.allclose(G.pushed(m, forward, 3.0, away=False)[:3, 3], [-0.5, 2, 3])
    c = np.array([0.3, -1, 2, 1])
    turned = G.turned_in_view(m, c[:3], right, 0.3, -0.2, scene)
    assert np.allclose(turned @ c, m @ c)
    assert np.allclose(turned[:3, :3] @ m[:3, :3].T, G.axis_angle(scene.T @ right, -0.2) @ G.rotation("z", 0.3))


def test_picks_and_hands_give_a_known_motion(spark):
    p = np.random.default_rng(0).uniform(-3, 3, (80, 3))
    m = G.rigid(G.rotation("y", 2.0), (5, 1, -4))
    q = p @ m[:3, :3].T + m[:3, 3]
    clouds = cloud(spark, p, cloud=0).union(cloud(spark, q, cloud=1))
    rough = q + np.random.default_rng(1).normal(0, 0.002, q.shape)
    picks = cloud(spark, p[:5], cloud=0).union(cloud(spark, rough[:5], cloud=1)).withColumnRenamed("id", "pair_idx")
    assert np.allclose(registration.align_by_pairs(clouds, picks, 0, 1, voxel=0.02), m, atol=1e-6)
    hand = G.rigid(G.rotation("z", 0.003), (0.01, 0, 0)) @ m
    found, fitness, rmse = registration.refine_moved(clouds, hand, 0, 1, voxel=0.02)
    assert np.allclose(found, m, atol=1e-6) and fitness == 1 and rmse < 1e-6


def test_slices_that_share_too_little_with_the_reference_are_chained_again(spark):
    p = np.random.default_rng(3).uniform(-3, 3, (200, 3))
    sliced, true = None, {}
    for s, (a, b) in enumerate(((0, 140), (40, 130), (90, 180), (132, 200))):
        true[s] = G.rigid(G.rotation("z", 0.002 * s), (0.01 * s, 0, 0))
        back = np.linalg.inv(true[s])
        own = cloud(spark, p[a:b] @ back[:3, :3].T + back[:3, 3], slice=s)
        sliced = own if sliced is None else sliced.union(own)
    cfg = IcpConfig(voxel=0.02)
    direct = registration.pairwise_icp(sliced, [(3, 0, np.eye(4))], cfg=cfg)[0]
    assert direct[1] < 0.3
    found, rejected = registration.align_slices(sliced, SliceConfig(), cfg)
    assert not rejected and all(np.allclose(found[s], true[s], atol=1e-6) for s in true)
    _, rejected = registration.align_slices(sliced, SliceConfig(chain=False), cfg)
    assert rejected == [3]


def test_samples_are_exact_and_repeat(spark):
    df = spark.range(0, 30_000, 1, 7).select("id", *(F.col("id").cast("double").alias(c) for c in "xyz"))
    one, two = (sorted(r.id for r in outliers.sample_points(df, 1000, 3).collect()) for _ in range(2))
    assert one == two and len(set(one)) == 1000 and outliers.sample_points(df.limit(5), 1000).count() == 5

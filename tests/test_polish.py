"""Alignment of dense slices isn't pulled off by points whose partners are missing, and ties of the encoder are ordered."""

import numpy as np
from pyspark.sql import functions as F

from pointloom.config import DeskewConfig, IcpConfig, SliceConfig
from pointloom.functions import geometry as G
from pointloom.operators import registration
from pointloom.plans import pipelines


def test_strangers_do_not_pull_a_slice_off(spark):
    rng = np.random.default_rng(5)
    scene = rng.uniform(-0.15, 0.15, (6000, 3))
    motion = G.rigid(G.rotation("z", 1e-3), (2e-4, -1e-4, 1e-4))
    own = (scene[rng.random(6000) < 0.7] - motion[:3, 3]) @ motion[:3, :3]
    rows = [(0, *map(float, p)) for p in scene[rng.random(6000) < 0.7]] + [(1, *map(float, p)) for p in own]
    sliced = spark.createDataFrame(rows, "slice int, x double, y double, z double")
    found, _ = registration.align_slices(sliced, SliceConfig(chain=False), IcpConfig(voxel=0.001))
    ref = 0 if np.array_equal(found[0], np.eye(4)) else 1
    want = motion if ref == 0 else np.linalg.inv(motion)
    assert np.abs(found[1 - ref] - want).max() < 1e-9


def test_samples_of_one_time_go_by_their_ties(spark):
    rows = [(k, 10**9 * (k // 2), 0.1 * (k % 5)) for k in range(40)]
    encoder = spark.createDataFrame(rows, "event_id long, t_ns long, angle double")
    points = spark.createDataFrame([(k, 0, 10**9 * k + 5 * 10**8, 1.0, 2.0, 3.0) for k in range(19)], "frame_id long, pt_idx int, stamp_ns long, x double, y double, z double")
    cfg = DeskewConfig(rotation_center=(0.0, 0.0, 0.0), mount_rpy_deg=(0.0, 0.0, 0.0))
    each = []
    for order in ("event_id", F.desc("event_id")):
        out = pipelines.sliced(points, encoder.orderBy(order), SliceConfig(overlap=1.0), cfg, ties=["event_id"])
        each.append({r.frame_id: (r.y, r.z) for r in out.collect()})
    # From the later sample of a second to the earlier one of the next.
    for k in range(19):
        a = -(0.1 * ((2 * k + 1) % 5) + 0.1 * ((2 * k + 2) % 5)) / 2
        want = (2 * np.cos(a) - 3 * np.sin(a), 2 * np.sin(a) + 3 * np.cos(a))
        assert all(np.allclose(e[k], want, atol=1e-5) for e in each)

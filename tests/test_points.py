"""Point operators: invariants and small cases worked out by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.config import DeskewConfig, IcpConfig, PlaneConfig, SliceConfig
from pointloom.functions import geometry as G
from pointloom.functions.grid import Grid, downsample
from pointloom.operators import filters, imu, mesh, neighbors, outliers, planes, registration, slicing, voxel
from pointloom.operators.deskew import deskew, deskewed
from pointloom.plans import pipelines


def cloud(spark, p, **more):
    rows = [(i, *map(float, q)) for i, q in enumerate(np.asarray(p, float))]
    df = spark.createDataFrame(rows, "id long, x double, y double, z double")
    return df.withColumns({k: F.lit(v) for k, v in more.items()})


def array(df, order="id"):
    return np.array([tuple(r) for r in df.orderBy(order).select("x", "y", "z").collect()])


def room(n=4000, noise=0.0, seed=0):
    rng = np.random.default_rng(seed)
    p = rng.uniform(-1, 1, (n, 3)) * [2, 1.5, 1]
    side, axis = rng.integers(0, 2, n) * 2 - 1, rng.integers(0, 3, n)
    p[np.arange(n), axis] = side * np.array([2, 1.5, 1])[axis] + rng.normal(0, noise, n)
    return p


def test_deskew_by_a_constant_angle_is_rigid(spark):
    p = np.random.default_rng(0).normal(size=(30, 3))
    for axis in "xyz":
        cfg = DeskewConfig(axis, 20.0, (0.1, 0.2, 0.3), True, mount_rpy_deg=(3, 5, 7), mount_axes=("-y", "+x", "+z"))
        x, y, z = deskewed(G.xyz(), F.lit(0.7), cfg)
        got = array(cloud(spark, p).select("id", x.alias("x"), y.alias("y"), z.alias("z")))
        d = lambda a: np.linalg.norm(a[:, None] - a[None], axis=-1)
        assert np.allclose(d(got), d(p))


def test_deskew_without_turning_is_identity(spark):
    p = np.random.default_rng(1).normal(size=(20, 3))
    x, y, z = deskewed(G.xyz(), F.lit(0.0), DeskewConfig(mount_axes=("+z", "-x", "-y")))
    assert np.allclose(array(cloud(spark, p).select("id", x.alias("x"), y.alias("y"), z.alias("z"))), p)


def test_deskew_needs_an_encoder(spark):
    with pytest.raises(ValueError):
        deskew(cloud(spark, np.ones((1, 3)), stamp_ns=0), spark.createDataFrame([], "t_ns long, angle double"))


def test_axis_names_must_be_a_permutation():
    with pytest.raises(ValueError):
        G.axis_matrix(("+x", "-x", "+z"))


def test_ranges_are_strict_and_inclusive_and_drop_nan(spark):
    p = [[0.5, 0, 0], [80, 0, 0], [1, 0, 0], [float("nan"), 0, 0], [float("inf"), 0, 0]]
    assert [r.id for r in filters.range_strict(cloud(spark, p)).collect()] == [2]
    assert [r.id for r in filters.range_inclusive(cloud(spark, p), 0.5, 80).orderBy("id").collect()] == [0, 1, 2]


def test_voxels(spark):
    p = np.random.default_rng(2).uniform(-1, 1, (500, 3)).astype(np.float32)
    first = voxel.voxel_first(cloud(spark, p), 0.3, ["id"])
    key = np.floor(p / np.float32(0.3))
    want = np.unique(key, axis=0, return_index=True)[1]
    assert sorted(r.id for r in first.collect()) == sorted(want.tolist())
    again = voxel.voxel_first(first.select("id", "x", "y", "z"), 0.3, ["id"])
    assert again.count() == first.count()
    mean = voxel.voxel_centroid(cloud(spark, p), 0.3)
    got = np.array(sorted(tuple(r) for r in mean.select("x", "y", "z").collect()))
    assert np.allclose(got, np.array(sorted(map(tuple, downsample(p.astype(float), 0.3)))))
    assert voxel.voxel_first(cloud(spark, p), 0, ["id"]).count() == 500


def test_slices_cover_each_phase_twice_and_core_once_but_for_borders(spark):
    ph = np.linspace(0, 2 * math.pi, 97, endpoint=False) + 0.001
    df = spark.createDataFrame([(i, float(a)) for i, a in enumerate(ph)] + [(1000, math.pi / 12)], "id long, phase double")
    rows = slicing.angular_slices(df, 12, 2.0).collect()
    for i in range(97):
        own = [r for r in rows if r.id == i]
        assert len(own) == 2 and sum(r.is_core for r in own) == 1
    assert sum(r.is_core for r in rows if r.id == 1000) == 0


def test_neighbours_match_brute_force(spark):
    rng = np.random.default_rng(3)
    a, b = rng.uniform(0, 1, (60, 3)), rng.uniform(0, 1, (80, 3))
    d = np.linalg.norm(a[:, None] - b[None], axis=-1)
    got = {r.id: r.t_id for r in neighbors.nearest_within(cloud(spark, a), cloud(spark, b), 0.2, ["id"], ["id"]).collect()}
    assert got == {i: int(d[i].argmin()) for i in range(60) if d[i].min() <= 0.2}
    index, _ = Grid(b, 0.2).nearest(a, 0.2)
    assert {i: int(j) for i, j in enumerate(index) if j >= 0} == got
    e = np.linalg.norm(a[:, None] - a[None], axis=-1)
    knn = neighbors.knn(cloud(spark, a), 6, ["id"], 0.05).collect()
    for i in range(60):
        assert [r.t_id for r in sorted((r for r in knn if r.id == i), key=lambda r: r.rank)] == np.argsort(e[i], kind="stable")[:6].tolist()


def test_kabsch_recovers_a_motion_and_refuses_lines(spark):
    p = np.random.default_rng(4).normal(size=(10, 3))
    m = G.rigid(G.euler_zyx((10, -20, 30)), (1, 2, 3))
    q = p @ m[:3, :3].T + m[:3, 3]
    pairs = spark.createDataFrame([(*map(float, a), *map(float, b)) for a, b in zip(p, q, strict=True)], "s_x double, s_y double, s_z double, t_x double, t_y double, t_z double")
    assert np.allclose(registration.kabsch(pairs), m)
    with pytest.raises(ValueError):
        registration.kabsch(pairs.limit(2))
    line = spark.createDataFrame([(float(i), 0.0, 0.0, 0.0, float(i), 0.0) for i in range(5)], pairs.schema)
    with pytest.raises(ValueError):
        registration.kabsch(line)


def test_icp_undoes_a_small_motion(spark):
    p = room(3000)
    m = G.rigid(G.euler_zyx((0.5, -0.4, 0.8)), (0.02, -0.015, 0.01))
    q = p @ m[:3, :3].T + m[:3, 3]
    both = cloud(spark, p, slice=0).union(cloud(spark, q, slice=1))
    t, fitness, rmse = registration.pairwise_icp(both, [(0, 1, np.eye(4))])[0]
    assert fitness > 0.95 and np.allclose(t, m, atol=0.02)
    t, fitness, rmse = registration.icp(cloud(spark, p[:600]), cloud(spark, q[:600]), 0.3, ["id"], iterations=15)
    assert np.allclose(t, m, atol=0.02)


def test_slices_are_aligned_around_the_circle(spark):
    p = room(6000, seed=5)
    parts, rng = None, np.random.default_rng(6)
    for s in range(4):
        q = p[rng.permutation(len(p))[:4000]] + [0.02 * s, -0.01 * s, 0.0]
        one = cloud(spark, q[: 4000 - 100 * s], slice=s)
        parts = one if parts is None else parts.union(one)
    parts = parts.persist()
    t, rejected = registration.align_slices(parts, SliceConfig(), IcpConfig())
    assert not rejected
    for s in range(4):
        assert np.allclose(t[s][:3, 3], [-0.02 * s, 0.01 * s, 0], atol=0.015)
    t, rejected = registration.align_slices(parts, SliceConfig(chain=False, min_fitness=1.01), IcpConfig())
    assert set(t) == {0} and rejected == [1, 2, 3]


def test_planes_of_a_noisy_room(spark):
    found = planes.find_planes(cloud(spark, room(9000, 0.005)), PlaneConfig(min_points=500, iterations=200)).collect()
    assert len(found) == 3
    assert all(abs(r.rms - 0.005) < 0.002 and r.p95 < 0.02 for r in found)


def test_report_over_clouds(spark):
    p = room(5000, 0.002)
    both = cloud(spark, p, cloud="a").union(cloud(spark, p + [0.01, 0, 0], cloud="b"))
    found, repeat = pipelines.evaluate(both, PlaneConfig(min_points=400, iterations=100))
    assert {r.cloud for r in found.collect()} == {"a", "b"}
    row = repeat.first()
    assert row.verdict == "good" and np.allclose(np.array(row.transformation).reshape(4, 4)[:3, 3], [-0.01, 0, 0], atol=0.005)


def test_outliers_leave(spark):
    p = np.vstack([np.random.default_rng(7).normal(0, 0.1, (200, 3)), [[5, 5, 5]]])
    kept = {r.id for r in outliers.remove_outliers(cloud(spark, p), ["id"]).collect()}
    assert 200 not in kept and len(kept) > 150


def test_tilt(spark):
    g = G.axis_angle((0, 0, 1), 0.2) @ np.array([9.8, 0, 0])
    rows = spark.createDataFrame([(i, *map(float, g)) for i in range(20)], "log_time_ns long, ax double, ay double, az double")
    assert np.allclose(imu.tilt_matrix(rows) @ g, [9.8, 0, 0])
    assert np.allclose(imu.tilt_matrix(rows.limit(9)), np.eye(3))


def test_mesh_of_a_sphere(spark):
    v = np.random.default_rng(8).normal(size=(3000, 3))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    p, n, t = mesh.reconstruct(v, 5, 0.3)
    size = np.linalg.norm(p, axis=1)
    assert len(t) > 500 and abs(np.median(size) - 1) < 0.1
    assert ((p * n).sum(1) > 0).mean() > 0.95


def test_normals_of_a_plane(spark):
    p = np.random.default_rng(9).uniform(0, 1, (300, 3)) * [1, 1, 0]
    n = neighbors.estimate_normals(cloud(spark, p), ("id",), 0.2)
    assert all(abs(abs(r.nz) - 1) < 1e-6 for r in n.collect())


def test_world_map_and_slices_end_to_end(spark):
    rng = np.random.default_rng(10)
    t = np.arange(0, 12_000_000_000, 20_000_000)
    angle = (t / 1e9 * 2 * math.pi / 10 + math.pi) % (2 * math.pi) - math.pi
    enc = spark.createDataFrame([(int(a), float(b)) for a, b in zip(t, angle, strict=True)], "t_ns long, angle double")
    rows = []
    p = room(400, seed=11)
    cfg = DeskewConfig(rotation_center=(0, 0, 0), mount_rpy_deg=(0, 0, 0))
    for f in range(1, 100):
        stamp = f * 100_000_000 + 1
        a = np.interp(stamp, t, np.unwrap(angle))
        own = p[rng.integers(0, len(p), 20)] @ G.rotation("x", a).T  # what the turning sensor sees
        rows += [(f, i, stamp, *map(float, q)) for i, q in enumerate(own)]
    points = spark.createDataFrame(rows, "frame_id long, pt_idx int, stamp_ns long, x double, y double, z double")
    out = pipelines.world_map(points, enc, deskew_cfg=cfg)
    got = np.array([tuple(r) for r in out.select("x", "y", "z").collect()])
    index, _ = Grid(p, 0.05).nearest(got, 0.05)
    assert len(got) and (index >= 0).all()
    assert pipelines.world_map(points.withColumn("stamp_ns", F.lit(-1)), enc, deskew_cfg=cfg).count() == 0
    merged, transforms, rejected = pipelines.slice_and_merge(points, enc, SliceConfig(slices=4), deskew_cfg=cfg)
    assert merged.count() > 50 and len(transforms) == 4

"""Files written by many tasks are those that one stream of bytes would give."""

import numpy as np
import pytest

from pointloom.sources import in_place, ranges
from pointloom.sources.codecs import ENCODERS, encode_e57
from pointloom.sources.points import SCHEMA, write_points


def table(spark, p):
    return spark.createDataFrame([(i, *map(float, q)) for i, q in enumerate(p)], "id long, x double, y double, z double").repartition(5)


@pytest.mark.parametrize("n", [0, 1, 4000, 9001])
def test_same_bytes_as_one_stream(spark, tmp_path, monkeypatch, n):
    monkeypatch.setattr(in_place, "PIECE", 4000)
    p = np.random.default_rng(n).normal(size=(n, 3)).astype(np.float32).astype(float) * 10
    s = {"n": n} | {f"{m}_{c}": (float(f(p[:, i])) if n else None) for m, f in (("min", np.min), ("max", np.max)) for i, c in enumerate("xyz")}
    df = table(spark, p)
    for fmt in ("e57", "pcd", "ply", "pts", "xyz", "las"):
        data = open(write_points(df, str(tmp_path / f"{n}.{fmt}"), order=["id"]), "rb").read()
        if fmt == "las":  # offsets are sums in any order
            assert len(data) == 375 + 20 * n
            continue
        whole = encode_e57(p) if fmt == "e57" else ENCODERS[fmt].head(n, s) + ENCODERS[fmt].body(p, s) + ENCODERS[fmt].tail
        assert data == whole, fmt
    assert not [f for f in tmp_path.iterdir() if f.name.endswith(".part")]


@pytest.mark.parametrize("fmt", ["xyz", "pts", "pcd", "ply", "las"])
def test_ranges_give_every_point_once(spark, tmp_path, monkeypatch, fmt):
    monkeypatch.setattr(ranges, "POINTS", 700)
    monkeypatch.setattr(ranges, "BYTES", 3000)
    p = np.random.default_rng(1).normal(size=(5001, 3)).round(3).astype(np.float32).astype(float)
    path = write_points(table(spark, p), str(tmp_path / f"a.{fmt}"), order=["id"])
    df, others = ranges.read_ranges(spark, ["file://" + path], SCHEMA)
    got = df.orderBy("pt_idx").collect()
    assert not others and [r["pt_idx"] for r in got] == list(range(5001))
    assert np.abs(np.array([r[2:] for r in got]) - p).max() <= 0.0006


def test_lines_of_any_width(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ranges, "BYTES", 7)
    lines = ["VERSION 0.7", "FIELDS i y x z", "SIZE 4 4 4 4", "TYPE U F F F", "COUNT 2 1 1 1", "WIDTH 4", "HEIGHT 1", "POINTS 4", "DATA ascii"]
    rows = [f"{i} 0 {i}.5 {'0' * i}{i} -{i}" for i in range(6)]  # two more than the head says
    (tmp_path / "a.pcd").write_text("\n".join(lines + rows))
    df, _ = ranges.read_ranges(spark, [f"file://{tmp_path}/a.pcd"], SCHEMA)
    assert [tuple(r) for r in df.orderBy("pt_idx").collect()] == [("a", i, float(i), i + 0.5, float(-i)) for i in range(4)]

"""What a point in a dense cell costs follows k, not the points within the radius; groups of any density get widths."""

import numpy as np
import pyarrow as pa
import pytest

from pointloom.operators import neighbors


def _block(p):
    """Points of one cell of width 1 as sources and targets of a block."""
    n = len(p)
    numbers = {f"_b{c}": np.zeros(2 * n, np.int64) for c in "xyz"} | {f"_{c}": np.tile(p[:, i], 2) for i, c in enumerate("xyz")}
    ids = pa.StructArray.from_arrays([pa.array(np.tile(np.arange(n), 2))], ["t_id"])
    return pa.table(numbers | {"_cell": np.full(2 * n, 555), "_r2": np.repeat([1.0, 0.0], n), "_target": np.repeat([False, True], n), "_t": ids})


@pytest.mark.parametrize("ranked", [True, False])
def test_a_dense_cell_is_searched_in_narrow_rings(monkeypatch, ranked):
    rng = np.random.default_rng(4)
    p = np.repeat(4.5 + rng.normal(size=(600, 3)) * 0.05, 2, axis=0)  # copies, so that distances tie
    d2 = (p[:, None, 0] - p[None, :, 0]) ** 2 + (p[:, None, 1] - p[None, :, 1]) ** 2 + (p[:, None, 2] - p[None, :, 2]) ** 2
    near = np.argsort(d2, axis=1, kind="stable")[:, :7]
    met, first_k = [], neighbors._first_k
    monkeypatch.setattr(neighbors, "_first_k", lambda who, *a: (met.append(len(who)), first_k(who, *a))[1])
    more = () if ranked else (False,)
    got = [np.concatenate(x) for x in zip(*neighbors._search(_block(p), ["_bx", "_by", "_bz"], ["id"], 7, *more), strict=True)]
    s, t, rank = got[0], got[1] - len(p), got[3]
    if ranked:
        assert set(zip(s, t, rank, strict=True)) == {(i, j, r + 1) for i in range(len(p)) for r, j in enumerate(near[i])}
    assert sorted(zip(s, t, strict=True)) == sorted((i, j) for i in range(len(p)) for j in near[i])
    assert sum(met) < 10 * 7 * len(p)  # 1,200 * 1,200 pairs are within the radius


def test_widths_of_groups_that_only_narrow_cells_suit(spark):
    rng = np.random.default_rng(5)
    rows = [(g, g * 1000 + i, *map(float, x)) for g, size in ((0, 1.0), (1, 1e-3)) for i, x in enumerate([*(rng.normal(size=(300, 3)) * size), (50.0, 50.0, 50.0)])]
    df = spark.createDataFrame(rows, "g int, id long, x double, y double, z double")
    widths = {r.g: (r._h, r._want) for r in neighbors.cell_widths(df, 3, ["g"]).collect()}
    assert widths[0][0] > 0.1 and widths[1][0] < 1e-2 and {w for _, w in widths.values()} == {3}
    assert neighbors.cell_widths(df.where("g = 1"), 3).first()._h == widths[1][0]
    got = {(r.id, r.t_id, r.rank) for r in neighbors.knn(df, 3, ["id"], by=["g"]).collect()}
    for g in (0, 1):
        ids, p = np.array([r[1] for r in rows if r[0] == g]), np.array([r[2:] for r in rows if r[0] == g])
        near = np.argsort(((p[:, None] - p[None]) ** 2).sum(2), axis=1, kind="stable")[:, :3]
        assert {(i, int(ids[j]), r + 1) for i, of in zip(ids.tolist(), near, strict=True) for r, j in enumerate(of)} == {x for x in got if x[0] // 1000 == g}

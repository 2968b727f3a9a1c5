"""Surface reconstruction from all points: oriented normals, a grid Poisson solve, tetrahedra.

Spark searches normals and nearest neighbours, orients the normals along a spanning tree that grows in blocks of
points and sums them up by cell. The driver gets the cells: the Poisson equation is solved by FFT on
a regular grid of 2**depth cells a side, which bounds ``depth`` at 8 (7 by default); a larger one is an error. The level set is cut out of the
grid by marching tetrahedra.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.functions.geometry import doubles, finite, xyz
from pointloom.functions.grid import Grid
from pointloom.functions.storage import broadcast_if_small, discard, materialize
from pointloom.operators.neighbors import estimate_normals, knn_within

MAX_DEPTH = 8
#: Points of a block in which trees grow first, on average, and how many blocks go into one of the next round (in bits).
BLOCK_POINTS, BLOCK_BITS = 20_000, 4
#: Weights are summed as whole numbers of this share, so that a sum doesn't depend on its order.
_ONE = 2**32


_CORNERS = [(i, j, k) for i in (0, 1) for j in (0, 1) for k in (0, 1)]
#: Points whose neighbours are searched together.
_POINTS = 250


def orient_normals(points: np.ndarray, normals: np.ndarray, radius: float, k: int = 10) -> np.ndarray:
    """``orient_along`` each point's ``k`` nearest within ``radius``, searched in pieces."""
    grid, ends = Grid(points, radius), []
    for low in range(0, len(points), _POINTS):
        who, near, _ = grid.pairs(points[low : low + _POINTS], radius)
        first = np.searchsorted(who, np.arange(len(points[low : low + _POINTS])))
        on = np.arange(len(who)) - first[who] <= k
        ends.append(np.stack([who[on] + low, near[on]]))
    return orient_along(points, normals, *(np.concatenate(ends, 1) if ends else np.zeros((2, 0), int)))


def _trees(n: int, a: np.ndarray, b: np.ndarray, turned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tree of each of ``n`` points and its turn against the tree's root; edges from ``a`` to ``b`` come best first.

    Trees grow together by their best edges (Boruvka). An end ``n`` is outside: a tree whose best edge goes there
    doesn't grow by itself, so all that do are part of the spanning tree of a larger graph.
    """
    tree, turn = np.arange(n + 1), np.zeros(n + 1, bool)
    while True:
        ta, tb = tree[a], tree[b]
        live = ta != tb
        a, b, turned, ta, tb = a[live], b[live], turned[live], ta[live], tb[live]
        best = np.full(n + 1, len(a))
        np.minimum.at(best, ta, np.arange(len(a)))
        np.minimum.at(best, tb, np.arange(len(a)))
        root = np.flatnonzero(best[:n] < len(a))
        root = root[(ta[best[root]] < n) & (tb[best[root]] < n)]
        if not len(root):
            return tree[:n], turn[:n]
        e = best[root]
        up, flip = np.arange(n + 1), np.zeros(n + 1, bool)
        up[root] = ta[e] + tb[e] - root
        flip[root] = turned[e] ^ turn[a[e]] ^ turn[b[e]]
        both = root[(up[up[root]] == root) & (root < up[root])]  # two trees with the same best edge
        up[both], flip[both] = both, False
        while (up != up[up]).any():
            flip, up = flip ^ flip[up], up[up]
        tree, turn = up[tree], turn ^ flip[tree]


def orient_along(points: np.ndarray, normals: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Flip normals to agree along a minimum spanning tree of the edges from ``a`` to ``b``, most parallel first.

    The highest point of each tree is made to point up. Memory is a few numbers an edge.
    """
    # In pieces, since products of all edges' normals would take six numbers an edge.
    dot = np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", normals[a[i : i + 10**6]], normals[b[i : i + 10**6]]) for i in range(0, len(a), 10**6))])
    by = np.argsort(-np.abs(dot), kind="stable")
    a, b, turned = a[by].astype(np.int32), b[by].astype(np.int32), dot[by] < 0
    tree, turn = _trees(len(points), a, b, turned)
    high = np.argsort(-points[:, 2], kind="stable")
    roots, first = np.unique(tree[high], return_index=True)
    top, down = high[first], np.zeros(len(points), bool)
    down[roots] = (normals[top, 2] < 0) ^ turn[top]
    return np.where((turn ^ down[tree])[:, None], -normals, normals)


def _lattice(low: np.ndarray, high: np.ndarray, n: int) -> tuple[np.ndarray, float]:
    """The grid's origin and step; points are in its middle two thirds."""
    step = (float((high - low).max()) or 1.0) * 1.5 / n
    return low - (n * step - (high - low)) / 2, step


def poisson_field(points: np.ndarray, normals: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, float, float, np.ndarray]:
    """The indicator on a grid, the grid's origin and step, the level at the points, the points' density."""
    n = 2**depth
    origin, step = _lattice(points.min(0), points.max(0), n)
    at = (points - origin) / step
    base = np.floor(at).astype(int)
    field, density = np.zeros((3, n, n, n)), np.zeros((n, n, n))
    for c in _CORNERS:
        w = np.prod(np.where(np.array(c), at - base, 1 - (at - base)), axis=1)
        ix = tuple(np.clip(base + np.array(c), 0, n - 1).T)
        np.add.at(density, ix, w)
        for a in range(3):
            np.add.at(field[a], ix, w * normals[:, a])
    chi, level, soft = solve_field(field, density)
    return chi, origin, step, level, soft


def cell_sums(points: DataFrame, origin: np.ndarray, step: float, n: int) -> DataFrame:
    """Of each corner of the grid that points are next to: its number, their weight, their weighted normals."""
    at = [(c - float(o)) / step for c, o in zip(xyz(), origin, strict=True)]
    base = [F.floor(c) for c in at]
    corners = []
    for c in _CORNERS:
        i, w = ([b + k for b, k in zip(base, c, strict=True)], [a - b if k else 1 - (a - b) for a, b, k in zip(at, base, c, strict=True)])
        corners.append(F.struct(((i[0] * n + i[1]) * n + i[2]).alias("cell"), (w[0] * w[1] * w[2]).alias("w")))
    each = points.select("nx", "ny", "nz", F.explode(F.array(*corners)).alias("_c")).select("_c.*", "nx", "ny", "nz")
    whole = [F.sum(F.round(v * _ONE).cast("long")).alias(k) for k, v in {"w": F.col("w"), **{c: F.col("w") * F.col(c) for c in ("nx", "ny", "nz")}}.items()]
    return each.groupBy("cell").agg(*whole)


def solve_field(field: np.ndarray, density: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """The indicator, its mean at the points, whose weights are in ``density``, and the softened density."""
    n = len(density)
    f = 2 * np.pi * np.fft.fftfreq(n)
    kx, ky, kz = np.meshgrid(f, f, 2 * np.pi * np.fft.rfftfreq(n), indexing="ij")
    k2 = kx**2 + ky**2 + kz**2
    k2[0, 0, 0] = 1
    spread = np.exp(-k2 * 1.5)  # a little smoothing
    hat = sum(1j * k * np.fft.rfftn(field[a]) for a, k in enumerate((kx, ky, kz))) * spread
    chi = np.fft.irfftn(-hat / k2, s=(n, n, n), axes=(0, 1, 2))
    level = float((density * chi).sum() / density.sum())
    soft = np.fft.irfftn(np.fft.rfftn(density) * spread, s=(n, n, n), axes=(0, 1, 2))
    return chi, level, soft


# The six tetrahedra of a cell around its diagonal, as corner numbers x + 2 y + 4 z.
_TETRAHEDRA = ((0, 1, 3, 7), (0, 3, 2, 7), (0, 2, 6, 7), (0, 6, 4, 7), (0, 4, 5, 7), (0, 5, 1, 7))


def marching_tetrahedra(f: np.ndarray, level: float) -> tuple[np.ndarray, np.ndarray]:
    """Vertices (in grid units) and triangles of the level set."""
    n = np.array(f.shape)
    above = f > level
    cell = np.zeros(n - 1, int)
    for c in range(8):
        i, j, k = c & 1, c >> 1 & 1, c >> 2
        cell += above[i : n[0] - 1 + i, j : n[1] - 1 + j, k : n[2] - 1 + k]
    base = np.argwhere((cell > 0) & (cell < 8))
    offset = np.array([[c & 1, c >> 1 & 1, c >> 2] for c in range(8)])
    ids = ((base[:, None] + offset) @ np.array([n[1] * n[2], n[2], 1])).astype(np.int64)
    flat = f.ravel()
    edges = []
    for t in _TETRAHEDRA:
        v = ids[:, t]
        inside = flat[v] > level
        count = inside.sum(1)
        order = np.argsort(~inside, axis=1, kind="stable")
        v = np.take_along_axis(v, order, 1)
        for need, faces in ((1, [((0, 1), (0, 2), (0, 3))]), (3, [((3, 0), (3, 1), (3, 2))]), (2, [((0, 2), (0, 3), (1, 3)), ((0, 2), (1, 3), (1, 2))])):
            on = v[count == need]
            for face in faces:
                edges.append(np.stack([np.sort(on[:, e], 1) for e in face], 1))
    edges = np.concatenate(edges) if edges else np.zeros((0, 3, 2), np.int64)
    unique, where = np.unique(edges[..., 0].ravel() * f.size + edges[..., 1].ravel(), return_inverse=True)
    unique = np.stack(np.divmod(unique, f.size), 1)
    a, b = flat[unique[:, 0]], flat[unique[:, 1]]
    p, q = (np.stack(np.unravel_index(unique[:, i], n), 1).astype(float) for i in (0, 1))
    share = np.divide(level - a, b - a, out=np.full(len(a), 0.5), where=a != b)
    vertices, triangles = p + share[:, None] * (q - p), where.reshape(-1, 3)
    triangles = triangles[(triangles[:, 0] != triangles[:, 1]) & (triangles[:, 1] != triangles[:, 2]) & (triangles[:, 0] != triangles[:, 2])]
    # Turn every triangle so that its normal points to lower values, which is outwards.
    c = vertices[triangles]
    middle = c.mean(1)
    grad = np.stack(np.gradient(f), -1)[tuple(np.clip(np.round(middle).astype(int), 0, n - 1).T)]
    flip = (np.cross(c[:, 1] - c[:, 0], c[:, 2] - c[:, 0]) * grad).sum(1) > 0
    triangles[flip] = triangles[flip][:, ::-1]
    return vertices, triangles


def reconstruct(points: np.ndarray, depth: int = 7, radius: float = 0.15, k: int = 30, orient_k: int = 10, cut: float = 0.10) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vertices, their normals, triangles; the ``cut`` share of vertices with least density is trimmed."""
    if depth > MAX_DEPTH:
        raise ValueError(f"depth {depth} is above {MAX_DEPTH}, which the grid bounds")
    normals = orient_normals(points, Grid(points, radius).normals(radius, k), radius, orient_k)
    return surface(*poisson_field(points, -normals, depth), cut)


def surface(chi: np.ndarray, origin: np.ndarray, step: float, level: float, density: np.ndarray, cut: float = 0.10) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The level set without the ``cut`` share of its vertices with least density; see ``reconstruct``."""
    v, t = marching_tetrahedra(chi, level)
    if not len(v):
        return v, v, t
    d = density[tuple(np.clip(np.round(v).astype(int), 0, density.shape[0] - 1).T)]
    keep = d >= np.quantile(d, cut)
    t = t[keep[t].all(1)]
    used = np.unique(t)
    place = np.full(len(v), -1)
    place[used] = np.arange(len(used))
    v, t = origin + v[used] * step, place[t]
    face = np.cross(v[t[:, 1]] - v[t[:, 0]], v[t[:, 2]] - v[t[:, 0]])
    n = np.stack([np.bincount(t.ravel(), np.repeat(face[:, i], 3), len(v)) for i in range(3)], 1)
    return v, n / np.maximum(np.linalg.norm(n, axis=1, keepdims=True), 1e-12), t


_EDGE = "a long, b long, lo long, hi long, w double, turned int, at_a int, at_b int"


def _grown(shift: int) -> Callable[[pa.Table], pa.Table]:
    """Grows the trees of a block from all edges of its nodes: rows of nodes (``part`` 0: the node ``a`` has the root ``b``),
    of edges between its trees (1), and of edges to other blocks, with its own end's root and turn (2 for ``a``, 3 for ``b``)."""

    def run(t: pa.Table) -> pa.Table:
        a, b, lo, hi, w, turned, at_a, at_b, key = (t[c].to_numpy() for c in ("a", "b", "lo", "hi", "w", "turned", "at_a", "at_b", "block"))
        by = np.lexsort((hi, lo, -w))
        by = by[np.append(True, (np.diff(lo[by]) != 0) | (np.diff(hi[by]) != 0))]  # each edge once
        a, b, lo, hi, w, turned, at_a, at_b = (x[by] for x in (a, b, lo, hi, w, turned, at_a, at_b))
        own = [x >> shift == key[0] for x in (at_a, at_b)]
        nodes = np.unique(np.concatenate([a[own[0]], b[own[1]]]))
        n = len(nodes)
        i, j = (np.where(o, np.searchsorted(nodes, x), n) for o, x in zip(own, (a, b), strict=True))
        tree, turn = _trees(n, i, j, turned > 0)
        tree, turn = np.append(tree, n), np.append(turn, False)
        roots = np.append(nodes, -1)[tree]
        a, b = np.where(own[0], roots[i], a), np.where(own[1], roots[j], b)
        turned = np.where(own[0], turned, 0) ^ turn[i] ^ turn[j]  # the turn of an edge is told by its first end
        part = np.where(own[0] & own[1], 1, np.where(own[0], 2, 3))
        left = np.flatnonzero(a != b)
        # Of edges between the same two the best.
        _, first = np.unique(np.sort(np.stack([a[left], b[left]]), axis=0), axis=1, return_index=True)
        e, none = left[first], np.zeros(n, np.int64)
        cols = [(none, part[e]), (nodes, a[e]), (roots[:n], b[e]), (none, lo[e]), (none, hi[e]), (none.astype(float), w[e]), (turn[:n], turned[e]), (none, at_a[e]), (none, at_b[e])]
        kinds = [pa.int32(), *[pa.int64()] * 4, pa.float64(), *[pa.int32()] * 3]
        return pa.table([pa.array(np.concatenate(c).astype(k.to_pandas_dtype()), k) for c, k in zip(cols, kinds, strict=True)], ["part", *(c.split()[0] for c in _EDGE.split(", "))])

    return run


def oriented(points: DataFrame, edges: DataFrame, blocks: int) -> DataFrame:
    """``points`` (id, block, x, y, z, nx, ny, nz) with normals as ``orient_along`` turns them, in Spark.

    ``edges`` are of ``_EDGE``: a point's number, its neighbour's, both again in order, how parallel, whether turned, and the
    blocks of both. In a block trees grow by edges that belong to the spanning tree of the whole; what is
    left are a few trees and edges, which meet in larger blocks, until all are in one.
    """
    ups, shift = [], 0
    while True:
        sides = F.expr(f"explode(CASE WHEN shiftright(at_a, {shift}) = shiftright(at_b, {shift}) THEN array(shiftright(at_a, {shift})) ELSE array(shiftright(at_a, {shift}), shiftright(at_b, {shift})) END)")
        grown = edges.select("*", sides.alias("block")).groupBy("block").applyInArrow(_grown(shift), f"part int, {_EDGE}")
        grown = materialize(grown, "trees")
        ups.append(grown.where("part = 0").select(F.col("a").alias("id"), F.col("b").alias("root"), (F.col("turned") > 0).alias("turn")))
        if not (blocks - 1) >> shift:
            break
        halves = grown.where("part > 1").groupBy("lo", "hi").agg(
            F.max(F.when(F.col("part") == 2, F.col("a"))).alias("a"), F.max(F.when(F.col("part") == 3, F.col("b"))).alias("b"),
            F.max("w").alias("w"), (F.sum("turned") % 2).cast("int").alias("turned"), F.max("at_a").alias("at_a"), F.max("at_b").alias("at_b"),
        )
        # An edge that either block has a better one for has one half only.
        names = [c.split()[0] for c in _EDGE.split(", ")]
        edges = grown.where("part = 1").select(*names).union(halves.where("a IS NOT NULL AND b IS NOT NULL").select(*names))
        shift += BLOCK_BITS
    roots = ups.pop()
    while ups:
        upper = roots.select(F.col("id").alias("root"), F.col("root").alias("_top"), F.col("turn").alias("_turn"))
        roots = ups.pop().join(upper, "root", "left").select("id", F.coalesce("_top", "root").alias("root"), (F.col("turn") != F.coalesce("_turn", F.lit(False))).alias("turn"))
    known = points.join(roots, "id", "left").withColumns({"root": F.coalesce("root", "id"), "turn": F.coalesce("turn", F.lit(False))})
    known = materialize(known, "with-roots")
    top = known.groupBy("root").agg(F.max_by((F.col("nz") < 0) != F.col("turn"), F.struct("z", -F.col("id"))).alias("down"))
    sign = F.when(F.col("turn") != F.col("down"), -1.0).otherwise(1.0)
    return known.join(broadcast_if_small(top), "root").select(*points.columns[:2], *xyz(), *((sign * F.col(c)).alias(c) for c in ("nx", "ny", "nz")))


def _interleaved(cells: list[Column]) -> Column:
    """The order of cells along a curve that keeps near ones together, of 20 bits each."""
    bits = [F.shiftleft(F.shiftright(c, k).bitwiseAND(F.lit(1)), 3 * k + i) for i, c in enumerate(cells) for k in range(20)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


def build_mesh(points: DataFrame, depth: int = 7, radius: float = 0.15) -> tuple[DataFrame, DataFrame]:
    """``vertices(vid, x, y, z, nx, ny, nz)`` and ``triangles(a, b, c)`` of the surface of all finite points."""
    if depth > MAX_DEPTH:
        raise ValueError(f"depth {depth} is above {MAX_DEPTH}, which the grid bounds")
    spark = points.sparkSession
    every = points.where(finite(*xyz())).select(*(c.alias(n) for c, n in zip(doubles(xyz()), "xyz", strict=True)))
    b = every.agg(F.count("*").alias("n"), *(f(c).alias(f"{p}{c}") for p, f in (("lo", F.min), ("hi", F.max)) for c in "xyz")).first()
    low, high = (np.array([b[f"{p}{c}"] or 0.0 for c in "xyz"]) for p in ("lo", "hi"))
    origin, step = _lattice(low, high, n := 2**depth)
    blocks = b["n"] // BLOCK_POINTS + 1
    near = _interleaved([((c - float(o)) / (step * n / 2**20)).cast("long") for c, o in zip(xyz(), origin, strict=True)])
    # Numbers and blocks are written once; a block is a range along the curve, of about as many points as others.
    every = every.withColumn("_near", near).repartitionByRange(blocks, "_near").drop("_near")
    every = materialize(every.select(F.monotonically_increasing_id().alias("id"), F.spark_partition_id().alias("block"), *xyz()), "mesh-points")
    with_normals = materialize(estimate_normals(every, ["id"], radius).select("id", "block", *xyz(), "nx", "ny", "nz"), "mesh-normals")
    discard(every)
    # A point's normal and block go along with its number, so that edges need no join.
    met = knn_within(with_normals, 11, radius, ["id", "block", "nx", "ny", "nz"]).where("id <> t_id")
    dot = sum(F.col(c) * F.col(f"t_{c}") for c in ("nx", "ny", "nz"))
    swap = F.col("id") > F.col("t_id")
    pick = lambda p, q: F.when(swap, F.col(q)).otherwise(F.col(p))
    lo, hi = pick("id", "t_id"), pick("t_id", "id")
    edges = met.select(lo.alias("a"), hi.alias("b"), lo.alias("lo"), hi.alias("hi"), F.abs(dot).alias("w"), (dot < 0).cast("int").alias("turned"), pick("block", "t_block").alias("at_a"), pick("t_block", "block").alias("at_b"))
    cells = cell_sums(oriented(with_normals, edges, blocks), origin, step, n).toArrow()  # at most one row a cell
    at = cells.column("cell").to_numpy()
    grids = [np.zeros(n**3) for _ in range(4)]
    for g, c in zip(grids, ("w", "nx", "ny", "nz"), strict=True):
        g[at] = cells.column(c).to_numpy() / _ONE
    density, *field = (g.reshape(n, n, n) for g in grids)
    del cells, grids
    chi, level, soft = solve_field(-np.array(field), density) if b["n"] else (density, 0.0, density)
    del field, density
    v, n, t = surface(chi, origin, step, level, soft)
    names, columns = ["vid", "x", "y", "z", "nx", "ny", "nz"], [np.arange(len(v)), *v.T, *n.T]
    kinds = [pa.int64(), *[pa.float64()] * 6]
    # As Arrow tables, since rows of Python numbers would take the driver many times the memory.
    vertices = spark.createDataFrame(pa.table([pa.array(np.ascontiguousarray(c), k) for c, k in zip(columns, kinds, strict=True)], names))
    return vertices, spark.createDataFrame(pa.table([pa.array(np.ascontiguousarray(c), pa.int64()) for c in t.reshape(-1, 3).T], ["a", "b", "c"]))

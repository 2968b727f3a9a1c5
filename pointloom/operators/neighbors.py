"""Neighbour search in blocks of cells: one shuffle, exact, no pairs of rows in Spark.

Space is cut into cells as wide as the search radius and cells into blocks. A source point goes to its
block, a target also to the blocks that its cell borders on, so each block finds its own neighbours: with
blocks of eight cells a target has about two copies. Within a block, columns of targets sorted by z give the
candidates in numpy, in pieces of a bounded number of pairs; where cells hold many more points than are asked for,
narrower rings go first. A search without a radius chooses its cells by each group's density.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_, or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointloom.functions.geometry import doubles, finite, xyz
from pointloom.functions.storage import broadcast_if_small, discard, materialize

CELLS = ("cx", "cy", "cz")
_BLOCKS = ("_bx", "_by", "_bz")
#: Cells along a block's edge, a power of two; with the cells around it, local coordinates run from 0 to EDGE + 2.
EDGE_BITS = 3
EDGE = 1 << EDGE_BITS
_SPAN = EDGE + 2
#: Rows that a task gathers before it searches whole blocks, and pairs that it looks at together.
_ROWS, _PAIRS = 100_000, 500_000
#: Narrower rings for points in dense cells, each of half the area of the one before.
_FINEST = 14


def _named(columns: Sequence[str], prefix: str = "") -> str:
    return "named_struct(" + ", ".join(f"'{prefix}{c}', `{c}`" for c in columns) + ")" if columns else "named_struct('_none', 0)"


def _placed(df: DataFrame, radius: float | str, by: Sequence[str], rest: str) -> DataFrame:
    """``by``, ``rest``, coordinates, the squared radius, block and cell of each point that can take part."""
    usable = " AND ".join([*(f"abs(CAST({c} AS DOUBLE)) < DOUBLE('Infinity')" for c in "xyz"), *(f"`{b}` IS NOT NULL" for b in by)])
    groups = [f"`{b}`" for b in by]
    df = df.where(usable).selectExpr(*groups, rest, *(f"CAST({c} AS DOUBLE) AS _{c}" for c in "xyz"), f"CAST({radius} AS DOUBLE) AS _h")
    df = df.selectExpr(*groups, "_p", "_x", "_y", "_z", "_h * _h AS _r2", *(f"floor(_{n} / _h) AS {c}" for n, c in zip("xyz", CELLS, strict=True)))
    return df.selectExpr(*groups, "_p", "_x", "_y", "_z", "_r2", *(f"shiftright({c}, {EDGE_BITS}) AS {b}" for b, c in zip(_BLOCKS, CELLS, strict=True)), *(f"CAST({c} & {EDGE - 1} AS INT) + 1 AS {c}" for c in CELLS))


def _around(placed: DataFrame, by: Sequence[str]) -> DataFrame:
    """Cells of these points and the cells around them."""
    groups = [f"`{b}`" for b in by]
    df = placed.select(*by, *_BLOCKS, *CELLS).distinct().selectExpr(*groups, *(f"{b} * {EDGE} + {c} AS {c}" for b, c in zip(_BLOCKS, CELLS, strict=True)))
    for c in CELLS:
        df = df.withColumn(c, F.explode(F.expr(f"array({c} - 2, {c} - 1, {c})")))
    df = df.distinct()
    return df.selectExpr(*groups, *(f"shiftright({c}, {EDGE_BITS}) AS {b}" for b, c in zip(_BLOCKS, CELLS, strict=True)), *(f"CAST({c} & {EDGE - 1} AS INT) + 1 AS {c}" for c in CELLS))


def in_blocks(target: DataFrame, radius: float | str, key: Sequence[str], by: Sequence[str] = (), extra: Sequence[str] = (), near: DataFrame | None = None) -> DataFrame:
    """Targets as ``neighbours`` meets them, each in its block and in those that its cell borders on; of ``near`` cells only."""
    groups = [f"`{b}`" for b in by]
    df = _placed(target, radius, by, f"{_named([*key, *extra], 't_')} AS _p")
    if near is not None:
        df = df.join(near, [*by, *_BLOCKS, *CELLS], "left_semi").select(*df.columns)
    for b, c in zip(_BLOCKS, CELLS, strict=True):
        df = df.selectExpr("*", f"explode(CASE {c} WHEN 1 THEN array(0, -1) WHEN {EDGE} THEN array(0, 1) ELSE array(0) END) AS _o{c}")
    return df.selectExpr(*groups, *(f"{b} + _o{c} AS {b}" for b, c in zip(_BLOCKS, CELLS, strict=True)), "_x", "_y", "_z", "_p AS _t")


def _up_to_kth(who: np.ndarray, d2: np.ndarray, k: int) -> np.ndarray:
    """Of pairs in order of ``who`` those not farther than the k-th nearest of each."""
    first = np.flatnonzero(np.diff(who, prepend=-1))
    n = np.diff(np.append(first, len(who)))
    kth = np.full(len(n), np.inf)
    many = np.flatnonzero(n > k)
    many = many[np.argsort(n[many])]  # rows of about one length are padded to the last
    a = 0
    while a < len(many):
        z = min(a + 256, len(many))
        z = min(z, a + max(1, int(_PAIRS // n[many[z - 1]])))
        rows, col = many[a:z], np.arange(n[many[z - 1]])
        padded = np.where(col < n[rows][:, None], d2[np.minimum(first[rows][:, None] + col, len(d2) - 1)], np.inf)
        kth[rows] = np.partition(padded, k - 1, axis=1)[:, k - 1]
        a = z
    return np.flatnonzero(d2 <= np.repeat(kth, n))


def _first_k(who: np.ndarray, at: np.ndarray, d2: np.ndarray, order: np.ndarray, k: int, ranked: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs in order of ``who`` the ``k`` with least (d2, order[at]) of each, and their ranks from 1.

    If they needn't be ``ranked``, numbers from 1 in any order.
    """
    if k == 1 and len(who):
        first = np.flatnonzero(np.diff(who, prepend=-1))
        least = np.repeat(np.minimum.reduceat(d2, first), np.diff(np.append(first, len(who))))
        on = np.flatnonzero(d2 == least)
        on = on[np.lexsort((order[at[on]], who[on]))]
    else:
        on = _up_to_kth(who, d2, k)
        if ranked:
            on = on[np.lexsort((order[at[on]], d2[on], who[on]))]
        elif len(on):  # only where equal distances leave more than k
            tied = np.flatnonzero((np.bincount(who[on] - who[0]) > k)[who[on] - who[0]])
            some = on[tied]
            on[tied] = some[np.lexsort((order[at[some]], d2[some], who[some]))]
    first = np.flatnonzero(np.diff(who[on], prepend=-1))
    rank = np.arange(len(on)) - np.repeat(first, np.diff(np.append(first, len(on))))
    return on[rank < k], rank[rank < k] + 1


def _starts(table: pa.Table, columns: Sequence[str]) -> np.ndarray:
    """Where a row differs from the one before it."""
    if len(table) < 2:
        return np.ones(len(table), bool)
    new = (pc.not_equal(table[c].slice(1), table[c].slice(0, len(table) - 1)).combine_chunks() for c in columns)
    return np.concatenate(([True], reduce(or_, (n.to_numpy(zero_copy_only=False) for n in new))))


def _keys(u: np.ndarray, block: np.ndarray, m: float, edge: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Columns in x and y of a grid of ``m`` to a cell, numbers that go by block, column and z, and columns in a row."""
    span = int(_SPAN * m) + 1
    at = np.clip(np.floor(u[:, :2] * m).astype(np.int64), edge, span - 1 - edge)
    return at, (block * span + at[:, 0]) * span + at[:, 1] + u[:, 2] / 16, span


def _search(table: pa.Table, groups: Sequence[str], keys: Sequence[str], k: int, ranked: bool = True) -> Iterator[tuple[np.ndarray, ...]]:
    """(row of source, row of target, d2, rank, number found), for rows of whole blocks in their order.

    A source in a dense cell looks within a fraction of the radius first; what has k targets there is done.
    """
    own = table["_target"].combine_chunks().to_numpy(zero_copy_only=False)
    new = _starts(table, groups)
    block, r2 = np.cumsum(new) - 1, table["_r2"].to_numpy()
    h = np.sqrt(np.maximum.reduceat(r2, np.flatnonzero(new)))[block]  # none in blocks without sources
    s, t = np.flatnonzero(~own), np.flatnonzero(own & (h > 0))
    if not len(s) or not len(t):
        return
    p = np.stack([table[c].to_numpy() for c in ("_x", "_y", "_z")], 1)
    named = pa.Table.from_struct_array(table["_t"].combine_chunks().take(pa.array(t)))
    order = np.empty(len(t), np.int64)
    order[pc.sort_indices(named, sort_keys=[(f"t_{n}", "ascending") for n in keys]).to_numpy()] = np.arange(len(t))
    # In radii, from the corner of the cells around the block.
    corner = np.stack([table[c].to_numpy() for c in _BLOCKS], 1) * EDGE - 1
    us, ut = (p[i] / h[i, None] - corner[i] for i in (s, t))
    slack = 1e-6 + 1e-15 * max(float(np.abs(corner).max()), 1.0) * EDGE
    _, place, _ = _keys(us, block[s], 1, 1)
    by = np.argsort(place, kind="stable")
    s, us, place = s[by], us[by], place[by]
    level, left, q = np.zeros(len(s), np.int64), np.ones(len(s), bool), np.arange(len(s))
    for fine in range(_FINEST):  # as long as the next ring's ball should hold 1.5 k
        m = 2 ** (fine / 2)
        at_key, key = np.sort(_keys(ut, block[t], m, 0)[1]), _keys(us[q], block[s[q]], m, 1)[1]
        near = np.searchsorted(at_key, key + 0.5 / m / 16, "right") - np.searchsorted(at_key, key - 0.5 / m / 16, "left")
        q = q[4.19 * near >= 1.5 * k * 2**1.5]
        if not len(q):
            break
        level[q] = fine + 1
    for fine in range(level.max(), -1, -1):
        q = np.flatnonzero(left & (level >= fine))
        if not len(q):
            continue
        m = 2 ** (fine / 2)
        _, at_key, span = _keys(ut, block[t], m, 0)
        by = np.lexsort((order, at_key))
        at_key, rows, orders, (tx, ty, tz) = at_key[by], t[by], order[by], p[t[by]].T.copy()
        u, sq, (sx, sy, sz) = us[q], s[q], p[s[q]].T.copy()
        column, key, _ = _keys(u, block[sq], m, 1)
        rest = slack + 32 * np.spacing(at_key[-1])
        gaps = [[np.maximum(g - slack, 0) for g in (u[:, i] - column[:, i] / m, np.full(len(q), 0.0), (column[:, i] + 1) / m - u[:, i])] for i in (0, 1)]
        lo, n = np.empty((len(q), 9), np.int64), np.empty((len(q), 9), np.int64)
        for c in range(9):
            dx, dy = divmod(c, 3)
            room = 1 / m**2 - gaps[0][dx] ** 2 - gaps[1][dy] ** 2
            reach = (np.sqrt(np.maximum(room, 0)) + rest) / 16
            middle = key + ((dx - 1) * span + dy - 1)
            lo[:, c] = np.searchsorted(at_key, middle - reach, "left")
            n[:, c] = np.where(room < 0, 0, np.searchsorted(at_key, middle + reach, "right") - lo[:, c])
        each, within = n.sum(1), r2[sq] / m**2
        many = np.cumsum(each)
        a = 0
        while a < len(q):
            z = max(a + 1, int(np.searchsorted(many, (many[a - 1] if a else 0) + _PAIRS, "right")))
            of, pairs = n[a:z].ravel(), each[a:z]
            at = np.arange(of.sum()) + np.repeat(lo[a:z].ravel() - np.cumsum(of) + of, of)
            d2 = (tx[at] - np.repeat(sx[a:z], pairs)) ** 2
            d2 += (ty[at] - np.repeat(sy[a:z], pairs)) ** 2
            d2 += (tz[at] - np.repeat(sz[a:z], pairs)) ** 2
            on = d2 <= np.repeat(within[a:z], pairs)
            who, at, d2 = np.repeat(np.arange(z - a), pairs)[on], at[on], d2[on]
            found = np.bincount(who, minlength=z - a)
            if fine:
                full = found >= k
                left[q[a:z][full]] = False
                who, at, d2 = (x[full[who]] for x in (who, at, d2))
            best, rank = _first_k(who, at, d2, orders, k, ranked)
            yield sq[a:z][who[best]], rows[at[best]], d2[best], rank, np.minimum(found, k)[who[best]]
            a = z


def _normals(s: np.ndarray, t: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Unit normals of each source's targets; pairs of one source are together from ``first`` on. (0, 0, 1) for fewer than three."""
    n = np.diff(np.append(first, len(s)))
    d = t - s  # from the source, so that sums of squares keep their digits
    if not len(first):
        return d
    mean = np.add.reduceat(d, first) / n[:, None]
    m = np.empty((len(first), 3, 3))
    for i in range(3):
        for j in range(i, 3):
            m[:, i, j] = m[:, j, i] = np.add.reduceat(d[:, i] * d[:, j], first) / n - mean[:, i] * mean[:, j]
    v = np.linalg.eigh(m)[1][:, :, 0]
    v[n < 3] = (0.0, 0.0, 1.0)
    return v


def neighbours(source: DataFrame, target: DataFrame, radius: float | str, k: int, key: Sequence[str], target_key: Sequence[str], by: Sequence[str] = (), extra: Sequence[str] = (), own: Sequence[str] = (), placed: bool = False, normals: bool = False, few: bool = False, second: bool = False) -> DataFrame:
    """Each source point's up to ``k`` nearest targets within ``radius``, of equal distances the least target key.

    Columns: ``by``, ``key``, ``own``, the source's ``s_x`` to ``s_z``, ``d2``, ``rank`` from 1, ``n_found``; of the
    target its key, coordinates and ``extra``, their names with ``t_`` before. A radius that is an expression is of
    columns that both sides have, the same within each group of ``by``. Points without a group or without
    finite coordinates take no part. A block's points pass through one task together. ``placed`` targets are those
    of ``in_blocks`` for this radius, written once for several searches. With ``normals`` a source has one row:
    ``by``, ``key``, ``own``, ``n_found`` and ``nx, ny, nz`` of what it found. Of ``few`` sources the cells are listed
    first, and targets that aren't in them or next to them aren't sent. With ``second`` and a ``k`` of 2 a source has one
    row, of its nearest, and ``next_d2``, the squared distance of the next one, infinite if there is none within the radius.
    """
    groups = [*by, *_BLOCKS]
    s = _placed(source, radius, by, f"{_named([*key, *own])} AS _p")
    t = target if placed else in_blocks(target, radius, target_key, by, extra, broadcast_if_small(_around(s, by)) if few else None)
    names_of = [f"`{b}`" for b in by]
    of_t, of_s = (df.schema[c].dataType.simpleString() for df, c in ((t, "_t"), (s, "_p")))
    a = s.selectExpr(*names_of, *_BLOCKS, "false AS _target", "_x", "_y", "_z", "_r2", "_p AS _s", f"CAST(NULL AS {of_t}) AS _t")
    b = t.selectExpr(*names_of, *_BLOCKS, "true AS _target", "_x", "_y", "_z", "0D AS _r2", f"CAST(NULL AS {of_s}) AS _s", "_t")
    both = a.union(b)
    names = [*by, "_s", "n_found", "nx", "ny", "nz"] if normals else [*by, "_s", "s_x", "s_y", "s_z", "d2", "rank", "n_found", *["next_d2"] * second, "_t", "t_x", "t_y", "t_z"]
    fields = {**{f.name: f.dataType for f in both.schema}, **dict.fromkeys(("s_x", "s_y", "s_z", "d2", "next_d2", "t_x", "t_y", "t_z", "nx", "ny", "nz"), T.DoubleType()), "rank": T.IntegerType(), "n_found": T.IntegerType()}
    schema = T.StructType([T.StructField(n, fields[n]) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
            table = table.combine_chunks()
            for i, j, d2, rank, found in _search(table, groups, target_key, k, not normals):
                if normals:
                    first = np.flatnonzero(rank == 1)
                    n = _normals(*(np.stack([table[c].take(pa.array(x)).to_numpy() for c in ("_x", "_y", "_z")], 1) for x in (i, j)), first)
                    cols = [table[c].take(pa.array(i[first])) for c in (*by, "_s")]
                    yield from pa.table([*cols, pa.array(found[first].astype(np.int32)), *map(pa.array, n.T.copy())], names).to_batches()
                    continue
                more = []
                if second:
                    first = np.flatnonzero(rank == 1)
                    after = np.append(np.where(rank[1:] == 2, d2[1:], np.inf), np.inf)[first]
                    more, (i, j, d2, rank, found) = [pa.array(after)], (x[first] for x in (i, j, d2, rank, found))
                i, j = pa.array(i), pa.array(j)
                cols = [table[c].take(i) for c in (*by, "_s", "_x", "_y", "_z")]
                cols += [pa.array(d2), pa.array(rank.astype(np.int32)), pa.array(found.astype(np.int32)), *more]
                cols += [table[c].take(j) for c in ("_t", "_x", "_y", "_z")]
                yield from pa.table(cols, names).to_batches()

        held, rows, enough = [], 0, _ROWS
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= enough:
                table = pa.Table.from_batches(held)
                last = int(np.flatnonzero(_starts(table, groups))[-1])
                if last:
                    yield from done(table.slice(0, last))
                held, rows = table.slice(last).to_batches(), rows - last
                enough = max(_ROWS, 2 * rows)
        if rows:
            yield from done(pa.Table.from_batches(held))

    found = both.repartition(*groups).sortWithinPartitions(*groups).mapInArrow(run, schema)
    if normals:
        return found.selectExpr(*names_of, *(f"_s.`{c}`" for c in (*key, *own)), *names[-4:])
    return found.selectExpr(*names_of, *(f"_s.`{c}`" for c in (*key, *own)), "s_x", "s_y", "s_z", "d2", "rank", "n_found", *["next_d2"] * second, *(f"_t.`t_{c}`" for c in target_key), "t_x", "t_y", "t_z", *(f"_t.`t_{c}`" for c in extra))


def nearest_within(source: DataFrame, target: DataFrame, radius: float, key: Sequence[str], target_key: Sequence[str], by: Sequence[str] = (), extra: Sequence[str] = ()) -> DataFrame:
    """Each source point's nearest target within ``radius``; of equal distances the least target key."""
    return neighbours(source, target, radius, 1, key, target_key, by, extra).drop("rank", "n_found")


def knn_within(points: DataFrame, k: int, radius: float, key: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Each point's up to ``k`` nearest within ``radius``, itself included, with ``rank`` from 1.

    Where points are dense rings widen up to the radius, as in ``knn``, so that what a point costs follows k.
    """
    return knn(points, k, key, by=by, radius=radius)


def estimate_normals(points: DataFrame, key: Sequence[str], radius: float, k: int = 30, by: Sequence[str] = (), counted: bool = False, thin: bool = False) -> DataFrame:
    """Adds ``nx, ny, nz`` from the covariance of each point's up to ``k`` neighbours within ``radius``.

    With ``counted`` also ``n_near``, how many these were, the point included. The 3 x 3 eigenproblems are solved
    where the neighbours are found; (0, 0, 1) for fewer than three. ``thin`` points, as voxels leave them, are searched
    by the radius at once; others in rings, as in ``knn_within``.
    """
    found = neighbours(points, points, radius, k, key, key, by, normals=True) if thin else knn(points, k, key, by=by, radius=radius, normals=True)
    return points.join(found.select(*by, *key, "nx", "ny", "nz", *[F.col("n_found").cast("long").alias("n_near")] * counted), [*by, *key])


#: Points that a cell should hold for a search of k neighbours, times k; denser ones are searched in narrower rings.
CELL_SHARE = 6.0
#: Widths tried, halves of the extent: the first, and the rest for groups that none of these suits.
LEVELS = (range(8), range(8, 14))


def cell_widths(points: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    """One row per group: ``_want``, its points up to k, and ``_h``, a cell width that suits its density.

    Of widths from the group's extent down by halves the largest is taken at which the cell of a point
    holds about ``CELL_SHARE`` * k points on average, itself not counted. Counts combine before the shuffle,
    the more the wider the cells, so narrow ones are counted only where they are asked for.
    """
    c = dict(zip(CELLS, doubles(xyz()), strict=True))
    sizes = points.groupBy(*by).agg(F.least(F.lit(k), F.count("*")).alias("_want"), *(F.min(v).alias(f"_lo_{n}") for n, v in c.items()), F.greatest(*(F.max(v) - F.min(v) for v in c.values())).alias("_extent"))
    sizes = broadcast_if_small(sizes) if by else F.broadcast(materialize(sizes, "extents"))  # one row per group
    each = points.join(sizes, list(by)) if by else points.crossJoin(sizes)
    done = None
    for levels in LEVELS:
        df = each.withColumn("_level", F.explode(F.array(*map(F.lit, levels)))).withColumn("_h", F.greatest(F.col("_extent"), F.lit(1e-9)) / F.pow(F.lit(2.0), F.col("_level")))
        cells = [F.floor((v - F.col(f"_lo_{n}")) / F.col("_h")).alias(n) for n, v in c.items()]
        counts = df.groupBy(*by, "_level", "_h", "_want", *cells).agg(F.count("*").alias("n"))
        tried = counts.groupBy(*by, "_level", "_h", "_want").agg((F.sum(F.col("n") * (F.col("n") - 1)) / F.sum("n")).alias("others"))
        fits = F.max(F.when(F.col("others") <= k * CELL_SHARE, F.col("_h"))).alias("_fits")
        widths = materialize(tried.groupBy(*by).agg(F.min("_h").alias("_least"), F.first("_want").alias("_want"), fits), "cell-widths")
        found = widths.select(*by, F.coalesce("_fits", "_least").alias("_h"), "_want")
        wide = widths.where("_fits IS NULL AND _least IS NOT NULL")
        if levels == LEVELS[-1] or wide.isEmpty():
            return found if done is None else done.union(found)
        if by:
            done = found.join(broadcast_if_small(wide.select(*by)), list(by), "left_anti")
            each = each.join(broadcast_if_small(wide.select(*by)), list(by), "left_semi")


def knn(points: DataFrame, k: int, key: Sequence[str], start: float | None = None, by: Sequence[str] = (), growth: float = 2.0, radius: float | None = None, normals: bool = False) -> DataFrame:
    """Each point's ``k`` nearest without a radius, or up to ``k`` within one: rings widen for the points that lack neighbours.

    A point is done once it has k neighbours within the ring's radius, which makes them its nearest, or once the
    ring is as wide as ``radius``. Each round sees only the points still open, and after the first only the targets
    around them; in a group of at most ``k`` points all are neighbours. The first radius is ``start``, or suits the
    density of each group. Points without a group or without finite coordinates take no part. With ``normals`` a
    point has one row: its normal and ``n_found``, as ``neighbours`` gives them.
    """
    points = points.where(reduce(and_, [finite(*xyz()), *(F.col(b).isNotNull() for b in by)])).select(*by, *key, "x", "y", "z")
    points = materialize(points, "points")
    # What a point can find is up to its own group: a small one must not end the search of the others.
    groups = cell_widths(points, k, by)
    groups = groups.withColumn("_h", F.lit(float(start))) if start else groups
    groups = groups.withColumn("_h", F.least("_h", F.lit(float(radius)))) if radius else groups
    groups = broadcast_if_small(groups) if by else F.broadcast(groups)  # one row
    points = materialize(points.join(groups, list(by)), "points") if by else points.crossJoin(groups)
    scale, left, done = 1.0, points, None
    while True:
        ring = f"least(_h * {scale}, {radius}D)" if radius else f"_h * {scale}"
        near = neighbours(left, points, ring, k, key, key, by, own=["_want", "_h"], normals=normals, few=scale > 1)
        ended = F.col("n_found") >= F.col("_want")
        ended = ended | (F.col("_h") * scale >= radius) if radius else ended
        full = near.where(ended).drop("_want", "_h")
        full = materialize(full if normals else full.drop("n_found"), "neighbours")
        done = full if done is None else done.union(full)
        ones = full if normals else full.where("rank = 1")
        before, left = left, materialize(left.join(ones.select(*by, *key), [*by, *key], "left_anti"), "open-points")
        if scale > 1:
            discard(before)
        if left.isEmpty():
            return done
        scale *= growth

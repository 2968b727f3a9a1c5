"""Rigid registration: correspondences and normal equations as joins and sums, small solves on the driver.

``icp`` iterates a distributed nearest-neighbour search and brings one row of sums to the driver each time;
``pairwise_icp`` thins clouds by voxels and does so for many pairs of clouds in one search, keyed by pair.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from pointloom.config import IcpConfig, SliceConfig
from pointloom.functions.geometry import apply_rigid, doubles, finite, xyz
from pointloom.functions.grid import kabsch_from_sums, step_from_normal_equations
from pointloom.functions.storage import discard, materialize
from pointloom.operators.neighbors import cell_widths, estimate_normals, in_blocks, neighbours
from pointloom.operators.voxel import KEYS, voxel_centroid


def transformed(points: DataFrame, m: np.ndarray) -> DataFrame:
    x, y, z = apply_rigid(doubles(xyz()), m)
    return points.withColumns({"x": x, "y": y, "z": z})


def _product_sums() -> list[Column]:
    sums = [F.sum(f"{p}_{n}").alias(f"{p}{n}") for p in "st" for n in "xyz"]
    return sums + [F.sum(F.col(f"s_{a}") * F.col(f"t_{b}")).alias(f"{a}{b}") for a in "xyz" for b in "xyz"]


def _plane_sums() -> list[Column]:
    s, d, n = ([F.col(f"{p}{c}") for c in "xyz"] for p in ("s_", "t_", "t_n"))
    j = [s[1] * n[2] - s[2] * n[1], s[2] * n[0] - s[0] * n[2], s[0] * n[1] - s[1] * n[0], *n]
    r = sum((s[i] - d[i]) * n[i] for i in range(3))
    upper = [F.sum(j[a] * j[b]).alias(f"a{a}{b}") for a in range(6) for b in range(a, 6)]
    return upper + [F.sum(j[a] * r).alias(f"b{a}") for a in range(6)]


def kabsch_sums(pairs: DataFrame) -> DataFrame:
    """One row: n, coordinate sums of source (s_) and target (t_), and their nine product sums."""
    return pairs.agg(F.count("*").alias("n"), *_product_sums())


def kabsch(pairs: DataFrame) -> np.ndarray:
    """The rigid transform that fits source to target best; needs three pairs that span a plane."""
    row = kabsch_sums(pairs).first()
    if row["n"] < 3:
        raise ValueError("at least three pairs are needed")
    s, d = (np.array([row[f"{p}{n}"] for n in "xyz"]) for p in "st")
    sd = np.array([[row[f"{a}{b}"] for b in "xyz"] for a in "xyz"])
    singular = np.linalg.svd(sd - np.outer(s, d) / row["n"])[1]
    if singular[1] <= 1e-12 * max(1.0, singular[0]):
        raise ValueError("the pairs lie on a line, which leaves a rotation free")
    return kabsch_from_sums(row["n"], s, d, sd)


def pick_pairs(picks: DataFrame) -> DataFrame:
    """Picks of cloud 0 and 1 paired by position; those without a partner are left out."""
    side = lambda c, p: picks.where(F.col("cloud") == c).select("pair_idx", *(F.col(n).cast("double").alias(f"{p}_{n}") for n in "xyz"))
    return side(0, "s").join(side(1, "t"), "pair_idx")


def normal_equations(met: DataFrame) -> DataFrame:
    """One row: the 21 upper entries of J'J and the 6 of J'r for point-to-plane, from s_, t_ and t_n columns."""
    return met.agg(*_plane_sums())


def fitness_rmse(source: DataFrame, met: DataFrame) -> DataFrame:
    """One row: the matched share of the source, and the RMS distance of what matched."""
    total = source.agg(F.count("*").alias("total"))
    got = met.agg(F.count("*").alias("matched"), F.sqrt(F.avg("d2")).alias("inlier_rmse"))
    return got.crossJoin(total).select((F.col("matched") / F.col("total")).alias("fitness"), "inlier_rmse", "matched", "total")


def icp(source: DataFrame, target: DataFrame, distance: float, key: Sequence[str], iterations: int = 100, init: np.ndarray | None = None, normals: bool = False, tolerance: float = 1e-6) -> tuple[np.ndarray, float, float]:
    """Distributed ICP: transform, fitness, inlier RMSE.

    Each iteration moves the original source by the transform so far, so plans don't grow; the target is
    written once. With ``normals`` the target has nx, ny, nz and distances are to planes.
    """
    extra = ["nx", "ny", "nz"] if normals else []
    target, source = materialize(target.select(*key, "x", "y", "z", *extra), "icp-target"), materialize(source.select(*key, "x", "y", "z"), "icp-source")
    total = source.count()
    # Rings from a width that suits the target's density up to the distance; those that find none go on to the next.
    row = cell_widths(target.where(finite(*xyz())), 2).first()
    rings = [min(row["_h"] or distance, distance) if row else distance]
    while rings[-1] < distance:
        rings.append(min(4 * rings[-1], distance))
    placed = materialize(in_blocks(target, rings[0], key, extra=extra), "placed-targets")
    sums = [*(_plane_sums() if normals else _product_sums()), F.count("*").alias("matched"), F.sum("d2").alias("d2")]
    t, before = np.eye(4) if init is None else init, (0.0, 0.0)
    for i in range(iterations + 1):
        left, row, used = transformed(source, t), {}, []
        for n, ring in enumerate(rings):
            met = neighbours(left, target if n else placed, ring, 1, key, key, extra=extra, placed=not n, few=n > 0)
            if ring < distance:
                used.append(met := materialize(met, "met"))
            for name, v in met.agg(*sums).first().asDict().items():
                row[name] = row.get(name, 0) + (v or 0)
            if ring < distance:
                used.append(left := materialize(left.join(met.select(*key), list(key), "left_anti"), "open-points"))
                if left.isEmpty():
                    break
        discard(*used)
        row["rmse"] = (row["d2"] / max(row["matched"], 1)) ** 0.5
        now = (row["matched"] / max(total, 1), row["rmse"] or 0.0)
        if i == iterations or row["matched"] < 3 or (i and abs(now[0] - before[0]) < tolerance and abs(now[1] - before[1]) < tolerance):
            break
        before = now
        t = _solve(row, normals) @ t
    discard(target, source, placed)
    return t, *now


def _solve(row, normals: bool) -> np.ndarray:
    if not normals:
        s, d = (np.array([row[f"{p}{n}"] for n in "xyz"]) for p in "st")
        return kabsch_from_sums(row["matched"], s, d, np.array([[row[f"{a}{b}"] for b in "xyz"] for a in "xyz"]))
    jtj = np.zeros((6, 6))
    for a in range(6):
        for b in range(a, 6):
            jtj[a, b] = jtj[b, a] = row[f"a{a}{b}"]
    return step_from_normal_equations(jtj, np.array([row[f"b{a}"] for a in range(6)]))


def _pair_table(source: DataFrame, live: list[int], ends: dict[int, tuple], t: dict[int, np.ndarray]) -> DataFrame:
    """The driver's row of each pair: its number, its clouds, its transform."""
    kind = to_arrow_type(source.schema["cloud"].dataType)
    cols = [pa.array(live, pa.int64()), pa.array([ends[p][0] for p in live], kind), pa.array([ends[p][1] for p in live], kind), pa.array([t[p].ravel().tolist() for p in live], pa.list_(pa.float64()))]
    return source.sparkSession.createDataFrame(pa.table(cols, ["pair", "cloud", "to", "m"]))


def _moved(prefix: str = "", out: str = "") -> list[str]:
    return [f"m[{4 * i}] * {prefix}x + m[{4 * i + 1}] * {prefix}y + m[{4 * i + 2}] * {prefix}z + m[{4 * i + 3}] AS {out}{c}" for i, c in enumerate("xyz")]


class _Correspondences:
    """Nearest targets of the sources of many pairs of clouds, searched again only where they may have changed.

    A search also tells how far the next target is. As long as a source has moved less since then than half of what
    that one is farther away, its nearest stays the same; a source without a target within ``WIDER`` times the distance has
    none within the distance as long as no point of its cloud's bounds has moved by the difference. So results are
    those of a new search. Beyond ``OPEN`` of all sources all are searched again.
    """

    WIDER, OPEN = 1.25, 0.1

    def __init__(self, source: DataFrame, target: DataFrame, ends: dict[int, tuple], extra: Sequence[str]):
        self.source, self.target, self.ends, self.extra = source, target, ends, list(extra)
        rows = source.groupBy("cloud").agg(F.count("*").alias("n"), *(f(c).alias(f"{p}{c}") for p, f in (("lo", F.min), ("hi", F.max)) for c in "xyz")).collect()  # a row per cloud
        self.totals = {r["cloud"]: r["n"] for r in rows}
        self.corners = {r["cloud"]: np.array([[r[f"{p}{c}"] for p, c in zip(k, "xyz", strict=True)] + [1.0] for k in product(("lo", "hi"), repeat=3)]) for r in rows}
        self.radius, self.at, self.base, self.placed = 0.0, {}, None, {}

    def _search(self, t: dict[int, np.ndarray], distance: float) -> None:
        if self.base is not None:
            discard(self.base)
        again, self.radius, self.at = self.radius, self.WIDER * distance, dict(t)
        if again == self.radius and again not in self.placed:  # written down once there is more than one search
            self.placed[again] = materialize(in_blocks(self.target, again, KEYS, ["cloud"], self.extra), "placed-targets")
        placed = self.placed.get(self.radius)
        moved = self.source.join(F.broadcast(_pair_table(self.source, list(t), self.ends, t)), "cloud").selectExpr("pair", "to AS cloud", *_moved())  # a row per pair
        met = neighbours(moved, self.target if placed is None else placed, self.radius, 2, ["pair"], KEYS, ["cloud"], self.extra, placed=placed is not None, second=True)
        room = F.expr(f"(sqrt(least(next_d2, {self.radius**2!r}D)) - sqrt(d2)) / 2 * (1 - 1e-9D) AS room")
        self.base = materialize(met.select("pair", "s_x", "s_y", "s_z", "d2", *self._goal(), room), "correspondences")

    def _goal(self) -> list[str]:
        return ["t_x", "t_y", "t_z", *(f"t_{c}" for c in self.extra)]

    def met(self, t: dict[int, np.ndarray], distance: float) -> DataFrame:
        """Of each source of these pairs, moved by ``t``, its nearest target within ``distance``: coordinates, ``d2``, ``extra``."""
        near, names = F.col("d2") <= distance**2, ["pair", "s_x", "s_y", "s_z", "d2", *self._goal()]
        since = {p: m @ np.linalg.inv(self.at[p]) for p, m in t.items() if p in self.at}
        # The farthest that a point within the bounds has moved is that of a corner.
        far = max((float(np.linalg.norm(self.corners[self.ends[p][0]] @ (m - self.at[p])[:3].T, axis=1).max()) for p, m in t.items() if p in since and self.ends[p][0] in self.corners), default=0.0)
        if len(since) < len(t) or far > (self.radius - distance) * (1 - 1e-9):
            self._search(t, distance)
            return self.base.where(near).select(*names)
        rows = self.base.drop("d2").join(F.broadcast(_pair_table(self.source, list(t), self.ends, since)), "pair")  # a row per pair
        rows = rows.selectExpr("pair", "to AS cloud", "room", "s_x AS _x", "s_y AS _y", "s_z AS _z", *_moved("s_", "s_"), *self._goal())
        rows = rows.withColumns({k: sum((F.col(f"s_{c}") - F.col(f"{p}{c}")) ** 2 for c in "xyz") for k, p in (("_m2", "_"), ("d2", "t_"))})
        stays = F.sqrt("_m2") < F.col("room")
        count = rows.where(~stays).count() if far else 0
        if count > self.OPEN * sum(self.totals.get(self.ends[p][0], 0) for p in t):
            self._search(t, distance)
            return self.base.where(near).select(*names)
        if not count:
            return rows.where(near).select(*names)
        left = rows.where(~stays).selectExpr("pair", "cloud", *(f"s_{c} AS {c}" for c in "xyz"))
        found = neighbours(left, self.target, distance, 1, ["pair"], KEYS, ["cloud"], self.extra, few=True)
        return rows.where(stays & near).select(*names).union(found.select(*names))

    def discard(self) -> None:
        discard(*self.placed.values(), *([] if self.base is None else [self.base]))


def _iterate(found: _Correspondences, transforms: dict[int, np.ndarray], distance: float, iterations: int, normals: bool, tolerance: float) -> dict[int, tuple[np.ndarray, float, float]]:
    """ICP of all pairs at once: the transform, fitness and inlier RMSE of each.

    A round moves every source by its pair's transform so far, takes the nearest targets of all pairs and sums them up
    by pair; 16 or 27 sums a pair come to the driver. Pairs leave as they converge.
    """
    t, before, out = dict(transforms), {}, {}
    sums = [*(_plane_sums() if normals else _product_sums()), F.count("*").alias("matched"), F.sqrt(F.avg("d2")).alias("rmse")]
    for i in range(iterations + 1):
        live = [p for p in t if p not in out]
        if not live:
            break
        met = found.met({p: t[p] for p in live}, distance)
        rows = {r["pair"]: r for r in met.groupBy("pair").agg(*sums).collect()}
        for p in live:
            row = rows.get(p)
            matched = row["matched"] if row else 0
            now = (matched / max(found.totals.get(found.ends[p][0], 0), 1), row["rmse"] if row else 0.0)
            was = before.get(p)
            if i == iterations or matched < 3 or (was and abs(now[0] - was[0]) < tolerance and abs(now[1] - was[1]) < tolerance):
                out[p] = (t[p], *now)
                continue
            before[p] = now
            t[p] = _solve(row, normals) @ t[p]
    return out


#: Rounds of ``_polish``, and the pairs that it keeps: those within so many times the median distance.
POLISH_ROUNDS, POLISH_MEDIANS = 4, 3.0


def _polish(near: _Correspondences, found: dict[int, tuple[np.ndarray, float, float]], distance: float) -> dict[int, tuple[np.ndarray, float, float]]:
    """Transforms of pairs of clouds fitted once more to the correspondences that agree with most others.

    A point whose partner isn't in the other cloud meets a stranger within ``distance``, the more often the denser
    the clouds, and pulls the fit off. A round leaves out what is farther than ``POLISH_MEDIANS`` times its pair's
    median distance in the round before. A target with too few neighbours for a plane counts by all three
    coordinates, not by a plane of its own making. Fitness and RMSE stay those of all correspondences.
    """
    t, limit = {p: m for p, (m, _, _) in found.items()}, dict.fromkeys(found, float("inf"))
    whole, normal = "named_struct('x', 1D, 'y', 0D, 'z', 0D), named_struct('x', 0D, 'y', 1D, 'z', 0D), named_struct('x', 0D, 'y', 0D, 'z', 1D)", "named_struct('x', t_nx, 'y', t_ny, 'z', t_nz)"
    for i in range(POLISH_ROUNDS):
        most = F.create_map(*(F.lit(v) for p in limit for v in (p, float(limit[p]))))  # an entry per pair
        met = near.met(t, distance).withColumn("most", most[F.col("pair").cast("int")])
        met = met.withColumn("_n", F.explode(F.expr(f"CASE WHEN t_n_near < 3 THEN array({whole}) ELSE array({normal}) END")))
        kept = F.col("d2") <= F.col("most")
        used = met.withColumns({f"t_n{c}": F.when(kept, F.col(f"_n.{c}")) for c in "xyz"})  # sums leave nulls out
        for row in used.groupBy("pair").agg(*_plane_sums(), F.count_if(kept).alias("kept"), F.percentile_approx("d2", 0.5, 10_000).alias("middle")).collect():
            p = row["pair"]
            if i and row["kept"] >= 6:
                t[p] = _solve(row, True) @ t[p]
            limit[p] = row["middle"] * POLISH_MEDIANS**2
    return {p: (t[p], *rest) for p, (_, *rest) in found.items()}


def pairwise_icp(clouds: DataFrame, pairs: Iterable[tuple], cloud: str = "slice", cfg: IcpConfig = IcpConfig(), fine_only: float | None = None, normal_radius: float | None = None, polish: bool = False) -> dict[int, tuple[np.ndarray, float, float]]:
    """Aligns cloud a to cloud b for each (a, b, init), all at once; results by position in ``pairs``.

    Clouds are thinned by voxels and targets get normals; then point to point with a wide distance, then to
    planes with a narrow one, or with ``fine_only`` (a distance) the second alone. No task holds a cloud, and the
    driver only transforms and sums of pairs. A pair without points in one cloud keeps its start, with fitness 0.
    With ``polish`` strangers' correspondences are left out in the end; see ``_polish``.
    """
    pairs = list(pairs)
    if not pairs:
        return {}
    ends = {i: (a, b) for i, (a, b, _) in enumerate(pairs)}
    start = {i: np.asarray(init, float).reshape(4, 4) for i, (_, _, init) in enumerate(pairs)}
    named = clouds.select(F.col(cloud).alias("cloud"), *(c.alias(n) for c, n in zip(doubles(xyz()), "xyz", strict=True)))
    used = sorted({c for e in ends.values() for c in e})
    thin = voxel_centroid(named.where(F.col("cloud").isin(used)), cfg.voxel, ["cloud"])
    if cfg.voxel <= 0:  # every point stays and needs a key of its own
        thin = thin.withColumns(dict(zip(KEYS, (F.monotonically_increasing_id(), F.lit(0), F.lit(0)), strict=True)))
    thin = materialize(thin.select("cloud", *KEYS, "x", "y", "z"), "thinned")
    goals = thin.where(F.col("cloud").isin(sorted({b for _, b in ends.values()})))
    goals = materialize(estimate_normals(goals, KEYS, normal_radius or cfg.normal_radius * cfg.voxel, cfg.max_neighbors, ["cloud"], counted=polish, thin=True), "with-normals")
    met = _Correspondences(thin, goals, ends, ["nx", "ny", "nz", *["n_near"] * polish])
    if fine_only is None:
        coarse = _iterate(met, start, cfg.coarse_distance * cfg.voxel, cfg.coarse_iterations, False, cfg.tolerance)
        start = {p: m for p, (m, _, _) in coarse.items()}
    near = cfg.fine_distance * cfg.voxel if fine_only is None else fine_only
    found = _iterate(met, start, near, cfg.fine_iterations, True, cfg.tolerance)
    if polish:
        found = _polish(met, found, near)
    met.discard()
    discard(thin, goals)
    return found


def align_slices(sliced: DataFrame, cfg: SliceConfig = SliceConfig(), icp_cfg: IcpConfig = IcpConfig()) -> tuple[dict[int, np.ndarray], list[int]]:
    """Transforms of each slice to the reference slice, and the slices rejected.

    Chain: every slice is aligned to the one before it, around the circle from the reference, and the
    transforms multiplied up; then each is refined against the reference from there. Those whose fitness
    falls short are chained again from the nearest refined neighbour, the left one of equals, and count as
    refined themselves then. Without the chain slices are aligned to the reference directly, and those
    that fall short are rejected. Alignments that don't depend on each other run as one job.
    """
    counts = {r["slice"]: r["n"] for r in sliced.groupBy("slice").agg(F.count("*").alias("n")).collect()}  # one row per slice
    ids = sorted(counts)
    if len(ids) < 2:
        raise ValueError("fewer than two slices have points")
    ref = max(ids, key=lambda s: (counts[s], -s))
    start = ids.index(ref)
    order = ids[start + 1 :] + ids[:start]
    eye, out = np.eye(4), {ref: np.eye(4)}
    if not cfg.chain:
        found = pairwise_icp(sliced, [(s, ref, eye) for s in order], cfg=icp_cfg, polish=True)
        good = {s: found[i] for i, s in enumerate(order) if found[i][1] >= cfg.min_fitness}
        return out | {s: v[0] for s, v in good.items()}, [s for s in order if s not in good]
    before = [ref, *order[:-1]]
    found = pairwise_icp(sliced, [(s, p, eye) for s, p in zip(order, before, strict=True)], cfg=icp_cfg)
    for i, s in enumerate(order):
        out[s] = out[before[i]] @ found[i][0]
    refined = {ref}
    fine = pairwise_icp(sliced, [(s, ref, out[s]) for s in order], cfg=icp_cfg, fine_only=icp_cfg.refine_distance * icp_cfg.voxel, polish=True)
    for i, s in enumerate(order):
        if fine[i][1] >= cfg.min_fitness:
            out[s] = fine[i][0]
            refined.add(s)
    for s in [s for s in order if s not in refined]:
        at, n = ids.index(s), len(ids)
        near = next(c for k in range(1, n + 1) for c in (ids[(at - k) % n], ids[(at + k) % n]) if c in refined)
        out[s] = out[near] @ pairwise_icp(sliced, [(s, near, eye)], cfg=icp_cfg, polish=True)[0][0]
        refined.add(s)
    return out, []


def transforms_table(spark: SparkSession, transforms: dict[int, np.ndarray]) -> DataFrame:
    return spark.createDataFrame([(int(s), m.ravel().tolist()) for s, m in transforms.items()], "slice int, m array<double>")


def align_by_pairs(clouds: DataFrame, picks: DataFrame, source: int, target: int, voxel: float = 0.10) -> np.ndarray:
    """Rigid fit of picked pairs, then ICP from there: the transform of the source cloud."""
    return refine_moved(clouds, kabsch(pick_pairs(picks)), source, target, voxel)[0]


def refine_moved(clouds: DataFrame, moved_by: np.ndarray, source: int, target: int, voxel: float = 0.10) -> tuple[np.ndarray, float, float]:
    """ICP of a cloud that was moved by hand: the transform of the cloud as it was, fitness, inlier RMSE."""
    moved = transformed(clouds.where(F.col("cloud") == source), moved_by)
    both = moved.unionByName(clouds.where(F.col("cloud") == target), allowMissingColumns=True)
    m, fitness, rmse = pairwise_icp(both, [(source, target, np.eye(4))], "cloud", IcpConfig(voxel=voxel))[0]
    return m @ moved_by, fitness, rmse

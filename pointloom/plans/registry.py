"""Queries over the surrogate views, one per operator, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.config import DeskewConfig, IcpConfig, MapConfig, PlaneConfig, SliceConfig
from pointloom.functions import geometry as G
from pointloom.functions.storage import materialize
from pointloom.operators import deskew as D
from pointloom.operators import filters, imu, neighbors, outliers, planes, registration, series, slicing, voxel
from pointloom.plans import pipelines
from pointloom.plans import surrogates as S
from pointloom.plans.surrogates import BIG, DESKEWED, ENC, FRAMES, IMU, PTS, SCAN, TP, theta

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
GATE_NS = 2 * 3600 * 10**9  # two hours, since the surrogate encoder is that sparse


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r(c: Column | str, name: str, digits: int = 6) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return (F.round(c.cast("double"), digits) + 0.0).alias(name)


def rounded(names: str = "xyz", digits: int = 6) -> list[Column]:
    return [r(n, n, digits) for n in names]


def R(expr: str, name: str, digits: int = 6) -> str:
    return f"round(CAST({expr} AS DOUBLE), {digits}) + 0.0 AS {name}"


XYZ = ", ".join(R(c, c) for c in "xyz")


def _series(spark, d) -> DataFrame:
    return materialize(series.unwrap(S.encoder(spark, d), ties=["event_id"]).select("event_id", "t_ns", F.col("unwrapped").alias("angle")), "encoder")


def _theta(spark, d) -> DataFrame:
    return series.interpolate(S.frames(spark, d), _series(spark, d), "t_ns", ties=["event_id"])


FRAME_THETA = f"WITH {ENC}, {FRAMES}, fr AS (SELECT event_id, t_ns, t_ns AS t FROM frames), {theta('fr')}"


@query(f"WITH {ENC} SELECT event_id, t_ns, {R('angle', 'unwrapped')} FROM uenc")
def unwrap(spark, d):
    return _series(spark, d).select("event_id", "t_ns", r("angle", "unwrapped"))


@query(f"{FRAME_THETA} SELECT event_id, t_ns, {R('theta', 'theta')} FROM th")
def interp_asof(spark, d):
    return _theta(spark, d).select("event_id", "t_ns", r("theta", "theta"))


@query(f"WITH {ENC}, {SCAN}, {theta('scan')}, {DESKEWED} SELECT frame_id, pt_idx, {XYZ} FROM dsk")
def deskew_absolute(spark, d):
    return D.deskew(S.scan(spark, d), _series(spark, d), ties=["event_id"]).select("frame_id", "pt_idx", *rounded())


MAP_VOXEL = "0.25"


@query(
    f"""WITH {ENC}, {SCAN}, {theta('scan')}, {DESKEWED},
gate AS (SELECT f.event_id FROM frames f JOIN uenc e ON e.t_ns BETWEEN f.t_ns - {GATE_NS} AND f.t_ns GROUP BY f.event_id HAVING count(*) >= 5),
near AS (SELECT frame_id, pt_idx, CAST(x AS FLOAT) AS x, CAST(y AS FLOAT) AS y, CAST(z AS FLOAT) AS z FROM dsk
         WHERE sqrt(x*x + y*y + z*z) BETWEEN 0.3 AND 20 AND frame_id IN (SELECT event_id FROM gate)),
cells AS (SELECT *, {", ".join(f"CAST(floor({c} / CAST({MAP_VOXEL} AS FLOAT)) AS BIGINT) AS k{c}" for c in "xyz")} FROM near),
firsts AS (SELECT *, row_number() OVER (PARTITION BY kx, ky, kz ORDER BY frame_id, pt_idx) AS rn FROM cells)
SELECT kx, ky, kz, frame_id, pt_idx, {", ".join(R(c, c, 4) for c in "xyz")} FROM firsts WHERE rn = 1"""
)
def world_map(spark, d, gate_ns: int = GATE_NS):
    cfg = MapConfig(voxel=float(MAP_VOXEL), gate_ns=gate_ns)
    return pipelines.world_map(S.scan(spark, d), S.encoder(spark, d), cfg).select("kx", "ky", "kz", "frame_id", "pt_idx", *rounded(digits=4))


#: Gravity of the surrogate samples, axes exchanged so that the platform leans clearly; see ``_leaning``.
_GRAVITY = f"""{IMU}, few AS (SELECT ay AS ax, ax / 50 AS ay, az FROM imu ORDER BY t_ns, event_id LIMIT 500),
mean_ AS (SELECT avg(ax) AS mx, avg(ay) AS my, avg(az) AS mz FROM few), grav AS (SELECT mx / s AS gx, my / s AS gy, mz / s AS gz FROM (SELECT *, sqrt(mx*mx + my*my + mz*mz) AS s FROM mean_))"""


def _leaning(spark, d) -> DataFrame:
    return S.imu(spark, d).select("event_id", "t_ns", F.col("ay").alias("ax"), (F.col("ax") / 50).alias("ay"), "az")


@query(
    f"""WITH {ENC}, {SCAN}, {theta('scan')}, {DESKEWED}, {_GRAVITY},
gate AS (SELECT f.event_id FROM frames f JOIN uenc e ON e.t_ns BETWEEN f.t_ns - {GATE_NS} AND f.t_ns GROUP BY f.event_id HAVING count(*) >= 5),
kept AS (SELECT * FROM dsk, grav WHERE sqrt(x*x + y*y + z*z) BETWEEN 0.3 AND 20 AND frame_id IN (SELECT event_id FROM gate)),
near AS (SELECT frame_id, pt_idx, CAST(gx*x + gy*y + gz*z AS FLOAT) AS x, CAST(y - gy*x - gy*(gy*y + gz*z)/(1 + gx) AS FLOAT) AS y, CAST(z - gz*x - gz*(gy*y + gz*z)/(1 + gx) AS FLOAT) AS z FROM kept),
cells AS (SELECT *, {", ".join(f"CAST(floor({c} / CAST({MAP_VOXEL} AS FLOAT)) AS BIGINT) AS k{c}" for c in "xyz")} FROM near),
firsts AS (SELECT *, row_number() OVER (PARTITION BY kx, ky, kz ORDER BY frame_id, pt_idx) AS rn FROM cells)
SELECT kx, ky, kz, frame_id, pt_idx, {", ".join(R(c, c, 4) for c in "xyz")} FROM firsts WHERE rn = 1"""
)
def world_map_tilted(spark, d):
    """The map set upright by gravity."""
    tilt = imu.tilt_matrix(_leaning(spark, d), ("t_ns", "event_id"))
    cfg = MapConfig(voxel=float(MAP_VOXEL), gate_ns=GATE_NS)
    return pipelines.world_map(S.scan(spark, d), S.encoder(spark, d), cfg, tilt=tilt).select("kx", "ky", "kz", "frame_id", "pt_idx", *rounded(digits=4))


def _turned(axis: str, invert: bool) -> str:
    a = "theta" if invert else "-theta"
    a = f"({a} - radians(30))"
    u, v, w = "(y - 0.1)", "(-x - 0.2)", "(z - 0.3)"
    turned = {
        "x": (u, f"{v}*cos({a}) - {w}*sin({a})", f"{v}*sin({a}) + {w}*cos({a})"),
        "y": (f"{u}*cos({a}) + {w}*sin({a})", v, f"{w}*cos({a}) - {u}*sin({a})"),
        "z": (f"{u}*cos({a}) - {v}*sin({a})", f"{u}*sin({a}) + {v}*cos({a})", w),
    }[axis]
    m = [f"({t} + {c})" for t, c in zip(turned, (0.1, 0.2, 0.3), strict=True)]
    return f"""SELECT '{axis}' AS axis, {str(invert).lower()} AS inverted, frame_id, pt_idx,
      {R("-" + m[1], "x")}, {R(m[0], "y")}, {R(m[2], "z")} FROM th"""


@query(f"WITH {ENC}, {SCAN}, {theta('scan')} " + " UNION ALL ".join(_turned(a, i) for a in "xyz" for i in (False, True)))
def deskew_axes(spark, d):
    th = D.with_theta(S.scan(spark, d), _series(spark, d), DeskewConfig(), ties=["event_id"]).persist()
    out = None
    for axis in "xyz":
        for invert in (False, True):
            cfg = DeskewConfig(axis, 30.0, (0.1, 0.2, 0.3), invert, mount_rpy_deg=(0, 0, 0), mount_axes=("+y", "-x", "+z"))
            x, y, z = D.deskewed(G.xyz(), F.col("theta"), cfg)
            one = th.select(F.lit(axis).alias("axis"), F.lit(invert).alias("inverted"), "frame_id", "pt_idx", r(x, "x"), r(y, "y"), r(z, "z"))
            out = one if out is None else out.union(one)
    return out


@query(f"WITH {FRAMES}, {ENC} SELECT f.event_id, CAST(count(e.event_id) AS BIGINT) AS n_samples, count(e.event_id) >= 5 AS passes FROM frames f LEFT JOIN uenc e ON e.t_ns BETWEEN f.t_ns - {GATE_NS} AND f.t_ns GROUP BY f.event_id")
def encoder_gate(spark, d):
    out = series.samples_before(S.frames(spark, d), S.encoder(spark, d), "t_ns", "t_ns", GATE_NS)
    return out.select("event_id", F.coalesce("n_samples", F.lit(0)).cast("long").alias("n_samples"), (F.coalesce("n_samples", F.lit(0)) >= 5).alias("passes"))


@query("SELECT 'joint_state' AS origin, CAST(count(*) AS BIGINT) AS n, " + R("sum(value)", "total", 2) + " FROM events WHERE event_type = 'purchase'")
def encoder_selection(spark, d):
    e = S.table(spark, d, "events")
    ns = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    joint = e.where("event_type = 'purchase'").select(ns.alias("log_time_ns"), F.array("value").alias("position"))
    angle = e.where("event_type = 'error'").select(ns.alias("log_time_ns"), F.col("value").alias("deg"))
    found, origin = series.select_encoder(joint, angle)
    return found.agg(F.count("*").alias("n"), r(F.sum("angle"), "total", 2)).select(F.lit(origin).alias("origin"), "n", "total")


SIZE = "sqrt(CAST(x AS DOUBLE)*x + CAST(y AS DOUBLE)*y + CAST(z AS DOUBLE)*z)"


def _range_sql(low, high, op1, op2):
    return f"WITH {PTS} SELECT vec_id, p, {XYZ} FROM pts WHERE {SIZE} {op1} {low} AND {SIZE} {op2} {high}"


@query(_range_sql(0.1, 0.3, ">", "<"))
def range_filter_strict(spark, d):
    return filters.range_strict(S.points(spark, d), 0.1, 0.3).select("vec_id", "p", *rounded())


@query(_range_sql(0.1, 0.3, ">=", "<="))
def range_filter_inclusive(spark, d):
    return filters.range_inclusive(S.points(spark, d), 0.1, 0.3).select("vec_id", "p", *rounded())


@query(f"WITH {PTS} SELECT vec_id, p, {XYZ} FROM (SELECT vec_id, p, x*10 AS x, y*10 AS y, z*10 AS z FROM pts) WHERE {SIZE} > 0.3 AND {SIZE} < 100")
def viewer_range(spark, d):
    ten = S.points(spark, d).select("vec_id", "p", *((F.col(c) * F.lit(10).cast("float")).alias(c) for c in "xyz"))
    return filters.viewer_range(ten).select("vec_id", "p", *rounded())


@query(f"WITH {PTS} SELECT vec_id, p, {XYZ} FROM pts WHERE p % 7 <> 0 AND p % 5 <> 0")
def finite_filter(spark, d):
    broken = S.points(spark, d).withColumn("x", F.when(F.col("p") % 7 == 0, float("nan")).otherwise(F.col("x").cast("double")))
    broken = broken.withColumn("y", F.when(F.col("p") % 5 == 0, float("-inf")).otherwise(F.col("y").cast("double")))
    return filters.keep_finite(broken).select("vec_id", "p", *rounded())


@query(f"WITH {FRAMES}, {ENC} SELECT event_id, t_ns FROM frames WHERE t_ns <= (SELECT max(t_ns) FROM uenc) - 86400000000000")
def trim_end(spark, d):
    return series.trim_end(S.frames(spark, d), "t_ns", S.encoder(spark, d), "t_ns", 86400)


PHASED = FRAME_THETA + f", ph AS (SELECT event_id, CASE WHEN theta % {TP} < 0 THEN theta % {TP} + {TP} ELSE theta % {TP} END AS phase FROM th)"


def _phased(spark, d) -> DataFrame:
    return slicing.with_phase(_theta(spark, d)).select("event_id", "phase")


@query(f"{PHASED} SELECT event_id, {R('phase', 'phase')} FROM ph")
def phase_mod(spark, d):
    return _phased(spark, d).select("event_id", r("phase", "phase"))


@query(f"{PHASED}, df AS (SELECT event_id, phase - pi() / 3 + pi() AS q FROM ph) SELECT event_id, {R(f'CASE WHEN q % {TP} < 0 THEN q % {TP} + {TP} ELSE q % {TP} END - pi()', 'diff')} FROM df")
def circular_difference(spark, d):
    return _phased(spark, d).select("event_id", r(G.circular_difference(F.col("phase"), F.lit(np.pi / 3)), "diff"))


SLICED = f"""{PHASED}, sl AS (SELECT event_id, CAST(s AS INT) AS slice, phase - s * {TP} / 12 + pi() AS q FROM ph, range(12) r(s)),
sd AS (SELECT event_id, slice, abs(CASE WHEN q % {TP} < 0 THEN q % {TP} + {TP} ELSE q % {TP} END - pi()) AS off FROM sl),
wide AS (SELECT event_id, slice, off < {TP} / 24 AS is_core FROM sd WHERE off < {TP} / 12)"""


def _sliced(spark, d) -> DataFrame:
    return slicing.angular_slices(_phased(spark, d)).select("event_id", "slice", "is_core")


@query(f"{SLICED} SELECT event_id, slice FROM wide WHERE is_core")
def angular_slices_core(spark, d):
    return _sliced(spark, d).where("is_core").select("event_id", "slice")


@query(f"{SLICED} SELECT event_id, slice, is_core FROM wide")
def angular_slices_wide(spark, d):
    return _sliced(spark, d)


COUNTS = "SELECT slice, count(*) AS n_wide, count(*) FILTER (is_core) AS n_core FROM wide GROUP BY slice"


@query(f"{SLICED} {COUNTS}")
def slice_counts(spark, d):
    return slicing.slice_counts(_sliced(spark, d))


@query(f"{SLICED} {COUNTS} ORDER BY n_wide DESC, slice LIMIT 1")
def reference_slice(spark, d):
    return slicing.reference_slice(_sliced(spark, d))


VOXEL_KEYS = ", ".join(f"CAST(floor({c} / CAST(0.1 AS FLOAT)) AS BIGINT) AS k{c}" for c in "xyz")


@query(
    f"""WITH {PTS}, c AS (SELECT *, {VOXEL_KEYS} FROM pts), f AS (SELECT *, row_number() OVER (PARTITION BY kx, ky, kz ORDER BY vec_id, p) AS rn FROM c)
SELECT kx, ky, kz, vec_id, p, {XYZ} FROM f WHERE rn = 1"""
)
def voxel_first(spark, d):
    return voxel.voxel_first(S.points(spark, d), 0.1, ["vec_id", "p"]).select("kx", "ky", "kz", "vec_id", "p", *rounded())


def _centroid_sql(source: str, size: float, digits: int = 6) -> str:
    keys = ", ".join(f"CAST(floor((CAST({c} AS DOUBLE) - (l{c} - {size} / 2)) / {size}) AS BIGINT) AS k{c}" for c in "xyz")
    lows = ", ".join(f"min(CAST({c} AS DOUBLE)) AS l{c}" for c in "xyz")
    return f"""lo AS (SELECT {lows} FROM {source}), c AS (SELECT *, {keys} FROM {source} CROSS JOIN lo)
SELECT kx, ky, kz, {", ".join(R(f"avg(CAST({c} AS DOUBLE))", c, digits) for c in "xyz")}, count(*) AS n FROM c GROUP BY kx, ky, kz"""


@query(f"WITH {PTS}, " + _centroid_sql("pts", 0.1))
def voxel_centroid(spark, d):
    return voxel.voxel_centroid(S.points(spark, d), 0.1).select("kx", "ky", "kz", *rounded(), "n")


@query(f"WITH {BIG}, " + _centroid_sql("big", 1.7))
def voxel_centroid_big(spark, d):
    return voxel.voxel_centroid(S.big(spark, d), 1.7).select("kx", "ky", "kz", *rounded(), "n")


MOVED = [0.8, -0.6, 0.0, 0.117, 0.6, 0.8, 0.0, -0.213, 0.0, 0.0, 1.0, 0.317]


@query(f"WITH {PTS}, a AS (SELECT vec_id, p, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(z AS DOUBLE) AS z FROM pts), m AS (SELECT vec_id, p, 0.8*x - 0.6*y + 0.117 AS x, 0.6*x + 0.8*y - 0.213 AS y, z + 0.317 AS z FROM pts), u AS (SELECT x, y, z FROM a UNION ALL SELECT x, y, z FROM m), " + _centroid_sql("u", 0.2, 4))
def merge_clouds(spark, d):
    p = S.points(spark, d)
    m = np.array([*MOVED, 0, 0, 0, 1], float).reshape(4, 4)
    both = p.select(*(F.col(c).cast("double") for c in "xyz")).union(registration.transformed(p, m).select("x", "y", "z"))
    return pipelines.merge_clouds(both, 0.2).select("kx", "ky", "kz", *rounded(digits=4), "n")


STATS = ", ".join(R(f"{f}(CAST({c} AS DOUBLE))", f"{n}_{c}") for f, n in (("min", "min"), ("max", "max"), ("avg", "mean")) for c in "xyz")


@query(f"WITH {PTS} SELECT {STATS}, count(*) AS n FROM pts")
def bounds(spark, d):
    return outliers.bounds(S.points(spark, d)).select(*(r(f"{s}_{c}", f"{s}_{c}") for s in ("min", "max", "mean") for c in "xyz"), "n")


@query(f"WITH {PTS} SELECT label, {', '.join(R(f'avg(CAST({c} AS DOUBLE))', c) for c in 'xyz')}, count(*) AS n FROM pts GROUP BY label")
def centroid(spark, d):
    return S.points(spark, d).groupBy("label").agg(*(r(F.avg(F.col(c).cast("double")), c) for c in "xyz"), F.count("*").alias("n"))


DX, DY, DZ = (f"CAST({c} AS DOUBLE)" for c in "xyz")


@query(f"WITH {PTS} SELECT vec_id, p, {R(f'0.8*{DX} - 0.6*{DY} + 0.117', 'x')}, {R(f'0.6*{DX} + 0.8*{DY} - 0.213', 'y')}, {R(f'{DZ} + 0.317', 'z')} FROM pts")
def rigid_transform(spark, d):
    m = np.array([*MOVED, 0, 0, 0, 1], float).reshape(4, 4)
    return registration.transformed(S.points(spark, d), m).select("vec_id", "p", *rounded())


@query(f"WITH {PTS} SELECT vec_id, p, {R(f'-{DY}', 'x')}, {R(f'-{DZ}', 'y')}, {R(DX, 'z')} FROM pts")
def rotate_scene(spark, d):
    """The scene's start rotation, made of quarter turns."""
    start = np.array([[0, -1, 0], [0, 0, -1], [1, 0, 0]], float)
    x, y, z = G.rotate(G.doubles(G.xyz()), start)
    return S.points(spark, d).select("vec_id", "p", r(x, "x"), r(y, "y"), r(z, "z"))


@query(
    f"WITH {PTS} SELECT vec_id, p, {R(f'{DX} * cos(radians(-90)) - {DY} * sin(radians(-90))', 'fx')}, {R(f'{DX} * sin(radians(-90)) + {DY} * cos(radians(-90))', 'fy')}, {R(DZ, 'fz')}, {R(DX, 'bx')}, {R(DY, 'by')}, {R(DZ, 'bz')} FROM pts"
)
def rotate_scene_back(spark, d):
    """A quarter turn and its inverse, as picks are taken back."""
    turn = G.rotation("z", -np.pi / 2)
    f = G.rotate(G.doubles(G.xyz()), turn)
    b = G.rotate(f, turn.T)
    return S.points(spark, d).select("vec_id", "p", *(r(c, f"f{n}") for c, n in zip(f, "xyz", strict=True)), *(r(c, f"b{n}") for c, n in zip(b, "xyz", strict=True)))


@query(f"WITH {PTS} SELECT vec_id, p, {R(DY, 'fx')}, {R(f'-{DX}', 'fy')}, {R(DZ, 'fz')}, {R(DX, 'bx')}, {R(DY, 'by')}, {R(DZ, 'bz')} FROM pts")
def mount_map(spark, d):
    m = G.axis_matrix(("+y", "-x", "+z"))
    f = G.rotate(G.doubles(G.xyz()), m)
    b = G.rotate(f, m.T)
    return S.points(spark, d).select("vec_id", "p", *(r(c, f"f{n}") for c, n in zip(f, "xyz", strict=True)), *(r(c, f"b{n}") for c, n in zip(b, "xyz", strict=True)))


@query(f"WITH {PTS} SELECT vec_id, p, {R(DX, 'x')}, {R(f'{DY}*cos(p*0.1) - {DZ}*sin(p*0.1)', 'y')}, {R(f'-({DY}*sin(p*0.1) + {DZ}*cos(p*0.1))', 'z')} FROM pts")
def world_rotate(spark, d):
    x, y, z = G.world_rotate_x(G.doubles(G.xyz()), F.col("p") * 0.1)
    return S.points(spark, d).select("vec_id", "p", r(x, "x"), r(y, "y"), r(z, "z"))


@query(
    f"""WITH {PTS}, c AS (SELECT avg({DX}) AS cx, avg({DY}) AS cy, avg({DZ}) AS cz FROM pts)
SELECT vec_id, p, {R(f'cx - ({DY} - cy)', 'x')}, {R(f'cy + ({DX} - cx)', 'y')}, {R(DZ, 'z')} FROM pts, c"""
)
def rotate_about_centroid(spark, d):
    one = S.points(spark, d)
    c = outliers.bounds(one).first()
    m = G.about([c["mean_x"], c["mean_y"], c["mean_z"]], np.array([[0, -1, 0], [1, 0, 0], [0, 0, 1]], float))
    return registration.transformed(one, m).select("vec_id", "p", *rounded())


@query(
    f"""WITH {PTS}, b AS (SELECT min({DZ}) AS lo, max({DZ}) AS hi FROM pts), h AS (SELECT vec_id, p, ({DZ} - lo) / (hi - lo) AS h FROM pts, b)
SELECT vec_id, p, {R('greatest(0, least(1, 4*h - 2))', 'r')}, {R('CASE WHEN h < 0.5 THEN greatest(0, least(1, 4*h)) ELSE greatest(0, least(1, 4 - 4*h)) END', 'g')}, {R('greatest(0, least(1, 2 - 4*h))', 'b')} FROM h"""
)
def height_colors(spark, d):
    return outliers.color_by_height(S.points(spark, d)).select("vec_id", "p", *rounded("rgb"))


@query(
    f"""WITH {PTS}, n AS (SELECT vec_id, p, {SIZE} AS d FROM pts), b AS (SELECT min(d) AS lo, max(d) AS hi FROM n), k AS (SELECT vec_id, p, (d - lo) / (hi - lo) AS k FROM n, b)
SELECT vec_id, p, {R('k', 'r')}, {R('1 - 2*abs(k - 0.5)', 'g')}, {R('1 - k', 'b')} FROM k"""
)
def distance_colors(spark, d):
    return outliers.color_by_distance(S.points(spark, d)).select("vec_id", "p", *rounded("rgb"))


@query(f"WITH {PTS} SELECT vec_id, p, {R('[0.2, 1.0, 0.2, 1.0][label % 4 + 1]', 'r')}, {R('[0.6, 0.4, 1.0, 0.2][label % 4 + 1]', 'g')}, {R('[1.0, 0.2, 0.4, 0.8][label % 4 + 1]', 'b')} FROM pts")
def compare_colors(spark, d):
    return outliers.color_by_cloud(S.points(spark, d), "label").select("vec_id", "p", *rounded("rgb"))


@query(
    """WITH b AS (SELECT event_id * 1000000 AS dev, epoch_us(ts) AS log FROM events), c AS (SELECT CAST(dev - (SELECT min(dev) FROM b) AS DOUBLE) AS d, CAST(log - (SELECT min(log) FROM b) AS DOUBLE) AS l FROM b)
SELECT """
    + f"{R('regr_slope(l, d)', 'slope', 4)}, {R('sqrt((regr_syy(l, d) - regr_slope(l, d) * regr_sxy(l, d)) / count(*)) / 1e6', 'rms_s', 1)}, count(*) AS n FROM c"
)
def clock_regression(spark, d):
    e = S.table(spark, d, "events").select((F.col("event_id") * 1000000).alias("stamp_ns"), F.unix_micros(F.col("ts").cast("timestamp")).alias("log_time_ns"))
    return series.clock_regression(e).select(r("slope", "slope", 4), r(F.col("rms") / 1e6, "rms_s", 1), "n")


FIRST = f"WITH {IMU}, f AS (SELECT * FROM imu ORDER BY t_ns, event_id LIMIT 500)"


@query(f"{FIRST} SELECT event_id, {', '.join(R(f'a{c}', f'a{c}') for c in 'xyz')} FROM f")
def imu_first_samples(spark, d):
    return imu.first_samples(S.imu(spark, d), ("t_ns", "event_id")).select("event_id", *(r(f"a{c}", f"a{c}") for c in "xyz"))


@query(
    f"""{FIRST}, m AS (SELECT avg(ax) AS mx, avg(ay) AS my, avg(az) AS mz, count(*) AS n FROM f), g AS (SELECT *, sqrt(mx*mx + my*my + mz*mz) AS s FROM m)
SELECT {R('mx / s', 'gx')}, {R('my / s', 'gy')}, {R('mz / s', 'gz')}, {R('degrees(acos(greatest(-1, least(1, mx / s))))', 'tilt_deg')}, n FROM g"""
)
def gravity_mean(spark, d):
    out = imu.gravity_mean(imu.first_samples(S.imu(spark, d), ("t_ns", "event_id")))
    return out.select(*(r(f"g{c}", f"g{c}") for c in "xyz"), r("tilt_deg", "tilt_deg"), "n")


PLANE = (0.6, 0.0, 0.8, 0.01)
DIST = f"(0.6*{DX} + 0.8*{DZ} + 0.01)"


@query(f"WITH {PTS} SELECT {R(f'sqrt(avg({DIST} * {DIST}))', 'rms')}, {R(f'quantile_cont(abs({DIST}), 0.95)', 'p95')}, count(*) AS n_pts FROM pts")
def plane_rms_p95(spark, d):
    return planes.plane_residuals(S.points(spark, d), PLANE).select(r("rms", "rms"), r("p95", "p95"), "n_pts")


@query(f"WITH {PTS} SELECT vec_id, p FROM pts WHERE abs({DIST}) < 0.03")
def plane_inliers(spark, d):
    return planes.plane_inliers(S.points(spark, d), PLANE, 0.03).select("vec_id", "p")


@query(f"WITH {PTS} SELECT vec_id, p FROM pts WHERE abs({DIST}) >= 0.03")
def plane_outliers(spark, d):
    return planes.plane_outliers(S.points(spark, d), PLANE, 0.03).select("vec_id", "p")


@query(f"WITH {PTS} SELECT vec_id, p, CASE WHEN abs({DZ}/{SIZE}) > 0.7 THEN 'пол/потолок' WHEN abs({DX}) > abs({DY}) THEN 'стена X' ELSE 'стена Y' END AS type FROM pts")
def plane_type(spark, d):
    p = S.points(spark, d)
    x, y, z = G.doubles(G.xyz())
    return p.select("vec_id", "p", G.plane_type(x, y, z / G.norm((x, y, z))).alias("type"))


def _clouds(spark, d) -> tuple[DataFrame, DataFrame]:
    p = S.points(spark, d).select(F.col("label").alias("cloud"), (F.col("vec_id") * 100 + F.col("p")).alias("id"), *(F.col(c).cast("double") for c in "xyz"))
    return p.where("cloud <> 0").drop("cloud"), p.where("cloud = 0").drop("cloud")


PAIRS = f"""WITH {PTS}, q AS (SELECT label, vec_id * 100 + p AS id, {DX} AS x, {DY} AS y, {DZ} AS z FROM pts),
s AS (SELECT * FROM q WHERE label <> 0), t AS (SELECT * FROM q WHERE label = 0),
pr AS (SELECT s.id AS id, t.id AS t_id, s.x AS sx, s.y AS sy, s.z AS sz, t.x AS tx, t.y AS ty, t.z AS tz, (s.x-t.x)*(s.x-t.x)+(s.y-t.y)*(s.y-t.y)+(s.z-t.z)*(s.z-t.z) AS d2 FROM s, t),
nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, t_id) AS rn FROM pr WHERE d2 <= 0.0025) WHERE rn = 1)"""


@query(f"{PAIRS} SELECT id, t_id, {R('d2', 'd2')} FROM nn")
def nn_within_radius(spark, d):
    s, t = _clouds(spark, d)
    return neighbors.nearest_within(s, t, 0.05, ["id"], ["id"]).select("id", "t_id", r("d2", "d2"))


@query(f"{PAIRS} SELECT {R('count(*) / (SELECT count(*) FROM s)', 'fitness')}, {R('sqrt(avg(d2))', 'inlier_rmse')}, count(*) AS matched, (SELECT count(*) FROM s) AS total FROM nn")
def icp_fitness_rmse(spark, d):
    s, t = _clouds(spark, d)
    out = registration.fitness_rmse(s, neighbors.nearest_within(s, t, 0.05, ["id"], ["id"]))
    return out.select(r("fitness", "fitness"), r("inlier_rmse", "inlier_rmse"), "matched", "total")


@query(f"{PAIRS} SELECT count(*) AS n, {', '.join(R(f'sum({p}{c})', f'{p}{c}') for p in 'st' for c in 'xyz')}, {', '.join(R(f'sum(s{a}*t{b})', a + b) for a in 'xyz' for b in 'xyz')} FROM nn")
def kabsch_covariance(spark, d):
    s, t = _clouds(spark, d)
    out = registration.kabsch_sums(neighbors.nearest_within(s, t, 0.05, ["id"], ["id"]))
    return out.select("n", *(r(f"{p}{c}", f"{p}{c}") for p in "st" for c in "xyz"), *(r(a + b, a + b) for a in "xyz" for b in "xyz"))


_J = ["sy*nz - sz*ny", "sz*nx - sx*nz", "sx*ny - sy*nx", "nx", "ny", "nz"]
_RES = "((sx-tx)*nx + (sy-ty)*ny + (sz-tz)*nz)"


@query(
    f"{PAIRS}, n3 AS (SELECT *, tx/sqrt(tx*tx+ty*ty+tz*tz) AS nx, ty/sqrt(tx*tx+ty*ty+tz*tz) AS ny, tz/sqrt(tx*tx+ty*ty+tz*tz) AS nz FROM nn) SELECT "
    + ", ".join(R(f"sum(({_J[a]})*({_J[b]}))", f"a{a}{b}") for a in range(6) for b in range(a, 6))
    + ", "
    + ", ".join(R(f"sum(({_J[a]})*{_RES})", f"b{a}") for a in range(6))
    + " FROM n3"
)
def icp_normal_equations(spark, d):
    """Normals are the targets' directions here."""
    s, t = _clouds(spark, d)
    size = G.norm(G.xyz())
    t = t.withColumns({f"n{c}": F.col(c) / size for c in "xyz"})
    out = registration.normal_equations(neighbors.nearest_within(s, t, 0.05, ["id"], ["id"], extra=["nx", "ny", "nz"]))
    return out.select(*(r(f"a{a}{b}", f"a{a}{b}") for a in range(6) for b in range(a, 6)), *(r(f"b{a}", f"b{a}") for a in range(6)))


SELF = f"""WITH {PTS}, q AS (SELECT vec_id * 100 + p AS id, {DX} AS x, {DY} AS y, {DZ} AS z, label FROM pts),
pr AS (SELECT a.label AS label, a.id AS id, b.id AS t_id, (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) AS d2 FROM q a JOIN q b ON a.label = b.label)"""


def _all(spark, d) -> DataFrame:
    return S.points(spark, d).select("label", (F.col("vec_id") * 100 + F.col("p")).alias("id"), *(F.col(c).cast("double") for c in "xyz"))


@query(f"{SELF} SELECT id, t_id, CAST(rank AS INT) AS rank, {R('d2', 'd2')} FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, t_id) AS rank FROM pr WHERE d2 <= 0.01) WHERE rank <= 5")
def knn_rank(spark, d):
    return neighbors.knn_within(_all(spark, d), 5, 0.1, ["id"], ["label"]).select("id", "t_id", "rank", r("d2", "d2"))


@query(f"{SELF} SELECT id, t_id, CAST(rank AS INT) AS rank, {R('d2', 'd2')} FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, t_id) AS rank FROM pr) WHERE rank <= 20")
def knn_unbounded(spark, d):
    return neighbors.knn(_all(spark, d), 20, ["id"], by=["label"]).select("id", "t_id", "rank", r("d2", "d2"))


OUTLIERS = SELF + ", md AS (SELECT label, id, avg(sqrt(d2)) AS m FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, t_id) AS rank FROM pr) WHERE rank <= 20 GROUP BY label, id), st AS (SELECT label, avg(m) AS mean, stddev_samp(m) AS std, count(*) AS n FROM md WHERE m > 0 GROUP BY label)"


@query(f"{OUTLIERS} SELECT label, {R('mean', 'mean')}, {R('std', 'std')}, n, {R('mean + 2*std', 'threshold')} FROM st")
def outlier_stats(spark, d):
    out = outliers.outlier_stats(outliers.neighbor_distances(_all(spark, d), ["id"], by=["label"]), by=["label"])
    return out.select("label", r("mean", "mean"), r("std", "std"), "n", r("threshold", "threshold"))


@query(f"{OUTLIERS} SELECT id, {XYZ} FROM q WHERE id IN (SELECT id FROM md JOIN st USING (label) WHERE m > 0 AND m < mean + 2*std)")
def outlier_filter(spark, d):
    return outliers.remove_outliers(_all(spark, d), ["id"], by=["label"]).select("id", *rounded())


RAY = f"WITH {PTS}, q AS (SELECT vec_id, p, ({DX} - 0.05) AS a, ({DY} + 0.02) AS b, ({DZ} - 0.01) AS c FROM pts), r AS (SELECT vec_id, p, a*0.6 + c*0.8 AS along, sqrt((b*0.8)*(b*0.8) + (c*0.6 - a*0.8)*(c*0.6 - a*0.8) + (b*0.6)*(b*0.6)) AS distance FROM q)"


@query(f"{RAY} SELECT vec_id, p, {R('along', 'along')}, {R('distance', 'distance')} FROM (SELECT * FROM r WHERE along > 0 ORDER BY distance, vec_id, p LIMIT 1) WHERE distance <= 0.5")
def ray_pick(spark, d):
    out = outliers.pick_nearest_to_ray(S.points(spark, d), (0.05, -0.02, 0.01), (3, 0, 4), 0.5, ["vec_id", "p"])
    return out.select("vec_id", "p", r("along", "along"), r("distance", "distance"))


@query(f"WITH {PTS}, k AS (SELECT vec_id % 2 AS cloud, vec_id // 2 * 100 + p AS pair_idx, {DX} AS x, {DY} AS y, {DZ} AS z FROM pts) SELECT a.pair_idx, {R('a.x', 's_x')}, {R('b.x', 't_x')}, {R('a.z', 's_z')}, {R('b.z', 't_z')} FROM k a JOIN k b ON a.cloud = 0 AND b.cloud = 1 AND a.pair_idx = b.pair_idx")
def pick_pairs(spark, d):
    p = S.points(spark, d)
    picks = p.select((F.col("vec_id") % 2).alias("cloud"), (F.floor(F.col("vec_id") / 2) * 100 + F.col("p")).alias("pair_idx"), "x", "y", "z")
    return registration.pick_pairs(picks).select("pair_idx", r("s_x", "s_x"), r("t_x", "t_x"), r("s_z", "s_z"), r("t_z", "t_z"))


@query(f"WITH {PTS} SELECT vec_id, p, {R(SIZE, 'density')} FROM pts WHERE {SIZE} >= (SELECT quantile_cont({SIZE}, 0.10) FROM pts)")
def density_cut(spark, d):
    p = S.points(spark, d).withColumn("density", G.norm(G.doubles(G.xyz())))
    return filters.density_cut(p).select("vec_id", "p", r("density", "density"))


@query(f"WITH {PTS} SELECT vec_id, p, {R('degrees(acos(greatest(-1, least(1, (cos(p*0.2)*2 + 1 - 1) / 2))))', 'angle_deg')}, {R(SIZE, 'shift')} FROM pts")
def transform_angle(spark, d):
    a = F.col("p") * 0.2
    o, i = F.lit(0.0), F.lit(1.0)
    m = F.array(F.cos(a), -F.sin(a), o, F.col("x").cast("double"), F.sin(a), F.cos(a), o, F.col("y").cast("double"), o, o, i, F.col("z").cast("double"), o, o, o, i)
    t = tuple(F.col("m")[k] for k in (3, 7, 11))
    return S.points(spark, d).withColumn("m", m).select("vec_id", "p", r(G.rotation_angle_deg(F.col("m")), "angle_deg"), r(G.norm(t), "shift"))


@query(f"WITH {PTS}, v AS (SELECT label, sqrt(avg({DX}*{DX}))*200 AS v FROM pts GROUP BY label) SELECT label, {R('v', 'rms_mm')}, CASE WHEN v < 20 THEN 'good' WHEN v < 40 THEN 'acceptable' ELSE 'poor' END AS planes, CASE WHEN v < 30 THEN 'good' WHEN v < 60 THEN 'acceptable' ELSE 'poor' END AS icp FROM v")
def quality_verdict(spark, d):
    x = F.col("x").cast("double")
    v = S.points(spark, d).groupBy("label").agg((F.sqrt(F.avg(x * x)) * 200).alias("v"))
    return v.select("label", r("v", "rms_mm"), G.verdict(F.col("v"), 20, 40).alias("planes"), G.verdict(F.col("v"), 30, 60).alias("icp"))


@query(f"WITH {PTS}, v AS (SELECT label, CASE WHEN label = 0 THEN 0 ELSE sqrt(avg({DX}*{DX})) END AS rmse FROM pts GROUP BY label) SELECT {R('avg(rmse)', 'mean')}, {R('min(rmse)', 'low')}, {R('max(rmse)', 'high')}, count(*) AS n FROM v WHERE rmse > 0")
def rms_summary(spark, d):
    x = F.col("x").cast("double")
    v = S.points(spark, d).groupBy("label").agg(F.when(F.col("label") == 0, 0.0).otherwise(F.sqrt(F.avg(x * x))).alias("rmse"))
    return v.where("rmse > 0").agg(r(F.avg("rmse"), "mean"), r(F.min("rmse"), "low"), r(F.max("rmse"), "high"), F.count("*").alias("n"))


@query(
    f"WITH {PTS} SELECT label AS slice, vec_id, p, {R(f'{DX}*cos(label*0.1) - {DY}*sin(label*0.1) + label', 'x')}, {R(f'{DX}*sin(label*0.1) + {DY}*cos(label*0.1)', 'y')}, {R(f'{DZ} - 1', 'z')} FROM pts WHERE label <> 4"
)
def merge_slices(spark, d):
    table = registration.transforms_table(spark, {k: G.rigid(G.rotation("z", k * 0.1), (k, 0, -1)) for k in range(10) if k != 4})
    out = slicing.merge_slices(S.points(spark, d).withColumnRenamed("label", "slice"), table)
    return out.select("slice", "vec_id", "p", *rounded())


@query(f"WITH {PTS} SELECT vec_id, p, printf('%.4f %.4f %.4f', {DX}, {DY}, {DZ}) AS line FROM pts")
def xyz_lines(spark, d):
    from pointloom.sources.text_formats import format_xyz

    return S.points(spark, d).select("vec_id", "p", format_xyz("x", "y", "z").alias("line"))


@query()
def icp_align(spark, d):
    """A cloud against itself moved by a known motion."""
    p = _all(spark, d)
    moved = registration.transformed(p, G.rigid(G.rotation("z", 0.01), (0.005, -0.005, 0.002)))
    m, fitness, rmse = registration.icp(p, moved, 0.03, ["id"], iterations=10)
    return spark.createDataFrame([(fitness, rmse, m.ravel().tolist())], "fitness double, inlier_rmse double, transformation array<double>")


@query()
def icp_slices(spark, d):
    """All labels against label 0 at once. They are different clouds, which need not settle: 15 rounds a stage at most."""
    clouds = S.points(spark, d).select(F.col("label").alias("slice"), "x", "y", "z")
    labels = [x[0] for x in clouds.select("slice").distinct().orderBy("slice").collect()]  # a row per slice
    found = registration.pairwise_icp(clouds, [(k, labels[0], np.eye(4)) for k in labels[1:]], cfg=IcpConfig(coarse_iterations=15, fine_iterations=15))
    return spark.createDataFrame([(labels[k + 1], f, e, m.ravel().tolist()) for k, (m, f, e) in found.items()], "slice int, fitness double, inlier_rmse double, transformation array<double>")


@query()
def ransac_plane(spark, d):
    return planes.find_planes(S.points(spark, d), PlaneConfig(min_points=500))


_FLAT = {"z": ("l_quantity + 10", "l_extendedprice / 1000 + 10", "0.0"), "x": ("-5.0", "l_extendedprice / 1000 + 10", "l_quantity + 1"), "y": ("l_quantity + 10", "-7.0", "l_extendedprice / 1000 + 1")}
#: Half of the rows lie on the floor, a quarter on each of two walls; each plane is far from the points of the others.
_FLAT_ROWS = {"z": "l_orderkey % 4 < 2", "x": "l_orderkey % 4 = 2", "y": "l_orderkey % 4 = 3"}
_FLAT_CASE = [f"CAST(CASE {' '.join(f'WHEN {_FLAT_ROWS[k]} THEN {_FLAT[k][i]}' for k in _FLAT)} END AS DOUBLE)" for i in range(3)]


@query(
    f"""WITH f AS (SELECT l_linestatus AS cloud, l_orderkey % 4 AS part, {', '.join(f'{e} AS {c}' for e, c in zip(_FLAT_CASE, 'xyz', strict=True))} FROM lineitem),
lo AS (SELECT cloud, min(x) AS lx, min(y) AS ly, min(z) AS lz FROM f GROUP BY cloud),
cells AS (SELECT DISTINCT cloud, greatest(part, 1) AS part, {', '.join(f'CAST(floor(({c} - (l{c} - 0.005 / 2)) / 0.005) AS BIGINT) AS k{c}' for c in 'xyz')} FROM f JOIN lo USING (cloud))
SELECT cloud, CASE part WHEN 1 THEN 'пол/потолок' WHEN 2 THEN 'стена X' ELSE 'стена Y' END AS type, {R('0', 'rms')}, {R('0', 'p95')}, count(*) AS n_pts FROM cells GROUP BY cloud, part HAVING count(*) >= 5000"""
)
def plane_report(spark, d):
    """Three planes in each of two clouds, found with the default number of candidates and points."""
    p = S.table(spark, d, "lineitem").selectExpr("l_linestatus AS cloud", *(f"{e} AS {c}" for e, c in zip(_FLAT_CASE, "xyz", strict=True)))
    found = planes.find_planes(p, PlaneConfig(), "cloud")
    return found.select("cloud", "type", r("rms", "rms"), r("p95", "p95"), "n_pts")


@query()
def normals(spark, d):
    from pointloom.operators.neighbors import estimate_normals

    return estimate_normals(_all(spark, d), ("id",), 0.05)


def _entries(spark, found: dict[int, np.ndarray], name: str = "cloud") -> DataFrame:
    """Transforms as rows of their first three rows' entries."""
    rows = [(k, i, j, float(m[i, j])) for k, m in found.items() for i in range(3) for j in range(4)]
    return spark.createDataFrame(rows, f"{name} int, i int, j int, v double").select(name, "i", "j", r("v", "value"))


def _known(name: str, cloud: str, entries: dict[tuple[int, int], str], rest: str = "") -> str:
    """SQL of a transform known by construction; entries that aren't given are those of the identity."""
    each = (f"SELECT CAST({cloud} AS INT) AS {name}, CAST({i} AS INT) AS i, CAST({j} AS INT) AS j, {R(entries.get((i, j), '1.0' if i == j else '0.0'), 'value')} {rest}" for i in range(3) for j in range(4))
    return " UNION ALL ".join(each)


@query(_known("cloud", "0", {(1, 1): "cos(0.3)", (1, 2): "-sin(0.3)", (2, 1): "sin(0.3)", (2, 2): "cos(0.3)", (0, 3): "1.0", (1, 3): "2.0", (2, 3): "3.0"}))
def kabsch_fit(spark, d):
    """A cloud fitted to itself moved by a known motion."""
    p = _all(spark, d)
    m = registration.kabsch(p.select("id", *(F.col(c).alias(f"s_{c}") for c in "xyz")).join(registration.transformed(p, G.rigid(G.rotation("x", 0.3), (1, 2, 3))).select("id", *(F.col(c).alias(f"t_{c}") for c in "xyz")), "id"))
    return _entries(spark, {0: m})


def _sparse(spark, d) -> DataFrame:
    """One point a vector, ten times the size, so that points lie far apart against what they are moved by."""
    return S.points(spark, d).where("p = 0 AND label < 3").select("vec_id", *((F.col(c).cast("double") * 10).alias(c) for c in "xyz"))


@query(_known("cloud", "0", {(0, 0): "cos(1.2)", (0, 1): "-sin(1.2)", (1, 0): "sin(1.2)", (1, 1): "cos(1.2)", (0, 3): "4.0", (1, 3): "-5.0", (2, 3): "0.5"}))
def pick_align(spark, d):
    """Picked pairs bring a cloud far off near another, and ICP goes on from there."""
    p = _sparse(spark, d)
    clouds = p.withColumn("cloud", F.lit(0)).union(registration.transformed(p, G.rigid(G.rotation("z", 1.2), (4, -5, 0.5))).withColumn("cloud", F.lit(1)))
    few = p.orderBy("vec_id").limit(6).select("vec_id")
    picks = clouds.join(F.broadcast(few), "vec_id").select("cloud", F.col("vec_id").alias("pair_idx"), "x", "y", "z")  # six rows
    return _entries(spark, {0: registration.align_by_pairs(clouds, picks, 0, 1, voxel=0.01)})


@query(_known("slice", "s", {(0, 0): "cos(0.002 * s)", (0, 1): "-sin(0.002 * s)", (1, 0): "sin(0.002 * s)", (1, 1): "cos(0.002 * s)", (0, 3): "0.01 * s"}, "FROM range(4) k(s)"))
def slice_chain(spark, d):
    """Four slices of one cloud, each moved by a known motion; the last shares too little with the reference
    and is chained again from its neighbour."""
    p, m = _sparse(spark, d), F.pmod(F.xxhash64("vec_id"), F.lit(100))
    sliced = None
    for s in range(4):
        low, high = ((0, 70), (20, 65), (45, 90), (66, 100))[s]
        own = p.where((m >= low) & (m < high))
        back = np.linalg.inv(G.rigid(G.rotation("z", 0.002 * s), (0.01 * s, 0, 0)))
        own = registration.transformed(own, back).withColumn("slice", F.lit(s))
        sliced = own if sliced is None else sliced.union(own)
    found, _ = registration.align_slices(materialize(sliced, "slices"), SliceConfig(), IcpConfig(voxel=0.02))
    return _entries(spark, found, "slice")


@query(f"SELECT 'b' AS source, 'a' AS target, {R('1.0', 'fitness')}, {R('0.0', 'inlier_rmse')}, {R('-0.01', 'dz')}, 'good' AS verdict")
def repeatability(spark, d):
    """A cloud against itself moved along an axis."""
    p = _sparse(spark, d)
    clouds = p.withColumn("cloud", F.lit("a")).union(p.withColumn("z", F.col("z") + 0.01).withColumn("cloud", F.lit("b")))
    _, table = pipelines.evaluate(materialize(clouds, "clouds"), PlaneConfig(min_points=10**9))
    return table.select("source", "target", r("fitness", "fitness"), r("inlier_rmse", "inlier_rmse"), r(F.col("transformation")[11], "dz"), "verdict")


SCENE_VOXEL = 0.25
#: The motion of slice s: a turn about z and a shift, so small against the points' distances that neighbours stay so.
_TURN, _SHIFT = 2e-5, (2e-4, -1e-4, 1e-4)


def _slice_motion(s: int) -> np.ndarray:
    return G.rigid(G.rotation("z", _TURN * s), [v * s for v in _SHIFT])


def _seen_scene(spark, d, lost: tuple[int, ...] = ()) -> DataFrame:
    """Raw scans of a turning sensor that sees one scene, as if each angular slice had moved by its motion.

    A frame has the points of one vector, ten times the size; those of slices in ``lost`` are far off.
    """
    frames = slicing.with_phase(_theta(spark, d))
    scene = min(S.table(spark, d, "embeddings").count(), S.frames(spark, d).count() // 16)
    seen = slicing.angular_slices(frames, 12, 1.0).where("is_core").select("event_id", "t_ns", "theta", "slice", (F.col("event_id") % scene).alias("vec_id"))
    p = seen.join(S.points(spark, d), "vec_id")
    back = F.array(*(F.array(*(F.lit(float(v)) for v in np.linalg.inv(_slice_motion(s)).ravel())) for s in range(12)))
    far = F.when(F.col("slice").isin(*lost), 50.0).otherwise(0.0) if lost else F.lit(0.0)
    x, y, z = G.apply_rigid_column(tuple((F.col(c).cast("double") * 10) for c in "xyz"), back[F.col("slice")])
    if lost:  # they have the points that they would have in place, so that the reference is the same slice
        p = filters.range_strict(p.withColumns(dict(zip("xyz", (x, y, z), strict=True))))
        x, y, z = G.xyz()
    x = x + far
    turned = (x, y * F.cos("theta") - z * F.sin("theta"), y * F.sin("theta") + z * F.cos("theta"))
    return p.select(F.col("event_id").alias("frame_id"), F.col("p").alias("pt_idx"), F.col("t_ns").alias("stamp_ns"), *(c.alias(n) for c, n in zip(turned, "xyz", strict=True)))


_PLAIN_MOUNT = DeskewConfig(rotation_center=(0.0, 0.0, 0.0), mount_rpy_deg=(0.0, 0.0, 0.0))
_a, _t = f"({_TURN} * {{0}})", [f"({v} * {{0}})" for v in _SHIFT]
_BACK = [
    f"cos({_a}) * ({{1}} - {_t[0]}) + sin({_a}) * ({{2}} - {_t[1]})",
    f"cos({_a}) * ({{2}} - {_t[1]}) - sin({_a}) * ({{1}} - {_t[0]})",
    f"{{3}} - {_t[2]}",
]
_FORTH = [f"cos({_a}) * {{1}} - sin({_a}) * {{2}} + {_t[0]}", f"sin({_a}) * {{1}} + cos({_a}) * {{2}} + {_t[1]}", f"{{3}} + {_t[2]}"]
SCENE = f"""{SLICED}, {PTS}, n AS (SELECT least((SELECT count(*) FROM embeddings), (SELECT count(*) FROM frames) // 16) AS scene),
core AS (SELECT event_id, slice, event_id % scene AS vec_id FROM sd, n WHERE off < {TP} / 24),
whole AS (SELECT slice, {', '.join(f'CAST({c} AS DOUBLE) * 10 AS {c}' for c in 'xyz')} FROM core JOIN pts USING (vec_id)),
moved AS (SELECT slice, {', '.join(f'CAST({e.format("slice", "x", "y", "z")} AS FLOAT) AS {c}' for e, c in zip(_BACK, 'xyz', strict=True))} FROM whole),
near AS (SELECT * FROM moved WHERE {SIZE} > 0.5 AND {SIZE} < 80),
ref AS (SELECT slice AS ref FROM near GROUP BY slice ORDER BY count(*) DESC, slice LIMIT 1),
true_ AS (SELECT slice, ref, {', '.join(f'{e.format("slice", DX, DY, DZ)} AS {c}' for e, c in zip(_FORTH, 'xyz', strict=True))} FROM near, ref),
merged AS (SELECT slice, {', '.join(f'{e.format("ref", "x", "y", "z")} AS {c}' for e, c in zip(_BACK, 'xyz', strict=True))} FROM true_)"""


@query(f"{SCENE}, " + _centroid_sql("merged", SCENE_VOXEL, 4))
def slice_and_merge(spark, d):
    """From raw scans and encoder to one cloud: slices are aligned by all their points, and their motion undone."""
    cfg = SliceConfig(overlap=1.0, map_voxel=SCENE_VOXEL)
    merged, _, _ = pipelines.slice_and_merge(_seen_scene(spark, d), S.encoder(spark, d), cfg, IcpConfig(voxel=0.001), _PLAIN_MOUNT, ties=["event_id"])
    return merged.select("kx", "ky", "kz", *rounded(digits=4), "n")


@query(
    f"""{SCENE}, good AS (SELECT slice, slice NOT IN (3, 7) AS kept, count(*) AS n FROM near GROUP BY slice)
SELECT CAST(g.slice AS INT) AS slice, kept, CASE WHEN kept THEN n ELSE 0 END AS n, {', '.join(f"CASE WHEN kept THEN {R(f'sum(m.{c}) / n', c, 4).removesuffix(f' AS {c}')} END AS {c}" for c in 'xyz')}
FROM good g JOIN merged m USING (slice) GROUP BY g.slice, kept, n"""
)
def slice_direct(spark, d):
    """Slices aligned to the reference alone; two that are far off are rejected and not in the result."""
    points = _seen_scene(spark, d, lost=(3, 7))
    cfg = SliceConfig(overlap=1.0, chain=False)
    sliced = pipelines.sliced(points, S.encoder(spark, d), cfg, _PLAIN_MOUNT, ties=["event_id"])
    found, rejected = registration.align_slices(sliced, cfg, IcpConfig(voxel=0.001))
    merged = slicing.merge_slices(pipelines.narrowed(sliced.where("is_core")), registration.transforms_table(spark, found))
    rows = merged.groupBy("slice").agg(F.count("*").alias("n"), *(r(F.avg(c), c, 4) for c in "xyz"))
    every = spark.createDataFrame([(int(s), s not in rejected) for s in sorted({*found, *rejected})], "slice int, kept boolean")
    return every.join(rows, "slice", "left").select("slice", "kept", F.coalesce("n", F.lit(0)).alias("n"), "x", "y", "z")


def _written(spark, points: DataFrame, fmt: str) -> DataFrame:
    from pointloom.functions.storage import shared_path
    from pointloom.sources.points import read_points, write_points

    return read_points(spark, write_points(points, f"{shared_path(spark, 'cloud')}.{fmt}", fmt))


FORMATS = {"e57": "{}", "ply": "{}", "pcd": "CAST({} AS FLOAT)", "xyz": "CAST(printf('%.4f', {}) AS DOUBLE)", "pts": "CAST(printf('%.4f', {}) AS DOUBLE)"}


@query(
    f"WITH {PTS} "
    + " UNION ALL ".join(f"SELECT '{f}' AS format, {', '.join(R(e.format(c), n) for c, n in zip((DX, DY, DZ), 'xyz', strict=True))} FROM pts" for f, e in FORMATS.items())
    + f" UNION ALL SELECT 'npz', {', '.join(R(c, n) for c, n in zip((DX, DY, DZ), 'xyz', strict=True))} FROM pts WHERE {SIZE} > 0.3 AND {SIZE} < 100"
)
def file_round_trips(spark, d):
    """A cloud written to and read from each format; archives give points between their ranges only."""
    p, out = S.points(spark, d), None
    for fmt in (*FORMATS, "npz"):
        one = _written(spark, p, fmt).select(F.lit(fmt).alias("format"), *rounded())
        out = one if out is None else out.union(one)
    return out


@query(
    f"WITH {PTS}, m AS (SELECT avg({DX}) AS mx, avg({DY}) AS my, avg({DZ}) AS mz FROM pts) SELECT "
    + ", ".join(R(f"round(({c} - m{n}) / 0.001) * 0.001 + m{n}", n, 5) for c, n in zip((DX, DY, DZ), "xyz", strict=True))
    + " FROM pts, m"
)
def las_round_trip(spark, d):
    return _written(spark, S.points(spark, d), "las").select(*rounded(digits=5))


@query(f"WITH {SCAN} SELECT stamp_ns, pt_idx, {R('CAST(x AS FLOAT)', 'x', 5)}, {R('CAST(y AS FLOAT)', 'y', 5)}, {R('CAST(z AS FLOAT)', 'z', 5)} FROM scan")
def frame_archive(spark, d):
    """Frames, stamps and encoder written to an archive and read from it."""
    from pointloom.functions.storage import shared_path
    from pointloom.sources.points import read_frames, write_frames

    path = write_frames(S.scan(spark, d), _series(spark, d), f"{shared_path(spark, 'frames')}.npz")
    points, _ = read_frames(spark, path)
    return points.select("stamp_ns", F.col("pt_idx").cast("int").alias("pt_idx"), *rounded(digits=5))


@query()
def sample_points(spark, d):
    return outliers.sample_points(S.points(spark, d), 1000, 7)


@query()
def mesh(spark, d):
    """Vertices and triangles, told apart by ``part``."""
    from pointloom.operators.mesh import build_mesh

    vertices, triangles = (x.withColumn("part", F.lit(n)) for x, n in zip(build_mesh(S.points(spark, d), radius=0.05), ("vertex", "triangle"), strict=True))
    return vertices.unionByName(triangles, allowMissingColumns=True)

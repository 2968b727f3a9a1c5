"""Geometry as Column expressions, and the small matrices that parametrise them."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Point = tuple[Column, Column, Column]
TWO_PI = 2 * math.pi


def xyz(prefix: str = "") -> Point:
    return F.col(f"{prefix}x"), F.col(f"{prefix}y"), F.col(f"{prefix}z")


def doubles(p: Point) -> Point:
    return tuple(c.cast("double") for c in p)  # type: ignore[return-value]


def rotation(axis: str, angle: float) -> np.ndarray:
    """Elementary rotation by ``angle`` radians about x, y or z."""
    i = "xyz".index(axis)
    j, k = (i + 1) % 3, (i + 2) % 3
    out = np.eye(3)
    out[j, j] = out[k, k] = math.cos(angle)
    out[k, j], out[j, k] = math.sin(angle), -math.sin(angle)
    return out


def euler_zyx(rpy_deg: Sequence[float]) -> np.ndarray:
    """Yaw about z after pitch about y after roll about x, in degrees."""
    roll, pitch, yaw = (math.radians(a) for a in rpy_deg)
    return rotation("z", yaw) @ rotation("y", pitch) @ rotation("x", roll)


def axis_angle(axis: Sequence[float], angle: float) -> np.ndarray:
    """Rotation about any axis."""
    a = np.asarray(axis, float) / np.linalg.norm(axis)
    cross = np.array([[0, -a[2], a[1]], [a[2], 0, -a[0]], [-a[1], a[0], 0]])
    return math.cos(angle) * np.eye(3) + math.sin(angle) * cross + (1 - math.cos(angle)) * np.outer(a, a)


def axis_matrix(axes: Sequence[str]) -> np.ndarray:
    """Signed permutation for names like '+x', '-y': row i picks the named input axis."""
    out = np.zeros((3, 3))
    for i, name in enumerate(axes):
        name = name.strip().lower()
        sign = -1.0 if name.startswith("-") else 1.0
        out[i, "xyz".index(name.lstrip("+-"))] = sign
    if (np.abs(out).sum(0) != 1).any():
        raise ValueError(f"axes {tuple(axes)} do not name each of x, y, z once")
    return out


def rigid(r: np.ndarray, t: Sequence[float] = (0.0, 0.0, 0.0)) -> np.ndarray:
    out = np.eye(4)
    out[:3, :3], out[:3, 3] = r, t
    return out


def rotate(p: Point, r: np.ndarray) -> Point:
    """``r @ p``; terms with a zero factor are left out of the expression."""

    def row(weights) -> Column:
        terms = [c if w == 1 else -c if w == -1 else c * float(w) for c, w in zip(p, weights, strict=True) if w != 0]
        out = terms[0] if terms else F.lit(0.0)
        for term in terms[1:]:
            out = out + term
        return out

    return tuple(row(r[i]) for i in range(3))  # type: ignore[return-value]


def translate(p: Point, t: Sequence[float]) -> Point:
    return tuple(c if v == 0 else c + float(v) for c, v in zip(p, t, strict=True))  # type: ignore[return-value]


def apply_rigid(p: Point, m: np.ndarray) -> Point:
    return translate(rotate(p, m[:3, :3]), m[:3, 3])


def apply_rigid_column(p: Point, m: Column) -> Point:
    """A rigid transform given as an array column of 16 numbers, row by row."""
    return tuple(m[4 * i] * p[0] + m[4 * i + 1] * p[1] + m[4 * i + 2] * p[2] + m[4 * i + 3] for i in range(3))  # type: ignore[return-value]


def about(center: Sequence[float], r: np.ndarray) -> np.ndarray:
    """Rotation about a point, as a rigid transform."""
    c = np.asarray(center, float)
    return rigid(r, c - r @ c)


def moved_in_view(m: np.ndarray, right: Sequence[float], forward: Sequence[float], dx: float, dy: float, speed: float, scene: np.ndarray | None = None) -> np.ndarray:
    """``m`` followed by a shift in the view plane, as a drag by (dx, dy) pixels at a hundredth of the speed each.

    Directions are the camera's; ``scene`` is the rotation it sees the cloud under.
    """
    up = np.cross(forward, right)
    plane = np.stack([-np.asarray(right, float), up / np.linalg.norm(up)])
    shift = 0.01 * speed * np.array([dx, dy]) @ plane
    return rigid(np.eye(3), shift if scene is None else scene.T @ shift) @ m


def pushed(m: np.ndarray, forward: Sequence[float], speed: float, away: bool = True, scene: np.ndarray | None = None) -> np.ndarray:
    """``m`` followed by a step of half the speed along the view, away from the camera or towards it."""
    shift = np.asarray(forward, float) * speed * (0.5 if away else -0.5)
    return rigid(np.eye(3), shift if scene is None else scene.T @ shift) @ m


def turned_in_view(m: np.ndarray, centroid: Sequence[float], right: Sequence[float], yaw: float, pitch: float, scene: np.ndarray | None = None) -> np.ndarray:
    """``m`` followed by yaw about the vertical and pitch about the camera's right, both through the moved centroid."""
    back = np.eye(3) if scene is None else scene.T
    r = axis_angle(back @ np.asarray(right, float), pitch) @ axis_angle(back @ np.array([0.0, 0.0, 1.0]), yaw)
    return about(m[:3, :3] @ np.asarray(centroid, float) + m[:3, 3], r) @ m


def turn(p: Point, axis: str, angle: Column) -> Point:
    """Rotate each point by its own angle; any axis but 'x' and 'y' is z."""
    c, s = F.cos(angle), F.sin(angle)
    x, y, z = p
    if axis == "x":
        return x, y * c - z * s, y * s + z * c
    if axis == "y":
        return x * c + z * s, y, z * c - x * s
    return x * c - y * s, x * s + y * c, z


def world_rotate_x(p: Point, angle: Column) -> Point:
    """Rotation about x with z mirrored."""
    x, y, z = turn(p, "x", angle)
    return x, y, -z


def norm(p: Point) -> Column:
    return F.sqrt(p[0] * p[0] + p[1] * p[1] + p[2] * p[2])


def finite(*cols: Column) -> Column:
    """Neither NaN nor infinite; comparisons alone would let NaN pass, which is above all numbers here."""
    out = F.lit(True)
    for c in cols:
        out = out & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return out


def phase(angle: Column) -> Column:
    """The angle in [0, 2 pi)."""
    return F.pmod(angle, F.lit(TWO_PI))


def circular_difference(a: Column, b: Column) -> Column:
    """a - b in [-pi, pi)."""
    return F.pmod(a - b + math.pi, F.lit(TWO_PI)) - math.pi


def rotation_angle_deg(m: Column) -> Column:
    """Rotation angle of a transform column."""
    cosine = (m[0] + m[5] + m[10] - 1) / 2
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))


def _clip01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def height_ramp(z: Column, low: Column, high: Column) -> Point:
    """Blue over green to red by height; grey where there is no extent."""
    h = (z - low) / (high - low)
    flat = high - low < 1e-6
    r, b = _clip01(4 * h - 2), _clip01(2 - 4 * h)
    g = F.when(h < 0.5, _clip01(4 * h)).otherwise(_clip01(4 - 4 * h))
    return tuple(F.when(flat, 0.5).otherwise(c) for c in (r, g, b))  # type: ignore[return-value]


def distance_ramp(d: Column, low: Column, high: Column) -> Point:
    """Blue to red by distance, green between."""
    k = (d - low) / (high - low)
    flat = high - low < 1e-6
    return tuple(F.when(flat, 0.5).otherwise(c) for c in (k, 1 - 2 * F.abs(k - 0.5), 1 - k))  # type: ignore[return-value]


#: Fixed colours of clouds shown together, and the grey of one shown white.
PALETTE = ((0.2, 0.6, 1.0), (1.0, 0.4, 0.2), (0.2, 1.0, 0.4), (1.0, 0.2, 0.8))
WHITE = 0.85


def compare_color(cloud: Column) -> Point:
    """The palette's colour for a cloud number."""
    at = F.pmod(cloud, F.lit(len(PALETTE))).cast("int")
    return tuple(F.array(*(F.lit(c[i]) for c in PALETTE))[at] for i in range(3))  # type: ignore[return-value]


#: Fixed names of plane types.
FLOOR, WALL_X, WALL_Y = "пол/потолок", "стена X", "стена Y"


def plane_type(nx: Column, ny: Column, nz: Column) -> Column:
    return F.when(F.abs(nz) > 0.7, FLOOR).when(F.abs(nx) > F.abs(ny), WALL_X).otherwise(WALL_Y)


def verdict(value_mm: Column, good: float, acceptable: float) -> Column:
    return F.when(value_mm < good, "good").when(value_mm < acceptable, "acceptable").otherwise("poor")
